"""Near-duplicate groups by SuperMinHash, banding, full-set checks and union-find.

1. Every text becomes its set of distinct word shingles (64-bit hashes) in one
   Arrow pass; equal sets collapse to one representative, so copies of any
   number cost one row each and never meet as pairs.
2. A SuperMinHash signature of each representative is cut into bands. In a
   bucket every member is tied to the smallest one only: linear in its size.
   With the default bands a pair at the threshold escapes all buckets with
   probability about 1e-5.
3. These ties are checked on full sets before anything is joined by them, and
   the confirmed ones give first components.
4. Only buckets whose members are still of several components are looked into:
   the smallest member's component against the others, and the others among
   themselves, in blocks of bounded size, each pair in the first band that it
   shares. Buckets of equal members are one.
5. Components of these links, between first components, give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthant.llm.kernels import U64, mix, shingles, slices, span_hashes, text_buffers, word_spans
from orthant.operators.graph import connected_components
from orthant.storage import materialize

_UNSET = U64(0xFFFFFFFFFFFFFFFF)
_DIGESTS = (0x51ED270B, 0x2545F491)
#: Bytes of text that a worker hashes at a time; what it holds for them is some twenty times as much.
_RUN = 1_500_000


def superminhash(elements: np.ndarray, ptr: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash signatures (Ertl, 2017) of many sets at once.

    ``elements`` holds the hashes of set after set, ``ptr`` their offsets. All
    elements take step j of their own Fisher-Yates shuffle together; the step
    writes (j, random fraction) to one component, and a set stops once each
    component is filled, as later steps can only be larger. Empty sets keep
    the unset value everywhere.
    """
    n = len(ptr) - 1
    out = np.full((n, size), _UNSET, U64)
    counts = np.diff(ptr)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ptr, ptr[first] + 32768, "right")) - 1)
        own = out[first:last]
        hashes = elements[ptr[first] : ptr[last]]
        row = np.repeat(np.arange(last - first), counts[first:last])
        order = None
        for j in range(size):
            with np.errstate(over="ignore"):
                draw = mix(hashes + U64(2 * j + 1) * U64(0xD1342543DE82EF95))
            k = (j + (((draw & U64(0xFFFFFFFF)) * U64(size - j)) >> U64(32))).astype(np.int64)
            if order is None:
                part, swap = k, k
            else:
                each = np.arange(len(k))
                part = order[each, k].astype(np.int64)
                order[each, k] = order[:, j]
                order[:, j] = part
            np.minimum.at(own.reshape(-1), row * size + part, (U64(j) << U64(32)) | (draw >> U64(32)))
            open_rows = (own == _UNSET).any(axis=1) & (counts[first:last] > 0)
            if not open_rows.any():
                break
            stay = open_rows[row]
            if order is None:
                hashes, row, swap = hashes[stay], row[stay], swap[stay]
                order = np.empty((len(row), size), np.uint8 if size <= 256 else np.uint16)
                order[:] = np.arange(size)
                order[np.arange(len(row)), swap] = 0
                order[:, 0] = swap
            elif not stay.all():
                hashes, row, order = hashes[stay], row[stay], order[stay]
        first = last
    return out


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw, at = text_buffers(texts)
    starts, ends, ptr = word_spans(raw, at)
    words = span_hashes(raw, starts, ends)
    found = [shingles(words[a:b], width) for a, b in zip(ptr[:-1], ptr[1:])]
    return (np.concatenate(found) if found else words), np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64)))


def _fold(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=sums[1:])
        return (sums[ptr[1:]] - sums[ptr[:-1]]).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], width: int, rows: int, bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", _RUN):
            sets, ptr = _sets(part.column("text"), width)
            signature = superminhash(sets, ptr, rows * bands).reshape(-1, bands, rows)
            with np.errstate(over="ignore"):
                keys = np.full(signature.shape[:2], 0x1234567, U64)
                for k in range(rows):
                    keys = mix(keys * U64(0x9E3779B97F4A7C15) + signature[:, :, k])
                digest = [_fold(mix(sets + U64(c)), ptr) for c in _DIGESTS]
            flat = pa.array(keys.reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(ptr)),
                    pa.array(digest[0]),
                    pa.array(digest[1]),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "keys"],
            )


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def _linked(component: np.ndarray, block: np.ndarray, keys: np.ndarray, band: int, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between components by pairs whose blocks differ, or, for one block, by all pairs; a spanning forest of them.

    A pair that shares a band before ``band`` is checked there and not here.
    """
    counts = np.array([len(x) for x in sets])
    order = np.argsort(-counts, kind="stable")
    counts, component, block, keys = counts[order], component[order], block[order], keys[order, :band]
    ptr = np.concatenate(([0], np.cumsum(counts)))
    ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    mark = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    names, root = np.unique(component, return_inverse=True)
    forest, links = _Forest(len(names)), []
    across = len(np.unique(block)) > 1
    for i in range(len(counts) - 1):
        # Sets are in falling order of size, so those below percent of this one end the row.
        stop = int(np.searchsorted(-counts, -((percent * counts[i] + 99) // 100), "right"))
        rest = np.arange(i + 1, stop)
        rest = rest[(root[rest] != root[i]) & ((block[rest] != block[i]) | (not across))]
        if band and len(rest):
            rest = rest[~(keys[rest] == keys[i]).any(axis=1)]
        if not len(rest):
            continue
        mark[ids[ptr[i] : ptr[i + 1]]] = True
        if len(rest) * 4 > stop - i - 1:
            span = mark[ids[ptr[i + 1] : ptr[stop]]]
            shared = np.add.reduceat(span, ptr[i + 1 : stop] - ptr[i + 1], dtype=np.int64)[rest - i - 1]
        else:
            shared = np.array([np.count_nonzero(mark[ids[ptr[j] : ptr[j + 1]]]) for j in rest])
        mark[ids[ptr[i] : ptr[i + 1]]] = False
        for j in rest[100 * shared >= percent * (counts[i] + counts[rest] - shared)]:
            a, b = forest.root(int(root[i])), forest.root(int(root[j]))
            if a != b:
                forest.up[max(a, b)] = min(a, b)
                links.append((int(names[a]), int(names[b])))
                root[root == max(a, b)] = min(a, b)
    return links


def _full_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``rep, set_a, set`` of the texts of ``members`` (``rep``), once for each set of an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, set()  # rows of an id follow one another
        for batch in batches:
            for part in slices(batch, "text", _RUN):
                sets, ptr = _sets(part.column("text"), width)
                digest = _fold(mix(sets + U64(_DIGESTS[0])), ptr)
                keep = []
                for i, (rep, own) in enumerate(zip(part.column("rep").to_pylist(), digest.tolist())):
                    if rep != last:
                        last, seen = rep, set()
                    if own not in seen and ptr[i] < ptr[i + 1]:
                        seen.add(own)
                        keep.append(i)
                lists = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(sets.view(np.int64)))
                keep = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("rep").take(keep), pa.array(digest).take(keep), lists.take(keep)], ["rep", "set_a", "set"])

    # A sort-merge join at every size: the texts move once, evenly, however few members there are.
    placed = docs.withColumnRenamed("doc_id", "rep").join(members.hint("merge"), "rep").select("rep", "text").sortWithinPartitions("rep")
    return materialize(placed.mapInArrow(run, "rep long, set_a long, set array<long>"), "sets")


def _confirmed_ties(ties: DataFrame, sets: DataFrame, percent: int, part: int) -> DataFrame:
    """Those of ``ties`` (``src, src_a, dst, dst_a, held``) whose full sets are alike, as ``src, dst``.

    A hub's set is copied once for each ``part`` members of its largest bucket, so its ties spread over tasks.
    """
    salts = ties.groupBy(F.col("dst").alias("rep"), F.col("dst_a").alias("set_a")).agg(F.ceil(F.max("held") / part).alias("salts"))
    hubs = sets.join(salts, ["rep", "set_a"]).select(F.col("rep").alias("dst"), F.col("set_a").alias("dst_a"), F.col("set").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    mine = sets.select(F.col("rep").alias("src"), F.col("set_a").alias("src_a"), "set")
    salt = F.expr(f"pmod(xxhash64(src), cast(ceil(held / {part}) as bigint))")
    pairs = ties.join(mine, ["src", "src_a"]).withColumn("salt", salt).join(hubs.hint("merge"), ["dst", "dst_a", "salt"])
    shared = F.size(F.array_intersect("set", "other"))
    return pairs.where(100 * shared >= percent * (F.size("set") + F.size("other") - shared)).select("src", "dst").distinct()


def _open_links(members: DataFrame, component: DataFrame, sets: DataFrame, percent: int, block_shingles: int) -> DataFrame:
    """Links ``src, dst`` between components that meet in a bucket of ``members`` (``band, key, rep, set_a, n, keys``)."""
    own = members.join(component, F.col("rep") == F.col("node"), "left").drop("node").withColumn("component", F.coalesce("component", "rep"))
    own = materialize(own, "members")
    bucket = own.groupBy("band", "key").agg(
        F.count("*").alias("held"),
        F.sum(F.xxhash64("rep", "set_a").cast("decimal(38,0)")).alias("print"),
        F.min(F.struct("rep", "set_a", "component")).alias("low"),
        F.min("component").alias("least"),
        F.max("component").alias("most"),
    )
    # The smallest member has met all others; buckets of the same members are looked into in their first band.
    bucket = bucket.where("held > 2 and least < most").groupBy("print", "held").agg(F.min(F.struct("band", "key", "low")).alias("b"))
    bucket = materialize(bucket.select("b.band", "b.key", F.col("b.low.rep").alias("low"), F.col("b.low.set_a").alias("low_a"), F.col("b.low.component").alias("base")), "open")
    rest = own.join(bucket, ["band", "key"]).where("rep <> low or set_a <> low_a").withColumn("same", F.col("component") == F.col("base"))
    rest = materialize(rest.select("band", "key", "rep", "set_a", "n", "keys", "component", "same"), "rest")
    held = lambda flag: F.ceil(F.coalesce(F.sum(F.when(F.col("same") == flag, F.col("n"))), F.lit(0)) / block_shingles).cast("long")
    totals = materialize(rest.groupBy("band", "key").agg(held(True).alias("p"), held(False).alias("q")), "totals")
    rest = rest.join(totals, ["band", "key"])
    # Blocks 0 .. p - 1 are of the smallest member's component and meet the q others only; these meet one another too.
    block = F.expr("case when p <= 1 and q <= 1 then 0 when same then pmod(xxhash64(rep), p) else p + pmod(xxhash64(rep), q) end")
    rest = rest.withColumn("block", block)
    others = F.expr("case when p <= 1 and q <= 1 then array(0L) when same and q = 0 then array() when same then sequence(p, p + q - 1) else sequence(0L, p + q - 1) end")
    tasks = rest.withColumn("other", F.explode(others)).withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    tasks = tasks.select("band", "key", "left", "right", "rep", "set_a", "block", "component", "keys").join(sets, ["rep", "set_a"])

    def confirm(frame: pd.DataFrame) -> pd.DataFrame:
        found = _linked(frame["component"].to_numpy(), frame["block"].to_numpy(), np.stack(frame["keys"].to_numpy()), int(frame["band"].iloc[0]), list(frame["set"]), percent)
        return pd.DataFrame(found, columns=["src", "dst"], dtype="int64")

    return tasks.groupBy("band", "key", "left", "right").applyInPandas(confirm, "src long, dst long")


def near_duplicates(
    docs: DataFrame, *, width: int = 5, percent: int = 85, rows: int = 6, bands: int = 24, block_shingles: int = 120_000, hub_part: int = 256
) -> DataFrame:
    """Group the rows of ``docs`` (``doc_id``, ``text``) whose shingle sets are alike.

    Two rows are linked when 100 * intersection >= percent * union of their
    sets of distinct ``width``-word shingles, words being runs of characters
    other than ASCII white space, A-Z in lower case; a text with fewer words
    is one shingle. Returns one row for each input row: ``doc_id``,
    ``n_shingles``, ``component_id`` (smallest doc_id reachable) and ``kept``.

    A text that is null, empty or without words has an empty set and is linked
    with nothing. Rows that repeat a doc_id are one node, also where their
    texts differ. A null doc_id joins no group: its component is null and it
    is kept. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(
        docs.mapInArrow(
            lambda batches: _signed(batches, width, rows, bands),
            "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>",
        ),
        "signed",
    )
    identity = ["n_shingles", "set_a", "set_b"]
    full = signed.where("n_shingles > 0 and doc_id is not null")
    reps = materialize(
        full.groupBy(*identity).agg(F.min(F.struct("doc_id", "keys")).alias("least")).select(*identity, F.col("least.doc_id").alias("rep"), "least.keys"),
        "reps",
    )
    cells = reps.select("rep", "set_a", F.col("n_shingles").alias("n"), F.posexplode("keys").alias("band", "key"))
    place = F.struct("rep", "set_a", "n")
    low = cells.groupBy("band", "key").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("held")).where("low < high")
    low = materialize(low.select("band", "key", "low", "held"), "buckets")
    met = materialize(cells.join(low, ["band", "key"]), "met")
    # Sets whose sizes are too far apart cannot be alike.
    ties = met.where(F.col("rep") != F.col("low.rep")).where(100 * F.least("n", "low.n") >= percent * F.greatest("n", "low.n"))
    ties = ties.groupBy(F.col("rep").alias("src"), F.col("set_a").alias("src_a"), F.col("low.rep").alias("dst"), F.col("low.set_a").alias("dst_a")).agg(F.max("held").alias("held"))
    sets = _full_sets(docs, met.select("rep").distinct(), width)
    links = _confirmed_ties(materialize(ties, "ties"), sets, percent, hub_part)
    twice = full.groupBy("doc_id").agg(F.min(F.struct(*identity)).alias("a"), F.max(F.struct(*identity)).alias("b")).where("a < b").select("doc_id")
    twice = materialize(twice, "twice")
    if not twice.isEmpty():  # ids with several sets tie these together
        same = full.join(twice, "doc_id").select("doc_id", *identity).distinct().join(reps.select(*identity, "rep"), identity)
        links = links.unionByName(same.select(F.col("doc_id").alias("src"), F.col("rep").alias("dst")))
    first = materialize(connected_components(materialize(links, "links")), "first")
    members = met.where("held > 2").select("band", "key", "rep", "set_a", "n").join(reps.select("rep", "set_a", "keys"), ["rep", "set_a"])
    second = connected_components(materialize(_open_links(members, first, sets, percent, block_shingles), "more"))
    second = second.withColumnsRenamed({"node": "from", "component": "to"})
    named = reps.drop("keys").join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = materialize(named.join(second, F.col("component") == F.col("from"), "left").select(*identity, F.coalesce("to", "component").alias("component")), "named")
    out = signed.select("doc_id", *identity).join(named, identity, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
