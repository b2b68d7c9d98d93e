"""Near-duplicate vectors by a forest of random-projection trees whose halves overlap.

A node splits at a random direction, and rows close to the plane go to both
sides. A pair of near-duplicates is lost by a tree only where it straddles a
plane by more than the overlap, and by the forest only if all trees lose it;
the width of the overlap is measured on pairs made at exactly the least
cosine. Of several directions and places a node takes the one with the fewest
rows in its overlap; a node that no plane divides, as the rows are too near each
other, stays one dense leaf.

Rows are compared by matrix products within leaves, a leaf of many rows in
blocks. A pair that meets in several leaves counts in the first alone, so links
are counted where they are found: no pair leaves its task, only each row's
number of links and a spanning tree of the linked rows. Components unite these
trees. Equal vectors are one row with a count.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthant.operators.graph import connected_components
from orthant.storage import materialize, release

#: Scores closer to the least cosine than this are summed again without a matrix product.
_EXACT = 1e-9
_KEY = ["k1", "k2"]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares overflow or vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class SpillTree:
    """Inner nodes in order of making; a child below zero is leaf number -1 - child. ``dense`` has leaves that no plane divides."""

    planes: np.ndarray  # nodes x dimensions
    cuts: np.ndarray
    kids: np.ndarray  # nodes x 2
    dense: np.ndarray  # leaves
    depth: int

    @classmethod
    def fit(cls, unit: np.ndarray, margin: float, leaf_rows: int, rng: np.random.Generator, candidates: int = 4, most_spill: float = 0.4) -> SpillTree:
        planes: list[np.ndarray] = []
        cuts: list[float] = []
        kids: list[list[int]] = []
        dense: list[bool] = []
        todo, depth = [(np.arange(len(unit)), -1, 0, 0)], 0
        while todo:
            rows, parent, side, level = todo.pop()
            depth = max(depth, level)
            best = None
            if len(rows) > leaf_rows:
                directions = rng.standard_normal((candidates, unit.shape[1]))
                directions /= np.linalg.norm(directions, axis=1, keepdims=True)
                at = unit[rows] @ directions.T
                for share in (0.5, 0.35, 0.65):
                    cut = np.quantile(at, share, axis=0)
                    spill = (np.abs(at - cut) <= margin).mean(axis=0)
                    c = int(np.argmin(spill))
                    if best is None or spill[c] < best[0]:
                        best = (spill[c], directions[c], cut[c], at[:, c])
            if best is None or best[0] > most_spill:
                me = -1 - len(dense)
                dense.append(best is not None)
            else:
                me = len(cuts)
                planes.append(best[1])
                cuts.append(float(best[2]))
                kids.append([0, 0])
                todo += [(rows[best[3] <= best[2] + margin], me, 0, level + 1), (rows[best[3] > best[2] - margin], me, 1, level + 1)]
            if parent >= 0:
                kids[parent][side] = me
        return cls(np.array(planes).reshape(len(cuts), unit.shape[1]), np.array(cuts), np.array(kids, np.int64).reshape(-1, 2), np.array(dense), depth)

    def route(self, unit: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a row goes to."""
        rows = np.arange(len(unit))
        if not len(self.cuts):
            return rows, np.zeros(len(unit), np.int64)
        node, out_rows, out_leaves = np.zeros(len(unit), np.int64), [], []
        while len(rows):
            off = np.einsum("ij,ij->i", unit[rows], self.planes[node]) - self.cuts[node]
            left, right = off <= margin, off > -margin
            rows, node = np.concatenate((rows[left], rows[right])), np.concatenate((self.kids[node[left], 0], self.kids[node[right], 1]))
            end = node < 0
            out_rows.append(rows[end])
            out_leaves.append(-1 - node[end])
            rows, node = rows[~end], node[~end]
        return np.concatenate(out_rows), np.concatenate(out_leaves)


@dataclass
class SpillForest:
    trees: list[SpillTree]
    margin: float

    @classmethod
    def fit(cls, unit: np.ndarray, trees: int, margin: float, leaf_rows: int, seed: int) -> SpillForest:
        return cls([SpillTree.fit(unit, margin, leaf_rows, np.random.default_rng([seed, t])) for t in range(trees)], margin)

    def codes(self, unit: np.ndarray, base: int = 0) -> list[np.ndarray]:
        """For each row its leaves, as ascending codes: tree, leaf, and in the lowest bit whether the leaf is dense."""
        rows, codes = [], []
        for t, tree in enumerate(self.trees):
            own, leaf = tree.route(unit, self.margin)
            rows.append(own)
            codes.append(((base + t) << 40) | (leaf << 1) | tree.dense[leaf])
        rows, codes = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((codes, rows))
        return np.split(codes[order], np.cumsum(np.bincount(rows, minlength=len(unit)))[:-1])

    def recall(self, unit: np.ndarray, cosine: float, levels: float, seed: int, pairs: int = 1000) -> float:
        """Share of pairs at exactly ``cosine`` that would meet in a forest with ``levels`` more levels."""
        rng = np.random.default_rng([seed, 7])
        one = unit[rng.choice(len(unit), min(pairs, len(unit)), replace=False)]
        off = rng.standard_normal(one.shape)
        off -= (off * one).sum(axis=1, keepdims=True) * one
        off /= np.maximum(np.sqrt((off * off).sum(axis=1, keepdims=True)), 1e-300)
        two = cosine * one + np.sqrt(1 - cosine * cosine) * off
        met = np.array([[len(np.intersect1d(a, b, assume_unique=True)) > 0 for a, b in zip(*(SpillForest([t], self.margin).codes(x) for x in (one, two)))] for t in self.trees])
        depth = max(1, np.mean([t.depth for t in self.trees]))
        return 1 - (1 - met.mean() ** ((depth + levels) / depth)) ** len(self.trees)


def calibrated(unit: np.ndarray, cosine: float, trees: int, leaf_rows: int, levels: float, recall: float, seed: int) -> SpillForest:
    """The forest with the narrowest overlap, in steps of a quarter of a pair's mean projection, that reaches ``recall``."""
    step = 0.25 * np.sqrt((2 - 2 * cosine) / unit.shape[1])
    for width in range(1, 9):
        forest = SpillForest.fit(unit, trees, width * step, leaf_rows, seed)
        if forest.recall(unit, cosine, levels, seed) >= recall:
            break
    return forest


def _spanning(linked: np.ndarray, start: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the symmetric ``linked`` connects, found breadth first from each of ``start`` in turn."""
    seen, out = np.zeros(len(linked), bool), []
    for root in start:
        if seen[root]:
            continue
        seen[root], front = True, np.array([root])
        while len(front):
            near = linked[front] & ~seen
            new = np.flatnonzero(near.any(axis=0))
            out += [(int(a), int(b)) for a, b in zip(front[near[:, new].argmax(axis=0)], new)]
            seen[new], front = True, new
    return out


def _earlier(codes: list[np.ndarray], code: int) -> tuple[np.ndarray, np.ndarray]:
    own = [c[: np.searchsorted(c, code)] for c in codes]
    return np.repeat(np.arange(len(own)), [len(c) for c in own]), np.concatenate(own) if own else np.zeros(0, np.int64)


def compare(part: pd.DataFrame, cosine: float, kind: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each row (weighed by the others' copies) and spanning edges, of the pairs that meet in this leaf first.

    ``part`` has the rows of one block of a leaf, or of two, whose pairs
    within a block are then left out: ``side`` is 0 or 1.
    """
    x = np.frombuffer(b"".join(part["vector"]), kind).reshape(len(part), -1)
    unit, copies = _unit(x), part["n"].to_numpy(np.int64)
    codes, code = [np.asarray(c, np.int64) for c in part["codes"]], int(part["code"].iloc[0])
    side = part["side"].to_numpy()
    two = side.any()
    one, other = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(part)),) * 2
    linked = np.zeros((len(part), len(part)), bool)
    if len(one) and len(other):
        score = unit[one] @ unit[other].T
        links = score >= cosine
        a, b = np.nonzero(np.abs(score - cosine) < _EXACT)
        if len(a):
            links[a, b] = (unit[one[a]] * unit[other[b]]).sum(axis=1) >= cosine
        if not two:
            np.fill_diagonal(links, False)
        a, b = np.nonzero(links.any(axis=1))[0], np.nonzero(links.any(axis=0))[0]
        if len(a):  # a pair that shares an earlier leaf belongs to that one
            (ra, ca), (rb, cb) = _earlier([codes[i] for i in one[a]], code), _earlier([codes[i] for i in other[b]], code)
            names = np.intersect1d(ca, cb)
            if len(names):
                shared = [np.zeros((n, len(names)), np.float32) for n in (len(a), len(b))]
                for table, r, c in zip(shared, (ra, rb), (ca, cb)):
                    at = np.isin(c, names)
                    table[r[at], np.searchsorted(names, c[at])] = 1
                links[np.ix_(a, b)] &= (shared[0] @ shared[1].T) == 0
            linked[np.ix_(one, other)] = links
            if two:
                linked |= linked.T
    return linked @ copies, _spanning(linked, np.flatnonzero(linked.any(axis=1)))


def _refined(state: DataFrame, sizes: DataFrame, margin: float, kind: str, leaf_rows: int, chunk_rows: int, fit_rows: int, tier: int, seed: int) -> DataFrame:
    """``state`` with the leaves in ``sizes`` (``code``, ``size``) split further, each by a tree fitted on about ``fit_rows`` of its rows."""
    rows = state.select(*_KEY, "n", "vector", F.explode("codes").alias("code")).join(sizes, "code")
    drawn = F.pmod(F.xxhash64(*_KEY, "code"), F.lit(1 << 30)) / float(1 << 30) < F.lit(float(fit_rows)) / F.col("size")

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        unit, code = _unit(np.frombuffer(b"".join(part["vector"]), kind).reshape(len(part), -1)), int(part["code"].iloc[0])
        least = max(8, int(leaf_rows * len(part) / part["size"].iloc[0]))
        tree = SpillTree.fit(unit, margin, least, np.random.default_rng([seed, tier, code % (1 << 31)]))
        return pd.DataFrame({"code": [code], "chunks": [-(-int(part["size"].iloc[0]) // chunk_rows)], "model": [pickle.dumps(tree)]})

    models = rows.where(drawn).groupBy("code").applyInPandas(grow, "code long, chunks long, model binary")
    models = materialize(models, "models")
    models = models.select("code", "model", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64(*_KEY), F.ceil(F.col("size") / chunk_rows)))

    def split(part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(model):  # no row was drawn: the leaf stays, and is not tried again
            code = part["code"] | 1
            return pd.DataFrame({"k1": part["k1"], "k2": part["k2"], "was": part["code"], "code": code})
        tree = pickle.loads(model["model"].iloc[0])
        own, leaf = tree.route(_unit(np.frombuffer(b"".join(part["vector"]), kind).reshape(len(part), -1)), margin)
        # A name for the leaf within the leaf: equal names by chance only bring more rows together.
        name = (int(part["code"].iloc[0]) * 0x9E3779B97F4A7C15 + tier * 0x632BE59BD9B4E019) % (1 << 38)
        was = part["code"].to_numpy()[own]
        fresh = ((was >> 40) << 40) | (((name + leaf * 0x2545F491) % (1 << 38)) << 1) | tree.dense[leaf]
        return pd.DataFrame({"k1": part["k1"].to_numpy()[own], "k2": part["k2"].to_numpy()[own], "was": was, "code": fresh})

    moved = dealt.groupBy("code", "chunk").cogroup(models.groupBy("code", "chunk")).applyInPandas(split, "k1 long, k2 long, was long, code long")
    moved = moved.groupBy(*_KEY).agg(F.collect_set("was").alias("gone"), F.collect_set("code").alias("come"))
    joined = state.join(moved, _KEY, "left")
    codes = F.when(F.col("gone").isNull(), F.col("codes")).otherwise(F.array_sort(F.array_union(F.array_except("codes", "gone"), F.col("come"))))
    return joined.select("node", *_KEY, "n", "vector", codes.alias("codes"))


def linked_vectors(
    rows: DataFrame, *, cosine: float = 0.95, trees: int = 8, leaf_rows: int = 300, leaf_sample: int = 16, sample: int = 20_000, sample_values: int = 4_000_000, recall: float = 0.999, block_rows: int = 2048, fit_rows: int = 4096, seed: int = 23
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of ``rows`` (``vec_id``, ``embedding``).

    Two rows are linked if their cosine in double precision is at least
    ``cosine`` (above 0, at most 1) and they meet in a leaf; no pair below it is. Vectors that
    are null, empty, zero or hold null or non-finite components, and vectors
    of different lengths, link with nothing. Every row counts, also where rows
    or vec_ids repeat: copies link with each other. ``component_id`` is the
    smallest vec_id reachable, null only where none is known; ``kept`` is true
    where it is the row's own, so of rows that repeat it all stay.

    The forest is fitted on at most ``sample`` vectors and ``sample_values``
    components of the most frequent length; a leaf that then has too many
    rows is split again by a tree of its own, until it has about
    ``leaf_rows`` or no plane divides it. All vectors are indexed. Vectors of
    rarer lengths are one leaf a length. Leaves beyond ``block_rows`` rows are
    compared block by block, each pair of blocks in a task of its own, so a
    leaf of rows all near each other costs their square in products but never
    meets as a whole.
    """
    spark = rows.sparkSession
    kind = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
    all_rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    zeroed = F.transform("vector", lambda x: x + F.lit(0.0))  # one zero of the two
    usable = F.when(F.coalesce(fine, F.lit(False)), zeroed)
    keyed = all_rows.select("vec_id", usable.alias("vector"))
    keyed = keyed.select("vec_id", "vector", F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(seed), F.reverse("vector")).alias("k2"))
    distinct = keyed.where("vector is not null").groupBy(*_KEY, "vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("id"))
    node = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), *_KEY).alias("node")
    distinct = materialize(distinct.select(node, *_KEY, "n", "vector"), "vectors")
    lengths = distinct.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if lengths is None:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    length, count = lengths["length"], lengths["count"]

    most = max(leaf_sample, min(sample, sample_values // length))
    drawn = distinct.where(F.size("vector") == length).orderBy(*_KEY).select("vector").limit(most).toPandas()
    unit = _unit(np.stack(drawn["vector"].to_numpy()))
    least = max(leaf_sample, int(leaf_rows * len(unit) / count))
    levels = max(0.0, np.log2(count * least / (len(unit) * leaf_rows)))
    forest = calibrated(unit, cosine, trees, least, levels, recall, seed)

    def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors, codes = frame["vector"].to_list(), [None] * len(frame)
            own = np.array([i for i, v in enumerate(vectors) if len(v) == length], np.int64)
            if len(own):
                for i, c in zip(own, forest.codes(_unit(np.stack([vectors[i] for i in own])))):
                    codes[i] = c
            for i, v in enumerate(vectors):
                if codes[i] is None:  # a leaf for each rarer length, beyond all trees
                    codes[i] = np.array([((1 << 20) << 40) | (len(v) << 1) | 1])
            yield pd.DataFrame({"k1": frame["k1"], "k2": frame["k2"], "none": frame["none"], "id": frame["id"], "n": frame["n"], "vector": [v.astype(kind).tobytes() for v in vectors], "codes": codes})

    slim = distinct.select(*_KEY, "node.none", "node.id", "n", "vector")
    state = slim.mapInPandas(home, "k1 long, k2 long, none boolean, id long, n long, vector binary, codes array<long>")
    state = materialize(state.select(F.struct("none", "id", *_KEY).alias("node"), *_KEY, "n", "vector", "codes"), "leaves")
    release(distinct)
    tier = 0
    while True:
        sizes = state.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("size"))
        sizes = materialize(sizes.where(F.col("size") > min(4 * leaf_rows, block_rows)), "sizes")
        coarse = sizes.where(F.col("code").bitwiseAND(F.lit(1)) == 0)
        if tier == 12 or coarse.isEmpty():
            break
        tier += 1
        finer = materialize(_refined(state, coarse, forest.margin, kind, leaf_rows, 16 * block_rows, fit_rows, tier, seed), "leaves")
        release(state)
        state = finer

    met = state.select("node", *_KEY, "n", "vector", "codes", F.explode("codes").alias("code"))
    large = sizes.where(F.col("size") > block_rows).select("code", F.ceil(F.col("size") / block_rows).cast("int").alias("blocks"))
    if large.isEmpty():
        met = met.withColumns({"pair": F.lit(0), "side": F.lit(0)})
    else:
        met = met.join(large, "code", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        block = F.pmod(F.xxhash64(*_KEY, F.lit(1)), F.col("blocks")).cast("int")
        met = met.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        low, high = F.least("block", "other"), F.greatest("block", "other")
        met = met.withColumns({"pair": low * F.col("blocks") + high, "side": (F.col("block") > F.col("other")).cast("int")})

    def leaf(part: pd.DataFrame) -> pd.DataFrame:
        links, edges = compare(part, cosine, kind)  # two blocks at most
        some, pairs = np.flatnonzero(links), np.array(edges, np.int64).reshape(-1, 2)
        own, near = part.iloc[np.concatenate((some, pairs[:, 0]))], part.iloc[np.concatenate((some, pairs[:, 1]))]
        out = {f"{end}_{c}": rows[c].to_numpy() for end, rows in (("own", own), ("near", near)) for c in name}
        return pd.DataFrame(out | {"links": np.concatenate((links[some], np.zeros(len(pairs), np.int64)))})

    name = {"none": "boolean", "id": "long", "k1": "long", "k2": "long"}
    shape = ", ".join(f"{end}_{c} {t}" for end in ("own", "near") for c, t in name.items())
    met = met.select("code", "pair", "side", "node.none", "node.id", *_KEY, "n", "vector", "codes")
    found = met.groupBy("code", "pair").applyInPandas(leaf, f"{shape}, links long")
    ends = [F.struct(*[F.col(f"{end}_{c}").alias(c) for c in name]).alias(end) for end in ("own", "near")]
    found = materialize(found.select(*ends, "links"), "links")  # of an edge, links are 0
    clusters = connected_components(found.where("links = 0").select(F.col("own").alias("src"), F.col("near").alias("dst")))
    counts = found.where("links > 0").groupBy("own").agg(F.sum("links").alias("links"))
    nodes = state.select("node", F.col("k1").alias("l1"), F.col("k2").alias("l2"), "n")
    known = nodes.join(counts, F.col("node") == F.col("own"), "left").drop("own")
    known = known.join(clusters.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    known = known.select("l1", "l2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    known = materialize(known, "known")

    mine = keyed.select("vec_id", *_KEY, F.col("vector").isNotNull().alias("valid"))
    # Rows without a usable vector have one key in common; they find no partner, so they are dealt by their id.
    mine = mine.withColumn("k2", F.when(F.col("valid"), F.col("k2")).otherwise(F.xxhash64("vec_id")))
    out = mine.join(known, F.col("valid") & (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")), "left")
    component = F.when(F.col("component").isNull(), F.col("vec_id")).when(~F.col("component.none"), F.col("component.id"))
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(rows: DataFrame) -> DataFrame:
    return linked_vectors(rows)
