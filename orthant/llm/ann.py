"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample; every vector is routed to one leaf of
each. A query walks all trees through one priority queue ordered by how far
beyond the splitting planes a branch lies, and visits the nearest leaves of
the whole forest. How many is calibrated on the sample against brute force, so
clustered data takes few leaves and data without structure takes many. Leaf
rows are reranked exactly.

Equal vectors are one row with their smallest ids. Neighbouring leaves of a tree
form a cell that one task reranks leaf by leaf, and a cell of more than
``block_rows`` rows is cut into blocks, so neither a hot vector nor a hot leaf
meets in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orthant.storage import materialize


@dataclass
class Forest:
    """Per tree: a unit direction and a median for each inner node, in heap order."""

    planes: np.ndarray  # trees x (2 ** depth - 1) x dimensions
    cuts: np.ndarray  # trees x (2 ** depth - 1)
    depth: int
    probes: int = 1

    @classmethod
    def fit(cls, unit: np.ndarray, trees: int, depth: int, seed: int) -> Forest:
        rng = np.random.default_rng(seed)
        nodes = (1 << depth) - 1
        planes = rng.standard_normal((trees, nodes, unit.shape[1]))
        planes /= np.linalg.norm(planes, axis=2, keepdims=True)
        cuts = np.zeros((trees, nodes))
        for t in range(trees):
            node = np.zeros(len(unit), np.int64)
            for level in range(depth):
                for own in range((1 << level) - 1, (2 << level) - 1):
                    rows = np.flatnonzero(node == own)
                    side = unit[rows] @ planes[t, own]
                    cuts[t, own] = np.median(side) if len(rows) else 0.0
                    node[rows] = 2 * own + 1 + (side > cuts[t, own])
        return cls(planes, cuts, depth)

    def route(self, unit: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        trees, nodes = self.cuts.shape
        out = np.zeros((len(unit), trees), np.int64)
        for t in range(trees):
            node = np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", unit, self.planes[t, node])
                node = 2 * node + 1 + (side > self.cuts[t, node])
            out[:, t] = node - nodes
        return out

    def search(self, unit: np.ndarray, probes: int | None = None) -> list[list[tuple[int, int]]]:
        """For each vector the (tree, leaf) pairs that come first from the shared queue."""
        trees, nodes = self.cuts.shape
        sides = np.einsum("tnd,qd->qtn", self.planes, unit, optimize=True) - self.cuts
        found = []
        for row in sides:
            queue = [(0.0, t, 0) for t in range(trees)]
            leaves: list[tuple[int, int]] = []
            while queue and len(leaves) < (probes or self.probes):
                far, t, node = heapq.heappop(queue)
                if node >= nodes:
                    leaves.append((t, node - nodes))
                    continue
                side = row[t, node]
                near = 2 * node + 1 + (side > 0)
                heapq.heappush(queue, (far, t, near))
                heapq.heappush(queue, (far + side * side, t, 4 * node + 3 - near))
            found.append(leaves)
        return found

    def calibrate(self, unit: np.ndarray, k: int, recall: float, queries: int = 200) -> None:
        """Set ``probes`` to the least number of leaves that reaches ``recall`` on the sample."""
        trees, leaves = len(self.cuts), 1 << self.depth
        asked = unit[:: max(1, len(unit) // queries)]
        score = asked @ unit.T
        score[np.arange(len(asked)), np.arange(0, len(unit), max(1, len(unit) // queries))] = -np.inf
        k = min(k, len(unit) - 1)
        if k < 1:
            self.probes = trees * leaves
            return
        true = np.argpartition(-score, k - 1, axis=1)[:, :k]
        homes = self.route(unit)
        order = self.search(asked, trees * leaves)
        needed = np.empty(true.shape)
        for i, visits in enumerate(order):
            place = np.empty((trees, leaves))
            for p, (t, leaf) in enumerate(visits):
                place[t, leaf] = p
            needed[i] = place[np.arange(trees), homes[true[i]]].min(axis=1)
        self.probes = int(min(trees * leaves, np.quantile(needed, recall, method="higher") + 1))


def _scaled(vectors: pd.Series) -> np.ndarray:
    """Vectors with a largest component between a half and one: a power of two apart, so no bit of a cosine changes and no square overflows."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(vectors: pd.Series) -> np.ndarray:
    x = _scaled(vectors)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rerank(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows for each query in the leaves that it visits; scores are sums over the original components alone."""
    q, r = _scaled(queries["vector"]), _scaled(rows["vector"])
    q_norm, r_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((r * r).sum(axis=1))
    visits = queries["leaves"].to_numpy()
    asker, asked = np.repeat(np.arange(len(q)), [len(v) for v in visits]), np.concatenate(visits)
    leaf = rows["leaf"].to_numpy()
    order, by_leaf = np.argsort(leaf, kind="stable"), np.argsort(asked, kind="stable")
    found = []
    for name in np.unique(leaf):
        own = order[np.searchsorted(leaf[order], name) : np.searchsorted(leaf[order], name, "right")]
        who = asker[by_leaf[np.searchsorted(asked[by_leaf], name) : np.searchsorted(asked[by_leaf], name, "right")]]
        for i in range(0, len(who), 2048):
            part = who[i : i + 2048]
            score = (q[part] @ r[own].T) / q_norm[part][:, None] / r_norm[own]
            take = min(k + 2, len(own))  # two to spare for the rounding of the matrix product
            best = own[np.argpartition(-score, take - 1, axis=1)[:, :take]].reshape(-1)
            left = np.repeat(part, take)
            exact = (q[left] * r[best]).sum(axis=1) / (q_norm[left] * r_norm[best])
            found.append((left, best, np.clip(exact, -1.0, 1.0)))
    if not found:
        return pd.DataFrame({"query": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
    left, best, score = (np.concatenate(x) for x in zip(*found))
    ids = rows["id"].to_numpy()[best]
    order = np.lexsort((ids, -score, left))
    left, ids, score = left[order], ids[order], score[order]
    place = np.arange(len(left)) - np.searchsorted(left, left)
    return pd.DataFrame({"query": queries["id"].to_numpy()[left], "id": ids, "score": score})[place < k]


def nearest(
    rows: DataFrame, asked, *, k: int = 5, trees: int = 4, leaf_rows: int = 200, leaf_sample: int = 16, sample: int = 20_000, sample_values: int = 8_000_000, recall: float = 0.97, block_rows: int = 20_000, seed: int = 11
) -> DataFrame:
    """The ``k`` rows nearest by cosine to each row of ``rows`` (``vec_id``, ``embedding``) where ``asked`` holds.

    A row is no neighbour of its own vec_id. Vectors that are null, zero or
    hold null or non-finite components take no part, nor do those of another
    length than the most frequent one; components of any finite size do. Returns ``query_id``, ``rank`` (from
    1), ``vec_id`` and ``score``, ties to the smaller vec_id; all candidates,
    if there are fewer than k: a query whose leaves hold too few is searched
    again in four times as many until it has them. Repeated rows count once.

    All rows are indexed. The index is fitted on ``sample`` rows at most, and
    no more than hold ``sample_values`` components. Trees grow with the table,
    to leaves of about ``leaf_rows`` rows, until a leaf has ``leaf_sample``
    rows of the sample.
    """
    spark = rows.sparkSession
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), asked.alias("asked"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = vectors.where(finite & F.exists("vector", lambda x: x != 0))
    vectors = materialize(vectors.withColumn("key", F.xxhash64("vector")), "vectors")
    lengths = vectors.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    vectors = vectors.where(F.size("vector") == lengths["n"])

    # One row per distinct vector with its k + 1 smallest ids: more of them cannot be among the k best.
    copies = Window.partitionBy("key", "vector").orderBy("vec_id")
    single = vectors.select("vec_id", "key", "vector").distinct()  # else repeated rows would fill the places
    few = single.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    distinct = few.groupBy("key", "vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    distinct = materialize(distinct.withColumn("id", F.col("ids")[0]), "distinct")
    count = distinct.count()

    most = max(leaf_sample, min(sample, sample_values // lengths["n"]))
    drawn = distinct.orderBy(F.xxhash64("id"), "id").select("vector").limit(most).toPandas()
    unit = _unit(drawn["vector"])
    depth = int(max(0, min(np.round(np.log2(count / leaf_rows)), np.floor(np.log2(max(1, len(unit) / leaf_sample))))))
    forest = Forest.fit(unit, trees, depth, seed)
    forest.calibrate(unit, k, recall)
    # Leaves that lie together are one cell, so that a query goes to few tasks; a cell is cut into blocks.
    bits = min(depth, max(6, int(np.ceil(np.log2(max(1, count / block_rows))))))
    shift, blocks = depth - bits, max(1, -(-count // ((1 << bits) * block_rows)))

    def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            leaves = forest.route(_unit(frame["vector"])) if len(frame) else np.zeros((0, trees), np.int64)
            yield pd.concat([pd.DataFrame({"tree": t, "cell": leaves[:, t] >> shift, "block": (frame["id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks, "id": frame["id"], "vector": frame["vector"], "leaf": leaves[:, t]}) for t in range(trees)])

    def probe(frames: Iterator[pd.DataFrame], probes: int) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 64):
                part = frame.iloc[i : i + 64]
                out = []
                for i, v, leaves in zip(part["id"], part["vector"], forest.search(_unit(part["vector"]), probes)):
                    cells: dict[tuple[int, int], list[int]] = {}
                    for t, leaf in leaves:
                        cells.setdefault((t, leaf >> shift), []).append(leaf)
                    out += [(t, cell, b, i, v, own) for (t, cell), own in cells.items() for b in range(blocks)]
                yield pd.DataFrame(out, columns=["tree", "cell", "block", "id", "vector", "leaves"])

    shape = "tree long, cell long, block long, id long, vector array<double>"
    cell = ["tree", "cell", "block"]
    queries = vectors.where("asked").select("vec_id", "key", "vector")
    wanted = queries.groupBy("key", "vector").agg(F.min("vec_id").alias("id"))
    wanted = materialize(wanted, "queries")
    indexed = distinct.select("id", "vector").mapInPandas(home, shape + ", leaf long")

    def score(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        return _rerank(q, r, k + 1)

    def search(asked: DataFrame, probes: int) -> DataFrame:
        """``query``, its vector and the list of its k + 1 nearest ids, its own among them."""
        tasks = max(1, min(4096, -(-asked.count() // 64)))  # a walk through the trees costs more than a row's transfer
        visits = asked.select("id", "vector").repartition(tasks, "id").mapInPandas(lambda frames: probe(frames, probes), shape + ", leaves array<long>")
        found = visits.groupBy(*cell).cogroup(indexed.groupBy(*cell)).applyInPandas(score, "query long, id long, score double")
        found = found.groupBy("query", "id").agg(F.max("score").alias("score"))
        best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
        answers = found.join(distinct.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("vec_id"))
        first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        answers = answers.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
        lists = answers.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
        return materialize(asked.join(lists, F.col("id") == F.col("query"), "left").select("id", "key", F.col("vector").alias("theirs"), "near"), "answers")

    need = min(k + 1, single.select("vec_id").distinct().count())
    probes, answers, lists = forest.probes, search(wanted, forest.probes), None
    while True:
        whole = F.coalesce(F.size("near") >= need, F.lit(False))
        complete = probes >= trees << depth
        done = answers if complete else answers.where(whole)
        lists = done if lists is None else lists.unionByName(done)
        short = answers.where(~whole)
        if complete or short.isEmpty():
            break
        probes = min(4 * probes, trees << depth)
        answers = search(short.select("id", "key", F.col("theirs").alias("vector")), probes)
    lists = lists.select("key", "theirs", "near")

    each = queries.select("vec_id", "key", "vector").distinct().join(lists, "key").where("vector = theirs")
    near = F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("vec_id")), 1, k)
    out = each.select(F.col("vec_id").alias("query_id"), F.posexplode(near).alias("at", "c"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), F.col("c.score").alias("score"))


def query(rows: DataFrame) -> DataFrame:
    return nearest(rows, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))
