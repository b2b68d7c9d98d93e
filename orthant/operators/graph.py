"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every
round is two hash aggregations and two equi-joins on the edge table; no
neighbourhood is collected and hubs meet their least neighbour by a broadcast,
so a hub of any degree stays a stream of rows over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthant.storage import materialize, release

#: Up to so many edges are joined plainly.
PLAIN = 20_000
#: Least degree of a hub, and the most hubs that are broadcast.
HUB = 256
MOST_HUBS = 100_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.min("dst").alias("low"))


def _with_low(edges: DataFrame, held: int) -> DataFrame:
    """``edges`` with ``low``, the least neighbour of ``src``.

    Sources of over ``HUB`` edges, of which there are at most ``held / HUB``,
    take it from a broadcast table and are not shuffled, so a hub of any degree
    is spread as its edges are. ``held`` is the number of edges.
    """
    low = _least_neighbour(edges)
    if held <= PLAIN:
        return edges.join(low, "src")
    least = max(HUB, held // MOST_HUBS)
    low = materialize(edges.groupBy("src").agg(F.min("dst").alias("low"), F.count("*").alias("degree")), "low")
    hubs = low.where(F.col("degree") > least)
    if hubs.isEmpty():
        return edges.join(low.drop("degree"), "src")
    few = F.broadcast(hubs.select(F.col("src").alias("hub"), F.col("low").alias("hub_low")))  # at most MOST_HUBS rows
    marked = edges.join(few, F.col("src") == F.col("hub"), "left")
    hot = marked.where("hub is not null").select("src", "dst", F.col("hub_low").alias("low"))
    cold = marked.where("hub is null").select("src", "dst").join(low.where(F.col("degree") <= least).drop("degree"), "src")
    return hot.unionByName(cold.select("src", "dst", "low"))


def _large_star(edges: DataFrame, held: int) -> DataFrame:
    joined = _with_low(_both_ways(edges), 2 * held).withColumn("low", F.least("src", "low"))
    return joined.where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame, held: int) -> DataFrame:
    joined = _with_low(edges, held)
    moved = joined.where("dst > low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.unionByName(joined.select("src", F.col("low").alias("dst"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    digest = F.xxhash64("src", "dst").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(digest)).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge to another node.

    ``edges`` has two orderable columns ``src`` and ``dst``; direction and
    repeats do not matter, self-loops and nulls are ignored. Returns ``node``
    and ``component``, the smallest node reachable.
    """
    pairs = edges.where("src <> dst")
    state = materialize(
        pairs.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges"
    )
    seen = _fingerprint(state)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        large = materialize(_large_star(state, seen[0]), "edges")
        after = materialize(_small_star(large, seen[0]), "edges")
        now = _fingerprint(after)
        release(large)
        release(state)
        state = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = state.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return state.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
