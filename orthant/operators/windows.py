"""Ordered operators: runs, ranks, curves, shortlists, allocations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_runs(points: DataFrame, keys: Sequence[str], along: str, gap: float, tie: str = "id") -> DataFrame:
    """Add ``run``: numbers from 0 the stretches of each group without a step over ``gap``."""
    order = Window.partitionBy(*keys).orderBy(along, tie)
    step = F.coalesce((F.col(along) - F.lag(along).over(order) > gap).cast("int"), F.lit(0))
    return points.withColumn("step", step).withColumn("run", F.sum("step").over(order)).drop("step")


def largest_gap(points: DataFrame, keys: Sequence[str], along: str) -> DataFrame:
    """The widest step between neighbours of each group: ``gap`` and where it starts (the first, if tied)."""
    order = Window.partitionBy(*keys).orderBy(along)
    steps = points.withColumn("gap", F.lead(along).over(order) - F.col(along)).where("gap is not null")
    return steps.groupBy(*keys).agg(F.max(F.struct("gap", (-F.col(along)).alias("m"))).alias("s")).select(*keys, "s.gap", (-F.col("s.m")).alias("start"))


def rank_weights(points: DataFrame, keys: Sequence[str], score: str, tie: str = "id") -> DataFrame:
    """Add ``rank_weight`` = 0.25 + 0.75 * rank / (n - 1), ranks from 0 by score; 1 for a single row."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(score, tie)) - 1
    n = F.count("*").over(Window.partitionBy(*keys))
    return points.withColumn("rank_weight", F.when(n > 1, 0.25 + 0.75 * rank / F.greatest(n - 1, F.lit(1))).otherwise(1.0))


def coverage_curve(distances: DataFrame, tolerance: float) -> DataFrame:
    """Covered share after each committed box: ``box_id``, ``covered_fraction``, ``added_points``.

    ``distances`` holds ``id``, ``box_id``, ``d`` for every pair. The first
    box that covers a point is an aggregate, and the curve is a running sum
    over boxes, so no window runs over the pairs.
    """
    first = distances.groupBy("id").agg(F.min(F.when(F.col("d") <= tolerance, F.col("box_id"))).alias("box_id"))
    added = first.groupBy("box_id").agg(F.count("*").alias("added_points"))
    total = added.agg(F.sum("added_points").alias("total"))  # one row
    boxes = distances.select("box_id").distinct().join(added, "box_id", "left").join(F.broadcast(total))
    running = F.sum(F.coalesce("added_points", F.lit(0))).over(Window.orderBy("box_id"))  # one row per box
    return boxes.select("box_id", (running / F.col("total")).alias("covered_fraction"), F.coalesce("added_points", F.lit(0)).cast("long").alias("added_points"))


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; the rank filter is pushed before the shuffle by Spark."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def round_robin_shortlist(rows: DataFrame, kind: str, order: Sequence[Column], n: int) -> DataFrame:
    """``n`` rows that take turns between kinds, best first within each; kinds in order of name."""
    placed = top_per_group(rows, [kind], order, n)
    return placed.orderBy("place", kind).limit(n)


def linspace_sample(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """``n`` evenly spaced rows by position in the order, first and last included.

    Positions come from a global sort by range and per-partition counts
    (``zipWithIndex`` in DataFrame terms: a rank within a range partition plus
    the running count of the partitions before).
    """
    parts = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    from orthant.storage import materialize

    parts = materialize(parts, "ranges")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = parts.join(F.broadcast(before.select("part", "before")), "part")  # one row per partition
    position = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    total = counts.agg(F.sum("n")).first()[0] or 0
    n = min(n, total)
    if n == 0:
        return rows.limit(0)
    spark = rows.sparkSession
    wanted = spark.range(n).select(F.floor(F.col("id") * F.lit(total - 1) / F.lit(max(n - 1, 1))).cast("long").alias("position")).distinct()
    return placed.withColumn("position", position.cast("long")).join(F.broadcast(wanted), "position", "left_semi").drop("part", "before", "position")


def largest_remainder(rows: DataFrame, key: str, mass: str, seats: int) -> DataFrame:
    """Share ``seats`` out in proportion to sqrt(mass), fractions to the largest remainders, ties by key."""
    all_rows = Window.partitionBy()
    quota = seats * F.sqrt(mass) / F.sum(F.sqrt(mass)).over(all_rows)
    out = rows.withColumn("quota", quota).withColumn("base", F.floor("quota")).withColumn("rest", F.col("quota") - F.col("base"))
    left = F.lit(seats) - F.sum("base").over(all_rows)
    place = F.row_number().over(Window.orderBy(F.desc("rest"), key))
    return out.select(key, mass, (F.col("base") + F.when(place <= left, 1).otherwise(0)).cast("long").alias("seats"))


def relabel_by_size(rows: DataFrame, label: str, minimum: int, tie: str = "id") -> DataFrame:
    """New labels from 0 by falling size, ties by the smallest id; groups below ``minimum`` get -1."""
    groups = rows.groupBy(label).agg(F.count("*").alias("n"), F.min(tie).alias("least")).where(F.col("n") >= minimum)
    named = groups.withColumn("region", F.row_number().over(Window.orderBy(F.desc("n"), "least")) - 1).select(label, "region")
    return rows.join(named, label, "left").withColumn("region", F.coalesce("region", F.lit(-1)))


def seeded_sample(rows: DataFrame, n: int, seed: int, key: str = "id", weight: str | None = None) -> DataFrame:
    """``n`` rows without replacement, reproducible; with ``weight`` by exponential keys -ln(u) / w."""
    bits = F.xxhash64(F.lit(seed), key).bitwiseAND(F.lit((1 << 53) - 1))
    u = (bits + 0.5) / float(1 << 53)
    order = u if weight is None else F.when(F.col(weight) > 0, -F.log(u) / F.when(F.col(weight) > 0, F.col(weight)))
    return rows.withColumn("draw", order).orderBy(F.col("draw").asc_nulls_last(), key).limit(n).drop("draw")


def running_minimum(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Add ``least``, the smallest value of the group so far."""
    return rows.withColumn("least", F.min(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def composite_layers(donors: DataFrame, keys: Sequence[str], stop: float = 1e-4) -> DataFrame:
    """Front-to-back compositing of donors (``depth``, ``alpha``, ``w``, ``r g b``, ``spacing``) per texel.

    The front donor opens a layer that takes in all within 0.75 of the
    smallest spacing behind it; the layer's colour is the weighted mean, its
    opacity the largest alpha. Layers add until less than ``stop`` of the
    light is left. One fold over the sorted donors of a texel.
    """
    item = F.struct("depth", "alpha", "w", "r", "g", "b", "spacing")
    sorted_rows = donors.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("d"))
    zero = F.lit(0.0)
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("front"), none.alias("depth"), F.lit(1.0).alias("light"), *[zero.alias(c) for c in ("r", "g", "b", "sw", "sr", "sg", "sb", "sa")], none.alias("near"))

    def closed(a: Column) -> dict[str, Column]:
        w = F.when(a["sw"] > 0, a["sw"])
        use = F.when((a["light"] > stop) & (a["sw"] > 0), a["light"] * a["sa"]).otherwise(0.0)
        return {"light": a["light"] - use, **{c: a[c] + use * F.coalesce(a["s" + c] / w, zero) for c in "rgb"}}

    def step(a: Column, x: Column) -> Column:
        same = a["front"].isNotNull() & (x["depth"] - a["front"] <= 0.75 * F.least(a["near"], x["spacing"]))
        done = closed(a)
        put = lambda old, new: F.when(same, old).otherwise(new)
        return F.struct(
            put(a["front"], x["depth"]).alias("front"),
            F.coalesce(a["depth"], x["depth"]).alias("depth"),
            put(a["light"], done["light"]).alias("light"),
            *[put(a[c], done[c]).alias(c) for c in "rgb"],
            put(a["sw"] + x["w"], x["w"]).alias("sw"),
            *[put(a["s" + c] + x["w"] * x[c], x["w"] * x[c]).alias("s" + c) for c in "rgb"],
            put(F.greatest(a["sa"], x["alpha"]), x["alpha"]).alias("sa"),
            put(F.least(a["near"], x["spacing"]), x["spacing"]).alias("near"),
        )

    def finish(a: Column) -> Column:
        done = closed(a)
        opaque = 1.0 - done["light"]
        shown = F.when(opaque > 0, opaque)
        return F.struct(*[(done[c] / shown).alias(c) for c in "rgb"], opaque.alias("alpha"), a["depth"].alias("depth"))

    return sorted_rows.select(*keys, F.aggregate("d", start, step, finish).alias("shown_")).select(*keys, "shown_.*")


def exact_quantiles(rows: DataFrame, value: str, shares: Sequence[float], accuracy: int = 10_000) -> list[float | None]:
    """Quantiles of a column, nulls apart, between the two nearest ranks; as ``percentile`` gives them, but no task holds all values.

    A sketch says between which values each rank lies, one count how many rows
    are below them, and only the rows between are put in order. Where a sketch
    was too narrow the bounds are widened, at last to all rows.
    """
    v = rows.select(F.col(value).cast("double").alias("v")).where("v is not null")
    n = v.count()
    if not n:
        return [None] * len(shares)
    at = [(n - 1) * float(q) for q in shares]
    found: dict[int, float] = {}
    margin = 2.0 / accuracy
    while open_ranks := sorted({r for p in at for r in (math.floor(p), math.ceil(p))} - set(found)):
        ends = [(r / n - margin, (r + 1) / n + margin) for r in open_ranks]
        asked = sorted({e for pair in ends for e in pair if 0 < e < 1})
        told = dict(zip(asked, v.agg(F.percentile_approx("v", asked, accuracy)).first()[0])) if asked else {}
        bounds = [tuple(told.get(e) for e in pair) for pair in ends]  # None: no bound on this side
        low = [F.lit(False) if a is None else F.col("v") < a for a, _ in bounds]
        high = [F.lit(False) if b is None else F.col("v") > b for _, b in bounds]
        below = v.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"b{i}") for i, c in enumerate(low)]).first()
        inside = F.filter(F.array(*[F.when(~(a | b), F.lit(i)) for i, (a, b) in enumerate(zip(low, high))]), lambda i: i.isNotNull())
        counts = v.withColumn("i", F.explode(inside)).groupBy("i", "v").agg(F.count("*").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
        target = F.element_at(F.array(*[F.lit(r - below[i]) for i, r in enumerate(open_ranks)]), F.col("i") + 1)
        hit = upto.where((F.col("upto") > target) & (F.col("upto") - F.col("n") <= target)).collect()  # one row a rank at most
        found |= {open_ranks[r["i"]]: r["v"] for r in hit}
        margin *= 8
    mix = lambda p: (math.ceil(p) - p) * found[math.floor(p)] + (p - math.floor(p)) * found[math.ceil(p)]
    return [found[int(p)] if p == math.floor(p) else mix(p) for p in at]
