"""Evaluation cells: spatial weights, representatives, components, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthant.functions.scalar import snapped_cell
from orthant.operators.graph import connected_components

CELL = ("ci", "cj", "ck")


def with_cells(points: DataFrame, width: float, origin: Sequence[float] | None = None, names: Sequence[str] = CELL) -> DataFrame:
    """Add the snapped cell of each point; the origin is the cloud's minimum unless given."""
    if origin is None:
        low = F.broadcast(points.agg(*[F.min(a).alias(f"low_{a}") for a in "xyz"]))  # one row
        out = points.join(low)
        for a, name in zip("xyz", names):
            out = out.withColumn(name, snapped_cell(F.col(a), F.col(f"low_{a}"), F.lit(width)))
        return out.drop("low_x", "low_y", "low_z")
    for a, name, o in zip("xyz", names, origin):
        points = points.withColumn(name, snapped_cell(F.col(a), F.lit(float(o)), F.lit(width)))
    return points


def distinct_positions(points: DataFrame, id_column: str = "id") -> DataFrame:
    """Each position once: ``x y z``, its smallest id and its number of rows."""
    zero = [(F.col(a) + 0.0).alias(a) for a in "xyz"]  # -0.0 and 0.0 are one position
    return points.select(id_column, *zero).groupBy("x", "y", "z").agg(F.min(id_column).alias("first_id"), F.count("*").alias("n"))


def cell_counts(points: DataFrame, width: float, origin: Sequence[float] | None = None) -> DataFrame:
    return with_cells(points, width, origin).groupBy(*CELL).agg(F.count("*").alias("n"))


def spatial_weights(points: DataFrame, width: float, rows: str | None = None) -> DataFrame:
    """Add ``weight``: one over the rows of the point's cell, scaled to a mean of 1.

    The mean of 1/n over all rows is the number of cells over the number of
    rows, so two counts replace a second pass over the points. Where ``rows``
    names a column, a point stands for so many rows and has the weight of all.
    """
    celled = with_cells(points, width)
    counts = celled.groupBy(*CELL).agg((F.sum(rows) if rows else F.count("*")).alias("cell_n"))
    total = F.broadcast(counts.agg(F.sum("cell_n").alias("rows_n"), F.count("*").alias("cells_n")))  # one row
    out = celled.join(counts, list(CELL)).join(total)
    weight = (F.col("rows_n") / F.col("cells_n")) / F.col("cell_n")
    return out.withColumn("weight", weight * F.col(rows) if rows else weight).drop("cell_n", "rows_n", "cells_n")


def half_offsets(reach: int = 1, dimensions: int = 3, most: int | None = None) -> list[tuple[int, ...]]:
    """Offsets to neighbouring cells, one of each opposite pair; ``most`` bounds the sum of steps (1: faces only)."""
    from itertools import product

    every = [o for o in product(range(-reach, reach + 1), repeat=dimensions) if any(o)]
    every = [o for o in every if most is None or sum(map(abs, o)) <= most]
    return [o for o in every if o > tuple(-x for x in o)]


def cell_adjacency(cells: DataFrame, names: Sequence[str] = CELL, keys: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """Pairs of occupied cells that touch, as structs ``src`` and ``dst``: an equi-join on shifted cells.

    ``keys`` are columns that both must share (a layer, for instance).
    """
    steps = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(names, o)]) for o in half_offsets(1, len(names), most)])
    own = cells.select(*keys, *names).distinct()
    ring = own.withColumn("step", F.explode(steps))
    ring = ring.select(F.struct(*keys, *names).alias("src"), *keys, *[(F.col(n) + F.col("step")[n]).alias(n) for n in names])
    return ring.join(own.withColumn("dst", F.struct(*keys, *names)), [*keys, *names]).select("src", "dst")


def cell_components(cells: DataFrame, names: Sequence[str] = CELL, keys: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """Each occupied cell with ``component``, the smallest cell that touching cells lead to."""
    own = cells.select(*keys, *names).distinct().withColumn("cell", F.struct(*keys, *names))
    found = connected_components(cell_adjacency(cells, names, keys, most))
    out = own.join(found, own["cell"] == found["node"], "left")
    return out.select(*keys, *names, F.coalesce("component", "cell").alias("component"))


def largest_patch(points: DataFrame, width: float, origin: Sequence[float] | None = None) -> DataFrame:
    """Rows of the largest group of points in touching cells."""
    counts = cell_counts(points, width, origin)
    return counts.join(cell_components(counts), list(CELL)).groupBy("component").agg(F.sum("n").alias("n")).agg(F.max("n").alias("largest"))


def component_coverage(points: DataFrame, covered: Column, weight: str = "weight", component: str = "component") -> DataFrame:
    """Weighted share of covered rows per component; 0 where a component weighs nothing."""
    mass = F.sum(weight)
    part = F.sum(F.when(covered, F.col(weight)).otherwise(0.0))
    return points.groupBy(component).agg(F.when(mass > 0, part / F.when(mass > 0, mass)).otherwise(0.0).alias("coverage"))


def spatial_representatives(points: DataFrame, width: float, origin: Sequence[float], id_column: str = "id") -> DataFrame:
    """The point of each cell that is nearest to the cell's centre, ties to the smaller id."""
    celled = with_cells(points, width, origin)
    gap = [F.col(a) - (o + (F.col(c) + 0.5) * width) for a, o, c in zip("xyz", origin, CELL)]
    far = gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]
    best = celled.groupBy(*CELL).agg(F.min(F.struct(far.alias("far"), F.col(id_column).alias("id"))).alias("best"))
    return best.select(*CELL, F.col("best.id").alias(id_column))


def representatives_within(points: DataFrame, maximum: int, id_column: str = "id", rounds: int = 40) -> DataFrame:
    """Representatives of the finest cells that give at most ``maximum`` of them, by bisection on the width.

    Where there are no more positions than that, each gets one, however many
    rows repeat it; positions closer than 1 / 2**40 of the extent may share one.
    """
    bounds = points.agg(*[F.min(a).alias(f"l{a}") for a in "xyz"], *[F.max(a).alias(f"h{a}") for a in "xyz"], F.count("*").alias("n")).first()
    origin = [bounds[f"l{a}"] for a in "xyz"]
    if not bounds["n"]:
        return points.select(id_column)
    extent = max(bounds[f"h{a}"] - bounds[f"l{a}"] for a in "xyz") or 1.0
    places = points.select(*[(F.col(a) + 0.0).alias(a) for a in "xyz"]).distinct().count()
    low, high = 0.0, extent * 2
    for _ in range(rounds):
        middle = high / 8 if low == 0 else (low + high) / 2
        cells = with_cells(points, middle, origin).select(*CELL).distinct().count()
        low, high = (middle, high) if cells > maximum else (low, middle)
        if cells <= maximum and (cells >= 0.95 * maximum or cells == places):
            break
        if high <= extent * 2.0**-40:  # finer cells have no whole numbers
            break
    return spatial_representatives(points, high, origin, id_column).select(id_column)


def weighted_quantile_split(points: DataFrame, value: str, weight: str, share: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """First value at which the running weight reaches ``share`` of the total, per group."""
    order = Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*keys)
    reached = points.withColumn("running", F.sum(weight).over(order)).withColumn("total", F.sum(weight).over(total))
    return reached.where(F.col("running") >= share * F.col("total")).groupBy(*keys).agg(F.min(value).alias("split"))
