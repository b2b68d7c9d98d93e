"""Distance joins, rewritten as equi-joins on cells with the exact test as residual."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthant.functions.scalar import Box
from orthant.storage import materialize, release

_NEAR = ("gi", "gj", "gk")


def _with_grid(df: DataFrame, width: float) -> DataFrame:
    for a, g in zip("xyz", _NEAR):
        df = df.withColumn(g, F.floor(F.col(a) / width).cast("long"))
    return df


def _around(df: DataFrame, width: float) -> DataFrame:
    """Each row once for its cell and each of the 26 around it."""
    df = _with_grid(df, width)
    for g in _NEAR:
        df = df.withColumn(g, F.explode(F.sequence(F.col(g) - 1, F.col(g) + 1)))
    return df


def distance(left: Sequence[str], right: Sequence[str]) -> Column:
    d = [F.col(a) - F.col(b) for a, b in zip(left, right)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def _reaching(df: DataFrame, width: float) -> DataFrame:
    """Each row once for every cell of which some place is at most ``width`` away, its own cell included."""
    gap = []
    for a, g in zip("xyz", _NEAR):
        low, slack = F.col(g) * width, F.abs(F.col(a)) * 1e-15  # what rounding may add
        gap.append(F.greatest(low - F.col(a) - slack, F.col(a) - (low + width) - slack, F.lit(0.0)))
    return _around(df, width).where(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] <= width * width)


#: Rows of either side in one block of a radius join, about; a task meets as many pairs as a block has.
BLOCK_ROWS = 4096
#: A cloud's join with itself takes so many times fewer points and more queries to a block: a query then finds some dozens at a time.
SHORT_RUNS = 16
#: Crowded cells up to this number are broadcast.
CROWDED_CELLS = 100_000


def radius_join(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Pairs (``id``, ``other_id``, ``d``) of a query and a point at most ``radius`` apart.

    Pairs grow with the square of the rows in a cell, so both sides of a cell
    with more than ``BLOCK_ROWS`` are cut into slices by hash, each slice of
    queries meets each slice of points in a block of its own, and blocks are
    dealt over as many tasks as the counted pairs need. No task meets more as a
    cell fills, and a join buffers one slice of points.

    Where both are one and the same DataFrame, a pair is met from one side and
    returned both ways: what a query finds in a block, then the same turned
    round. A file's packing meets each distance again close behind and
    keeps little more than half of them.
    """
    width = radius * 1.001 or 1.0  # a little wider: rounding moves no pair two cells apart
    itself = queries is points
    left = _reaching(queries.select("id", "x", "y", "z"), width)
    if itself:
        own, here = F.struct(*[F.floor(F.col(a) / width).cast("long").alias(g) for a, g in zip("xyz", _NEAR)]), F.struct(*_NEAR)
        left = left.where(own <= here).withColumn("same", own == here)
    right = _with_grid(points.select(F.col("id").alias("other_id"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), "x", "y", "z"), width).drop(*"xyz")
    asks, holds = (side.groupBy(*_NEAR).agg(F.count("*").alias(name)) for side, name in ((left, "asks"), (right, "holds")))
    cells = materialize(asks.join(holds, list(_NEAR)), "cells")
    most = {"asks": BLOCK_ROWS * SHORT_RUNS, "holds": max(1, BLOCK_ROWS // SHORT_RUNS)} if itself else {"asks": BLOCK_ROWS, "holds": BLOCK_ROWS}
    crowded = (F.col("asks") > most["asks"]) | (F.col("holds") > most["holds"])
    met = cells.agg(F.sum(F.col("asks").cast("double") * F.col("holds")).alias("pairs"), F.count_if(crowded).alias("crowded")).first()
    cuts = cells.where(crowded).select(*_NEAR, *[F.ceil(F.col(n) / most[n]).cast("int").alias(c) for n, c in (("asks", "lefts"), ("holds", "rights"))])
    cuts = F.broadcast(cuts) if met["crowded"] <= CROWDED_CELLS else cuts
    tasks = max(queries.sparkSession.sparkContext.defaultParallelism, int((1 + itself) * (met["pairs"] or 0) // BLOCK_ROWS**2) + 1)
    keys = [*_NEAR, "li", "ri"]

    def dealt(side: DataFrame, own: str, other: str, *row: str) -> DataFrame:
        parts = {c: F.coalesce(c + "s", F.lit(1)) for c in ("left", "right")}
        side = side.join(cuts, list(_NEAR), "left").withColumn(own[0] + "i", F.pmod(F.xxhash64(*row), parts[own]).cast("int"))
        return side.withColumn(other[0] + "i", F.explode(F.sequence(F.lit(0), parts[other] - 1))).drop("lefts", "rights").repartition(tasks, *keys)

    left = dealt(left, "left", "right", "id", "x", "y", "z")
    if itself:  # queries of one place come together, as they find much the same points
        left = left.sortWithinPartitions(*keys, *[F.floor(F.col(a) / (width / 8)) for a in "xyz"]).withColumn("turned", F.explode(F.array(F.lit(False), F.lit(True))))
    found = left.join(dealt(right, "right", "left", "other_id", "ox", "oy", "oz").hint("merge"), keys)
    found = found.withColumn("d", distance("xyz", ("ox", "oy", "oz"))).where(F.col("d") <= radius)
    if not itself:
        return found.select("id", "other_id", "d")
    # Within a cell both rows of a pair ask: the smaller one's find counts; equal rows find each other and are not turned.
    one, two = F.struct("x", "y", "z"), F.struct(F.col("ox").alias("x"), F.col("oy").alias("y"), F.col("oz").alias("z"))
    ranked = F.struct("id", one), F.struct(F.col("other_id").alias("id"), two)
    counts = F.when(F.col("id") < F.col("other_id"), True).when(F.col("id") > F.col("other_id"), False).otherwise((ranked[0] < ranked[1]) | (~F.col("turned") & (ranked[0] == ranked[1])))
    turn = lambda a, b: F.when(F.col("turned"), F.col(b)).otherwise(F.col(a)).alias(a)
    return found.where(~F.col("same") | counts).select(turn("id", "other_id"), turn("other_id", "id"), "d")


#: So many queries at most are compared with every point.
FEW_QUERIES = 64


def _first_width(points: DataFrame, count: int, extent: float, k: int, sample: int = 20_000) -> float:
    """Largest cell width at which a point shares its cell with about ``k`` others at most, judged by a sample of bounded size."""
    share = min(1.0, 0.9 * sample / count)
    part = points if share == 1.0 else points.where(F.xxhash64("id", "x", "y", "z").bitwiseAND(F.lit((1 << 30) - 1)) < int(share * (1 << 30)))
    xyz = part.select("x", "y", "z").limit(2 * sample).toPandas().to_numpy()  # the limit is far above what the share lets through
    xyz = np.unique(xyz + 0.0, axis=0)  # copies share a cell of any width
    width = extent / 2
    while len(xyz) > 1 and width > extent * 1e-12:
        cells = np.floor((xyz - xyz.min(axis=0)) / width).astype(np.int64)
        held = np.unique(cells, axis=0, return_counts=True)[1]
        if (held * (held - 1)).sum() / len(xyz) / share <= 0.6 * (k + 1):
            break
        width /= 2**0.5
    return width


#: Candidate pairs of a neighbour search that one task should meet, about.
TASK_PAIRS = 1_000_000


def _first_of_each(points: DataFrame, most: int) -> DataFrame:
    """Of the rows at one position those with the ``most`` smallest ids; none of the others can be among as many nearest."""
    order = Window.partitionBy(*[F.col(a) + 0.0 for a in "xyz"]).orderBy("id")
    return points.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most).drop("turn")


def nearest_neighbors(
    queries: DataFrame, points: DataFrame, k: int, *, exclude_self: bool = False, width: float | None = None, rounds: int = 60, places: bool = False
) -> DataFrame:
    """The exact ``k`` nearest points of each query: ``id``, ``rank`` (from 1), ``other_id``, ``d``.

    Ties go to the smaller id. A round joins each open query to the points of
    the 27 cells around it, which hold all points within one cell width; a
    query whose k-th distance is at most that is finished, the others go on
    with cells of twice the width. Dense places finish in small cells and
    sparse ones in large cells, so no single width has to serve both.
    Pairs are dealt by cell over as many tasks as there are queries for, and of
    points at one position only the first few take part (all points are at
    ``places`` of their own where the caller says so). Fewer than ``k`` rows come back only where there are fewer points; where
    ``rounds`` do not suffice for a given ``width``, that is an error.
    """
    points = points.select("id", "x", "y", "z")
    queries = queries.select("id", "x", "y", "z")
    own = None if places else materialize(_first_of_each(points, k + exclude_self), "points")
    points = points if own is None else own
    both = points.withColumn("asks", F.lit(0)).unionByName(queries.withColumn("asks", F.lit(1)))
    bounds = both.agg(*[F.min(a).alias(f"l{a}") for a in "xyz"], *[F.max(a).alias(f"h{a}") for a in "xyz"], F.sum("asks").alias("asks"), F.count("*").alias("n")).first()
    left = bounds["asks"] or 0
    count = bounds["n"] - left
    schema = "id long, rank int, other_id long, d double"
    if not count or bounds["lx"] is None:
        return points.sparkSession.createDataFrame([], schema)
    extent = max(bounds[f"h{a}"] - bounds[f"l{a}"] for a in "xyz")
    whole = 4 * extent + 1e-300
    width = width or (_first_width(points, count, extent, k) if extent else 1.0)
    done, open_queries, waiting = None, queries, None
    for _ in range(rounds):
        last = width >= whole or not extent
        tasks = max(1, -(-left * 16 * (k + 1) // TASK_PAIRS))
        right = _with_grid(points, width).withColumnsRenamed({"id": "other_id", "x": "ox", "y": "oy", "z": "oz"}).repartition(tasks, *_NEAR)
        around = _around(open_queries, width).repartition(tasks, *_NEAR)
        found = around.join(right.hint("merge"), list(_NEAR)).withColumn("d", distance("xyz", ("ox", "oy", "oz")))
        if exclude_self:
            found = found.where("id <> other_id")
        if not last:  # a query that takes in more than this is open
            found = found.where(F.col("d") <= width)
        order = Window.partitionBy("id").orderBy("d", "other_id")
        best = found.select("id", "other_id", "d").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = materialize(best.select("id", "rank", "other_id", "d"), "nearest")
        if last:
            settled = best
        else:
            full = best.groupBy("id").agg(F.max("d").alias("far"), F.count("*").alias("n")).where((F.col("n") == k) & (F.col("far") <= width)).select("id").hint("merge")
            settled = best.join(full, "id", "left_semi")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        rest, before = materialize(open_queries.join(full, "id", "left_anti"), "open"), waiting
        left, waiting = rest.count(), rest
        if before is not None:
            release(before)
        if not left:
            break
        open_queries, width = rest, width * 2
        if left <= FEW_QUERIES:  # lonely ones would need a round for each doubling; one pass over the points settles them
            named = F.broadcast(open_queries.select("id", *[F.col(a).alias("q" + a) for a in "xyz"]))
            pairs = points.withColumnRenamed("id", "other_id").join(named).withColumn("d", distance("xyz", ("qx", "qy", "qz")))
            if exclude_self:
                pairs = pairs.where("id <> other_id")
            best = pairs.select("id", "other_id", "d").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            done = done.unionByName(materialize(best.select("id", "rank", "other_id", "d"), "nearest"))
            break
    else:
        raise RuntimeError(f"{left} queries have not found their neighbours within {rounds} rounds from this width")
    if own is not None:
        release(own)
    return done.select("id", "rank", F.col("other_id"), "d")


def nearest_within(queries: DataFrame, points: DataFrame, reach: float, tasks: int, *, spread_points: bool = False) -> DataFrame:
    """The nearest point of each query that has one at most ``reach`` away: ``id``, ``d``, ``other_id``, ``ox``, ``oy``, ``oz``.

    Ties go to the smaller id. One join by cells, dealt over ``tasks``, and one
    minimum, however far the other queries are from all points. Queries go to
    the cells around theirs, or points do where the caller says they are fewer.
    """
    lay = (_with_grid, _around) if spread_points else (_around, _with_grid)
    left = lay[0](queries.select("id", "x", "y", "z"), reach).repartition(tasks, *_NEAR)
    right = lay[1](points.select(F.col("id").alias("other_id"), "x", "y", "z"), reach).withColumnsRenamed({"x": "ox", "y": "oy", "z": "oz"}).repartition(tasks, *_NEAR)
    found = left.join(right.hint("merge"), list(_NEAR)).withColumn("d", distance("xyz", ("ox", "oy", "oz"))).where(F.col("d") <= reach)
    return found.groupBy("id").agg(F.min(F.struct("d", "other_id", "ox", "oy", "oz")).alias("at")).select("id", "at.*")


#: Points of a cell that a search for any of them keeps together, about.
SLICE_POINTS = 50_000


def any_within(queries: DataFrame, points: DataFrame, width: float, count: int, tasks: int) -> DataFrame:
    """``id`` of the queries with any of the ``count`` points at most their own ``reach``, of ``width`` or less, away.

    A query stops at the first point that it meets in a cell. Points are dealt
    by cell and slice, as a few wide cells may hold them all.
    """
    slices = 1 + count // SLICE_POINTS
    keys = [*_NEAR, "slice"]
    left = _around(queries.select("id", "x", "y", "z", "reach"), width).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(tasks, *keys)
    right = _with_grid(points, width).select(*[F.col(g).alias("o" + g) for g in _NEAR], F.pmod(F.xxhash64("id", "x", "y", "z"), F.lit(slices)).cast("int").alias("oslice"), *[F.col(a).alias("o" + a) for a in "xyz"])
    met = distance("xyz", ("ox", "oy", "oz")) <= F.col("reach")
    for key in keys:
        met = met & (F.col(key) == F.col("o" + key))
    return left.join(right.repartition(tasks, *["o" + key for key in keys]).hint("merge"), met, "left_semi").select("id").distinct()


def nearest_spacing(points: DataFrame) -> DataFrame:
    """Distance of every row to the nearest other position; equal positions share it. Null for a single position."""
    from orthant.operators.cells import distinct_positions

    places = materialize(distinct_positions(points).withColumnRenamed("first_id", "id"), "positions")
    near = nearest_neighbors(places, places, 1, exclude_self=True, places=True).select("id", F.col("d").alias("spacing"))
    spaced = places.join(near, "id", "left").select(*[F.col(a).alias("p" + a) for a in "xyz"], "spacing")
    zero = {a: F.col(a) + 0.0 for a in "xyz"}
    same = [zero[a] == spaced["p" + a] for a in "xyz"]
    return points.join(spaced, same[0] & same[1] & same[2]).drop("px", "py", "pz")


def local_outliers(points: DataFrame, factor: float = 50.0, minimum: int = 20) -> DataFrame:
    """Positions whose third neighbour is over ``factor`` times as far as is usual among their nearest eight.

    Returns ``x y z`` and ``is_outlier`` per distinct position; none with
    fewer than ``minimum`` positions or a factor of 0.
    """
    from orthant.operators.cells import distinct_positions

    places = materialize(distinct_positions(points).withColumnRenamed("first_id", "id"), "positions")
    if factor == 0 or places.count() < minimum:
        return places.select("id", "x", "y", "z", F.lit(False).alias("is_outlier"))
    near = materialize(nearest_neighbors(places, places, 8, exclude_self=True, places=True), "near")
    third = near.where("rank = 3").select("id", F.col("d").alias("d3"))
    around = near.join(third.select(F.col("id").alias("other_id"), F.col("d3").alias("other_d3")), "other_id").groupBy("id").agg(F.median("other_d3").alias("usual"))
    flagged = places.join(third, "id", "left").join(around, "id", "left")
    return flagged.select("id", "x", "y", "z", F.coalesce(F.col("d3") > factor * F.col("usual"), F.lit(False)).alias("is_outlier"))


#: Boxes up to this number go to all executors; more meet the points by cells.
BROADCAST_BOXES = 4096


def box_points(boxes: DataFrame, points: DataFrame, tolerance: float, width: float | None = None) -> DataFrame:
    """Pairs (``box_id``, ``id``, ``d``) of a box and a point at most ``tolerance`` from its volume.

    Few boxes are broadcast. More are spread over the cells of their bounding
    boxes, of the given ``width`` or the mean extent, and meet the points there.
    """
    named = boxes.select("box_id", *[F.col(c).alias("b_" + c) for c in boxes.columns if c != "box_id"])
    box = Box("b_")
    near = box.distance()
    if boxes.count() <= BROADCAST_BOXES and width is None:
        return points.join(F.broadcast(named)).withColumn("d", near).where(F.col("d") <= tolerance).select("box_id", "id", "d")
    low = [F.col("b_c" + a) - box.half_extent(i) - tolerance for i, a in enumerate("xyz")]
    high = [F.col("b_c" + a) + box.half_extent(i) + tolerance for i, a in enumerate("xyz")]
    width = width or float(named.agg(F.avg(F.greatest(*[h - l for h, l in zip(high, low)]))).first()[0] or 1.0)
    for g, a, b in zip(_NEAR, low, high):
        named = named.withColumn(g, F.explode(F.sequence(F.floor(a / width), F.floor(b / width))))
    return _with_grid(points, width).join(named, list(_NEAR)).withColumn("d", near).where(F.col("d") <= tolerance).select("box_id", "id", "d")


def points_in_bounds(points: DataFrame, center: Sequence[float], half: Sequence[float]) -> DataFrame:
    """Points inside an axis-aligned box, faces included; a plain filter, so it reaches the scan."""
    for a, c, h in zip("xyz", center, half):
        points = points.where(F.col(a).between(c - h, c + h))
    return points


def nearest_box(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """The box whose surface is nearest to each point: ``id``, ``box_id``, ``d``, ties to the smaller box."""
    named = boxes.select("box_id", *[F.col(c).alias("b_" + c) for c in boxes.columns if c != "box_id"])
    if named.count() > BROADCAST_BOXES:
        raise ValueError(f"nearest_box takes at most {BROADCAST_BOXES} boxes")
    pairs = points.join(F.broadcast(named)).select("id", F.struct(Box("b_").surface_distance().alias("d"), "box_id").alias("at"))
    return pairs.groupBy("id").agg(F.min("at").alias("at")).select("id", "at.box_id", "at.d")


def nearest_triangle(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Distance of each point to a mesh: ``id``, ``tri_id``, ``d``; triangles are ``a b c`` arrays of 3."""
    from orthant.functions.scalar import triangle_distance_squared

    if triangles.count() > BROADCAST_BOXES * 12:
        raise ValueError("too many triangles for a broadcast join")
    corner = {k: [F.col(k)[i] for i in range(3)] for k in "abc"}
    squared = triangle_distance_squared([F.col(a) for a in "xyz"], corner["a"], corner["b"], corner["c"])
    pairs = points.join(F.broadcast(triangles)).select("id", F.struct(squared.alias("d2"), "tri_id").alias("at"))
    return pairs.groupBy("id").agg(F.min("at").alias("at")).select("id", "at.tri_id", F.sqrt("at.d2").alias("d"))


def segment_distance(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Distance of each point to the nearest of a few segments (``seg_id``, ``a``, ``b`` arrays of 3)."""
    from orthant.functions.scalar import segment_distance_squared

    squared = segment_distance_squared([F.col(a) for a in "xyz"], [F.col("a")[i] for i in range(3)], [F.col("b")[i] for i in range(3)])
    if segments.count() > BROADCAST_BOXES:
        raise ValueError("too many segments for a broadcast join")
    return points.join(F.broadcast(segments)).groupBy("id").agg(F.sqrt(F.min(squared)).alias("d"))
