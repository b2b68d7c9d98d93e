"""Sparse voxel grids: occupancy, morphology, integral images, containment.

A grid is a DataFrame of occupied cells ``i j k``. Morphology with a cube
works axis by axis, so a reach of n costs 3 (2n+1) rows a voxel, not (2n+1)^3.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthant.functions.scalar import Box, quaternion_rotation, splat_radii
from orthant.operators.graph import connected_components

IJK = ("i", "j", "k")


def occupancy(points: DataFrame, width: float, origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    return points.select(*[F.floor((F.col(a) - o) / width).cast("long").alias(c) for a, o, c in zip("xyz", origin, IJK)]).distinct()


def dilate(voxels: DataFrame, layers: int) -> DataFrame:
    """All cells at most ``layers`` away on every axis."""
    out = voxels.select(*IJK)
    for c in IJK:
        out = out.withColumn(c, F.explode(F.sequence(F.col(c) - layers, F.col(c) + layers))).distinct()
    return out


def erode(voxels: DataFrame, layers: int) -> DataFrame:
    """Cells whose whole neighbourhood of ``layers`` is occupied; outside the grid is empty.

    Along one axis that is a cell at least ``layers`` away from both ends of
    its run, found by numbering the cells of each line.
    """
    out = voxels.select(*IJK).distinct()
    for c in IJK:
        others = [o for o in IJK if o != c]
        run = F.col(c) - F.row_number().over(Window.partitionBy(*others).orderBy(c))
        out = out.withColumn("run", run)
        ends = Window.partitionBy(*others, "run")
        out = out.withColumn("low", F.min(c).over(ends)).withColumn("high", F.max(c).over(ends))
        out = out.where((F.col(c) - F.col("low") >= layers) & (F.col("high") - F.col(c) >= layers)).select(*IJK)
    return out


def clearance(voxels: DataFrame) -> DataFrame:
    """Chessboard depth of each cell: how many layers of erosion it survives, plus one.

    One round a layer until nothing is left; each round's cells are written, so
    the plan of a deep solid does not grow.
    """
    from orthant.storage import materialize, release

    level, rest, done = 0, materialize(voxels.select(*IJK).distinct(), "clearance"), []
    while not rest.isEmpty():
        level += 1
        inner = materialize(erode(rest, 1), "clearance")
        done.append(materialize(rest.join(inner, list(IJK), "left_anti").withColumn("clearance", F.lit(level).cast("long")), "layer"))
        release(rest)
        rest = inner
    return reduce(DataFrame.unionByName, done) if done else rest.withColumn("clearance", F.lit(0).cast("long"))


def euclidean_band(voxels: DataFrame, radius: float, width: float = 1.0) -> DataFrame:
    """All cells whose centre is at most ``radius`` from the centre of an occupied one."""
    reach = radius / width + 1e-7
    n = int(math.floor(reach))
    ball = [(a, b, c) for a in range(-n, n + 1) for b in range(-n, n + 1) for c in range(-n, n + 1) if a * a + b * b + c * c <= reach * reach]
    steps = F.array(*[F.struct(*[F.lit(v).cast("long").alias(x) for v, x in zip(o, IJK)]) for o in ball])
    out = voxels.select(*IJK, F.explode(steps).alias("s"))
    return out.select(*[(F.col(c) + F.col("s")[c]).alias(c) for c in IJK]).distinct()


def bounding_grid(voxels: DataFrame, pad: int = 0) -> DataFrame:
    """Every cell of the bounding box, made from one row of bounds."""
    grid = voxels.agg(*[F.min(c).alias(f"l{c}") for c in IJK], *[F.max(c).alias(f"h{c}") for c in IJK]).where("li is not null")
    for c in IJK:
        grid = grid.withColumn(c, F.explode(F.sequence(F.col(f"l{c}") - pad, F.col(f"h{c}") + pad))).repartition(*[x for x in IJK[: IJK.index(c) + 1]])
    return grid.select(*IJK)


def complement(voxels: DataFrame, pad: int = 0) -> DataFrame:
    return bounding_grid(voxels, pad).join(voxels.select(*IJK), list(IJK), "left_anti")


def label_components(voxels: DataFrame, *, faces_only: bool = True, minimum: int = 1) -> DataFrame:
    """Cells with ``component`` (its smallest cell), by shared faces or by any touch; small ones dropped."""
    from orthant.operators.cells import cell_components

    out = cell_components(voxels, IJK, most=1 if faces_only else None)
    if minimum > 1:
        large = out.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= minimum).select("component")
        out = out.join(large, "component", "left_semi")
    return out.select(*IJK, "component")


def _empty_runs(voxels: DataFrame) -> DataFrame:
    """Runs ``i j low high`` of empty cells along k, within the bounds and one cell around them.

    They are the gaps between a line's occupied cells and its two ends, so
    their number follows the lines and the occupied cells, not the volume.
    """
    own = voxels.select(*IJK).distinct()
    ends = own.agg(*[F.min(c).alias(f"l{c}") for c in IJK], *[F.max(c).alias(f"h{c}") for c in IJK]).where("li is not null")
    lines = ends.withColumn("i", F.explode(F.sequence(F.col("li") - 1, F.col("hi") + 1))).repartition("i")
    lines = lines.withColumn("j", F.explode(F.sequence(F.col("lj") - 1, F.col("hj") + 1)))
    border = lines.select("i", "j", F.explode(F.array(F.col("lk") - 2, F.col("hk") + 2)).alias("k"))
    before = F.lag("k").over(Window.partitionBy("i", "j").orderBy("k"))
    gaps = own.unionByName(border).select("i", "j", (before + 1).alias("low"), (F.col("k") - 1).alias("high"))
    return gaps.where("low <= high")


def fill_holes(voxels: DataFrame) -> DataFrame:
    """Add the empty cells that the outside cannot reach through touching empty cells.

    Empty cells are followed as runs along k, not one by one: two runs in
    neighbouring lines touch where they overlap or meet at a corner.
    """
    runs = _empty_runs(voxels)
    runs = runs.withColumn("node", F.struct("i", "j", "low"))
    steps = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    left = runs.select(F.col("node").alias("src"), "low", "high", "i", "j", F.explode(steps).alias("s"))
    left = left.select("src", "low", "high", (F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"))
    right = runs.select(F.col("node").alias("dst"), F.col("low").alias("l2"), F.col("high").alias("h2"), "i", "j")
    edges = left.join(right, ["i", "j"]).where((F.col("low") <= F.col("h2") + 1) & (F.col("l2") <= F.col("high") + 1)).select("src", "dst")
    named = runs.join(connected_components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    bounds = voxels.agg(*[F.min(c).alias(f"l{c}") for c in IJK]).first()
    if bounds["li"] is None:
        return voxels.select(*IJK)
    # The padded corner is empty, so its run is of the outside, and its node the smallest one of all.
    corner = F.struct(*[F.lit(bounds[f"l{c}"] - 1).alias(c) for c in ("i", "j")], F.lit(bounds["lk"] - 1).alias("low"))
    holes = named.where(F.col("component") != corner).select("i", "j", F.explode(F.sequence("low", "high")).alias("k"))
    return voxels.select(*IJK).distinct().unionByName(holes)


def reconstruct(observed: DataFrame, layers: int, minimum: int = 16) -> DataFrame:
    """Solid interior: dilate, fill enclosed voids, erode one layer more, keep face-connected parts of some size."""
    solid = erode(fill_holes(dilate(observed, layers)), layers + 1)
    return label_components(solid, minimum=minimum).select(*IJK)


def safe_region(observed: DataFrame, interior: DataFrame) -> DataFrame:
    """Cells that a cuboid may use: observed or interior."""
    return observed.select(*IJK).unionByName(interior.select(*IJK)).distinct()


def voxel_counts(**layers: DataFrame) -> DataFrame:
    """One row with the number of distinct cells of each named layer, and of the cells that all of them share (``shared``)."""
    names = list(layers)
    marked = reduce(DataFrame.unionByName, [v.select(*IJK, *[F.lit(int(n == m)).alias(m) for m in names]) for n, v in layers.items()])
    own = marked.groupBy(*IJK).agg(*[F.max(n).alias(n) for n in names])
    both = F.least(*names) if len(names) > 1 else F.col(names[0])
    return own.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names], F.coalesce(F.sum(both), F.lit(0)).cast("long").alias("shared"))


def turned_cells(safe: DataFrame, frame: Sequence[Sequence[float]]) -> DataFrame:
    """Cells ``i j k`` of the lattice along the columns of ``frame`` whose world bounds hold safe cells only.

    Both lattices have cells of the same width and their origin in common. Safe
    cells propose the turned cells in which their centres fall and those
    around; a turned cell meets the cells of its world bounds in one equi-join
    and stays where it finds them all.
    """
    turn = [[float(v) for v in row] for row in frame]
    along = lambda v, w: v[0] * w[0] + v[1] * w[1] + v[2] * w[2]
    centre = [F.col(c) + 0.5 for c in IJK]
    own = safe.select(*IJK).distinct()
    proposed = own.select(*[F.floor(along(centre, [turn[a][j] for a in range(3)])).cast("long").alias(c) for j, c in enumerate(IJK)]).distinct()
    proposed = dilate(proposed, 1)
    half = [sum(abs(v) for v in row) / 2 for row in turn]
    world = [along(centre, row) for row in turn]
    need, out = F.lit(1).cast("long"), proposed.select(F.struct(*IJK).alias("cell"), *[F.floor(w - h + 1e-9).cast("long").alias("l" + c) for w, h, c in zip(world, half, IJK)], *[F.ceil(w + h - 1e-9).cast("long").alias("h" + c) for w, h, c in zip(world, half, IJK)])
    for c in IJK:
        need = need * (F.col("h" + c) - F.col("l" + c))
    out = out.withColumn("need", need)
    for c in IJK:
        out = out.withColumn(c, F.explode(F.sequence(F.col("l" + c), F.col("h" + c) - 1)))
    full = out.join(own, list(IJK)).groupBy("cell", "need").agg(F.count("*").alias("n")).where("n = need")
    return full.select("cell.*")


def integral_image(voxels: DataFrame, shape: Sequence[int]) -> DataFrame:
    """``i j k`` from 0 to the shape with ``total``, the occupied cells below the corner on all axes.

    Three running sums, one per axis; lines of different axes are independent.
    """
    spark = voxels.sparkSession
    grid = spark.range(shape[0] + 1).select(F.col("id").alias("i"))
    grid = grid.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(shape[1])).cast("array<long>"))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(shape[2])).cast("array<long>")))
    shifted = voxels.select(*[(F.col(c) + 1).alias(c) for c in IJK], F.lit(1).cast("long").alias("one"))
    out = grid.join(shifted, list(IJK), "left").withColumn("total", F.coalesce("one", F.lit(0)).cast("long"))
    for c in IJK:
        line = Window.partitionBy(*[o for o in IJK if o != c]).orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("total", F.sum("total").over(line))
    return out.select(*IJK, "total")


def box_sums(image: DataFrame, boxes: DataFrame) -> DataFrame:
    """Occupied cells in half-open index boxes (``box_id, i0 j0 k0 i1 j1 k1``) from eight corners each."""
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (0, 1) for b in (0, 1) for c in (0, 1)])
    at = boxes.withColumn("s", F.explode(corners))
    for name, bit in zip(IJK, "abc"):
        at = at.withColumn(name, F.when(F.col("s")[bit] == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0")).cast("long"))
    sign = F.when((F.col("s.a") + F.col("s.b") + F.col("s.c")) % 2 == 1, 1).otherwise(-1)
    return at.join(image, list(IJK)).groupBy("box_id").agg(F.sum(sign * F.col("total")).alias("n"))


def overlap_volume(voxels: DataFrame, boxes: DataFrame, width: float) -> DataFrame:
    """Exact volume of voxels inside axis-aligned boxes (``box_id, x0 .. z1``), summed per box."""
    part = []
    for a, c in zip("xyz", IJK):
        part.append(F.greatest(F.lit(0.0), F.least((F.col(c) + 1) * width, F.col(f"{a}1")) - F.greatest(F.col(c) * width, F.col(f"{a}0"))))
    pairs = voxels.join(F.broadcast(boxes))  # candidates of one round
    return pairs.groupBy("box_id").agg(F.sum(part[0] * part[1] * part[2]).alias("inside"))


def exterior_fraction(voxels: DataFrame, boxes: DataFrame, width: float) -> DataFrame:
    """Share of each axis-aligned box that lies outside the occupied voxels."""
    volume = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * (F.col("z1") - F.col("z0"))
    joined = boxes.join(overlap_volume(voxels, boxes, width), "box_id", "left")
    return joined.select("box_id", F.when(volume > 0, 1.0 - F.coalesce("inside", F.lit(0.0)) / F.when(volume > 0, volume)).otherwise(0.0).alias("exterior"))


def box_overlaps_voxel(width: float, epsilon: float = 0.0, prefix: str = "b_") -> Column:
    """Separating-axis test of a box against the voxel ``i j k``: 15 axes, touching is no overlap."""
    h = width / 2.0
    centre = [(F.col(c) + 0.5) * width - F.col(f"{prefix}c{a}") for a, c in zip("xyz", IJK)]
    half = [F.col(f"{prefix}d{a}") / 2.0 for a in "xyz"]
    r = [[F.col(f"{prefix}r{i}{j}") for j in range(3)] for i in range(3)]
    tests = []
    for i in range(3):  # world axes
        tests.append(F.abs(centre[i]) < h + reduce(lambda s, t: s + t, [F.abs(r[i][j]) * half[j] for j in range(3)]) - epsilon)
    for j in range(3):  # box axes
        gap = F.abs(reduce(lambda s, t: s + t, [centre[i] * r[i][j] for i in range(3)]))
        tests.append(gap < half[j] + h * reduce(lambda s, t: s + t, [F.abs(r[i][j]) for i in range(3)]) - epsilon)
    for i in range(3):  # world axis i x box axis j
        a, b = (i + 1) % 3, (i + 2) % 3
        for j in range(3):
            # e_i x r_j has components 0 at i, -r[b][j] at a, r[a][j] at b
            na, nb = -r[b][j], r[a][j]
            length = na * na + nb * nb
            reach_voxel = h * (F.abs(na) + F.abs(nb))
            reach_box = reduce(lambda s, t: s + t, [half[m] * F.abs(na * r[a][m] + nb * r[b][m]) for m in range(3)])
            gap = F.abs(centre[a] * na + centre[b] * nb)
            tests.append((length <= 1e-24) | (gap < reach_voxel + reach_box - epsilon * F.sqrt(length)))
    return reduce(lambda s, t: s & t, tests)


def box_voxels(boxes: DataFrame, width: float) -> DataFrame:
    """Candidate voxels of each box: all cells of its axis-aligned bounds, with the box as ``b_`` columns."""
    out = boxes.select("box_id", *[F.col(c).alias("b_" + c) for c in boxes.columns if c != "box_id"])
    box = Box("b_")
    for i, (a, c) in enumerate(zip("xyz", IJK)):
        low = F.floor((F.col("b_c" + a) - box.half_extent(i)) / width)
        high = F.floor((F.col("b_c" + a) + box.half_extent(i)) / width)
        out = out.withColumn(c, F.explode(F.sequence(low, high)))
    return out


def certify_boxes(boxes: DataFrame, safe: DataFrame, width: float, *, strict: bool = False) -> DataFrame:
    """``box_id``, ``certified``: no part of the box lies in a voxel that is not safe.

    Only the box's own voxels are enumerated; those in the safe set drop out
    by an anti-join, and any of the rest that the box overlaps rejects it.
    """
    epsilon = 0.0 if strict else 1e-8 * width
    bad = box_voxels(boxes, width).join(safe.select(*IJK), list(IJK), "left_anti").where(box_overlaps_voxel(width, epsilon)).select("box_id").distinct()
    return boxes.select("box_id").join(bad.withColumn("bad", F.lit(True)), "box_id", "left").select("box_id", F.col("bad").isNull().alias("certified"))


def rasterize_ellipsoids(splats: DataFrame, width: float, sigma: float = 3.0) -> DataFrame:
    """Voxels whose centre lies inside a splat: ``x y z``, ``qw qx qy qz``, ``sx sy sz`` (scales)."""
    r = quaternion_rotation(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    scales = [F.col(c) for c in ("sx", "sy", "sz")]
    radii = splat_radii(r, scales, sigma)
    out = splats.select("*", *[v.alias(f"m{i}{j}") for i, row in enumerate(r) for j, v in enumerate(row)], *[v.alias(f"rad{i}") for i, v in enumerate(radii)])
    for i, (a, c) in enumerate(zip("xyz", IJK)):
        out = out.withColumn(c, F.explode(F.sequence(F.floor((F.col(a) - F.col(f"rad{i}")) / width), F.floor((F.col(a) + F.col(f"rad{i}")) / width))))
    d = [(F.col(c) + 0.5) * width - F.col(a) for a, c in zip("xyz", IJK)]
    metric = F.lit(0.0)
    for j, s in enumerate(scales):
        q = reduce(lambda u, v: u + v, [d[i] * F.col(f"m{i}{j}") for i in range(3)]) / s
        metric = metric + q * q
    return out.where(metric <= sigma * sigma).select(*IJK).distinct()
