"""Growing certified boxes face by face to the farthest place that stays within safe cells.

How far a face can move is not searched but solved: on each separating axis of
a box and a cell, both the gap and the reach are linear in the way the face
goes, so a cell that is not safe gives the one distance at which the box
begins to overlap it. The least of these over the cells in the face's path is
how far the box may grow; a face takes one join and one aggregate for all boxes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthant.functions.scalar import AXES
from orthant.operators.voxel import IJK, box_voxels
from orthant.storage import materialize, release

GEOMETRY = ("cx", "cy", "cz", "dx", "dy", "dz", *[f"r{i}{j}" for i in range(3) for j in range(3)])
#: Growth is a multiple of the longest way divided by this, what twelve halvings would resolve.
STEPS = 1 << 12
#: Overlaps up to this share of a voxel are touching.
TOUCH = 1e-8
SHARES = (0.0, 0.25, 0.5, 0.75, 1.0)


def _dot(a: list, b: list) -> Column:
    return reduce(lambda s, t: s + t, [x * y for x, y in zip(a, b)])


def separating_axes(width: float) -> Column:
    """The 15 axes of a box against voxels, with what of them does not depend on the voxel.

    Of each axis ``n0 n1 n2``: ``p``, the part of the way ``v0 v1 v2`` along
    it (turned so that it is not negative), ``reach`` of box and voxel, and
    ``hold``, by so much less that faces in one plane do not overlap for rounding.
    """
    half = [F.col("d" + a) / 2.0 for a in AXES]
    sides = [[F.col(f"r{i}{j}") for i in range(3)] for j in range(3)]  # axis j of the box
    way = [F.col(f"v{i}") for i in range(3)]
    axes = [[F.lit(1.0 if i == k else 0.0) for i in range(3)] for k in range(3)] + sides
    for k in range(3):
        for side in sides:
            a, b = (k + 1) % 3, (k + 2) % 3
            cross = [F.lit(0.0)] * 3
            cross[a], cross[b] = -side[b], side[a]
            axes.append(cross)
    out = []
    for n in axes:
        p = _dot(way, n)
        reach = width / 2.0 * reduce(lambda s, t: s + t, [F.abs(x) for x in n]) + _dot(half, [F.abs(_dot(side, n)) for side in sides])
        turn = F.when(p < 0, -1.0).otherwise(1.0)
        out.append(F.struct(*[(turn * x).alias(f"n{i}") for i, x in enumerate(n)], F.abs(p).alias("p"), reach.alias("reach"), (reach - TOUCH * width * F.sqrt(_dot(n, n))).alias("hold"), (_dot(n, n) > 1e-18).alias("there")))
    return F.filter(F.array(*out), lambda n: n["there"])  # the product of parallel edges is no axis


def meeting_distance(width: float, axes: str = "axes", center: tuple[str, str, str] = ("cx", "cy", "cz")) -> Column:
    """How far the face may move before the box overlaps the voxel ``i j k``; null if never.

    With g the gap of the centres along an axis, the two overlap on it while g
    is above the reach below zero and the way's part above g less the reach.
    """
    gap = [(F.col(c) + 0.5) * width - F.col(o) for c, o in zip(IJK, center)]

    def begin(n: Column) -> Column:
        g = gap[0] * n["n0"] + gap[1] * n["n1"] + gap[2] * n["n2"]
        moving = F.when(g > -n["hold"], F.greatest(F.lit(0.0), (g - n["reach"]) / n["p"]))
        return F.when(n["p"] > 1e-12, moving).otherwise(F.when(F.abs(g) < n["hold"], 0.0))

    begins = F.transform(axes, begin)
    return F.when(~F.exists(begins, lambda x: x.isNull()), F.array_max(begins))


def _moved(boxes: DataFrame, distance: Column) -> DataFrame:
    """``boxes`` with the face ``face`` (an axis) along ``v0 v1 v2`` moved outward by ``distance``."""
    out = boxes.withColumn("moved", distance)
    out = out.withColumns({f"c{a}": F.col(f"c{a}") + F.col("moved") / 2.0 * F.col(f"v{i}") for i, a in enumerate(AXES)})
    return out.withColumns({f"d{a}": F.when(F.col("face") == j, F.col(f"d{a}") + F.col("moved")).otherwise(F.col(f"d{a}")) for j, a in enumerate(AXES)}).drop("moved")


def _way(axis: Column, sign: Column | float) -> dict[str, Column]:
    """Columns ``face``, ``v0``, ``v1`` and ``v2`` of the side along box axis ``axis`` that looks to ``sign``."""
    pick = lambda i: reduce(lambda rest, j: F.when(axis == j, F.col(f"r{i}{j}")).otherwise(rest), (1, 2), F.col(f"r{i}0"))
    return {"face": axis, **{f"v{i}": sign * pick(i) for i in range(3)}}


def _reach(faced: DataFrame, voxels: DataFrame, width: float, farthest: float) -> DataFrame:
    """``faced`` (boxes with a unique ``box_id`` and the columns of ``_way``) with ``way``, how far that face may move."""
    step = farthest / STEPS
    swept = box_voxels(_moved(faced, F.lit(float(farthest))).select("box_id", *GEOMETRY), width).select("box_id", *IJK)
    blocked = swept.join(voxels, list(IJK), "left_anti")
    own = faced.select("box_id", "cx", "cy", "cz", separating_axes(width).alias("axes"))
    ends = blocked.join(own, "box_id").groupBy("box_id").agg(F.min(meeting_distance(width)).alias("way"))
    way = F.least(F.coalesce(F.col("way"), F.lit(float(farthest))), F.lit(float(farthest)))
    return faced.join(ends, "box_id", "left").withColumn("way", F.least(F.floor(way / step + 1e-9), F.lit(STEPS - 1)) * step)


def extended(boxes: DataFrame, safe: DataFrame, width: float, farthest: float) -> DataFrame:
    """Six boxes for each of ``boxes``: ``box_id``, ``face`` (axis), ``sign`` and the geometry with this one face moved as far as it may.

    All faces of all boxes take one join and one aggregate.
    """
    faces = F.array(*[F.struct(F.lit(j).alias("axis"), F.lit(s).alias("sign")) for j in range(3) for s in (-1.0, 1.0)])
    faced = boxes.select("box_id", *[F.col(c).cast("double").alias(c) for c in GEOMETRY], F.explode(faces).alias("at"))
    faced = faced.withColumns({**_way(F.col("at.axis"), F.col("at.sign")), "of": F.col("box_id"), "box_id": F.struct("box_id", "at")})
    found = _reach(materialize(faced, "faces"), safe.select(*IJK), width, farthest)
    return _moved(found, F.col("way")).select(F.col("of").alias("box_id"), "face", F.col("at.sign").alias("sign"), *GEOMETRY)


def grow_certified(boxes: DataFrame, safe: DataFrame, width: float, farthest: float, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``boxes`` (``box_id`` and geometry) with their six faces moved outward as far as they stay within ``safe`` (``i j k``).

    The axis along which a box is longest goes first, its lower side before
    its upper one. No face moves beyond ``farthest``. Cells that are not in
    ``safe`` may not be overlapped; touching is no overlap. Growth is rounded
    down to ``farthest / STEPS``. A box that already overlaps such a cell
    stays as it is. With ``score`` (trials with ``box_id`` and geometry ->
    ``box_id``, ``score``) a face takes the best of five shares of its way,
    the least of equal ones.
    """
    by_length = F.array_sort(F.array(*[F.struct((-F.col(f"d{a}")).alias("size"), F.lit(j).alias("axis")) for j, a in enumerate(AXES)]))
    state = materialize(boxes.select("box_id", *[F.col(c).cast("double").alias(c) for c in GEOMETRY]).withColumn("order", by_length), "growth")
    voxels = safe.select(*IJK)
    for turn in range(6):
        faced = state.withColumns(_way(F.col("order")[turn // 2]["axis"], 1.0 if turn % 2 else -1.0))
        grown = _reach(faced, voxels, width, farthest)
        if score is None:
            moved = _moved(grown, F.col("way"))
        else:
            grown = materialize(grown, "grown")
            trials = _moved(grown.withColumn("share", F.explode(F.array(*map(F.lit, SHARES)))), F.col("way") * F.col("share"))
            trials = materialize(trials.withColumns({"of": F.col("box_id"), "box_id": F.struct("box_id", "share")}), "trials")
            scored = trials.select("of", F.col("box_id").alias("trial"), F.col("box_id.share").alias("share")).join(
                score(trials.select("box_id", *GEOMETRY)).withColumnRenamed("box_id", "trial"), "trial"
            )
            best = scored.groupBy("of").agg(F.min_by("share", F.struct(-F.col("score"), F.col("share"))).alias("share"))
            moved = _moved(grown.join(best, F.col("box_id") == F.col("of")), F.col("way") * F.col("share"))
        after = materialize(moved.select("box_id", *GEOMETRY, "order"), "growth")
        release(state)
        state = after
    return state.drop("order")

