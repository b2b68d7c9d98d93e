"""Refining proposed boxes: all trials of all proposals are rows of one table, scored by one join and one aggregate a step."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orthant.functions.scalar import AXES
from orthant.operators.objective import field_scores
from orthant.storage import materialize, release

#: Shares of a proposal's points that a fit may leave out at every face, and the places that a single face may move to.
TRIMS = (0.0, 0.005, 0.02, 0.05)
FACE_TRIMS = (0.0, 0.01, 0.05)
TURN_DEGREES = 2.0
#: Bins an interval of values is counted in at a time, how often at most, and the share of the first interval at which values are one.
BINS, PASSES, FINE = 4096, 4, 1e-9


def _turns(rotation: np.ndarray) -> list[np.ndarray]:
    """The frame turned by two degrees either way about each of its own axes."""
    out = []
    for axis in range(3):
        for angle in np.radians((-TURN_DEGREES, TURN_DEGREES)):
            a, b = (axis + 1) % 3, (axis + 2) % 3
            turn = np.eye(3)
            turn[a, a] = turn[b, b] = np.cos(angle)
            turn[a, b], turn[b, a] = -np.sin(angle), np.sin(angle)
            out.append(rotation @ turn)
    return out


def _quantiles(support: DataFrame, frames: Sequence[tuple[int, np.ndarray]], shares: Sequence[float], within: Sequence[dict]) -> list[np.ndarray]:
    """For each (group, frame) the ``shares`` of the group's rows along the frame's axes: shares x 3, or None without points.

    A point counts for its ``rows``; a group's points lie about in the box
    ``within`` of its number. The rows are counted in bins along each axis,
    then again within those bins alone that hold a share and several values,
    so what is ordered at once is bounded however many points there are.
    """
    spark = support.sparkSession
    out: list = [None] * len(frames)
    todo, first = [], {}  # frame, axis, interval and the shares (at first) or ranks asked of it
    for k, (g, f) in enumerate(frames):
        middle, half = within[g]["center"] @ f, np.abs(f.T @ within[g]["rotation"]) @ within[g]["dimensions"] / 2
        for j in range(3):
            first[k, j] = float(2 * half[j]) or 1.0
            todo.append((k, j, float(middle[j] - half[j]), float(middle[j] + half[j]), list(enumerate(shares))))
    for turn in range(PASSES):
        rows = [(n, frames[k][0], *map(float, frames[k][1][:, j]), low, BINS / (high - low) if high > low else 0.0, high) for n, (k, j, low, high, _) in enumerate(todo)]
        table = spark.createDataFrame(rows, "n int, of int, f0 double, f1 double, f2 double, low double, scale double, high double")
        asked = spark.createDataFrame([(n, i, float(v)) for n, t in enumerate(todo) for i, v in t[4]], "n int, share int, asked double")
        u = F.col("x") * F.col("f0") + F.col("y") * F.col("f1") + F.col("z") * F.col("f2")
        rows = support.join(F.broadcast(table), F.col("group") == F.col("of")).withColumn("u", u)
        if turn:
            rows = rows.where((F.col("u") >= F.col("low")) & (F.col("u") <= F.col("high")))
        place = F.least(F.greatest(F.floor((F.col("u") - F.col("low")) * F.col("scale")), F.lit(0)), F.lit(BINS - 1))
        bins = rows.groupBy("n", place.alias("bin")).agg(F.sum("rows").alias("m"), F.min("u").alias("least"), F.max("u").alias("most"))
        each = Window.partitionBy("n")  # a row for each bin that is not empty
        bins = bins.withColumns({"upto": F.sum("m").over(each.orderBy("bin")), "total": F.sum("m").over(each)})
        rank = F.col("asked") if turn else F.least(F.greatest(F.ceil(F.col("asked") * F.col("total")), F.lit(1)), F.col("total"))
        hit = bins.join(F.broadcast(asked), "n").withColumn("rank", rank).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("m") < F.col("rank")))
        left: dict = {}
        for r in hit.select("n", "share", "least", "most", (F.col("rank") - F.col("upto") + F.col("m")).alias("rank")).collect():  # one row for each share of an interval
            k, j, i = todo[r["n"]][0], todo[r["n"]][1], r["share"]
            if out[k] is None:
                out[k] = np.zeros((len(shares), 3))
            out[k][i, j] = r["most"] if shares[i] >= 1 else r["least"]
            if 0 < shares[i] < 1 and r["most"] - r["least"] > FINE * first[k, j]:
                left.setdefault((k, j, r["least"], r["most"]), []).append((i, r["rank"]))
        todo = [(*key, ranks) for key, ranks in left.items()]
        if not todo:
            break
    return out


def _bounds(box: dict) -> tuple[np.ndarray, np.ndarray]:
    half = np.abs(box["rotation"]) @ box["dimensions"] / 2
    return box["center"] - half, box["center"] + half


def scored(points: DataFrame, trials: Sequence[tuple[int, dict]], exterior: Callable[[dict], float], tolerance: float, **options) -> list[float]:
    """Scores of (group, box) trials by ``field_scores``; 0 for a box that no point is near."""
    spark, ends = points.sparkSession, {}
    for g, box in trials:
        low, high = _bounds(box)
        a, b = ends.get(g, (low, high))
        ends[g] = (np.minimum(a, low), np.maximum(b, high))
    groups = spark.createDataFrame([(g, *map(float, a), *map(float, b)) for g, (a, b) in ends.items()], "group int, lx double, ly double, lz double, hx double, hy double, hz double")
    rows = [(k, g, float(exterior(b)), 0.0, *map(float, b["center"]), *map(float, b["dimensions"]), *map(float, b["rotation"].reshape(-1))) for k, (g, b) in enumerate(trials)]
    shape = "box_id int, group int, exterior double, reverse_gain double, " + ", ".join(f"{p}{a} double" for p in "cd" for a in AXES)
    table = spark.createDataFrame(rows, shape + ", " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)))
    found = {r["box_id"]: r["score"] for r in field_scores(points, table, groups, tolerance, **options).select("box_id", "score").collect()}  # one row a trial
    return [found.get(k, 0.0) for k in range(len(trials))]


def refine_boxes(
    points: DataFrame,
    boxes: Sequence[dict],
    certify: Callable[[Sequence[dict]], Sequence[bool]],
    exterior: Callable[[dict], float],
    tolerance: float,
    *,
    least: float = 0.0,
    **options,
) -> list[tuple[dict, float]]:
    """Each box (``center``, ``dimensions``, ``rotation``, ``kind``) after hill climbing, with its score.

    ``points``: ``x``, ``y``, ``z``, ``weight``, ``field``, and ``rows`` where a
    point stands for several; those within the tolerance of a proposal's volume
    are its support. In turn a proposal may be
    fitted to its support less a trim of up to 5 %, have any one face moved
    to the support's end or to 1 or 5 % of it (twice), and be turned by two
    degrees about an axis and fitted again. Of a step's trials that ``certify``
    accepts the best one is taken if it is better than what there is. All
    proposals go through the four steps side by side. No side gets shorter than
    ``least``. ``options`` go to ``field_scores``.
    """
    from orthant.operators.mesh import boxes_table, flat_boxes
    from orthant.functions.scalar import Box

    if not boxes:
        return []
    spark = points.sparkSession
    table = flat_boxes(boxes_table(spark, boxes))
    named = F.broadcast(table.select(F.col("box_id").alias("group"), *[F.col(c).alias("b_" + c) for c in table.columns if c != "box_id"]))  # the proposals of a round
    rows = F.col("rows") if "rows" in points.columns else F.lit(1).alias("rows")
    support = materialize(points.select("x", "y", "z", rows).join(named, Box("b_").distance() <= tolerance * (1 + 1e-12)).select("group", "x", "y", "z", "rows"), "support")
    values = scored(points, list(enumerate(boxes)), exterior, tolerance, **options)
    best = list(zip(boxes, values))
    around = [b | {"dimensions": b["dimensions"] + 2 * tolerance} for b in boxes]

    def fitted(g: int, frame: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict:
        return boxes[g] | {"center": frame @ ((low + high) / 2), "dimensions": np.maximum(high - low, least), "rotation": frame.copy()}

    def take(trials: list[tuple[int, dict]]) -> None:
        allowed = [t for t, ok in zip(trials, certify([b for _, b in trials])) if ok] if trials else []
        if not allowed:
            return
        for (g, box), value in zip(allowed, scored(points, allowed, exterior, tolerance, **options)):
            if value > best[g][1] + max(1e-12, abs(best[g][1]) * 1e-10):
                best[g] = (box, value)

    def fits(frames: list[tuple[int, np.ndarray]]) -> list[tuple[int, dict]]:
        found = _quantiles(support, frames, [*TRIMS, *(1 - t for t in TRIMS)], around)
        n = len(TRIMS)
        return [(g, fitted(g, f, q[k], q[n + k])) for (g, f), q in zip(frames, found) if q is not None for k in range(n)]

    take(fits([(g, b["rotation"]) for g, b in enumerate(boxes)]))
    for _ in range(2):
        frames = [(g, b["rotation"]) for g, (b, _) in enumerate(best)]
        found, trials = _quantiles(support, frames, [*FACE_TRIMS, *(1 - t for t in FACE_TRIMS)], around), []
        for (g, f), q in zip(frames, found):
            if q is None:
                continue
            middle, half = best[g][0]["center"] @ f, best[g][0]["dimensions"] / 2
            for axis in range(3):
                for k in range(len(FACE_TRIMS)):
                    for side in (0, 1):
                        ends = [middle - half, middle + half]
                        ends[side][axis] = q[k + side * len(FACE_TRIMS), axis]
                        if (ends[1] > ends[0]).all():
                            trials.append((g, fitted(g, f, *ends)))
        take(trials)
    take(fits([(g, f) for g, (b, _) in enumerate(best) for f in _turns(b["rotation"])]))
    release(support)
    return best
