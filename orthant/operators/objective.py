"""How good a set of cuboids is, and what one more would bring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthant.functions.scalar import Box, exterior_cost
from orthant.operators import mesh
from orthant.operators.spatial import BROADCAST_BOXES, nearest_neighbors, nearest_triangle
from orthant.storage import materialize


def _named(boxes: DataFrame, prefix: str) -> DataFrame:
    if boxes.count() > BROADCAST_BOXES:
        raise ValueError(f"at most {BROADCAST_BOXES} boxes")
    return F.broadcast(boxes.select(*[F.col(c).alias(prefix + c) for c in boxes.columns]))


def union_field(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Add ``field``, the smallest signed distance to a box, and ``far``, the distance to the union; infinite without boxes."""
    columns = points.columns
    box = Box("b_")
    pairs = points.join(_named(boxes, "b_"), how="left")
    best = pairs.groupBy(*columns).agg(F.min(box.signed_distance()).alias("field"))
    endless = F.lit(float("inf"))
    return best.withColumn("field", F.coalesce("field", endless)).withColumn("far", F.greatest(F.col("field"), F.lit(0.0)))


def trial_scores(points: DataFrame, committed: DataFrame, trials: DataFrame, tolerance: float, *, reference_volume: float, penalty: float = 2.0) -> DataFrame:
    """Score of each trial box (``box_id``, geometry, ``exterior``, ``reverse_gain``) on weighted points.

    The gain is the weight newly within the tolerance of the volume, plus the
    mean fall of the capped distance to the surface, plus the weight that comes
    to lie near the surface, plus a quarter of the reverse gain, over the cost
    of exterior volume; never below 0. One join and one aggregate for all trials.
    """
    known = union_field(points.select("id", "x", "y", "z", "weight"), committed)
    pairs = known.join(_named(trials, "t_"))
    sums = pairs.groupBy("t_box_id").agg(*_gains(tolerance, F.sum("weight")), *_of_box())
    return sums.select(F.col("t_box_id").alias("box_id"), "volume_gain", "source_gain", "coverage_gain", _score(reference_volume, penalty).alias("score"))


def _gains(tolerance: float, total: Column) -> list[Column]:
    """What a trial ``t_`` brings to points with ``field`` and ``weight``, as shares of ``total``."""
    new, tau = F.least(F.col("field"), Box("t_").signed_distance()), F.lit(tolerance)
    cap = lambda s: F.least(F.abs(s) / tau, F.lit(1.0))
    near = lambda s: (F.abs(s) <= tau).cast("int")
    w, covered = F.col("weight"), ((F.col("field") > tau) & (F.greatest(new, F.lit(0.0)) <= tau)).cast("int")
    return [
        (F.sum(w * covered) / total).alias("volume_gain"),
        (F.sum(w * (cap(F.col("field")) - cap(new))) / total).alias("source_gain"),
        (F.sum(w * (near(new) - near(F.col("field")))) / total).alias("coverage_gain"),
    ]


def _of_box() -> list[Column]:
    return [F.first("t_exterior").alias("exterior"), F.first("t_reverse_gain").alias("reverse_gain"), F.first(Box("t_").volume()).alias("volume")]


def _score(reference_volume: float, penalty: float) -> Column:
    gain = F.col("volume_gain") + F.col("source_gain") + F.col("coverage_gain") + 0.25 * F.col("reverse_gain")
    return F.greatest(gain, F.lit(0.0)) / exterior_cost(F.col("volume"), reference_volume, F.col("exterior"), penalty)


def with_field(points: DataFrame, box: dict | None = None) -> DataFrame:
    """``points`` with ``field``, the smallest signed distance to the boxes so far, after one more (``center``, ``dimensions``, ``rotation``).

    The field of the boxes before is in the table already, so a commit is one
    pass over the points without a join: what it costs does not depend on how
    many boxes there are.
    """
    old = F.col("field") if "field" in points.columns else F.lit(float("inf"))
    if box is None:
        return points.withColumn("field", old)
    literal = Box("")
    numbers = {"c" + a: v for a, v in zip("xyz", box["center"])} | {"d" + a: v for a, v in zip("xyz", box["dimensions"])}
    numbers |= {f"r{i}{j}": box["rotation"][i][j] for i in range(3) for j in range(3)}
    literal.col = lambda name: F.lit(float(numbers[name]))  # type: ignore[method-assign]
    return points.withColumn("field", F.least(old, literal.signed_distance()))


def field_scores(points: DataFrame, trials: DataFrame, groups: DataFrame, tolerance: float, *, total: float, deep: float, reference_volume: float, penalty: float = 2.0, most_buried: float = float("inf")) -> DataFrame:
    """``trial_scores`` of trials in groups, for points that carry their ``field`` (``with_field``).

    ``trials`` (``box_id``, ``group``, geometry, ``exterior``,
    ``reverse_gain``) differ little within a group; ``groups`` has the bounds
    (``group``, ``lx .. hz``) of all of a group's trials. Points farther than
    the tolerance from these bounds gain nothing, so a point meets the groups
    first and their trials only where it may count. A box that buries more
    than ``most_buried`` of the weight deeper than the tolerance scores 0;
    ``deep`` is the weight that the boxes so far have buried, ``total`` all of it.
    """
    reach = tolerance * (1 + 1e-9)
    inside = reduce(lambda s, t: s & t, [(F.col(a) >= F.col("l" + a) - reach) & (F.col(a) <= F.col("h" + a) + reach) for a in "xyz"])
    near = points.join(F.broadcast(groups), inside)  # a few groups
    named = F.broadcast(trials.select(*[F.col(c).alias("t_" + c) for c in trials.columns]))  # a few dozen boxes a group
    pairs = near.join(named, F.col("group") == F.col("t_group"))
    limit = -tolerance * (1 + 1e-10)
    sunk = F.sum(F.when((F.col("field") >= limit) & (Box("t_").signed_distance() < limit), F.col("weight")).otherwise(0.0)) + deep
    sums = pairs.groupBy("t_box_id").agg(*_gains(tolerance, F.lit(total)), *_of_box(), sunk.alias("buried"))
    score = F.when(F.col("buried") <= most_buried + 1e-9 * total, _score(reference_volume, penalty)).otherwise(0.0)
    return sums.select(F.col("t_box_id").alias("box_id"), "volume_gain", "source_gain", "coverage_gain", "buried", score.alias("score"))


def buried(points: DataFrame, boxes: DataFrame, tolerance: float) -> DataFrame:
    """Points inside the union and farther than the tolerance from its outer surface; no later box can mend them.

    ``boxes``: ``box_id``, ``center``, ``dimensions``, ``rotation``.
    """
    skin = nearest_triangle(points, mesh.triangles(mesh.exposed_polygons(boxes)))
    inside = points.join(_named(mesh.flat_boxes(boxes), "b_"), Box("b_").contains(), "left_semi").select("id")
    deep = skin.where(F.col("d") > tolerance * (1 + 1e-10)).select("id", "d")
    return points.join(inside, "id", "left_semi").join(deep, "id").select(*points.columns, "d")


def burial_feasible(points: DataFrame, boxes: DataFrame, tolerance: float, target: float) -> bool:
    """The buried weight stays within what the coverage target leaves open."""
    mass = buried(points, boxes, tolerance).agg(F.sum("weight")).first()[0] or 0.0
    return mass <= (1 - target) * (points.agg(F.sum("weight")).first()[0] or 0.0) + 1e-9


def reverse_error(samples: DataFrame, points: DataFrame, tolerance: float, reference_area: float) -> DataFrame:
    """Area-weighted distance of surface samples to the points, capped at four tolerances: I / (A + I)."""
    near = nearest_neighbors(samples.select("id", "x", "y", "z"), points, 1).select("id", "d")
    integral = F.sum(F.col("area") * F.least(F.col("d") / tolerance, F.lit(4.0)))
    return samples.join(near, "id").agg((integral / (reference_area + integral)).alias("reverse_error"))


def distance_metrics(points: DataFrame, distance: Column, weight: str = "weight") -> DataFrame:
    """Mean, RMS and quantiles of a distance, by rows and by weight, in one row."""
    from orthant.operators.windows import exact_quantiles

    points = materialize(points.select(distance.alias("far"), weight), "distances")
    w, distance = F.col(weight), F.col("far")
    part = F.array(*[F.lit(q).cast("double") for q in exact_quantiles(points, "far", (0.5, 0.9, 0.95, 0.99, 1.0))])
    rows = points.agg(
        F.count("*").alias("n"), F.avg(distance).alias("mean"), F.sqrt(F.avg(distance * distance)).alias("rms"),
        (F.sum(w * distance) / F.sum(w)).alias("weighted_mean"), F.sqrt(F.sum(w * distance * distance) / F.sum(w)).alias("weighted_rms"), part.alias("q"),
    )
    return rows.select("n", "mean", "rms", "weighted_mean", "weighted_rms", *[F.col("q")[i].alias(n) for i, n in enumerate(("q50", "q90", "q95", "q99", "q100"))])


def normal_votes(normals: DataFrame, *, degrees: float = 10.0, least: float = 0.035, rounds: int = 24) -> list[tuple[list[float], float]]:
    """Main directions of weighted unit normals (``normal``, ``area``) without regard to sign, with their share of the area.

    Each round takes the heaviest open normal and all within ``degrees`` of
    it; a round is one aggregate, and there are ``rounds`` at most.
    """
    import math

    total = normals.agg(F.sum("area")).first()[0] or 0.0
    rest, out = normals.select("normal", "area"), []
    dot = lambda v: sum((F.col("normal")[i] * float(v[i]) for i in range(1, 3)), F.col("normal")[0] * float(v[0]))
    for _ in range(rounds):
        top = rest.groupBy("normal").agg(F.sum("area").alias("area")).orderBy(F.desc("area"), "normal").first()
        if top is None or not total:
            break
        cosine = dot(top["normal"])
        close = F.abs(cosine) >= math.cos(math.radians(degrees))
        turned = [F.sum(F.when(close, F.signum(cosine) * F.col("area") * F.col("normal")[i])).alias(f"v{i}") for i in range(3)]
        row = rest.agg(F.sum(F.when(close, F.col("area"))).alias("mass"), *turned).first()
        if row["mass"] / total >= least:
            length = math.sqrt(sum(row[f"v{i}"] ** 2 for i in range(3)))
            out.append(([row[f"v{i}"] / length for i in range(3)], row["mass"] / total))
        rest = rest.where(~close)
    return sorted(out, key=lambda x: -x[1])


def transfer_normals(points: DataFrame, donors: DataFrame, *, k: int = 8, reach: float = 4.0, residual: float = 0.5, degrees: float = 25.0) -> DataFrame:
    """``id, normal`` of points near donors that have one (``id, x, y, z, normal, spacing``).

    A donor counts within ``reach`` of its spacings, where the point lies close
    to its tangent plane and its normal agrees with the nearest donor's; the
    normals of those that count are averaged by a Gaussian of the distance.
    """
    import math

    near = nearest_neighbors(points, donors, k)
    given = donors.select(F.col("id").alias("other_id"), *[F.col(a).alias("d" + a) for a in "xyz"], "normal", "spacing")
    # Copies make small files of many rows, so no side of these joins may go through the driver by the size of its files.
    rows = near.hint("merge").join(given, "other_id").hint("merge").join(points.select("id", "x", "y", "z"), "id")
    first = rows.where("rank = 1").select("id", F.col("normal").alias("first")).hint("merge")
    n = [F.col("normal")[i] for i in range(3)]
    off = F.abs(sum(((F.col(a) - F.col("d" + a)) * n[i] for i, a in enumerate("yz", 1)), (F.col("x") - F.col("dx")) * n[0]))
    rows = rows.where((F.col("d") <= reach * F.col("spacing")) & (off <= residual * F.col("spacing"))).join(first, "id")
    cosine = sum((n[i] * F.col("first")[i] for i in range(1, 3)), n[0] * F.col("first")[0])
    rows = rows.where(F.abs(cosine) >= math.cos(math.radians(degrees)))
    w = F.exp(-(F.col("d") / F.col("spacing")) * (F.col("d") / F.col("spacing")) / 2.0) * F.signum(cosine)
    means = rows.groupBy("id").agg(*[F.sum(w * n[i]).alias(f"v{i}") for i in range(3)])
    length = F.sqrt(F.col("v0") * F.col("v0") + F.col("v1") * F.col("v1") + F.col("v2") * F.col("v2"))
    return means.where(length > 0).select("id", F.array(*[F.col(f"v{i}") / length for i in range(3)]).alias("normal"))


def quality_failures(report: dict, *, most_boxes: int | None = None, area: float | None = None, coverage: float = 0.999) -> list[str]:
    """What a run's report does not live up to, in words; empty where all holds."""
    out = []
    gates = report.get("gates", {})
    if not gates.get("target_reached"):
        out.append(f"target not reached: {report.get('stopping_reason')}")
    if gates.get("raw_coverage", 0.0) < coverage:
        out.append(f"coverage {gates.get('raw_coverage')} is below {coverage}")
    if most_boxes is not None and len(report.get("cuboids", [])) > most_boxes:
        out.append(f"{len(report['cuboids'])} cuboids where {most_boxes} are enough")
    if area is not None and abs(gates.get("exposed_area", 0.0) - area) > 0.02 * area:
        out.append(f"exposed area {gates.get('exposed_area')} is not {area}")
    return out
