"""Normals, edge scores and surface regions from nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orthant.functions.config import LineSettings, SurfaceSettings
from orthant.functions.scalar import normal_angle
from orthant.operators.cells import distinct_positions
from orthant.operators.graph import connected_components
from orthant.operators.spatial import nearest_neighbors
from orthant.operators.windows import relabel_by_size
from orthant.storage import materialize

_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
_SEGMENTS = "seg_id int, a array<double>, b array<double>, n long, rmse double, gap double, score double"


def moments(rows: DataFrame, keys: list[str], values: tuple[str, str, str] = ("x", "y", "z"), counts: str | None = None) -> DataFrame:
    """``n`` and the covariance ``c00 .. c22`` of each group: nine sums that combine map-side.

    Where ``counts`` names a column, each row stands for so many.
    """
    mean = (lambda c: F.sum(c * F.col(counts)) / F.sum(counts)) if counts else F.avg
    v = [F.col(c) for c in values]
    cov = [(mean(v[i] * v[j]) - mean(v[i]) * mean(v[j])).alias(f"c{i}{j}") for i, j in _PAIRS]
    return rows.groupBy(*keys).agg((F.sum(counts) if counts else F.count("*")).alias("n"), *cov)


def eigen(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add rising ``eigenvalues`` and the ``axes`` (array of unit vectors, in their order) of ``c00 .. c22``."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, "n"]) + ", eigenvalues array<double>, axes array<array<double>>"

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            m = np.zeros((len(frame), 3, 3))
            for i, j in _PAIRS:
                m[:, i, j] = m[:, j, i] = frame[f"c{i}{j}"].to_numpy()
            values, vectors = np.linalg.eigh(np.nan_to_num(m))
            out = frame[[*keys, "n"]].copy()
            out["eigenvalues"] = list(values)
            out["axes"] = [[list(a) for a in v.T] for v in vectors]
            yield out

    return rows.select(*keys, "n", *[f"c{i}{j}" for i, j in _PAIRS]).mapInPandas(solve, schema)


def neighbourhoods(points: DataFrame, k: int = 30) -> tuple[DataFrame, DataFrame]:
    """Distinct positions, and their edges to neighbours (``id, rank, other_id, d``)."""
    places = materialize(distinct_positions(points).withColumnRenamed("first_id", "id"), "positions")
    return places, materialize(nearest_neighbors(places, places, k, exclude_self=True, places=True), "edges")


def local_geometry(places: DataFrame, edges: DataFrame, *, radius_factor: float = 6.0, minimum: int = 8) -> DataFrame:
    """``id, normal, eigenvalues, spacing, valid`` of every position.

    Neighbours count within ``radius_factor`` times the position's spacing
    (the median distance to its three nearest). A normal is valid with enough
    of them, where the smallest eigenvalue is at most 0.3 of the middle one
    and that is not negligible. Normals have no sign.
    """
    scale = edges.where("rank <= 3").groupBy("id").agg(F.median("d").alias("spacing"))
    near = edges.join(scale, "id").where((F.col("d") > 0) & (F.col("d") <= radius_factor * F.col("spacing") * (1 + 1e-10)))
    there = places.select(F.col("id").alias("other_id"), "x", "y", "z")
    here = places.select("id", *[F.col(a).alias("o" + a) for a in "xyz"])
    # Relative to the position itself, so that far origins cost no digits.
    spread = near.join(there, "other_id").join(here, "id").select("id", *[(F.col(a) - F.col("o" + a)).alias(a) for a in "xyz"])
    shape = eigen(moments(spread, ["id"]), ["id"])
    e = F.col("eigenvalues")
    valid = (F.col("n") >= minimum) & (e[1] > 1e-5 * (e[0] + e[1] + e[2])) & (e[0] <= 0.3 * e[1])
    out = shape.select("id", F.col("axes")[0].alias("normal"), "eigenvalues", valid.alias("valid"))
    return places.select("id").join(scale, "id", "left").join(out, "id", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def edge_scores(geometry: DataFrame, edges: DataFrame, *, share: float = 0.9, minimum: int = 6) -> DataFrame:
    """``id, score``: the lower 90th percentile of angles to the neighbours' normals; null with too few."""
    own = geometry.where("valid").select("id", "normal")
    other = own.select(F.col("id").alias("other_id"), F.col("normal").alias("other"))
    angle = normal_angle([F.col("normal")[i] for i in range(3)], [F.col("other")[i] for i in range(3)])
    lists = edges.join(own, "id").join(other, "other_id").groupBy("id").agg(F.sort_array(F.collect_list(angle)).alias("a"))
    at = F.floor(share * (F.size("a") - 1)).cast("int") + 1
    return lists.select("id", F.when(F.size("a") >= minimum, F.element_at("a", at)).alias("score"))


def segment_surfaces(places: DataFrame, geometry: DataFrame, edges: DataFrame, settings: SurfaceSettings | None = None, *, edge_angle: float = 60.0, barriers: DataFrame | None = None) -> DataFrame:
    """``id, region`` of every position: components of neighbours that lie in one smooth surface, -1 for none.

    Core positions have a valid normal, are no edges and keep away from
    ``barriers`` (segments). Two of them are joined when they are near, their
    normals agree and each lies close to the other's tangent plane.
    """
    s = settings or SurfaceSettings()
    from orthant.operators.spatial import segment_distance

    core = geometry.where("valid").join(edge_scores(geometry, edges), "id", "left").where(F.coalesce(F.col("score") < edge_angle, F.lit(True)))
    core = core.select("id", "normal", "spacing").join(places.select("id", "x", "y", "z"), "id")
    if barriers is not None:
        far = segment_distance(core, barriers).withColumnRenamed("d", "barrier")
        core = core.join(far, "id", "left").where(F.coalesce(F.col("barrier") > 2 * F.col("spacing"), F.lit(True))).drop("barrier")
    core = materialize(core, "core")
    other = core.select(*[F.col(c).alias("o_" + c) for c in core.columns])
    pairs = edges.select("id", F.col("other_id").alias("o_id"), "d").join(core, "id").join(other, "o_id")
    least = F.least("spacing", "o_spacing")
    step = [F.col("o_" + a) - F.col(a) for a in "xyz"]
    off = lambda n: F.abs(step[0] * F.col(n)[0] + step[1] * F.col(n)[1] + step[2] * F.col(n)[2])
    cosine = F.abs(F.aggregate(F.zip_with("normal", "o_normal", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    good = (
        (F.col("d") <= s.neighbor_factor * least)
        & (cosine >= float(np.cos(np.radians(s.angle_degrees))))
        & (F.greatest(off("normal"), off("o_normal")) <= s.residual_factor * least)
    )
    links = pairs.where(good).select(F.col("id").alias("src"), F.col("o_id").alias("dst"))
    named = core.select("id").join(connected_components(links).withColumnRenamed("node", "id"), "id", "left")
    named = named.select("id", F.coalesce("component", "id").alias("part"))
    regions = relabel_by_size(named, "part", s.minimum_region).select("id", "region")
    return places.select("id").join(regions, "id", "left").select("id", F.coalesce("region", F.lit(-1)).cast("int").alias("region"))


def region_frames(places: DataFrame, regions: DataFrame, most: int = 32) -> DataFrame:
    """A right-handed frame (``axes``) for each of the largest regions, from its principal axes."""
    sizes = regions.where("region >= 0").where(F.col("region") < most)
    shape = eigen(moments(places.join(sizes, "id"), ["region"]), ["region"])
    a = F.col("axes")
    cross = F.array(*[a[0][(i + 1) % 3] * a[1][(i + 2) % 3] - a[0][(i + 2) % 3] * a[1][(i + 1) % 3] for i in range(3)])
    return shape.select("region", "n", F.array(a[0], a[1], cross).alias("axes"))


def tangents(places: DataFrame, radius: float, *, k: int = 24, minimum: int = 5) -> DataFrame:
    """``id, tangent, linearity`` of edge positions, from those of the ``k`` nearest that lie within ``radius``.

    The tangent is the principal axis, without a sign; linearity is the share
    of the largest eigenvalue that the middle one leaves, 0 with fewer than
    ``minimum`` positions (the position itself counts).
    """
    near = nearest_neighbors(places, places, k).where(F.col("d") <= radius)
    there = places.select(F.col("id").alias("other_id"), "x", "y", "z")
    here = places.select("id", *[F.col(a).alias("o" + a) for a in "xyz"])
    spread = near.join(there, "other_id").join(here, "id").select("id", *[(F.col(a) - F.col("o" + a)).alias(a) for a in "xyz"])
    e = F.col("eigenvalues")
    linearity = F.when((F.col("n") >= minimum) & (e[2] > 1e-20), (e[2] - e[1]) / e[2]).otherwise(0.0)
    return eigen(moments(spread, ["id"]), ["id"]).select("id", F.col("axes")[2].alias("tangent"), linearity.alias("linearity"))


def _near_lines(places: DataFrame, lines: list[tuple[np.ndarray, np.ndarray]], reach: float) -> DataFrame:
    """``id, line, along, x y z w`` of every position within ``reach`` of a line."""
    rows = [(n, *map(float, base), *map(float, way)) for n, (base, way) in enumerate(lines)]
    table = places.sparkSession.createDataFrame(rows, "line int, bx double, by double, bz double, wx double, wy double, wz double")
    near = places.join(F.broadcast(table))  # as many rows as a round has trials
    d = [F.col(a) - F.col("b" + a) for a in "xyz"]
    near = near.withColumn("along", d[0] * F.col("wx") + d[1] * F.col("wy") + d[2] * F.col("wz"))
    off = sum((F.pow(v - F.col("along") * F.col("w" + a), F.lit(2)) for v, a in zip(d[1:], "yz")), F.pow(d[0] - F.col("along") * F.col("wx"), F.lit(2)))
    return near.where(off <= reach * reach).select("id", "line", "along", "x", "y", "z", "w")


def _longest_runs(near: DataFrame, gap: float, minimum: int) -> tuple[DataFrame, DataFrame]:
    """Each line's positions in its best run (``line, id, along, x y z w``), and the run's ``value``: weight times the root of its length."""
    order = Window.partitionBy("line").orderBy("along", "id")
    opens = F.coalesce(F.col("along") - F.lag("along").over(order) > gap, F.lit(True)).cast("long")
    near = materialize(near.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))), "runs")
    length = F.max("along") - F.min("along")
    runs = near.groupBy("line", "run").agg(F.count("*").alias("n"), (F.sum("w") * F.sqrt(length)).alias("value"), length.alias("length"))
    runs = runs.where((F.col("n") >= minimum) & (F.col("length") > 0))
    best = runs.groupBy("line").agg(F.max_by("run", F.struct("value", -F.col("run"))).alias("run"), F.max("value").alias("value"))
    return near.join(F.broadcast(best.select("line", "run")), ["line", "run"]).select("line", "id", "along", "x", "y", "z", "w"), best


def _first_line(near: DataFrame) -> DataFrame:
    """A position near several lines belongs to the first of them."""
    at = F.struct("line", "along", "x", "y", "z", "w")
    return near.groupBy("id").agg(F.min(at).alias("at")).select("id", "at.*")


def _fitted(rows: DataFrame, key: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The line of weighted total least squares through each group's positions: base and way."""
    centre = rows.groupBy(key).agg(*[(F.sum(F.col("w") * F.col(a)) / F.sum("w")).alias("c" + a) for a in "xyz"])
    own = rows.join(F.broadcast(centre), key).withColumns({"d" + a: F.col(a) - F.col("c" + a) for a in "xyz"})
    sums = own.groupBy(key, "cx", "cy", "cz").agg(*[F.sum(F.col("w") * F.col("d" + "xyz"[i]) * F.col("d" + "xyz"[j])).alias(f"c{i}{j}") for i, j in _PAIRS])
    found = {}
    for r in sums.collect():  # one row a line
        m = np.zeros((3, 3))
        for i, j in _PAIRS:
            m[i, j] = m[j, i] = r[f"c{i}{j}"]
        found[r[key]] = (np.array([r["cx"], r["cy"], r["cz"]]), np.linalg.eigh(m)[1][:, 2])
    return found


def _measured(rows: DataFrame, lines: dict[int, tuple[np.ndarray, np.ndarray]], key: str) -> list:
    """Number, ends, widest gap, farthest and root mean square distance and mean score of each line's positions (``key, id, x y z score``)."""
    table = rows.sparkSession.createDataFrame([(n, *map(float, b), *map(float, v)) for n, (b, v) in lines.items()], f"{key} int, bx double, by double, bz double, wx double, wy double, wz double")
    d = [F.col(a) - F.col("b" + a) for a in "xyz"]
    at = rows.join(F.broadcast(table), key).withColumn("along", d[0] * F.col("wx") + d[1] * F.col("wy") + d[2] * F.col("wz"))
    off = sum((F.pow(v - F.col("along") * F.col("w" + a), F.lit(2)) for v, a in zip(d[1:], "yz")), F.pow(d[0] - F.col("along") * F.col("wx"), F.lit(2)))
    step = F.col("along") - F.lag("along").over(Window.partitionBy(key).orderBy("along", "id"))
    at = at.select(key, "along", "score", off.alias("off"), step.alias("step"))
    return at.groupBy(key).agg(
        F.count("*").alias("n"), F.min("along").alias("low"), F.max("along").alias("high"), F.coalesce(F.max("step"), F.lit(0.0)).alias("gap"),
        F.sqrt(F.max("off")).alias("far"), F.sqrt(F.avg("off")).alias("rmse"), F.avg("score").alias("score"),
    ).collect()  # one row a line


def _merged(held: DataFrame, ends: dict[int, tuple[np.ndarray, np.ndarray]], reach: float, gap: float, angle: float) -> dict[int, int]:
    """Segment to merge into, for every segment: nearly collinear neighbours whose joint support is one straight run.

    Segments are paired off, nearest ends first, and all pairs of a round are
    fitted and measured at once.
    """
    into, refused = {n: n for n in ends}, set()
    ends = dict(ends)
    while angle > 0:
        ways = {n: (b - a) / np.linalg.norm(b - a) for n, (a, b) in ends.items()}
        near = []
        for i in ends:
            for j in ends:
                if i < j and (i, j) not in refused and abs(ways[i] @ ways[j]) >= np.cos(np.radians(angle)):
                    away = min(np.linalg.norm(p - q) for p in ends[i] for q in ends[j])
                    if away <= gap + 2 * reach:
                        near.append((away, i, j))
        pairs, used = [], set()
        for _, i, j in sorted(near):
            if not {i, j} & used:
                used |= {i, j}
                pairs.append((i, j))
        if not pairs:
            break
        number = {n: k for k, pair in enumerate(pairs) for n in pair}
        names = held.sparkSession.createDataFrame([(n, number[root]) for n, root in into.items() if root in number], "seg_id int, pair int")
        joint = held.join(F.broadcast(names), "seg_id")
        lines = _fitted(joint, "pair")
        for r in _measured(joint, lines, "pair"):
            i, j = pairs[r["pair"]]
            if r["far"] > reach or r["gap"] > gap:
                refused.add((i, j))
                continue
            base, way = lines[r["pair"]]
            ends[i] = (base + r["low"] * way, base + r["high"] * way)
            del ends[j]
            into = {n: i if root == j else root for n, root in into.items()}
            refused = {p for p in refused if i not in p}
    return into


def edge_lines(candidates: DataFrame, spacing: float, settings: LineSettings | None = None) -> tuple[DataFrame, DataFrame]:
    """Straight edge segments among edge positions (``id x y z score``), and the positions behind them.

    Returns ``seg_id, a, b, n, rmse, gap, score`` and ``seg_id, id``. Positions
    whose surroundings are linear propose lines along their tangents, the best
    of each coarse cell first, ``trials`` of them a round. All open positions
    then choose: lines are ranked by their best run, refitted by weighted total
    least squares and cut at gaps, and a position belongs to the first line it
    is near. Supports leave the table, until ``quiet_rounds`` rounds bring no
    line. At last collinear neighbours are merged where their joint support
    holds as one. Weights follow the rank of the score, in hundredths.
    """
    s = settings or LineSettings()
    spark, reach, gap = candidates.sparkSession, s.distance_factor * spacing, s.gap_factor * spacing
    candidates = materialize(candidates.select("id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "score")]), "candidates")
    cuts = sorted(set(candidates.approxQuantile("score", [i / 100 for i in range(1, 100)], 0.001)))
    rank = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col("score"))) / max(1, len(cuts))
    places = candidates.select("id", "x", "y", "z", (0.25 + 0.75 * F.coalesce(rank, F.lit(0.0))).alias("w"))
    seeds = tangents(candidates, s.tangent_factor * spacing, k=s.tangent_neighbors).where(F.col("linearity") >= s.minimum_linearity)
    seeds = seeds.join(places, "id").withColumn("promise", F.col("linearity") * F.col("w"))
    still, seeds = materialize(places, "open"), materialize(seeds, "seeds")
    found, supports, quiet = {}, [], 0
    while quiet < s.quiet_rounds and len(found) < s.maximum_lines:
        coarse = [F.floor(F.col(a) / (4 * gap)) for a in "xyz"]
        best = seeds.groupBy(*coarse).agg(F.max_by(F.struct("id", "x", "y", "z", "tangent", "promise"), F.struct("promise", "id")).alias("s")).select("s.*")
        best = best.orderBy(F.desc("promise"), "id").limit(s.trials).collect()
        if not best:
            break
        lines = [(np.array([r["x"], r["y"], r["z"]]), np.array(r["tangent"])) for r in best]
        _, values = _longest_runs(_near_lines(still, lines, reach), gap, s.minimum_support)
        order = [r["line"] for r in values.orderBy(F.desc("value"), "line").collect()]  # at most a row a trial
        lines, taken = [lines[n] for n in order], None
        for step in range(4 if lines else 0):
            taken, _ = _longest_runs(_first_line(_near_lines(still, lines, reach)), gap, s.minimum_support)
            if step < 3:
                fitted = _fitted(taken, "line")
                lines = [fitted[n] for n in sorted(fitted)]
            if not lines:
                break
        kept = {}
        if lines:
            taken = materialize(taken, "support")
            ends = taken.groupBy("line").agg(F.min("along").alias("low"), F.max("along").alias("high")).orderBy("line").collect()
            for r in ends[: s.maximum_lines - len(found)]:
                base, way = lines[r["line"]]
                kept[r["line"]] = len(found)
                found[len(found)] = (base + r["low"] * way, base + r["high"] * way)
        quiet = 0 if kept else quiet + 1
        gone = spark.createDataFrame([(r["id"],) for r in best], seeds.select("id").schema)  # seeds that had their turn
        if kept:
            names = spark.createDataFrame(list(kept.items()), "line int, seg_id int")
            own = taken.join(F.broadcast(names), "line").select("seg_id", "id")
            supports.append(own)
            still = materialize(still.join(own.select("id"), "id", "left_anti"), "open")
            gone = gone.unionByName(own.select("id"))
        seeds = materialize(seeds.join(gone, "id", "left_anti"), "seeds")
    if not found:
        return spark.createDataFrame([], _SEGMENTS), spark.createDataFrame([], candidates.select(F.lit(0).alias("seg_id"), "id").schema)
    held = materialize(reduce(DataFrame.unionByName, supports).join(places, "id").join(candidates.select("id", "score"), "id"), "held")
    into = _merged(held, found, reach, gap, s.merge_degrees)
    number = {root: n for n, root in enumerate(sorted(set(into.values())))}
    names = spark.createDataFrame([(n, number[root]) for n, root in into.items()], "old int, seg_id int")
    held = materialize(held.withColumnRenamed("seg_id", "old").join(F.broadcast(names), "old").drop("old"), "held")
    lines, out = _fitted(held, "seg_id"), []
    for r in _measured(held, lines, "seg_id"):
        base, way = lines[r["seg_id"]]
        out.append((r["seg_id"], [float(v) for v in base + r["low"] * way], [float(v) for v in base + r["high"] * way], r["n"], r["rmse"], r["gap"], r["score"]))
    return spark.createDataFrame(sorted(out), _SEGMENTS), held.select("seg_id", "id")
