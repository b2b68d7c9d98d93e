"""Box unions as meshes: exposed faces, areas, samples, support bounds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthant.functions.scalar import FACE_CORNERS
from orthant.operators.cells import distinct_positions
from orthant.operators.spatial import TASK_PAIRS, any_within, nearest_within
from orthant.storage import materialize


def _planes(box: dict) -> tuple[np.ndarray, np.ndarray]:
    """Outward normals and offsets of a box's six sides: n . x <= c inside."""
    r, half = np.asarray(box["rotation"], float), np.asarray(box["dimensions"], float) / 2
    n = np.concatenate((-r.T, r.T))[[0, 3, 1, 4, 2, 5]]
    return n, n @ np.asarray(box["center"], float) + np.repeat(half, 2)


def _split(polygon: np.ndarray, height: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The parts of a convex polygon below and above height 0, given at its corners; a part without area is empty.

    Corners within ``eps`` of 0 are on the line; the points at which edges
    cross it are put in between, and then each part is a mere selection.
    """
    height = np.where(np.abs(height) <= eps, 0.0, height)
    ahead = np.roll(height, -1)
    cross = np.flatnonzero(height * ahead < 0)
    share = (height[cross] / (height[cross] - ahead[cross]))[:, None]
    points = polygon[cross] * (1 - share) + np.roll(polygon, -1, axis=0)[cross] * share
    polygon, height = np.insert(polygon, cross + 1, points, axis=0), np.insert(height, cross + 1, 0.0)
    return tuple(polygon[side] if (side & (height != 0)).any() else polygon[:0] for side in (height <= 0, height >= 0))


def corners(box: dict) -> np.ndarray:
    signs = np.array([[(k >> j & 1) - 0.5 for j in range(3)] for k in range(8)])
    return np.asarray(box["center"]) + signs * np.asarray(box["dimensions"]) @ np.asarray(box["rotation"]).T


def face_remains(face: np.ndarray, normal: np.ndarray, owner: int, others: Sequence[tuple[int, dict]], eps: float) -> list[np.ndarray]:
    """What is left of a face when all other boxes are taken away.

    Where two faces lie in one plane and look the same way, the box with the
    smaller number keeps it; where they look at each other, both lose it.
    """
    parts = [face]
    for number, box in others:
        n, c = _planes(box)
        flush = np.abs(face @ n.T - c).max(axis=0) <= eps  # sides of the other box in the face's plane
        if number > owner and (flush & (n @ normal > 1 - 1e-9)).any():
            continue
        cuts, left = np.flatnonzero(~flush), []
        for part in parts:
            for k in cuts:  # what lies beyond a side is outside the box; the rest meets the next side
                part, beyond = _split(part, part @ n[k] - c[k], eps)
                if len(beyond) >= 3 and polygon_area(beyond) > eps * eps:
                    left.append(beyond)
                if len(part) < 3:
                    break
        parts = left
    return parts


def polygon_area(p: np.ndarray) -> float:
    return float(np.linalg.norm(np.cross(p[1:-1] - p[0], p[2:] - p[0]).sum(axis=0)) / 2)


def exposed_polygons(boxes: DataFrame, *, earlier_only: bool = False) -> DataFrame:
    """Polygons (``box_id, side, part, polygon``) of the outer surface of a union of boxes.

    ``boxes``: ``box_id``, ``center``, ``dimensions``, ``rotation`` (rows).
    Every face meets only boxes whose bounds touch its own; one task clips a
    face. ``earlier_only`` lets only boxes with smaller numbers clip, as rendering does.
    """
    half = lambda i: F.aggregate(
        F.sequence(F.lit(0), F.lit(2)), F.lit(0.0), lambda s, j: s + F.abs(F.get(F.col("rotation")[i], j)) * F.get("dimensions", j) / 2.0
    )
    bounds = boxes.select("*", *[(F.col("center")[i] - half(i)).alias(f"l{i}") for i in range(3)], *[(F.col("center")[i] + half(i)).alias(f"h{i}") for i in range(3)])
    extent = bounds.agg(F.max(F.greatest(*[F.abs(f"h{i}") + F.abs(f"l{i}") for i in range(3)]))).first()[0] or 1.0
    eps = extent * 1e-11
    other = bounds.select(*[F.col(c).alias("o_" + c) for c in bounds.columns])
    touch = F.lit(True)
    for i in range(3):
        touch = touch & (F.col(f"l{i}") <= F.col(f"o_h{i}") + eps) & (F.col(f"o_l{i}") <= F.col(f"h{i}") + eps)
    order = (F.col("o_box_id") <= F.col("box_id")) if earlier_only else F.lit(True)
    near = bounds.join(other, touch & order)  # at most a few hundred boxes; each meets itself, so no list is empty
    struct = F.struct(F.col("o_box_id").alias("id"), F.col("o_center").alias("center"), F.col("o_dimensions").alias("dimensions"), F.col("o_rotation").alias("rotation"))
    groups = near.groupBy("box_id").agg(
        F.first("center").alias("center"), F.first("dimensions").alias("dimensions"), F.first("rotation").alias("rotation"), F.sort_array(F.collect_list(struct)).alias("near")
    )
    faces = groups.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(5))))

    def clip(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                rotation = np.stack([np.asarray(r) for r in row["rotation"]])
                box = {"center": row["center"], "dimensions": row["dimensions"], "rotation": rotation}
                side = int(row["side"])
                quad, normal = corners(box)[list(FACE_CORNERS[side])], rotation[:, side // 2] * (1 if side % 2 else -1)
                if polygon_area(quad) <= eps * eps:
                    continue
                others = [(o["id"], {"center": o["center"], "dimensions": o["dimensions"], "rotation": np.stack([np.asarray(r) for r in o["rotation"]])}) for o in row["near"] if o["id"] != row["box_id"]]
                for k, part in enumerate(face_remains(quad, normal, row["box_id"], others, eps)):
                    out.append((row["box_id"], side, k, [list(map(float, v)) for v in part], polygon_area(part), list(map(float, normal))))
            yield pd.DataFrame(out, columns=["box_id", "side", "part", "polygon", "area", "normal"])

    return faces.mapInPandas(clip, "box_id int, side int, part int, polygon array<array<double>>, area double, normal array<double>")


def triangles(polygons: DataFrame) -> DataFrame:
    """A fan of triangles (``tri_id, box_id, a, b, c, area``) of convex polygons."""
    fan = polygons.where(F.size("polygon") >= 3).select("box_id", "side", "part", "polygon", F.explode(F.sequence(F.lit(1), F.size("polygon") - 2)).alias("k"))
    fan = fan.select("box_id", "side", "part", "k", F.col("polygon")[0].alias("a"), F.get("polygon", F.col("k")).alias("b"), F.get("polygon", F.col("k") + 1).alias("c"))
    key = F.xxhash64("box_id", "side", "part", "k").alias("tri_id")
    return fan.select(key, "box_id", "a", "b", "c", triangle_area().alias("area"))


def triangle_area():
    u = [F.col("b")[i] - F.col("a")[i] for i in range(3)]
    v = [F.col("c")[i] - F.col("a")[i] for i in range(3)]
    n = [u[(i + 1) % 3] * v[(i + 2) % 3] - u[(i + 2) % 3] * v[(i + 1) % 3] for i in range(3)]
    return F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2.0


def surface_samples(mesh: DataFrame, spacing: float, block: int = 4096) -> DataFrame:
    """Equal-area low-discrepancy points of each triangle: ``tri_id, k, x, y, z, area`` (of the sample).

    As many as the spacing asks for; they are made ``block`` at a time, so a
    large triangle is no long array.
    """
    n = F.greatest(F.ceil(F.col("area") / (spacing * spacing)), F.lit(1)).cast("long")
    rows = mesh.where("area > 0").withColumn("n", n).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))))
    rows = rows.withColumn("k", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + block, F.col("n")) - 1)))
    u = F.sqrt((F.col("k") + 0.5) / F.col("n"))
    v = (F.col("k") * 0.618033988749895 + 0.5) % 1.0
    at = [F.col("a")[i] * (1 - u) + u * ((1 - v) * F.col("b")[i] + v * F.col("c")[i]) for i in range(3)]
    return rows.select("tri_id", "k", *[p.alias(a) for p, a in zip(at, "xyz")], (F.col("area") / F.col("n")).alias("area"))


def support_bounds(mesh: DataFrame, points: DataFrame, tolerance: float, *, target: float | None = None, gap: float = 0.002, depth: int = 16, slack: float = 0.0) -> dict:
    """Sound bounds on the share of a mesh's area within ``tolerance`` of the points.

    Level by level: a triangle whose corners all lie near the nearest point to
    its centroid is supported, one whose whole circumference is too far is
    not, and the rest is cut in four. Area never visited counts as unknown. Of
    a triangle too wide for any point's ball it is only asked whether some
    point is in reach.
    """
    total = mesh.agg(F.sum("area")).first()[0] or 0.0
    if total == 0:
        return {"lower": 0.0, "upper": 1.0, "levels": 0, "area": 0.0}
    level = materialize(mesh.where("area > 0").select("a", "b", "c", "area"), "level")
    points = materialize(distinct_positions(points).select(F.col("first_id").alias("id"), "x", "y", "z"), "positions")
    ends = points.agg(F.count("*").alias("n"), *[(F.max(a) - F.min(a)).alias(a) for a in "xyz"]).first()
    yes = no = 0.0
    for step in range(depth + 1):
        centre = [(F.col("a")[i] + F.col("b")[i] + F.col("c")[i]) / 3.0 for i in range(3)]
        middle = [F.col(x) for x in "xyz"]
        far = lambda v, w: F.sqrt(sum(((F.col(v)[i] - w[i]) * (F.col(v)[i] - w[i]) for i in range(1, 3)), (F.col(v)[0] - w[0]) * (F.col(v)[0] - w[0])))
        own = level.withColumn("id", F.xxhash64("a", "b", "c")).select("*", *[c.alias(x) for c, x in zip(centre, "xyz")])
        own = materialize(own.withColumn("radius", F.greatest(*[far(v, middle) for v in "abc"])), "level")
        # No corner is farther from the centroid than 4/3 of the radius of a ball that holds all three.
        wide = F.col("radius") > tolerance * 1.334
        asks = own.agg(F.count_if(~wide).alias("narrow"), F.max(F.when(~wide, F.col("radius"))).alias("least"), F.count_if(wide).alias("wide"), F.max("radius").alias("most")).first()
        verdicts = []
        for kind, radius in (("narrow", asks["least"]), ("wide", asks["most"])):
            if not asks[kind]:
                continue
            # What is farther from a centroid than this leaves its triangle without support, wherever it is.
            within = (radius + tolerance + slack) * (1 + 1e-9)
            share = np.prod([min(1.0, 3 * within / ends[a]) if ends[a] else 1.0 for a in "xyz"])
            tasks = 1 + int(asks[kind] * ends["n"] * share // (4 * TASK_PAIRS))
            rows = own.where(wide if kind == "wide" else ~wide)
            places = rows.select("id", "x", "y", "z", (F.col("radius") + (tolerance + slack)).alias("reach")).distinct()
            if kind == "wide":
                near = any_within(places, points, within, ends["n"], tasks).withColumn("met", F.lit(True))
                state = F.when(F.col("met").isNull(), 0)
            else:
                near = nearest_within(places, points, within, tasks, spread_points=ends["n"] < asks[kind])
                place = [F.col("o" + x) for x in "xyz"]
                reach = F.greatest(*[far(v, place) for v in "abc"])
                state = F.when(F.least(F.col("d") + F.col("radius"), reach) + slack <= tolerance, 1).when(F.col("d").isNull() | (F.col("d") - F.col("radius") - slack > tolerance), 0)
            verdicts.append(rows.join(near, "id", "left").select("a", "b", "c", "area", state.alias("state")))
        judged = materialize(reduce(DataFrame.unionByName, verdicts), "judged")
        sums = {r["state"]: r["s"] for r in judged.groupBy("state").agg(F.sum("area").alias("s")).collect()}  # three rows
        yes, no = yes + sums.get(1, 0.0), no + sums.get(0, 0.0)
        lower, upper = min(1.0, yes / total), max(0.0, 1.0 - no / total)
        if None not in sums or upper - lower <= gap or (target is not None and (lower >= target or upper < target)):
            break
        half = lambda p, q: F.zip_with(p, q, lambda s, t: (s + t) / 2.0)
        ab, bc, ca = half("a", "b"), half("b", "c"), half("c", "a")
        parts = F.array(*[F.struct(F.lit(0).alias("z"), p.alias("a"), q.alias("b"), r.alias("c")) for p, q, r in ((F.col("a"), ab, ca), (ab, F.col("b"), bc), (ca, bc, F.col("c")), (ab, bc, ca))])
        level = materialize(judged.where("state is null").select(F.explode(parts).alias("t"), (F.col("area") / 4.0).alias("area")).select("t.a", "t.b", "t.c", "area"), "level")
    return {"lower": lower, "upper": max(lower, upper), "levels": step + 1, "area": total}


def boxes_table(spark: SparkSession, boxes: Sequence[dict]) -> DataFrame:
    """Boxes as a DataFrame, numbered in commit order."""
    rows = [(i, [float(v) for v in b["center"]], [float(v) for v in b["dimensions"]], [[float(v) for v in r] for r in np.asarray(b["rotation"])]) for i, b in enumerate(boxes)]
    return spark.createDataFrame(rows, "box_id int, center array<double>, dimensions array<double>, rotation array<array<double>>")


def flat_boxes(boxes: DataFrame) -> DataFrame:
    """The same with one column for each number, as the expressions want them."""
    return boxes.select(
        "box_id",
        *[F.col("center")[i].alias("c" + a) for i, a in enumerate("xyz")],
        *[F.col("dimensions")[i].alias("d" + a) for i, a in enumerate("xyz")],
        *[F.col("rotation")[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)],
    )
