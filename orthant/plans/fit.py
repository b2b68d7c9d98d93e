"""Covering a cloud with an append-only list of certified cuboids.

Work that grows with the cloud (weights, coverage, gains, distances) is
DataFrame work; each round of the selection is a fixed number of jobs. What is
bounded by the settings (the voxel grid of at most ``resolution`` cells a side,
the candidates, the committed boxes) is kept on the driver as arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthant.functions.config import FitSettings, check_grid, reconstruction_layers
from orthant.functions.scalar import Box, evaluation_tolerance
from orthant.operators import cells, growth, hull, mesh, normals, refine, voxel
from orthant.operators.objective import burial_feasible, normal_votes, with_field
from orthant.operators.spatial import nearest_neighbors, nearest_spacing
from orthant.storage import materialize, release

GRID_BYTES = 1 << 30


class CoverageNotReachedError(RuntimeError):
    """No cuboid at all could be certified."""


def make_box(center, dimensions, rotation, kind: str) -> dict:
    return {"center": np.asarray(center, float), "dimensions": np.asarray(dimensions, float), "rotation": np.asarray(rotation, float), "kind": kind}


def volume(box: dict) -> float:
    return float(np.prod(box["dimensions"]))


@dataclass
class Solid:
    """Dense safe cells of a bounded grid, with their integral image."""

    safe: np.ndarray
    origin: np.ndarray
    width: float
    prefix: np.ndarray = field(init=False)

    def __post_init__(self):
        self.prefix = np.zeros(np.array(self.safe.shape) + 1, np.int64)
        self.prefix[1:, 1:, 1:] = self.safe.cumsum(0).cumsum(1).cumsum(2)

    def count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Safe cells in half-open index boxes."""
        p, total = self.prefix, 0
        for k in range(8):
            pick = [(high if k >> a & 1 else low)[..., a] for a in range(3)]
            total = total + (1 if bin(k).count("1") % 2 else -1) * p[pick[0], pick[1], pick[2]]
        return total

    def certify(self, box: dict, strict: bool = True) -> bool:
        """No unsafe cell overlaps the box.

        A cell overlaps where its centre lies inside the sum of box and cell, a
        body spanned by their six edges; its sides are the planes of two edges.
        """
        # A flat box that lies on a border of cells is in the cells of both sides, not in none.
        edges = np.concatenate((box["rotation"].T * np.maximum(box["dimensions"], 1e-6 * self.width)[:, None], np.eye(3) * self.width)) / 2
        reach = np.abs(edges[:3]).sum(axis=0)
        slack = 0.0 if strict else 1e-9
        low = np.floor((box["center"] - reach - self.origin) / self.width + slack).astype(int)
        high = np.maximum(low + 1, np.ceil((box["center"] + reach - self.origin) / self.width - slack).astype(int))
        if (low < 0).any() or (high > self.safe.shape).any():
            return False
        unsafe = np.argwhere(~self.safe[tuple(map(slice, low, high))])
        offset = (unsafe + low + 0.5) * self.width + self.origin - box["center"]
        one, two = np.triu_indices(6, 1)
        sides = np.cross(edges[one], edges[two])
        size = np.linalg.norm(sides, axis=1)
        sides = sides[size > 1e-9 * size.max()] / size[size > 1e-9 * size.max(), None]
        span = np.abs(sides @ edges.T).sum(axis=1) - (0.0 if strict else 1e-8 * self.width)
        return not (np.abs(offset @ sides.T) < span).all(axis=1).any()

    def exterior(self, box: dict, n: int = 10) -> float:
        """Share of the box outside safe cells, on a fixed grid of strata."""
        g = (np.arange(n) + 0.5) / n - 0.5
        local = np.stack(np.meshgrid(g, g, g, indexing="ij"), -1).reshape(-1, 3) * box["dimensions"]
        at = np.floor((box["center"] + local @ box["rotation"].T - self.origin) / self.width).astype(int)
        inside = ((at >= 0) & (at < self.safe.shape)).all(axis=1)
        at = np.clip(at, 0, np.array(self.safe.shape) - 1)
        return float(1 - (inside & self.safe[at[:, 0], at[:, 1], at[:, 2]]).mean())

    def grow(self, seed: np.ndarray, keep: int = 2) -> list[tuple[np.ndarray, np.ndarray]]:
        """The largest index boxes of safe cells around a seed, ``keep`` for each choice of the height axis.

        Every column over the seed's level has a height up and one down from
        it, and a box is as high as its footprint's least ones. Outward from
        the seed these minima fall in a few steps, and only footprints that end
        just before a step can be largest: along the first axis on the seed's
        own line, along the second on what the chosen rows leave.
        """
        found: dict[tuple, int] = {}
        for axis in range(3):
            safe = np.moveaxis(self.safe, axis, 0)
            level, (x, y) = int(seed[axis]), (int(v) for v in np.delete(seed, axis))
            up = np.logical_and.accumulate(safe[level:], axis=0).sum(axis=0)
            down = np.logical_and.accumulate(safe[level::-1], axis=0).sum(axis=0) - 1
            own = []
            for a, b in product(_reaches(up[x::-1, y], down[x::-1, y]), _reaches(up[x:, y], down[x:, y])):
                rows = slice(x - a, x + b + 1)
                over, under = up[rows].min(axis=0), down[rows].min(axis=0)
                for c, d in product(_reaches(over[y::-1], under[y::-1]), _reaches(over[y:], under[y:])):
                    cols = slice(y - c, y + d + 1)
                    top, bottom = int(over[cols].min()), int(under[cols].min())
                    own.append(((a + b + 1) * (c + d + 1) * (top + bottom), x - a, y - c, level - bottom, x + b + 1, y + d + 1, level + top))
            for size, *ends in sorted(own, reverse=True)[:keep]:
                low, high = (np.insert(np.array(part[:2]), axis, part[2]) for part in (ends[:3], ends[3:]))
                found[(*low.tolist(), *high.tolist())] = size
        return [(np.array(k[:3]), np.array(k[3:])) for k in found]


def _reaches(up: np.ndarray, down: np.ndarray) -> list[int]:
    """Places, outward from the first, behind which the least height up or down falls."""
    over, under = np.minimum.accumulate(up), np.minimum.accumulate(np.where(up > 0, down, -1))
    open_cells = int(np.argmin(over > 0)) if (over == 0).any() else len(over)
    steps = np.flatnonzero((np.diff(over[:open_cells]) != 0) | (np.diff(under[:open_cells]) != 0))
    return [*steps.tolist(), open_cells - 1]


@dataclass
class Prepared:
    """A cloud in unit coordinates with what a fit needs of it."""

    points: DataFrame  # each position once: id (its least), x, y, z, rows, weight (of all its rows), component
    count: int
    low: np.ndarray
    scale: float
    spacing: float
    tolerance: float
    solid: Solid
    frames: list[np.ndarray]
    safe: DataFrame  # the solid's cells


def prepare(cloud: DataFrame, settings: FitSettings, regions: DataFrame | None = None) -> Prepared:
    """Normalize a cleaned cloud (``id, x, y, z``), weigh it, rebuild its solid and find frames.

    Of the cloud's rows one for each position goes on, with their number; all
    counts, weights, moments and quantiles of the fit are those of the rows.
    """
    shapes = None if regions is None else normals.region_frames(cloud, regions)
    cloud = materialize(cells.distinct_positions(cloud).withColumnsRenamed({"first_id": "id", "n": "rows"}), "cloud")
    b = cloud.agg(F.sum("rows").alias("n"), *[F.min(a).alias("l" + a) for a in "xyz"], *[F.max(a).alias("h" + a) for a in "xyz"]).first()
    if (b["n"] or 0) < 20:
        raise ValueError("at least 20 points are needed")
    low = np.array([b["l" + a] for a in "xyz"])
    extent = float(max(b["h" + a] - b["l" + a] for a in "xyz")) or 1.0
    unit = cloud.select("id", *[((F.col(a) - float(o)) / extent).alias(a) for a, o in zip("xyz", low)], "rows")
    unit = materialize(unit, "unit")
    spacing = float(nearest_spacing(unit).agg(F.percentile("spacing", 0.5, F.col("rows"))).first()[0] or 0.0)
    tolerance = evaluation_tolerance(spacing, 1.0, settings.detail_factor, settings.tolerance / extent if settings.tolerance else None)

    width = 1.0 / settings.resolution
    layers = reconstruction_layers(settings.shell_layers, spacing, width)
    reach = 2 * max(width, spacing)
    pad = layers + int(math.ceil(reach / width)) + 2
    shape = tuple(int(math.floor((b["h" + a] - b["l" + a]) / extent / width)) + 1 + 2 * pad for a in "xyz")
    check_grid(shape, GRID_BYTES)
    observed = materialize(voxel.occupancy(unit, width), "observed")
    inner = voxel.reconstruct(observed, layers)
    safe = materialize(voxel.safe_region(voxel.euclidean_band(observed, reach, width), inner), "safe")
    grid = np.zeros(shape, bool)
    at = safe.toPandas()[list(voxel.IJK)].to_numpy() + pad  # at most the grid that was checked
    at = at[((at >= 0) & (at < shape)).all(axis=1)]
    grid[at[:, 0], at[:, 1], at[:, 2]] = True
    solid = Solid(grid, np.full(3, -pad * width), width)

    weighted = cells.spatial_weights(unit, 2 * tolerance, "rows")
    parts = cells.cell_components(cells.with_cells(unit, 2 * tolerance))
    points = weighted.join(parts, list(cells.CELL)).select("id", "x", "y", "z", "rows", "weight", F.col("component").cast("string").alias("component"))
    return Prepared(materialize(points, "points"), b["n"], low, extent, spacing, tolerance, solid, find_frames(unit, shapes), safe)


def find_frames(points: DataFrame, regions: DataFrame | None = None, most: int = 12) -> list[np.ndarray]:
    """World axes, principal axes of the cloud (positions with ``rows``), square pairs of hull directions, principal axes of ``regions`` (``region_frames``) and of octants; equal frames once."""
    middle = points.agg(*[(F.sum(F.col(a) * F.col("rows")) / F.sum("rows")).alias(a) for a in "xyz"]).first()
    split = points.withColumn("part", F.lit(-1)).unionByName(points.withColumn("part", sum((F.when(F.col(a) > middle[a], 1 << i).otherwise(0) for i, a in enumerate("yz")), F.when(F.col("x") > middle["x"], 4).otherwise(0)).cast("int")))
    shapes = normals.eigen(normals.moments(split, ["part"], counts="rows"), ["part"]).orderBy("part").collect()  # nine rows
    found = [np.eye(3)]
    whole, octants = ([np.array(r["axes"]).T for r in shapes if r["n"] >= 8 and (r["part"] < 0) == first] for first in (True, False))
    rows = whole + hull.frames_of(hull.hull_directions(points))[:4]
    if regions is not None:
        rows += [np.array(r["axes"]).T for r in regions.orderBy("region").collect()]  # at most 32 rows
    for frame in rows + octants:
        u, _, v = np.linalg.svd(frame)
        frame = u @ v
        if np.linalg.det(frame) < 0:
            frame[:, 2] = -frame[:, 2]
        if all((np.abs(f.T @ frame).max(axis=0) < np.cos(np.radians(2))).any() for f in found):
            found.append(frame)
    return found[:most]


def normal_frames(p: Prepared, most: int = 4, sample: int = 4096) -> list[np.ndarray]:
    """Frames of pairs of main surface directions that stand square, from normals at spread representatives."""
    chosen = cells.representatives_within(p.points, sample)
    points = p.points.join(chosen, "id", "left_semi").select("id", "x", "y", "z")
    places, edges = normals.neighbourhoods(points, 20)
    valid = normals.local_geometry(places, edges).where("valid").select("normal", F.lit(1.0).alias("area"))
    ways = [np.array(v) for v, _ in normal_votes(materialize(valid, "normals"), rounds=8)][:most]
    found = []
    for i, a in enumerate(ways):
        for b in ways[i + 1 :]:
            if abs(a @ b) < np.sin(np.radians(10)):
                b = b - (a @ b) * a
                frame = np.stack((a, b / np.linalg.norm(b), np.cross(a, b / np.linalg.norm(b))), axis=1)
                if all((np.abs(f.T @ frame).max(axis=0) < np.cos(np.radians(0.5))).any() for f in [*p.frames, *found]):
                    found.append(frame)
    return found


def frame_table(points: DataFrame, frames: Sequence[np.ndarray]) -> DataFrame:
    """Each point once per frame (``f``) with its coordinates along the frame's axes, ``u0 u1 u2``."""
    rows = F.array(*[F.struct(F.lit(i).alias("f"), *[F.lit(float(r[a, j])).alias(f"r{a}{j}") for a in range(3) for j in range(3)]) for i, r in enumerate(frames)])
    out = points.withColumn("m", F.explode(rows))
    return out.select(*points.columns, F.col("m.f").alias("f"), *[(F.col("x") * F.col("m")[f"r0{j}"] + F.col("y") * F.col("m")[f"r1{j}"] + F.col("z") * F.col("m")[f"r2{j}"]).alias(f"u{j}") for j in range(3)])


def _bounds_to_boxes(rows, frames: Sequence[np.ndarray], kind: str) -> list[dict]:
    out = []
    for r in rows:
        low, high = (np.array([r[f"{p}{j}"] for j in range(3)]) for p in "lh")
        out.append(make_box(frames[r["f"]] @ ((low + high) / 2), high - low, frames[r["f"]], kind))
    return out




def _ends() -> list:
    return [e for j in range(3) for e in (F.min(f"u{j}").alias(f"l{j}"), F.max(f"u{j}").alias(f"h{j}"))]


def bounding_boxes(p: Prepared) -> list[dict]:
    """The cloud's bounding box in every frame."""
    rows = frame_table(p.points, p.frames).groupBy("f").agg(*_ends()).orderBy("f").collect()  # one row per frame
    return _bounds_to_boxes(rows, p.frames, "whole")


def panel_boxes(points: DataFrame, p: Prepared, layers: int = 8, parts: int = 8, minimum: int = 4) -> list[dict]:
    """Thin boxes: heaviest layers along each frame axis, cut into connected patches.

    Layers of two tolerances, in two phases; a patch's box has its points' bounds.
    """
    step = 2 * p.tolerance
    table = frame_table(points.select("id", "x", "y", "z", "rows", "weight"), p.frames)
    ways = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("phase")) for a in range(3) for s in (0.0, 0.5)])
    rows = table.withColumn("w", F.explode(ways)).select("*", "w.*").drop("w")
    along = F.when(F.col("axis") == 0, F.col("u0")).when(F.col("axis") == 1, F.col("u1")).otherwise(F.col("u2"))
    first = F.when(F.col("axis") == 0, F.col("u1")).otherwise(F.col("u0"))
    second = F.when(F.col("axis") == 2, F.col("u1")).otherwise(F.col("u2"))
    key = ["f", "axis", "phase", "bin"]
    size = 2 * max(step, p.spacing)
    rows = materialize(rows.withColumn("bin", F.floor(along / step + F.col("phase"))).withColumn("ca", F.floor(first / size)).withColumn("cb", F.floor(second / size)), "layers")
    from orthant.operators.windows import top_per_group

    mass = rows.groupBy(*key).agg(F.sum("weight").alias("mass"))
    best = top_per_group(mass, ["f", "axis", "phase"], [F.desc("mass"), F.col("bin")], layers).select(*key)
    rows = rows.join(F.broadcast(best), key)  # a few layers per frame and axis
    patches = cells.cell_components(rows, ("ca", "cb"), key)
    patch = rows.join(patches, [*key, "ca", "cb"]).groupBy(*key, "component").agg(F.sum("weight").alias("mass"), F.sum("rows").alias("n"), *_ends())
    patch = patch.where(F.col("n") >= minimum)
    rows = top_per_group(patch, ["f", "axis", "phase"], [F.desc("mass"), F.col("component")], parts).orderBy(F.desc("mass"), "f", "axis", "phase", "bin").collect()
    return _bounds_to_boxes(rows, p.frames, "panel")


def grown_boxes(p: Prepared, seeds: int = 48) -> list[dict]:
    """Boxes of safe cells grown from evenly spread deep cells, tightened later to their points."""
    at = np.argwhere(p.solid.safe)
    if not len(at):
        return []
    pick = at[np.unique(np.linspace(0, len(at) - 1, seeds).astype(int))]
    found = {}
    for seed in pick:
        for low, high in p.solid.grow(seed):
            found[(*low, *high)] = (low, high)
    w, o = p.solid.width, p.solid.origin
    return [make_box(o + (low + high) / 2 * w, (high - low) * w, np.eye(3), "grown") for low, high in found.values()]


def _key(box: dict) -> tuple:
    return tuple(np.round(np.concatenate((box["center"], box["dimensions"], box["rotation"].reshape(-1))), 8))


def _measure(p: Prepared, open_points: DataFrame, boxes: Sequence[dict]) -> list[dict]:
    """For each box the weight and rows it covers and the bounds of its points: one broadcast join and one aggregate."""
    spark = p.points.sparkSession
    table = mesh.flat_boxes(mesh.boxes_table(spark, boxes))
    named = table.select("box_id", *[F.col(c).alias("b_" + c) for c in table.columns if c != "box_id"])
    box = Box("b_")
    near = open_points.join(F.broadcast(named)).where(box.distance() <= p.tolerance * (1 + 1e-12))  # candidates of one round
    local = box.local()
    inside = box.contains()
    sums = near.groupBy("box_id").agg(
        F.sum("weight").alias("gain"), F.sum("rows").alias("rows"),
        *[F.min(F.when(inside, q)).alias(f"l{j}") for j, q in enumerate(local)], *[F.max(F.when(inside, q)).alias(f"h{j}") for j, q in enumerate(local)],
    )
    found = {r["box_id"]: r.asDict() for r in sums.collect()}  # one row per candidate
    return [found.get(i, {"gain": 0.0, "rows": 0}) for i in range(len(boxes))]


def _tightened(box: dict, seen: dict) -> dict | None:
    if seen.get("l0") is None:
        return None
    low, high = (np.array([seen[f"{s}{j}"] for j in range(3)]) for s in "lh")
    return make_box(box["center"] + box["rotation"] @ ((low + high) / 2), np.maximum(high - low, 0.0), box["rotation"], box["kind"])


@dataclass
class Fit:
    boxes: list[dict]  # in source units, commit order
    curve: list[dict]
    reason: str
    tolerance: float
    prepared: Prepared


def select_boxes(p: Prepared, settings: FitSettings, *, committed: Sequence[dict] = (), propose: Callable[[DataFrame], list[dict]] | None = None, on_commit: Callable[[list[dict]], None] | None = None, progress: Callable[[str], None] | None = None) -> tuple[list[dict], list[dict], str]:
    """Commit the box of the best score until all gates hold; committed boxes never change.

    A round measures all candidates against the rows still open, scores the
    first of them on the surface objective, grows and refines the best few and
    commits the best that buries no more than the coverage target leaves open.
    Points carry their distance to the boxes so far, so a commit is one pass.
    Boxes that are not certified within the solid are not measured. Without a
    surface target (``target_surface_support`` 0) burial is allowed.
    """
    boxes, curve = list(committed), []
    pool, seen, enough = [], set(), []

    def add(new: Sequence[dict]) -> None:
        for box in new:
            if _key(box) not in seen:
                seen.add(_key(box))
                if p.solid.certify(box):
                    pool.append(box)

    def cost(box: dict) -> float:
        return 1.0 + settings.exterior_penalty * p.solid.exterior(box) * volume(box)

    add(bounding_boxes(p))
    state = with_field(p.points)
    for box in boxes:
        state = with_field(state, box)
    state = materialize(state, "state")
    need, reach, surface = math.ceil(settings.target_coverage * p.count), p.tolerance * (1 + 1e-12), settings.target_surface_support > 0
    total = p.points.agg(F.sum("weight")).first()[0]
    most_buried = (1 - settings.target_coverage) * total if surface else float("inf")
    covered = _rows_within(state, reach) if boxes else 0
    if not boxes:  # one box may do; then nothing else is searched
        for widen in (False, True):
            if widen:
                p.frames += normal_frames(p)
                add(bounding_boxes(p))
            measured = _measure(p, state, pool) if pool else []
            enough = [b for b, m in zip(pool, measured) if m["rows"] >= need]
            enough = [b for b, v in zip(enough, _scored(p, state, enough, settings, total, most_buried)) if v > 0]
            if enough:
                pool = [min(enough, key=volume)]
                break
    if not enough:
        add(panel_boxes(state.where(F.col("field") > reach), p))
        add(grown_boxes(p))
    reason = ""
    while not reason:
        done = covered >= need
        if done and gates(Fit([to_source(b, p) for b in boxes], curve, "", p.tolerance * p.scale, p), settings)["target_reached"]:
            reason = "target_reached"
            break
        if len(boxes) >= settings.max_cuboids:
            reason = "maximum_box_budget"
            break
        # Once the rows are covered, those too deep in the boxes to count as surface are what is left to do.
        open_points = state.where((F.abs("field") if done else F.col("field")) > reach)
        if boxes:
            add(panel_boxes(open_points, p))
            add(residual_boxes(open_points, p))
            if propose is not None:
                add(propose(open_points))
        best = _best_trial(p, state, open_points, boxes, pool, settings, cost, total, most_buried)
        if best is None:
            before = len(pool)
            add(_raw_cells(p, open_points))
            if len(pool) == before:
                reason = "surface_quality_not_reached" if done else "bounded_candidate_search_exhausted" if boxes or pool else "no_candidates"
            continue
        boxes.append(best)
        after = materialize(with_field(state, best), "state")
        release(state)
        state, before = after, covered
        covered = _rows_within(state, reach)
        curve.append({"cuboids": len(boxes), "covered_fraction": covered / p.count, "added_points": covered - before})
        if on_commit is not None:
            on_commit(boxes)
        if progress is not None:
            progress(f"{len(boxes)} cuboids, {covered / p.count:.4f} covered")
    release(state)
    if reason == "no_candidates":
        raise CoverageNotReachedError(reason)
    return boxes, curve, reason


def _rows_within(state: DataFrame, reach: float) -> int:
    return state.where(F.col("field") <= reach).agg(F.sum("rows")).first()[0] or 0


def _scored(p: Prepared, state: DataFrame, boxes: Sequence[dict], settings: FitSettings, total: float, most_buried: float) -> list[float]:
    if not boxes:
        return []
    return refine.scored(state, list(enumerate(boxes)), p.solid.exterior, p.tolerance, **_options(p, state, settings, total, most_buried))


def _options(p: Prepared, state: DataFrame, settings: FitSettings, total: float, most_buried: float) -> dict:
    deep = state.where(F.col("field") < -p.tolerance * (1 + 1e-10)).agg(F.sum("weight")).first()[0] or 0.0
    return {"total": total, "deep": deep, "reference_volume": 1.0, "penalty": settings.exterior_penalty, "most_buried": most_buried}


def _best_trial(p: Prepared, state: DataFrame, open_points: DataFrame, boxes: Sequence[dict], pool: list[dict], settings: FitSettings, cost: Callable[[dict], float], total: float, most_buried: float) -> dict | None:
    """The box to commit next: of the ``prescreen`` best by gain the ``finalists`` best by score, faces moved out included, refined.

    Candidates that score nothing leave the pool. The winner must also keep
    what the union buries, faces between its boxes included, within bounds.
    """
    while pool:
        measured = _measure(p, open_points, pool)
        order = sorted(range(len(pool)), key=lambda i: (-measured[i]["gain"] / cost(pool[i]), volume(pool[i]), i))
        order = [i for i in order if measured[i]["gain"] > 1e-12][: settings.prescreen]
        if not order:
            return None
        first = [pool[i] for i in order]
        first += [t for t in (_tightened(pool[i], measured[i]) for i in order) if t is not None and p.solid.certify(t)]
        options = _options(p, state, settings, total, most_buried)
        values = refine.scored(state, list(enumerate(first)), p.solid.exterior, p.tolerance, **options)
        ranked = sorted((i for i, v in enumerate(values) if v > 0), key=lambda i: (-values[i], volume(first[i]), i))
        if not ranked:
            gone = {id(pool[i]) for i in order}
            pool[:] = [b for b in pool if id(b) not in gone]
            continue
        finalists = [first[i] for i in ranked[: settings.finalists]]

        def whole(found: Sequence[tuple[dict, float]]) -> list[tuple[dict, float]]:
            """Boxes that score, with the reverse part where the surface counts, best first."""
            found = [(box, value) for box, value in found if value > 0]
            if most_buried < float("inf"):
                gains = reverse_gains(p, boxes, [box for box, _ in found])
                found = [(box, value + 0.25 * gain / cost(box)) for (box, value), gain in zip(found, gains)]
            return sorted(found, key=lambda f: (-f[1], volume(f[0])))

        certify = lambda trials: [p.solid.certify(b) for b in trials]
        longer = [b for b in _extended(p, finalists) if p.solid.certify(b, strict=False)]
        values = refine.scored(state, list(enumerate(longer)), p.solid.exterior, p.tolerance, **options) if longer else []
        # An extended face lies beyond its points until it is refined, so these boxes do not compete with the tight ones yet.
        chosen = finalists + [box for box, _ in whole(list(zip(longer, values)))[: settings.finalists]]
        found = refine.refine_boxes(state, chosen, certify, p.solid.exterior, p.tolerance, least=1e-4 * p.solid.width, **options)
        for box, _ in whole(found):
            if not boxes or most_buried == float("inf"):
                return box
            if burial_feasible(p.points, mesh.boxes_table(p.points.sparkSession, [*boxes, box]), p.tolerance, settings.target_coverage):
                return box
        gone = {id(pool[i]) for i in order}
        pool[:] = [b for b in pool if id(b) not in gone]
    return None


def _face_samples(box: dict, n: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centres of n x n patches of each face, and the patches' areas."""
    at, points, areas = (np.arange(n) + 0.5) / n - 0.5, [], []
    for axis in range(3):
        one, two = (a for a in range(3) if a != axis)
        for side in (-0.5, 0.5):
            local = np.full((n * n, 3), side)
            local[:, one], local[:, two] = (m.ravel() for m in np.meshgrid(at, at))
            points.append(box["center"] + local * box["dimensions"] @ box["rotation"].T)
            areas.append(np.full(n * n, box["dimensions"][one] * box["dimensions"][two] / n**2))
    return np.concatenate(points), np.concatenate(areas)


def _outside(points: np.ndarray, boxes: Sequence[dict], eps: float) -> np.ndarray:
    out = np.ones(len(points), bool)
    for b in boxes:
        out &= (np.abs((points - b["center"]) @ b["rotation"]) - b["dimensions"] / 2).max(axis=1) > -eps
    return out


def reverse_gains(p: Prepared, boxes: Sequence[dict], trials: Sequence[dict]) -> list[float]:
    """By how much each trial lowers the share of outer surface that no point stands behind.

    Patches of all boxes (384 each) meet the points in one nearest join; a
    patch counts by its distance, at most four tolerances, while it is not
    inside another box of the union.
    """
    if not trials:
        return []
    parts = [_face_samples(b) for b in (*boxes, *trials)]
    at, area = np.concatenate([x for x, _ in parts]), np.concatenate([a for _, a in parts])
    rows = [(i, *map(float, v)) for i, v in enumerate(at)]
    samples = p.points.sparkSession.createDataFrame(rows, "id long, x double, y double, z double")
    near = nearest_neighbors(samples, p.points.select("id", "x", "y", "z"), 1).select("id", "d").collect()  # the patches of a round
    far = np.empty(len(at))
    far[[r["id"] for r in near]] = [r["d"] for r in near]
    loss, own = area * np.minimum(far / p.tolerance, 4.0), np.repeat(np.arange(len(parts)), [len(a) for _, a in parts])
    every, eps = [*boxes, *trials], 1e-6 * p.solid.width
    edges = np.ptp(_corners(p), axis=0)
    reference = 2 * (edges[0] * edges[1] + edges[1] * edges[2] + edges[2] * edges[0]) or 1.0

    def error(members: list[int]) -> float:
        total = 0.0
        for k in members:
            mine = own == k
            total += loss[mine][_outside(at[mine], [every[m] for m in members if m != k], eps)].sum()
        return total / (reference + total)

    before = list(range(len(boxes)))
    now = error(before)
    return [now - error([*before, len(boxes) + k]) for k in range(len(trials))]


def _corners(p: Prepared) -> np.ndarray:
    b = p.points.agg(*[F.min(a) for a in "xyz"], *[F.max(a) for a in "xyz"]).first()
    return np.array(b, float).reshape(2, 3)


def _extended(p: Prepared, boxes: Sequence[dict]) -> list[dict]:
    """``boxes`` with one face each moved out as far as the solid's cells allow, where that is any way."""
    spark, origin, least = p.points.sparkSession, p.solid.origin, 1e-6 * p.solid.width
    moved = [b | {"center": b["center"] - origin, "dimensions": np.maximum(b["dimensions"], least)} for b in boxes]
    cells_at = [F.round(F.col(c) - float(o) / p.solid.width).cast("long").alias(c) for c, o in zip(voxel.IJK, origin)]
    farthest = p.solid.width * max(p.solid.safe.shape)
    rows = growth.extended(mesh.flat_boxes(mesh.boxes_table(spark, moved)), p.safe.select(*cells_at), p.solid.width, farthest)
    out = []
    for r in rows.orderBy("box_id", "face", "sign").collect():  # six of each finalist
        b, size = boxes[r["box_id"]], np.array([r["d" + a] for a in "xyz"])
        if (size > b["dimensions"] + 0.5 * p.solid.width).any():
            out.append(b | {"center": np.array([r["c" + a] for a in "xyz"]) + origin, "dimensions": size, "kind": "extended"})
    return out


def residual_boxes(open_points: DataFrame, p: Prepared, parts: int = 8, minimum: int = 4) -> list[dict]:
    """Boxes around the heaviest connected groups of open points, along the group's own axes and the cloud's frames.

    Groups are components of occupied cells, their axes come from moments;
    both are aggregates, and a few rows for each of ``parts`` groups return.
    """
    celled = cells.with_cells(open_points.select("id", "x", "y", "z", "rows", "weight"), 2 * max(2 * p.tolerance, p.spacing), tuple(float(v) for v in p.solid.origin))
    grouped = celled.join(cells.cell_components(celled), list(cells.CELL)).withColumn("part", F.col("component").cast("string"))
    mass = grouped.groupBy("part").agg(F.sum("weight").alias("mass"), F.sum("rows").alias("n")).where(F.col("n") >= minimum)
    heavy = mass.orderBy(F.desc("mass"), "part").limit(parts).select("part")
    grouped = materialize(grouped.join(F.broadcast(heavy), "part").select("part", "x", "y", "z", "rows", "weight"), "residual")
    own = {r["part"]: np.array(r["axes"]).T for r in normals.eigen(normals.moments(grouped, ["part"], counts="rows"), ["part"]).collect()}
    out = []
    for part, axes in sorted(own.items()):
        u, _, v = np.linalg.svd(axes)
        frame = u @ v
        if np.linalg.det(frame) < 0:
            frame[:, 2] = -frame[:, 2]
        frames = [frame, *p.frames]
        rows = frame_table(grouped.where(F.col("part") == part).select("x", "y", "z"), frames).groupBy("f").agg(*_ends()).orderBy("f").collect()  # one row a frame
        out += _bounds_to_boxes(rows, frames, "residual")
    release(grouped)
    return out


def _raw_cells(p: Prepared, open_points: DataFrame, most: int = 8) -> list[dict]:
    """Small cubes at the heaviest cells still open."""
    w = p.solid.width
    side = min(w, p.tolerance / math.sqrt(3))
    rows = voxel_mass(open_points, w).orderBy(F.desc("mass"), *voxel.IJK).limit(most).collect()
    return [make_box([r["mx"], r["my"], r["mz"]], [side] * 3, np.eye(3), "raw") for r in rows]


def voxel_mass(points: DataFrame, width: float) -> DataFrame:
    """Weight of each cell and its point nearest to the cell's least corner, a place that exists in the cloud."""
    celled = points.select("weight", "x", "y", "z", *[F.floor(F.col(a) / width).cast("long").alias(c) for a, c in zip("xyz", voxel.IJK)])
    return celled.groupBy(*voxel.IJK).agg(F.sum("weight").alias("mass"), F.min(F.struct("x", "y", "z")).alias("m")).select(*voxel.IJK, "mass", F.col("m.x").alias("mx"), F.col("m.y").alias("my"), F.col("m.z").alias("mz"))


def to_source(box: dict, p: Prepared) -> dict:
    return box | {"center": p.low + box["center"] * p.scale, "dimensions": box["dimensions"] * p.scale}


def to_unit(box: dict, p: Prepared) -> dict:
    return box | {"center": (box["center"] - p.low) / p.scale, "dimensions": box["dimensions"] / p.scale}


def fit_cuboids(cloud: DataFrame, settings: FitSettings | None = None, *, regions: DataFrame | None = None, committed: Sequence[dict] = (), on_commit: Callable[[list[dict]], None] | None = None, propose=None, progress=None) -> Fit:
    """Cover a cleaned cloud (``id, x, y, z``); ``committed`` boxes (source units) are kept as a prefix."""
    settings = settings or FitSettings()
    p = prepare(cloud, settings, regions)
    tell = None if on_commit is None else lambda boxes: on_commit([to_source(b, p) for b in boxes])
    boxes, curve, reason = select_boxes(p, settings, committed=[to_unit(b, p) for b in committed], propose=propose, on_commit=tell, progress=progress)
    return Fit([to_source(b, p) for b in boxes], curve, reason, p.tolerance * p.scale, p)


def gates(fit: Fit, settings: FitSettings) -> dict:
    """Coverage by rows, by space and by component, surface support bounds, and whether all gates hold."""
    p = fit.prepared
    spark = p.points.sparkSession
    unit = mesh.boxes_table(spark, [to_unit(b, p) for b in fit.boxes])
    table = mesh.flat_boxes(unit)
    named = F.broadcast(table.select(*[F.col(c).alias("b_" + c) for c in table.columns]))
    hit = p.points.join(named, Box("b_").distance() <= p.tolerance * (1 + 1e-12), "left_semi").select("id").withColumn("hit", F.lit(True))
    rows = materialize(p.points.join(hit, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False))), "hits")
    total = rows.agg((F.sum(F.when(F.col("hit"), F.col("rows")).otherwise(0)) / F.sum("rows")).alias("raw"), (F.sum(F.when(F.col("hit"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("spatial")).first()
    least = cells.component_coverage(rows, F.col("hit")).agg(F.min("coverage")).first()[0]
    out = {"raw_coverage": total["raw"], "spatial_coverage": total["spatial"], "minimum_component_coverage": least}
    ok = total["raw"] >= settings.target_coverage and total["spatial"] >= settings.target_coverage - 1e-12 and least >= settings.target_component_coverage
    if settings.target_surface_support > 0:
        skin = mesh.triangles(mesh.exposed_polygons(unit))
        bounds = mesh.support_bounds(skin, p.points.select("id", "x", "y", "z"), p.tolerance, target=settings.target_surface_support)
        out |= {"surface_support_lower": bounds["lower"], "surface_support_upper": bounds["upper"], "exposed_area": bounds["area"] * p.scale**2}
        ok = ok and bounds["lower"] >= settings.target_surface_support
    return out | {"target_reached": bool(ok)}
