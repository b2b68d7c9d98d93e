"""Growth, refinement and what the selection of a fit promises."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthant.operators import growth, mesh, objective, refine
from orthant.plans.fit import Solid, make_box


def turned(x, y, z):
    a, b, c = np.radians((x, y, z))
    one = np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]])
    two = np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]])
    three = np.array([[np.cos(c), -np.sin(c), 0], [np.sin(c), np.cos(c), 0], [0, 0, 1]])
    return three @ two @ one


def halving(box, solid, farthest):
    """Each face moved by twelve halvings of the way, the box certified each time."""
    center, size, frame = box["center"].copy(), box["dimensions"].copy(), box["rotation"]
    for axis in np.argsort(-size, kind="stable"):
        for sign in (-1, 1):
            low, high = 0.0, farthest
            for _ in range(12):
                middle, trial = (low + high) / 2, size.copy()
                trial[axis] += middle
                if solid.certify(make_box(center + sign * middle / 2 * frame[:, axis], trial, frame, "x"), strict=False):
                    low = middle
                else:
                    high = middle
            center = center + sign * low / 2 * frame[:, axis]
            size[axis] += low
    return center, size


def test_growth_is_as_far_as_halving_finds(spark):
    rng = np.random.default_rng(3)
    safe, width = rng.random((10, 10, 10)) < 0.96, 0.125
    solid, boxes = Solid(safe, np.zeros(3), width), []
    while len(boxes) < 10:
        frame = np.linalg.qr(rng.standard_normal((3, 3)))[0] if len(boxes) % 2 else np.eye(3)
        box = make_box(rng.uniform(0.3, 0.95, 3), rng.uniform(0.01, 0.12, 3), frame, "x")
        if solid.certify(box):
            boxes.append(box)
    cells = spark.createDataFrame([tuple(map(int, c)) for c in np.argwhere(safe)], "i long, j long, k long")
    table = mesh.flat_boxes(mesh.boxes_table(spark, boxes))
    found = growth.grow_certified(table, cells, width, 10 * width).orderBy("box_id").collect()
    for box, r in zip(boxes, found):
        center, size = halving(box, solid, 10 * width)
        assert np.allclose([r["cx"], r["cy"], r["cz"]], center, atol=1e-9) and np.allclose([r["dx"], r["dy"], r["dz"]], size, atol=1e-9)
    # A box over cells that are not safe, and one without any safe cell around, stay as they are.
    stuck = [make_box(np.full(3, 0.6), np.full(3, 1.2), np.eye(3), "x"), make_box(np.full(3, 9.0), np.full(3, 0.1), np.eye(3), "x")]
    left = growth.grow_certified(mesh.flat_boxes(mesh.boxes_table(spark, stuck)), cells, width, 10 * width).orderBy("box_id").collect()
    assert [(r["dx"], r["dy"], r["dz"]) for r in left] == [(1.2, 1.2, 1.2), (0.1, 0.1, 0.1)]


def test_growth_by_score_takes_a_share_of_the_way(spark):
    cells = spark.range(8).select(F.col("id").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("k"))
    box = mesh.flat_boxes(mesh.boxes_table(spark, [make_box(np.array([3.5, 0.5, 0.5]), np.full(3, 0.5), np.eye(3), "x")]))
    whole = growth.grow_certified(box, cells, 1.0, 16.0).first()
    assert (whole["dx"], whole["dy"], whole["dz"]) == (8.0, 1.0, 1.0)
    wants = lambda trials: trials.select("box_id", (-F.abs(F.col("dx") - 4.4) - F.abs(F.col("dy") - 0.5)).alias("score"))
    part = growth.grow_certified(box, cells, 1.0, 16.0, wants).first()
    assert part["dx"] == pytest.approx(0.5 + 3.25 + 0.25 * 4.25, abs=0.01) and part["dy"] == 0.5


def rectangles(parts, step):
    out = []
    for low, high in parts:
        axes = [np.linspace(a, b, int(np.ceil((b - a) / step)) + 1) for a, b in zip(low, high)]
        out.append(np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3))
    return np.unique(np.concatenate(out), axis=0)


L_PRISM = [
    ([0, 0, 0], [0, 2, 1]), ([1, 1, 0], [1, 2, 1]), ([2, 0, 0], [2, 1, 1]), ([0, 0, 0], [2, 0, 1]), ([1, 1, 0], [2, 1, 1]),
    ([0, 2, 0], [1, 2, 1]), ([0, 0, 0], [2, 1, 0]), ([0, 1, 0], [1, 2, 0]), ([0, 0, 1], [2, 1, 1]), ([0, 1, 1], [1, 2, 1]),
]


def cloud(spark, points, tolerance):
    from orthant.operators.cells import spatial_weights

    table = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double, z double")
    return objective.with_field(spatial_weights(table, 2 * tolerance)).cache()


def plain_score(points, weights, box, tolerance, target):
    """The objective of one box alone, as loops would have it; all cells are safe."""
    local = np.abs((points - box["center"]) @ box["rotation"]) - box["dimensions"] / 2
    signed = np.sqrt((np.maximum(local, 0) ** 2).sum(axis=1)) + np.minimum(local.max(axis=1), 0)
    if weights[signed < -tolerance * (1 + 1e-10)].sum() > (1 - target) * weights.sum() + 1e-9 * weights.sum():
        return 0.0
    gains = (signed <= tolerance) * 1.0 + (1 - np.minimum(np.abs(signed) / tolerance, 1)) + (np.abs(signed) <= tolerance)
    return (weights * gains).sum() / weights.sum()


def test_an_expanded_arm_of_an_l_is_recovered(spark):
    points, tolerance = rectangles(L_PRISM, 0.06), 0.06
    table = cloud(spark, points, tolerance)
    weights = np.array([r["weight"] for r in table.orderBy("id").collect()])
    seed = make_box(np.array([49, 25, 25]) / 48, np.array([53, 27, 27]) / 24, np.eye(3), "x")
    arm = make_box(np.array([1, 0.5, 0.5]), np.array([2.0, 1, 1]), np.eye(3), "x")
    everything = lambda boxes: [True] * len(boxes)
    options = dict(total=float(weights.sum()), deep=0.0, reference_volume=3.0, most_buried=0.0)
    assert refine.scored(table, [(0, seed), (1, arm)], lambda b: 0.0, tolerance, **options) == pytest.approx([plain_score(points, weights, b, tolerance, 1) for b in (seed, arm)])
    (found, score), = refine.refine_boxes(table, [seed], everything, lambda b: 0.0, tolerance, **options)
    assert plain_score(points, weights, seed, tolerance, 1) == 0 and plain_score(points, weights, arm, tolerance, 1) > 1
    assert score >= plain_score(points, weights, arm, tolerance, 1) - 1e-12
    assert score == pytest.approx(plain_score(points, weights, found, tolerance, 1))
    # Nothing certified: the proposal stays.
    (same, _), = refine.refine_boxes(table, [seed], lambda boxes: [False] * len(boxes), lambda b: 0.0, tolerance, **options)
    assert same is seed
    assert refine.refine_boxes(table, [], everything, lambda b: 0.0, tolerance, **options) == []


def test_several_faces_are_trimmed_together(spark):
    grid, faces = np.linspace(0, 1, 11), []
    u, v = (m.ravel() for m in np.meshgrid(grid, grid))
    for axis in range(3):
        for side in (0, 1):
            face = np.full((u.size, 3), float(side))
            face[:, [a for a in range(3) if a != axis]] = np.column_stack((u, v))
            faces.append(face * [2, 1, 1])
    y, z = (m.ravel() for m in np.meshgrid(np.linspace(1.11, 1.13, 4), np.linspace(0.2, 0.8, 6)))
    source = np.vstack((np.unique(np.concatenate(faces), axis=0), np.column_stack((np.zeros(y.size), y, z))))
    tolerance, proposals, expected = 0.06, [], []
    frames = [np.eye(3), turned(17, 31, 53)]
    # Two clouds side by side in one table: proposals of both are refined in the same steps.
    points = np.concatenate([(source + np.random.default_rng(42).normal(0, 2e-4, source.shape) * k) @ f.T + [3 + 20 * k, 3, 3] for k, f in enumerate(frames)])
    table = cloud(spark, points, tolerance)
    weights = np.array([r["weight"] for r in table.orderBy("id").collect()])
    for k, f in enumerate(frames):
        proposals.append(make_box(np.array([1, 0.55, 0.5]) @ f.T + [3 + 20 * k, 3, 3], np.array([2.16, 1.3, 1.16]), f, "x"))
    options = dict(total=float(weights.sum()), deep=0.0, reference_volume=4.0, most_buried=0.001 * float(weights.sum()))
    assert refine.scored(table, list(enumerate(proposals)), lambda b: 0.0, tolerance, **options) == [0.0, 0.0]
    found = refine.refine_boxes(table, proposals, lambda boxes: [True] * len(boxes), lambda b: 0.0, tolerance, **options)
    for box, score in found:
        assert np.allclose(box["dimensions"], [2, 1, 1], atol=0.002)
        assert score == pytest.approx(plain_score(points, weights, box, tolerance, 0.999)) and score > 0.5


def test_the_field_of_many_commits_is_the_union_field(spark):
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(-1, 1, (300, 3)))], "id long, x double, y double, z double")
    boxes = [make_box(rng.uniform(-0.7, 0.7, 3), rng.uniform(0.1, 0.9, 3), np.linalg.qr(rng.standard_normal((3, 3)))[0], "x") for _ in range(5)]
    state = objective.with_field(points)
    for box in boxes:
        state = objective.with_field(state, box)
    whole = {r["id"]: r["field"] for r in objective.union_field(points, mesh.flat_boxes(mesh.boxes_table(spark, boxes))).collect()}
    assert all(r["field"] == pytest.approx(whole[r["id"]], abs=1e-12) for r in state.collect())


def test_an_l_takes_three_boxes_at_most(spark):
    from orthant.functions.config import FitSettings
    from orthant.plans import fit
    from orthant.sources import views

    points = views.case_cloud(spark, "l_shape", 0.125).withColumn("id", F.monotonically_increasing_id())
    found = fit.fit_cuboids(points.select("id", "x", "y", "z"), FitSettings(resolution=24, max_cuboids=4))
    assert len(found.boxes) <= 3 and found.curve[-1]["covered_fraction"] >= 0.999
    assert found.reason in ("target_reached", "surface_quality_not_reached")
    # No point lies deep in a box: the whole bounding box, which would cover everything, was not taken.
    state = found.prepared.points
    for box in found.boxes:
        state = objective.with_field(state, fit.to_unit(box, found.prepared))
    assert state.where(F.col("field") < -found.prepared.tolerance * 1.001).count() == 0
