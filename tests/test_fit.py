"""One run from a file to exports, and what a fit promises."""

import json

import numpy as np
from pyspark.sql import functions as F

from orthant.functions.config import FitSettings
from orthant.plans import fit, run
from orthant.sources import ply, views


def test_run_resume_and_rebake(spark, tmp_path):
    points = views.sheet(spark, 10).select("x", "y", "z", F.lit(0.8).alias("r"), F.lit(0.3).alias("g"), F.lit(0.2).alias("b"), F.col("id").alias("source_index"))
    ply.write_points(points, str(tmp_path / "a.ply"))
    basic = ["--ply", str(tmp_path / "a.ply"), "--resolution", "12", "--atlas-size", "32"]
    assert run.run(run.parser().parse_args([*basic, "--output", str(tmp_path / "one")]), spark) == 0
    report = json.loads((tmp_path / "one" / "report.json").read_text())
    assert len(report["cuboids"]) == 1 and report["gates"]["target_reached"] and report["texture"]["texture_support"] > 0.9
    assert (tmp_path / "one" / "cuboids.glb").read_bytes()[:4] == b"glTF"
    assert run.run(run.parser().parse_args([*basic, "--output", str(tmp_path / "two"), "--rebake", str(tmp_path / "one")]), spark) == 0
    again = json.loads((tmp_path / "two" / "report.json").read_text())
    assert again["cuboids"] == report["cuboids"] and again["rebaked"]
    assert (tmp_path / "two" / "cuboids.obj").read_bytes() == (tmp_path / "one" / "cuboids.obj").read_bytes()


def test_budget_and_frozen_prefix(spark):
    far = views.sheet(spark, 8).unionByName(views.sheet(spark, 8).select(F.col("id") + 1000, F.col("x") + 3.0, "y", "z").toDF("id", "x", "y", "z"))
    found = fit.fit_cuboids(far, FitSettings(resolution=16, max_cuboids=1))
    assert found.reason == "maximum_box_budget" and len(found.boxes) == 1 and found.curve[-1]["covered_fraction"] < 1
    both = fit.fit_cuboids(far, FitSettings(resolution=16, max_cuboids=3), committed=found.boxes)
    assert both.reason == "target_reached" and len(both.boxes) == 2
    assert np.allclose(both.boxes[0]["center"], found.boxes[0]["center"]) and np.allclose(both.boxes[0]["dimensions"], found.boxes[0]["dimensions"])


def test_a_turned_cube_is_one_box(spark):
    a, b = np.radians(25), np.radians(40)
    turn = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]]) @ np.array([[1, 0, 0], [0, np.cos(b), -np.sin(b)], [0, np.sin(b), np.cos(b)]])
    shell = views.shell(spark, 9)
    at = [sum((float(turn[i, j]) * F.col(c) for j, c in enumerate("yz", 1)), float(turn[i, 0]) * F.col("x")).alias(n) for i, n in enumerate("xyz")]
    found = fit.fit_cuboids(shell.select("id", *at), FitSettings(resolution=24, max_cuboids=4))
    assert found.reason == "target_reached" and len(found.boxes) == 1
    assert np.allclose(sorted(found.boxes[0]["dimensions"]), 1, atol=0.05)


def test_copies_of_a_position_are_one_row_that_counts_for_all(spark):
    rng = np.random.default_rng(5)
    places = np.unique(np.round(rng.uniform(0, 1, (60, 3)) * [4, 3, 1], 2), axis=0)
    copies = rng.integers(1, 40, len(places))
    every = np.repeat(places, copies, axis=0)
    p = fit.prepare(spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(every)], "id long, x double, y double, z double"), FitSettings(resolution=8))
    found = p.points.orderBy("id").collect()
    assert p.count == len(every) and [r["rows"] for r in found] == copies.tolist()
    near = np.linalg.norm(places[:, None] - places, axis=2) + 1e9 * np.eye(len(places))
    assert np.isclose(p.spacing, np.median(np.repeat(near.min(axis=1), copies)) / p.scale)
    # Weights: of a cell all rows share the same, whatever their number.
    at = np.floor((places - places.min(axis=0)) / p.scale / (2 * p.tolerance) + 1e-9)
    cell = np.unique(at, axis=0, return_inverse=True)[1].ravel()
    held = np.bincount(cell, copies)
    assert np.allclose([r["weight"] for r in found], copies / held[cell] * len(every) / len(held))
    axes = np.linalg.eigh(np.cov(every.T))[1]
    assert any((np.abs(f.T @ axes).max(axis=0) > 1 - 1e-9).all() for f in p.frames)


def test_quantiles_of_a_refinement_are_those_of_all_rows(spark):
    from orthant.operators.refine import _quantiles

    rng = np.random.default_rng(6)
    turn, shares = np.linalg.qr(rng.standard_normal((3, 3)))[0], [0.0, 0.005, 0.02, 0.5, 0.95, 1.0]
    groups = [np.exp(3 * rng.standard_normal((700, 3))), np.round(rng.uniform(-1, 1, (200, 3)), 1), np.zeros((3, 3))]  # far outliers, ties, one place
    copies = [rng.integers(1, 60, len(g)) for g in groups]
    rows = [(g, *map(float, v), int(n)) for g, (at, number) in enumerate(zip(groups, copies)) for v, n in zip(at, number)]
    support = spark.createDataFrame(rows, "group int, x double, y double, z double, rows long")
    within = [fit.make_box((at.min(axis=0) + at.max(axis=0)) / 2, np.ptp(at, axis=0), np.eye(3), "x") for at in (*groups, groups[0])]
    frames = [(g, f) for g in range(4) for f in (np.eye(3), turn)]
    found = _quantiles(support, frames, shares, within)
    assert found[6] is None and found[7] is None
    for (g, f), own in zip(frames[:6], found):
        u = np.sort(np.repeat(groups[g] @ f, copies[g], axis=0), axis=0)
        want = [u[min(max(int(np.ceil(s * len(u))), 1), len(u)) - 1] for s in shares]
        assert np.allclose(own, want, rtol=0, atol=2e-9 * (np.ptp(u, axis=0).max() + 1))


def test_grown_boxes_are_the_largest_around_a_seed():
    from itertools import product

    from orthant.plans.fit import Solid

    rng = np.random.default_rng(2)
    for _ in range(12):
        solid = Solid(rng.random((5, 6, 5)) < 0.85, np.zeros(3), 1.0)
        seed = np.argwhere(solid.safe)[rng.integers(solid.safe.sum())]
        boxes = solid.grow(seed)
        assert all((low <= seed).all() and (seed < high).all() and solid.count(low, high) == np.prod(high - low) for low, high in boxes)
        ranges = [[(a, b) for a in range(s + 1) for b in range(s + 1, n + 1)] for s, n in zip(seed.tolist(), solid.safe.shape)]
        best = 0
        for (a, b), (c, d), (e, f) in product(*ranges):
            if (b - a) * (d - c) * (f - e) > best and solid.safe[a:b, c:d, e:f].all():
                best = (b - a) * (d - c) * (f - e)
        own = max(np.prod(high - low) for low, high in boxes)
        assert own >= 0.5 * best  # footprints follow the seed's own line


def test_certificates_against_points_of_the_box():
    from orthant.plans.fit import Solid, make_box

    rng = np.random.default_rng(3)
    solid = Solid(rng.random((8, 8, 8)) < 0.93, np.zeros(3), 0.125)
    seen = set()
    for _ in range(150):
        rotation = np.linalg.qr(rng.standard_normal((3, 3)))[0]
        box = make_box(rng.uniform(0.3, 0.7, 3), rng.uniform(0.02, 0.3, 3), rotation, "x")
        local = rng.uniform(-0.5, 0.5, (4000, 3)) * box["dimensions"]
        at = np.floor((box["center"] + local @ rotation.T) / 0.125).astype(int)
        inside = ((at >= 0) & (at < 8)).all()
        bad = not inside or not solid.safe[tuple(at.T)].all()
        if solid.certify(box):
            assert not bad
        seen.add((solid.certify(box), bad))
    assert (True, False) in seen and (False, True) in seen


def test_atlas_rectangles_keep_their_distance():
    from orthant.operators.texture import pack_atlas

    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        sizes = [tuple(x) for x in rng.uniform(0.05, 3, (n, 2))]
        rects = pack_atlas(sizes, 512, 3)
        used = np.zeros((512, 512), int)
        for (x, y, w, h), (a, b) in zip(rects, sizes):
            assert x >= 3 and y >= 3 and x + w + 3 <= 512 and y + h + 3 <= 512
            used[y - 3 : y + h + 3, x - 3 : x + w + 3] += 1
        assert used.max() == 1 and (n > 7 or used.mean() > 0.3)
        density = max(w / a for (_, _, w, _), (a, _) in zip(rects, sizes))
        assert all(abs(w - a * density) <= 1 + 0.1 * a * density for (_, _, w, _), (a, _) in zip(rects, sizes))
