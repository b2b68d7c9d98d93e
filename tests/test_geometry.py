"""Analytic and brute-force checks of the geometry."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthant.functions import config, scalar
from orthant.operators import cells, mesh, normals, spatial, voxel, windows
from orthant.sources import views

EYE = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]


def cloud(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double, z double")


def test_neighbours_equal_all_pairs_over_very_different_densities(spark):
    rng = np.random.default_rng(7)
    p = np.concatenate((rng.random((80, 3)), rng.random((80, 3)) * 1e-4, [[1000.0, 0, 0]]))
    got = {(r["id"], r["rank"]): r["other_id"] for r in spatial.nearest_neighbors(cloud(spark, p), cloud(spark, p), 4, exclude_self=True).collect()}
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    np.fill_diagonal(d, np.inf)
    for i in range(len(p)):
        assert [got[i, k] for k in range(1, 5)] == np.lexsort((np.arange(len(p)), d[i]))[:4].tolist()


def test_neighbours_of_few_points(spark):
    two = cloud(spark, [(0, 0, 0), (1, 0, 0)])
    assert spatial.nearest_neighbors(two, two, 5).count() == 4
    assert spatial.nearest_neighbors(two, two.limit(0), 5).count() == 0


def test_outlier_far_from_a_sheet(spark):
    sheet = views.sheet(spark, 30)
    both = sheet.unionByName(spark.createDataFrame([(900, 10000.0, 0.0, 0.0)], sheet.schema))
    assert [r["id"] for r in spatial.local_outliers(both).where("is_outlier").collect()] == [900]
    assert spatial.local_outliers(both, 0.0).where("is_outlier").count() == 0


def test_spacing_ignores_copies(spark):
    sheet = views.sheet(spark, 18)
    once = spatial.nearest_spacing(sheet).agg(F.median("spacing")).first()[0]
    copies = sheet.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).drop("k")
    assert spatial.nearest_spacing(copies).agg(F.median("spacing")).first()[0] == once == pytest.approx(1 / 17)


def test_box_boundary_far_from_the_origin(spark):
    box = spark.createDataFrame([(0, 1e8, -2e8, 3e8, 2.0, 4.0, 6.0, *np.eye(3).reshape(-1).tolist())], "box_id int, " + ", ".join(f"{c} double" for c in ("cx", "cy", "cz", "dx", "dy", "dz", *[f"r{i}{j}" for i in range(3) for j in range(3)])))
    on = cloud(spark, [(1e8 + 1, -2e8 + t, 3e8) for t in np.linspace(-2, 2, 100)])
    assert spatial.box_points(box, on, 0.0).count() == 100
    assert spatial.box_points(box, on, 0.0, width=3.0).count() == 100


def test_touching_is_no_overlap(spark):
    step = math.ulp(1.0)
    rows = [(float(x),) for x in (1.0, 1.0 - step, 1.0 + step, -1.0, -1.0 + step)]
    table = spark.createDataFrame(rows, "at double").withColumns({"i": F.col("at") - 0.5, "j": F.lit(-0.5), "k": F.lit(-0.5)})
    one = {f"b_{c}": v for c, v in zip(("cx", "cy", "cz", "dx", "dy", "dz", *[f"r{i}{j}" for i in range(3) for j in range(3)]), (0.0, 0.0, 0.0, 1.0, 1.0, 1.0, *np.eye(3).reshape(-1)))}
    table = table.withColumns({k: F.lit(float(v)) for k, v in one.items()})
    assert [r["hit"] for r in table.select(voxel.box_overlaps_voxel(1.0).alias("hit")).collect()] == [False, True, False, False, True]


def test_morphology_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    grid = rng.random((6, 6, 6)) < 0.7
    table = spark.createDataFrame([tuple(map(int, v)) for v in np.argwhere(grid)], "i long, j long, k long")
    padded = np.pad(grid, 1)
    small = np.all([padded[1 + a : 7 + a, 1 + b : 7 + b, 1 + c : 7 + c] for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)], axis=0)
    assert sorted(tuple(r) for r in voxel.erode(table, 1).collect()) == sorted(map(tuple, np.argwhere(small).tolist()))
    wide = np.pad(grid, 2)
    large = np.any([np.roll(wide, (a, b, c), (0, 1, 2)) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)], axis=0)
    assert sorted(tuple(r) for r in voxel.dilate(table, 1).collect()) == sorted(map(tuple, (np.argwhere(large) - 2).tolist()))


def test_a_closed_shell_fills_and_an_open_one_does_not(spark):
    shell = [(i, j, k) for i in range(5) for j in range(5) for k in range(5) if {0, 4} & {i, j, k}]
    full = spark.createDataFrame(shell, "i long, j long, k long")
    assert voxel.fill_holes(full).count() == 125
    assert voxel.fill_holes(full.where("not (i = 0 and j = 2 and k = 2)")).count() == len(shell) - 1
    assert voxel.clearance(voxel.fill_holes(full)).agg(F.max("clearance")).first()[0] == 3


def test_line_stays_one_component_and_weights_do_not_move(spark):
    line = [(0.3 * i, 0, 0) for i in range(10)] + [(1.0, 0, 0)]
    a = cells.spatial_weights(cloud(spark, line), 0.3).orderBy("id").collect()
    b = cells.spatial_weights(cloud(spark, np.array(line) / 2.7), 0.3 / 2.7).orderBy("id").collect()
    assert [r["weight"] for r in a] == pytest.approx([r["weight"] for r in b])
    assert sum(r["weight"] for r in a) == pytest.approx(11)
    assert cells.cell_components(cells.with_cells(cloud(spark, line), 0.3)).select("component").distinct().count() == 1


def test_component_coverage_counts_places_not_rows(spark):
    points = cells.spatial_weights(cloud(spark, [(0, 0, 0)] * 1000 + [(10, 0, 0)]), 0.2)
    named = points.withColumn("component", F.when(F.col("x") > 5, 1).otherwise(0))
    out = cells.component_coverage(named, F.col("x") < 5).orderBy("component").collect()
    assert [r["coverage"] for r in out] == [1.0, 0.0]


def test_noise_has_few_normals(spark):
    rng = np.random.default_rng(3)
    places, edges = normals.neighbourhoods(cloud(spark, rng.uniform(-1, 1, (1500, 3))))
    assert normals.local_geometry(places, edges).where("valid").count() < 0.15 * 1500


def test_union_of_cases(spark):
    for name, area in (("cube", 6.0), ("l_shape", 2 * (2.5 + 0.5) + 7.0)):
        rows = views.CASES[name]
        bounds = [(i, *(float(c - e / 2) for c, e in zip(*b)), *(float(c + e / 2) for c, e in zip(*b))) for i, b in enumerate(rows)]
        rects = views.union_rectangles(spark.createDataFrame(bounds, "box_id int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"))
        e = [F.col(f"{a}1") - F.col(f"{a}0") for a in "xyz"]
        total = rects.agg(F.sum(e[0] * e[1] + e[1] * e[2] + e[2] * e[0])).first()[0]
        poly = mesh.exposed_polygons(mesh.boxes_table(spark, [{"center": c, "dimensions": d, "rotation": EYE} for c, d in rows])).agg(F.sum("area")).first()[0]
        assert total == pytest.approx(poly)
        if name == "cube":
            assert total == pytest.approx(area)


def test_layers_composite_front_to_back(spark):
    def texel(alpha):
        rows = [(0, 0.005, alpha, 1.0, 0.0, 0.0, 0.0, 0.01), (0, 0.03, 1.0, 1.0, 1.0, 1.0, 1.0, 0.01)]
        return windows.composite_layers(spark.createDataFrame(rows, "t int, depth double, alpha double, w double, r double, g double, b double, spacing double"), ["t"]).first()

    thin, thick = texel(0.1), texel(1.0)
    assert thin["r"] == pytest.approx(0.9) and thin["depth"] == 0.005 and thin["alpha"] == pytest.approx(1.0)
    assert thick["r"] == pytest.approx(0.0)


def test_settings_are_checked():
    for bad in ({"max_cuboids": 0}, {"target_coverage": 1.5}, {"tolerance": -1.0}, {"resolution": 1}):
        with pytest.raises(ValueError):
            config.FitSettings(**bad)
    with pytest.raises(ValueError):
        config.check_grid((1000, 1000, 1000), 1 << 30)
    with pytest.raises(ValueError):
        config.worker_count(-1)
    assert all(abs(np.linalg.det(config.up_rotation(a)) - (-1 if a == "-y" else 1)) < 1e-12 or a == "-y" for a in ("+x", "-x", "+y", "-y", "+z", "-z"))


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.support_status(F.lit(0.96), F.lit(None).cast("double"), 0.95).alias("a"),
        scalar.support_status(F.lit(0.1), F.lit(0.2), 0.95).alias("b"),
        scalar.support_status(F.lit(None).cast("double"), F.lit(None).cast("double"), 0.95).alias("c"),
        scalar.sane_color(F.lit(float("nan"))).alias("d"),
        scalar.sane_color(F.lit(float("inf"))).alias("e"),
        scalar.linear_to_srgb(scalar.srgb_to_linear(F.lit(0.37))).alias("f"),
        F.array(*scalar.palette(F.lit(-1))).alias("g"),
    ).first()
    assert tuple(row)[:5] == ("reached", "not_reached", "inconclusive", 0.65, 1.0)
    assert row["f"] == pytest.approx(0.37) and row["g"] == [0.61, 0.64, 0.68]


def _segments(found):
    lines, support = found
    ids = {}
    for r in support.collect():
        ids.setdefault(r["seg_id"], []).append(r["id"])
    return [(r, sorted(ids[r["seg_id"]])) for r in lines.collect()]


def test_edge_lines_of_three_axes(spark):
    """Three edges of 100 positions, the last of low score."""
    rows = [(100 * n + i, *(float(i) / 10 if a == n else 5.0 * (a == (n + 1) % 3) for a in range(3)), 90.0 if n < 2 else 10.0) for n in range(3) for i in range(100)]
    edge = spark.createDataFrame(rows, "id long, x double, y double, z double, score double")
    found = _segments(normals.edge_lines(edge, 0.1))
    assert sorted(ids for _, ids in found) == [list(range(100 * n, 100 * n + 100)) for n in range(3)]
    for r, ids in found:
        assert math.dist(r["a"], r["b"]) == pytest.approx(9.9) and r["n"] == 100 and r["gap"] == pytest.approx(0.1) and r["rmse"] < 1e-9
    assert sorted(r["score"] for r, _ in found) == [10, 90, 90]
    assert normals.edge_lines(edge.limit(0), 0.1)[0].count() == 0


def test_edges_of_a_cube(spark):
    cube = views.shell(spark, 21)
    on = [F.when(F.abs(F.col(a)) > 0.5 - 1e-9, 1).otherwise(0) for a in "xyz"]
    found = _segments(normals.edge_lines(cube.where(on[0] + on[1] + on[2] >= 2).withColumn("score", F.lit(90.0)), 1 / 20))
    assert len(found) == 12
    for r, _ in found:
        step = np.abs(np.array(r["a"]) - np.array(r["b"]))
        assert abs(step.max() - 1) < 0.35 and np.sort(step)[1] < 0.05


def test_tangents_follow_lines(spark):
    rng = np.random.default_rng(4)
    line = np.linspace(0, 1, 60)[:, None] * [0.6, 0.8, 0] + [1, 2, 3]
    blob = rng.uniform(0, 0.2, (80, 3)) - 5
    found = {r["id"]: r for r in normals.tangents(cloud(spark, [*line, *blob, (50, 50, 50)]), 0.1).collect()}
    for i in range(60):
        assert abs(abs(np.dot(found[i]["tangent"], [0.6, 0.8, 0])) - 1) < 1e-9 and found[i]["linearity"] > 1 - 1e-9
    assert np.mean([found[i]["linearity"] for i in range(60, 140)]) < 0.6
    assert found[140]["linearity"] == 0


def test_collinear_segments_merge_and_others_do_not(spark):
    """Two halves of one line, one across and one beyond a gap."""
    at = [(0, (i / 10, 0.0, 0.0)) for i in range(20)] + [(1, (2 + i / 10, 0.0, 0.0)) for i in range(20)]
    at += [(2, (2.0, 0.1 + i / 10, 0.0)) for i in range(20)] + [(3, (4.5 + i / 10, 0.0, 0.0)) for i in range(20)]
    held = spark.createDataFrame([(n, i, *p, 1.0, 1.0) for i, (n, p) in enumerate(at)], "seg_id int, id long, x double, y double, z double, w double, score double")
    ends = {n: tuple(np.array([p for m, p in at if m == n])[[0, -1]]) for n in range(4)}
    assert normals._merged(held, ends, 0.15, 0.4, 5.0) == {0: 0, 1: 0, 2: 2, 3: 3}
    assert normals._merged(held, ends, 0.15, 0.7, 5.0) == {0: 0, 1: 0, 2: 2, 3: 0}
    assert normals._merged(held, ends, 0.15, 0.7, 0.0) == {n: n for n in range(4)}


def test_neighbours_where_points_coincide(spark):
    from orthant.operators.spatial import nearest_neighbors

    rng = np.random.default_rng(2)
    at = np.concatenate((rng.uniform(0, 1, (300, 3)), np.repeat([[0.5, 0.5, 0.5]], 80, axis=0)))
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "id long, x double, y double, z double")
    got = {(r["id"], r["rank"]): (r["other_id"], r["d"]) for r in nearest_neighbors(points, points, 3, exclude_self=True).collect()}
    far = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    for i in range(len(at)):
        near = sorted((far[i, j], j) for j in range(len(at)) if j != i)[:3]
        assert [got[i, k + 1][0] for k in range(3)] == [j for _, j in near]
    with pytest.raises(RuntimeError, match="rounds"):
        nearest_neighbors(points, points, 3, exclude_self=True, width=1e-9, rounds=2)


def test_hull_facets_equal_all_triples():
    from itertools import combinations

    from orthant.operators import hull

    rng = np.random.default_rng(6)
    for n in (4, 9, 40):
        p = rng.normal(size=(n, 3))
        want = []
        for t in combinations(range(n), 3):
            cross = np.cross(p[t[1]] - p[t[0]], p[t[2]] - p[t[0]])
            side = (p - p[t[0]]) @ cross / np.linalg.norm(cross)
            if (side <= 1e-12).all() or (side >= -1e-12).all():
                want.append((np.linalg.norm(cross) / 2, *(cross / np.linalg.norm(cross) * (1 if side.min() < -1e-12 else -1))))
        normal, area = hull.facets(p)
        got = np.array(sorted(zip(area, *normal.T)))
        assert np.allclose(got, np.array(sorted(want)))
    assert not len(hull.facets(np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0]], float))[1])


def test_hull_directions_of_a_turned_square_and_cube(spark):
    from orthant.operators import hull

    turn = np.array([[0.6, -0.8, 0], [0.8, 0.6, 0], [0, 0, 1]]) @ np.array([[1, 0, 0], [0, 12 / 13, -5 / 13], [0, 5 / 13, 12 / 13]])
    grid = np.array([(a, b, 0) for a in range(12) for b in range(12)], float)
    cube = np.array([(a, b, c) for a in range(7) for b in range(7) for c in range(7) if {0, 6} & {a, b, c}], float)
    for shape, count in ((grid, 3), (cube, 3)):
        found = hull.hull_directions(cloud(spark, shape @ turn.T))
        assert len(found) == count
        frame = hull.frames_of(found)[0]
        assert np.allclose(np.abs(frame.T @ turn).max(axis=0), 1) and np.linalg.det(frame) > 0
    line = cloud(spark, [(i, 2 * i, 0) for i in range(9)])
    assert hull.hull_directions(line) == [] and hull.hull_directions(line.limit(0)) == []
    # Thousands of inner points and copies change nothing.
    rng = np.random.default_rng(1)
    more = np.concatenate((cube, cube, rng.uniform(1, 5, (3000, 3)))) @ turn.T
    assert np.allclose([w for _, w in hull.hull_directions(cloud(spark, more))], 1 / 3)


def test_turned_cells_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    solid = np.ones((9, 8, 7), bool)
    solid[tuple(rng.integers(0, 7, (3, 4)))] = False
    safe = {tuple(map(int, c)) for c in np.argwhere(solid) - 3}
    turn = np.array([[0.6, -0.8, 0], [0.8, 0.6, 0], [0, 0, 1]])
    got = {tuple(r) for r in voxel.turned_cells(spark.createDataFrame(sorted(safe), "i long, j long, k long"), turn).collect()}
    half, want = np.abs(turn).sum(axis=1) / 2, set()
    for cell in np.array(np.meshgrid(*[range(-14, 15)] * 3)).reshape(3, -1).T:
        centre = turn @ (cell + 0.5)
        low, high = np.floor(centre - half + 1e-9).astype(int), np.ceil(centre + half - 1e-9).astype(int)
        if all((i, j, k) in safe for i in range(low[0], high[0]) for j in range(low[1], high[1]) for k in range(low[2], high[2])):
            want.add(tuple(map(int, cell)))
    assert got == want and want
    eye = {tuple(r) for r in voxel.turned_cells(spark.createDataFrame(sorted(safe), "i long, j long, k long"), np.eye(3)).collect()}
    assert eye == safe


def test_support_bounds_hold_dense_samples(spark):
    tri = spark.createDataFrame([([0.0, 0.0, 0.0], [2.0, 0.0, 0.0], [0.0, 2.0, 0.0], 2.0)], "a array<double>, b array<double>, c array<double>, area double")
    found = mesh.support_bounds(tri, cloud(spark, [(0, 0, 0), (1.2, 0.3, 0.1)]), 0.5, gap=0.1)
    u, v = (np.stack(np.meshgrid(*[(np.arange(400) + 0.5) / 400] * 2)).reshape(2, -1))
    keep = u + v < 1
    at = np.column_stack((2 * u[keep], 2 * v[keep], np.zeros(keep.sum())))
    share = (np.minimum(np.linalg.norm(at, axis=1), np.linalg.norm(at - [1.2, 0.3, 0.1], axis=1)) <= 0.5).mean()
    assert found["lower"] - 1e-3 <= share <= found["upper"] + 1e-3 and found["upper"] - found["lower"] <= 0.1


def test_large_triangles_are_sampled_in_blocks(spark):
    tri = spark.createDataFrame([(1, 0, [0.0, 0.0, 0.0], [2.0, 0.0, 0.0], [0.0, 2.0, 0.0], 2.0)], "tri_id long, box_id int, a array<double>, b array<double>, c array<double>, area double")
    plain, blocks = (mesh.surface_samples(tri, 0.1, block=b).select("k", "x", "y", "area").orderBy("k").collect() for b in (4096, 7))
    assert plain == blocks and [r["k"] for r in plain] == list(range(200)) and sum(r["area"] for r in plain) == pytest.approx(2)


def test_nearest_within_against_all_pairs(spark):
    from orthant.operators.spatial import nearest_within

    rng = np.random.default_rng(31)
    p, q = rng.uniform(-1, 1, (300, 3)), rng.uniform(-2, 2, (120, 3))
    far = np.linalg.norm(q[:, None] - p[None], axis=2)
    got = {r["id"]: (r["other_id"], r["d"]) for r in nearest_within(cloud(spark, q), cloud(spark, p), 0.4, 3).collect()}
    assert set(got) == set(np.flatnonzero(far.min(axis=1) <= 0.4).tolist()) and 0 < len(got) < 120
    assert all(other == far[i].argmin() and abs(d - far[i].min()) < 1e-12 for i, (other, d) in got.items())


def test_support_bounds_take_no_round_for_far_triangles(spark, monkeypatch):
    def no_search(*_, **__):
        raise AssertionError("a triangle far from all points needs no widening search")

    monkeypatch.setattr(mesh, "nearest_neighbors", no_search, raising=False)
    tri = spark.createDataFrame([([0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], 0.5), ([900.0, 0.0, 0.0], [901.0, 0.0, 0.0], [900.0, 1.0, 0.0], 0.5)], "a array<double>, b array<double>, c array<double>, area double")
    found = mesh.support_bounds(tri, cloud(spark, [(0.3, 0.3, 0.0)]), 2.0)
    assert found["lower"] == found["upper"] == 0.5 and found["levels"] == 1


@pytest.mark.parametrize("slice_points", [50_000, 40])
def test_any_within_against_all_pairs(spark, monkeypatch, slice_points):
    monkeypatch.setattr(spatial, "SLICE_POINTS", slice_points)
    rng = np.random.default_rng(36)
    p, q, reach = rng.uniform(-1, 1, (300, 3)), rng.uniform(-3, 3, (120, 3)), rng.uniform(0.2, 0.9, 120)
    asks = cloud(spark, q).join(spark.createDataFrame([(i, float(r)) for i, r in enumerate(reach)], "id long, reach double"), "id")
    got = [r["id"] for r in spatial.any_within(asks, cloud(spark, p), 0.9, 300, 3).collect()]
    want = np.flatnonzero(np.linalg.norm(q[:, None] - p[None], axis=2).min(axis=1) <= reach).tolist()
    assert sorted(got) == want and 0 < len(got) < 120


def test_nearest_within_is_the_same_with_points_spread(spark):
    rng = np.random.default_rng(37)
    q, p = cloud(spark, rng.uniform(-2, 2, (200, 3))), cloud(spark, rng.uniform(-1, 1, (90, 3)))
    plain, spread = (sorted(map(tuple, spatial.nearest_within(q, p, 0.4, 3, spread_points=s).collect())) for s in (False, True))
    assert plain == spread and len(plain) > 5


def test_support_bounds_search_no_nearest_point_of_wide_triangles(spark, monkeypatch):
    asked = []
    nearest = mesh.nearest_within
    monkeypatch.setattr(mesh, "nearest_within", lambda q, p, reach, *a, **b: (asked.append(reach), nearest(q, p, reach, *a, **b))[1])
    tri = spark.createDataFrame([([0.0, 0.0, 0.0], [8.0, 0.0, 0.0], [0.0, 8.0, 0.0], 32.0), ([0.0, 0.0, 9.0], [0.3, 0.0, 9.0], [0.0, 0.3, 9.0], 0.045)], "a array<double>, b array<double>, c array<double>, area double")
    found = mesh.support_bounds(tri, cloud(spark, [(1.0, 1.0, 0.0), (4.0, 2.0, 0.2), (0.1, 0.1, 9.0)]), 0.5)
    within = (np.pi * 0.25 + np.pi * 0.21 + 0.045) / 32.045  # two circles inside the large one, all of the small one
    assert found["lower"] <= within <= found["upper"] and found["upper"] - found["lower"] <= 0.002
    assert asked and max(asked) < 0.5 * 7 / 3 + 0.01


def test_the_query_of_support_bounds_leaves_at_most_the_settings_gap(spark, tmp_path):
    from orthant.plans.registry import queries

    rows = [(1, [0.0, 0.0, 0.0], 0), (2, [0.4, 0.3, 0.2], 0), (3, [0.3, 0.1, 0.1], 1), (4, [0.6, 0.5, 0.4], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries()["support_bounds"](spark, str(tmp_path)).first()
    assert 0 < found["lower"] <= found["upper"] <= found["lower"] + 0.002


def test_neighbours_of_many_copies_meet_few_of_them(spark):
    from orthant.operators import spatial

    rng = np.random.default_rng(32)
    places = rng.uniform(0, 1, (12, 3))
    p = np.repeat(places, 40, axis=0)
    kept = spatial._first_of_each(cloud(spark, p), 4)
    assert kept.count() == 12 * 4
    for own in (False, True):
        got = {(r["id"], r["rank"]): r["other_id"] for r in spatial.nearest_neighbors(cloud(spark, p), cloud(spark, p), 3, exclude_self=own).collect()}
        d = np.linalg.norm(p[:, None] - p[None], axis=2)
        if own:
            np.fill_diagonal(d, np.inf)
        order = np.argsort(d, axis=1, kind="stable")[:, :3]
        assert got == {(i, r + 1): int(order[i, r]) for i in range(len(p)) for r in range(3)}


def test_a_neighbour_search_is_dealt_over_tasks(spark, monkeypatch):
    from orthant.operators import spatial

    plans = []
    written = spatial.materialize
    monkeypatch.setattr(spatial, "TASK_PAIRS", 1000)
    monkeypatch.setattr(spatial, "materialize", lambda df, name="step": (plans.append((name, df._jdf.queryExecution().sparkPlan().toString())), written(df, name))[1])
    p = np.random.default_rng(33).uniform(0, 1, (200, 3))
    assert spatial.nearest_neighbors(cloud(spark, p), cloud(spark, p), 5, exclude_self=True, places=True).count() == 1000
    first = next(plan for name, plan in plans if name == "nearest")
    assert "Broadcast" not in first and "20), REPARTITION_BY_NUM" in first


def test_transferred_normals_send_no_table_through_the_driver(spark):
    from orthant.operators import objective

    p = np.repeat(np.random.default_rng(34).uniform(0, 1, (30, 3)), 5, axis=0)
    donors = cloud(spark, p).withColumn("normal", F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).withColumn("spacing", F.lit(0.5))
    found = objective.transfer_normals(cloud(spark, p), donors)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert found.count() == 150


def test_exact_quantiles_order_only_what_lies_around_the_ranks(spark, monkeypatch):
    def whole(*_, **__):
        raise AssertionError("percentile gathers all values in one task")

    monkeypatch.setattr(F, "percentile", whole)
    rng = np.random.default_rng(35)
    shares = (0.0, 0.37, 0.5, 0.95, 1.0)
    for values in (rng.normal(size=4001), np.round(rng.normal(size=900)), np.array([3.0]), np.array([1.0, 1e300, -1e300])):
        rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        for accuracy in (10_000, 50):
            assert np.allclose(windows.exact_quantiles(rows, "v", shares, accuracy), np.quantile(values, shares), rtol=1e-12, atol=1e-12)
    assert windows.exact_quantiles(rows.where("v > 1e301"), "v", (0.5,)) == [None]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_a_radius_join_deals_a_crowded_cell_over_tasks(spark, monkeypatch, broadcast):
    monkeypatch.setattr(spatial, "BLOCK_ROWS", 50, raising=False)
    monkeypatch.setattr(spatial, "CROWDED_CELLS", broadcast, raising=False)
    rng = np.random.default_rng(8)
    q = np.vstack([rng.uniform(0.01, 0.09, (400, 3)), np.full((90, 3), -0.25), rng.uniform(-0.5, 0.5, (200, 3)), [(1e8, -2e8, 3e8), (1e17, 0, 0)]])
    p = np.vstack([q[::2], rng.uniform(0.0, 0.1, (300, 3)), [(float("nan"), 0.0, 0.0)], [(1e8 + 0.05, -2e8, 3e8)]])
    found = spatial.radius_join(cloud(spark, q), cloud(spark, p), 0.1).withColumn("task", F.spark_partition_id()).collect()
    d = q[:, None] - p[None]
    d = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2])
    assert {(r["id"], r["other_id"]): r["d"] for r in found} == {(i, j): d[i, j] for i, j in np.argwhere(d <= 0.1).tolist()}
    assert len(found) == (d <= 0.1).sum()
    # A task meets several blocks at most, however full the cell.
    assert np.unique([r["task"] for r in found], return_counts=True)[1].max() < 8 * 50 * 50


def test_a_radius_join_without_rows_or_reach(spark):
    two = cloud(spark, [(0.0, 0.0, 0.0), (0.0, 0.0, 0.1), (0.0, -0.0, 0.1)])
    assert spatial.radius_join(two, two.limit(0), 0.1).count() == 0
    assert spatial.radius_join(two.limit(0), two, 0.1).count() == 0
    assert {tuple(r)[:2] for r in spatial.radius_join(two, two, 0.0).collect()} == {(0, 0), (1, 1), (1, 2), (2, 1), (2, 2)}


def odd_cloud(spark):
    """Copies of whole rows, of ids, of positions and of neither; both zeros, no id, no place."""
    rng = np.random.default_rng(38)
    p = np.vstack([rng.uniform(0.01, 0.09, (150, 3)), rng.uniform(-0.3, 0.3, (150, 3)), np.full((20, 3), -0.25), [(1e8, -2e8, 3e8), (1e8 + 0.05, -2e8, 3e8), (1e17, 0, 0), (0.0, 0.0, 0.0), (-0.0, 0.0, -0.0)]])
    rows = [(i // 2 if i < 60 else i, *map(float, v)) for i, v in enumerate(p)] + [(400 + i % 2, *map(float, p[i // 2])) for i in range(12)]
    rows += [rows[0]] * 2 + [rows[200]] + [(None, 0.05, 0.05, 0.05)] * 2 + [(None, 0.06, 0.05, 0.05), (500, None, 0.0, 0.0), (501, float("nan"), 0.0, 0.0)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double, z double")


@pytest.mark.parametrize("block, broadcast", [(4096, 100_000), (160, 100_000), (160, 0)])
def test_a_cloud_joined_with_itself_gives_each_pair_both_ways(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(spatial, "BLOCK_ROWS", block)
    monkeypatch.setattr(spatial, "CROWDED_CELLS", broadcast)
    rows, points = odd_cloud(spark)
    found = [tuple(r) for r in spatial.radius_join(points, points, 0.1).collect()]
    p = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows])
    d = p[:, None] - p[None]
    d = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2])
    want = [(rows[i][0], rows[j][0], float(d[i, j])) for i, j in np.argwhere(d <= 0.1).tolist()]
    order = lambda rows: sorted(rows, key=lambda r: tuple(-1 if v is None else v for v in r))
    assert order(found) == order(want)


def test_pairs_of_a_cloud_with_itself_pack_well(spark, tmp_path):
    points = cloud(spark, np.random.default_rng(39).uniform(0.0, 0.2, (1500, 3)))
    pairs = spatial.radius_join(points, points, 0.1)
    pairs.write.parquet(f"{tmp_path}/pairs")
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert size < 8 * pairs.count()  # less than the plain distances alone
