"""Textures of whole models."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthant.operators import cells, mesh, texture
from orthant.plans import run
from orthant.plans.bake import bake_model
from orthant.sources import export, views

EYE = np.eye(3)


def coloured(cloud, red):
    return cloud.withColumns({"r": red, "g": F.lit(0.3), "b": F.lit(0.2), "opacity": F.lit(1.0)})


def test_a_cube_with_a_box_inside_and_one_on_top(spark, tmp_path):
    cloud = coloured(views.shell(spark, 11), F.when(F.col("x") > 0.49, 1.0).otherwise(0.1))
    box = lambda centre, size: {"center": np.array(centre, float), "dimensions": np.array(size, float), "rotation": EYE}
    boxes = [box((0, 0, 0), (1, 1, 1)), box((0, 0, 0), (0.5, 0.5, 0.5)), box((0, 0, 0.6), (0.6, 0.6, 0.4))]
    model = bake_model(cloud, boxes, 0.05, atlas_size=128)
    faces = {(f["box"], f["side"]): f for f in model.report["faces"]}
    # The box inside takes no texels; of the one on top the bottom is within the cube.
    assert set(faces) == {(0, s) for s in range(6)} | {(2, s) for s in (0, 1, 2, 3, 5)}
    assert model.report["hidden_faces"] == 7
    assert all(faces[0, s]["projected"] == 1 and abs(faces[0, s]["area"] - 1) < 1e-9 for s in range(6))
    assert abs(faces[2, 0]["area"] - 0.6 * 0.3) < 1e-9 and faces[2, 5]["projected"] == 0
    assert abs(sum(faces[2, 5][k] for k in ("projected", "completed", "uncolored")) - 1) < 1e-9
    image, twin = model.image(), model.confidence()
    for f in model.faces:
        x, y, w, h = f.rect
        assert np.array_equal(image[y - 4, x : x + w], image[y, x : x + w])  # the border is repeated
        if f.box == 0 and f.side in (0, 1):
            assert abs(int(image[y + h // 2, x + w // 2, 0]) - (255 if f.side else 26)) <= 1
            assert tuple(twin[y + h // 2, x + w // 2]) == (51, 188, 147)
        if f.box == 2 and f.side == 5:
            assert tuple(twin[y + h // 2, x + w // 2]) == (240, 145, 62)
    # Seen texels of a clipped side are those of its part alone.
    i = next(i for i, f in enumerate(model.faces) if (f.box, f.side) == (2, 0))
    f, seen = model.faces[i], {(r["px"], r["py"]) for r in model.visible.where(F.col("face") == i).collect()}
    x, y, w, h = f.rect
    want = set()
    for px in range(w):
        for py in range(h):
            at = f.origin + (px + 0.5) / w * f.width * f.u + (py + 0.5) / h * f.height * f.v
            if at[2] >= 0.5 - 1e-9:  # centres on the border are seen
                want.add((px, py))
    assert seen == want
    drawn = {}
    for f in model.faces:
        drawn.setdefault(f.box, []).extend((f.in_space(p), f.in_atlas(p, 128)) for p in f.parts)
    export.write_textured_obj(str(tmp_path), boxes, drawn, "atlas.png")
    lines = (tmp_path / "textured.obj").read_text().splitlines()
    corners = np.array([[float(v) for v in s.split()[1:]] for s in lines if s.startswith("v ")])
    marks = np.array([[float(v) for v in s.split()[1:]] for s in lines if s.startswith("vt ")])
    assert len(corners) == len(marks) == sum(len(p) for f in model.faces for p in f.parts)
    assert ((marks >= 0) & (marks <= 1)).all() and abs(corners).max() <= 0.8 + 1e-12
    # A texture position read back through the atlas is the corner itself.
    f = model.faces[0]
    at = np.column_stack((marks[: len(f.parts[0]), 0], 1 - marks[: len(f.parts[0]), 1])) * 128 - f.rect[:2]
    assert np.allclose(f.in_space(at / f.rect[2:] * (f.width, f.height)), corners[: len(f.parts[0])])


def test_edges_take_colours_of_their_own_box_only(spark):
    # Only the top of the cube is observed; its sides are coloured near the shared edges, the bottom is not.
    top = coloured(views.sheet(spark, 15, offset=1.0), F.lit(1.0))
    model = bake_model(top, [{"center": (0.5, 0.5, 0.5), "dimensions": (1, 1, 1), "rotation": EYE}], 0.04, atlas_size=128)
    faces = {f["side"]: f for f in model.report["faces"]}
    assert faces[5]["projected"] > 0.99 and faces[4]["completed"] == faces[4]["projected"] == 0
    assert all(faces[s]["projected"] == 0 and 0.05 < faces[s]["completed"] < 0.2 for s in range(4))
    assert abs(model.report["supported_area_fraction"] - 1 / 6) < 0.01


def test_layers_of_a_thin_slab_keep_their_sides(spark):
    # Two layers in one slab: broad faces show their own outer skin although the other one is within reach.
    layers = coloured(views.sheet(spark, 15), F.lit(1.0)).unionByName(coloured(views.sheet(spark, 15, offset=0.06), F.lit(0.0)).withColumn("id", F.col("id") + 1000))
    model = bake_model(layers, [{"center": (0.5, 0.5, 0.03), "dimensions": (1, 1, 0.06), "rotation": EYE}], 0.04, atlas_size=128)
    image = model.image()
    for f in model.faces:
        if f.side in (4, 5):
            x, y, w, h = f.rect
            assert f.outward and abs(int(image[y + h // 2, x + w // 2, 0]) - (0 if f.side == 5 else 255)) <= 3


def test_nothing_to_bake(spark):
    with pytest.raises(ValueError):
        bake_model(coloured(views.sheet(spark, 3), F.lit(1.0)), [], 0.1)


def test_population_ignores_order_and_sees_changes(spark):
    cloud = views.sheet(spark, 6)
    assert run.population(cloud) == run.population(cloud.orderBy(F.desc("id")))
    assert run.population(cloud) != run.population(cloud.withColumn("z", F.when(F.col("id") == 7, 1e-9).otherwise(F.col("z"))))
    assert run.population(cloud.where("id < 0")) == {"points": 0, "hashes": "0"}


def test_representatives_of_repeated_and_close_positions(spark):
    rows = [(i, float(i % 5), 0.0, 1e-280 * (i % 2)) for i in range(60)]
    found = cells.representatives_within(spark.createDataFrame(rows, "id long, x double, y double, z double"), 100)
    assert found.count() == 5
    same = spark.createDataFrame([(i, 1.0, 2.0, 3.0) for i in range(9)], "id long, x double, y double, z double")
    assert [r["id"] for r in cells.representatives_within(same, 4).collect()] == [0]


def test_diagnostics_are_tables(spark, tmp_path):
    run.write_diagnostics(str(tmp_path), views.sheet(spark, 12))
    rows = spark.read.parquet(str(tmp_path / "diagnostics" / "positions"))
    assert rows.count() == 144 and rows.where("valid and abs(normal[2]) > 0.999").count() > 100
    assert rows.where("region = 0").count() > 100
    assert spark.read.parquet(str(tmp_path / "diagnostics" / "edge_lines")).columns


def test_mask_of_a_turned_face(spark):
    c, s = np.cos(0.4), np.sin(0.4)
    boxes = mesh.boxes_table(spark, [{"center": (1, 2, 3), "dimensions": (2, 1, 0.5), "rotation": [[c, -s, 0], [s, c, 0], [0, 0, 1]]}])
    from orthant.functions.scalar import box_faces

    found = texture.face_polygons(mesh.exposed_polygons(boxes), box_faces(mesh.flat_boxes(boxes))).collect()
    assert len(found) == 6
    for r in found:
        p = np.array([(q["u"], q["v"]) for q in r["uv"]])
        area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(p, np.roll(p, -1, axis=0))) / 2
        assert area > 0 and np.isclose(area, r["area"]) and p.min() > -1e-9
