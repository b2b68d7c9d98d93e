"""PLY in all its forms, exports, checkpoints."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthant.plans import run
from orthant.sources import export, ply, views

HEAD = "ply\nformat {} 1.0\ncomment made by hand\n{}element vertex {}\nproperty float x\nproperty double y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
ROWS = [(i * 0.5, i * 0.25, -1.0, i % 256, 90, 40) for i in range(50)]


def write(path, form, lists=False):
    extra = "element face 2\nproperty list uchar int vertex_indices\n" if lists else ""
    data = HEAD.format(form, extra, len(ROWS)).encode()
    order = ">" if form.endswith("big_endian") else "<"
    if form == "ascii":
        data += b"3 0 1 2\n4 0 1 2 3\n" * lists + "".join(" ".join(map(str, r)) + "\n" for r in ROWS).encode()
    else:
        data += (struct.pack(order + "B3iB4i", 3, 0, 1, 2, 4, 0, 1, 2, 3) if lists else b"") + b"".join(struct.pack(order + "fdf3B", *r) for r in ROWS)
    path.write_bytes(data)


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
@pytest.mark.parametrize("lists", [False, True])
def test_ply_forms(spark, tmp_path, form, lists):
    write(tmp_path / "a.ply", form, lists)
    spark.dataSource.register(ply.PlySource)
    frame = spark.read.format("ply").option("rowsperpartition", "7").load(str(tmp_path / "a.ply"))
    assert frame.count() == 50
    got = [tuple(r) for r in frame.orderBy("source_index").collect()]
    assert got == [(i, *map(float, r)) for i, r in enumerate(ROWS)]


def test_ply_rejects_what_it_cannot_read(spark, tmp_path):
    (tmp_path / "a.ply").write_bytes(b"nothing")
    with pytest.raises(Exception, match="not a PLY file"):
        ply.read_ply(spark, str(tmp_path / "a.ply")).count()
    with pytest.raises(ValueError):
        ply.read_header(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nend_header\n")


def test_written_points_come_back(spark, tmp_path):
    points = views.sheet(spark, 6).select("x", "y", "z", F.lit(1.0).alias("r"), F.lit(0.5).alias("g"), F.lit(0.0).alias("b"), F.col("id").alias("source_index"))
    ply.write_points(points, str(tmp_path / "p.ply"))
    back = ply.clean_cloud(ply.read_ply(spark, str(tmp_path / "p.ply")))
    assert back.count() == 36 and [p.name for p in tmp_path.iterdir()] == ["p.ply"]
    row = back.orderBy("id").first()
    assert (row["r"], row["g"], row["b"]) == (1.0, pytest.approx(128 / 255), 0.0)


def test_cleaning_splats(spark):
    rows = [(i, float(i % 7), float(i // 7), 0.0, 5.0 if i else -9.0, *[0.0] * 3, 1.0, 0.0, 0.0, 0.0, *[1.0] * 3) for i in range(42)] + [(42, float("nan"), 0.0, 0.0, 5.0, *[0.0] * 3, 1.0, 0.0, 0.0, 0.0, *[1.0] * 3)]
    names = ["source_index", "x", "y", "z", "opacity", *[f"scale_{i}" for i in range(3)], *[f"rot_{i}" for i in range(4)], *[f"f_dc_{i}" for i in range(3)]]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'source_index' else 'double'}" for n in names))
    clean = ply.clean_cloud(frame)
    assert clean.count() == 41
    row = clean.first()
    assert row["r"] == pytest.approx(0.5 + 0.28209479177387814) and row["splat"]["quat_wxyz"] == [1.0, 0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        ply.clean_cloud(frame.limit(5))


def boxes():
    return [{"center": np.array([0.0, 1, 2]), "dimensions": np.array([1.0, 2, 3]), "rotation": np.eye(3), "kind": "t"}]


def test_exports(tmp_path):
    export.write_obj(str(tmp_path), boxes())
    text = (tmp_path / "cuboids.obj").read_text()
    assert text.count("\nv ") == 8 and text.count("\nf ") == 6
    export.write_mesh_ply(str(tmp_path / "m.ply"), boxes())
    assert export.png(np.zeros((2, 3, 3), np.uint8)).startswith(b"\x89PNG")
    quad = np.array([[0.0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0]])
    data = export.glb(boxes(), {0: [(quad, quad[:, :2])]}, export.png(np.zeros((2, 2, 3), np.uint8)), "+z", 2.0)
    magic, version, length = struct.unpack("<III", data[:12])
    assert (magic, version, length) == (0x46546C67, 2, len(data))
    size = struct.unpack("<I", data[12:16])[0]
    doc = json.loads(data[20 : 20 + size])
    assert doc["accessors"][0]["count"] == 4 and doc["accessors"][2]["count"] == 6 and len(doc["nodes"]) == 2
    assert "[6]" in export.viewer(boxes(), {0: [quad]})


def test_checkpoint_slots_and_tampering(tmp_path):
    slots = run.Checkpoint(str(tmp_path), {"a": 1})
    slots.save([])
    slots.save(boxes())
    assert len(run.read_checkpoint(str(tmp_path), {"a": 1})) == 1
    with pytest.raises(ValueError, match="other settings"):
        run.read_checkpoint(str(tmp_path), {"a": 2})
    (tmp_path / "state-1.json").write_text("{}")
    with pytest.raises(ValueError, match="changed"):
        run.read_checkpoint(str(tmp_path), {"a": 1})
    with pytest.raises(ValueError):
        export.unpack_box(export.pack_box(boxes()[0]) | {"rotation": [[2.0, 0, 0], [0, 1, 0], [0, 0, 1]]})


def test_command_line_errors(tmp_path):
    assert run.main(["--ply", str(tmp_path / "none.ply"), "--output", str(tmp_path)]) == 2
    assert run.main(["--ply", "x", "--output", str(tmp_path / "o"), "--resume", "a", "--rebake", "b"]) == 2
