"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import numpy as np
import pytest

from orthant.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Fits take a minute; tests/test_fit.py runs one.
SLOW = {"greedy_cover"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    return repr(float(value)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name in SLOW:
        pytest.skip("covered elsewhere")
    frame = QUERIES[name](spark, DATA)
    rows = frame.collect()
    if name not in SQL:
        assert rows
        return
    found = duck.sql(SQL[name])
    assert sorted(frame.columns) == sorted(found.columns)
    order = sorted(frame.columns)
    own = sorted(tuple(plain(r[c]) for c in order) for r in rows)
    at = [found.columns.index(c) for c in order]
    assert own == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def embeddings(spark, folder, points):
    rows = [(i, [float(v) for v in p], i % 10) for i, p in enumerate(points)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_every_splat_is_rasterised(spark, tmp_path):
    rng = np.random.default_rng(3)
    points = np.float32(rng.uniform(-1, 1, (90, 3))).astype(float)
    got = {tuple(r) for r in QUERIES["ellipsoid_raster"](spark, embeddings(spark, tmp_path, points)).select("i", "j", "k").collect()}
    # Turned about z by 2 atan2(0.8, 0.6): cosine -0.28, sine 0.96.
    axes, scales, want = np.array([[-0.28, 0.96, 0], [-0.96, -0.28, 0], [0, 0, 1]]), np.array([0.03, 0.02, 0.04]), set()
    for p in points:
        near = np.floor(p / 0.05).astype(int) + np.array(np.meshgrid(*[range(-4, 5)] * 3)).reshape(3, -1).T
        inside = ((((near + 0.5) * 0.05 - p) @ axes.T / scales) ** 2).sum(axis=1) <= 9
        want |= {tuple(map(int, c)) for c in near[inside]}
    assert got == want


def test_voxel_queries_keep_outlying_and_central_points(spark, tmp_path):
    grid = {(i, j, k) for i in range(-1, 2) for j in range(-1, 2) for k in range(-1, 2)}
    cells = (grid - {(0, 0, 0)}) | {(9, -8, 7), (-12, 0, 3)}  # a closed shell around the origin, and two outliers
    folder = embeddings(spark, tmp_path, [[(c + 0.5) * 0.1 for c in cell] for cell in sorted(cells)])
    image = QUERIES["integral_image"](spark, folder).collect()
    assert len(image) == 23 * 11 * 10 and max(r["total"] for r in image) == len(cells)
    low = (-12, -8, -1)
    for r in image[::97]:
        assert r["total"] == sum(all(c - o < r[a] for c, o, a in zip(cell, low, "ijk")) for cell in cells)
    sums = {r["box_id"]: r["n"] for r in QUERIES["box_sums"](spark, folder).collect()}
    lower = lambda cell: [c - o < n // 2 for c, o, n in zip(cell, low, (22, 10, 9))]
    assert sums == {0: len(cells), 1: sum(all(lower(c)) for c in cells), 2: sum(not any(lower(c)) for c in cells)}
    assert {tuple(r) for r in QUERIES["fill_holes"](spark, folder).select("i", "j", "k").collect()} == cells | {(0, 0, 0)}
