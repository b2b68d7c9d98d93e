"""Point clouds made of the driver's tables or of ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, x, y, z, label``: the first three components of each vector."""
    part = [F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *part, "label")


def lineitem_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        (F.col("l_quantity") / 50.0).alias("x"), (F.col("l_extendedprice") / 105000.0).alias("y"), (F.col("l_discount") * 10.0).alias("z"), "l_returnflag", "l_tax"
    )


def part_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A planar cloud with repeated positions."""
    rows = table(spark, sf_dir, "part")
    return rows.select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("x"), ((F.col("p_retailprice") - 900.0) / 100.0).alias("y"), F.lit(0.0).alias("z"))


def event_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    day = F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6
    return rows.select(F.col("event_id").alias("id"), "user_id", day.alias("x"), (F.col("value") / 100.0).alias("y"), (F.col("user_id") / 150.0).alias("z"))


def part_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cuboid for each part, every other one turned about z (by the angle of 3, 4, 5)."""
    rows = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    center = {"cx": F.col("p_size") / 50.0, "cy": (F.col("p_retailprice") - 900.0) / 100.0, "cz": (key % 7) / 7.0}
    extent = {"dx": (1 + key % 3) / 10.0, "dy": (1 + key % 5) / 20.0, "dz": (1 + F.col("p_size") % 4) / 15.0}
    turn = [[0.6, -0.8, 0.0], [0.8, 0.6, 0.0], [0.0, 0.0, 1.0]]
    frame = {f"r{i}{j}": F.when(key % 2 == 0, float(i == j)).otherwise(turn[i][j]) for i in range(3) for j in range(3)}
    return rows.select(key.alias("box_id"), *[c.alias(n) for n, c in (center | extent | frame).items()])


def label_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounds of each label's vectors in ``embedding_cloud``: ``box_id``, ``x0 .. z1``."""
    ends = [e for a in "xyz" for e in (F.min(a).alias(f"{a}0"), F.max(a).alias(f"{a}1"))]
    return embedding_cloud(spark, sf_dir).groupBy(F.col("label").alias("box_id")).agg(*ends)


#: The same clouds as DuckDB CTEs.
SQL = {
    "v_emb": "v_emb AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings)",
    "v_line": "v_line AS (SELECT l_quantity / 50e0 AS x, l_extendedprice / 105000e0 AS y, l_discount * 10e0 AS z, l_returnflag, l_tax FROM lineitem)",
    "v_part": "v_part AS (SELECT p_partkey AS id, p_size / 50e0 AS x, (p_retailprice - 900e0) / 100e0 AS y, 0e0 AS z FROM part)",
    "v_boxes": "v_boxes AS (SELECT p_partkey AS box_id, p_size / 50e0 AS cx, (p_retailprice - 900e0) / 100e0 AS cy, (p_partkey % 7) / 7e0 AS cz, (1 + p_partkey % 3) / 10e0 AS dx, (1 + p_partkey % 5) / 20e0 AS dy, (1 + p_size % 4) / 15e0 AS dz, "
    + ", ".join(f"CASE WHEN p_partkey % 2 = 0 THEN {float(i == j)}e0 ELSE {turn}e0 END AS r{i}{j}" for i, row in enumerate(((0.6, -0.8, 0.0), (0.8, 0.6, 0.0), (0.0, 0.0, 1.0))) for j, turn in enumerate(row))
    + " FROM part)",
    "v_bounds": "v_bounds AS (SELECT label AS box_id, min(embedding[1])::DOUBLE AS x0, max(embedding[1])::DOUBLE AS x1, min(embedding[2])::DOUBLE AS y0, max(embedding[2])::DOUBLE AS y1, min(embedding[3])::DOUBLE AS z0, max(embedding[3])::DOUBLE AS z1 FROM embeddings GROUP BY label)",
    "v_event": "v_event AS (SELECT event_id AS id, user_id, epoch_us(ts) / 86400e6 AS x, value / 100e0 AS y, user_id / 150e0 AS z FROM events)",
}


def _span(spark: SparkSession, n: int, name: str) -> DataFrame:
    return spark.range(n).select(F.col("id").alias(name))


def sheet(spark: SparkSession, n: int, size: float = 1.0, offset: float = 0.0) -> DataFrame:
    """n x n points of a square of side ``size`` at z = ``offset``."""
    grid = _span(spark, n, "i").join(_span(spark, n, "j"))
    return grid.select((F.col("i") * n + F.col("j")).alias("id"), (F.col("i") * (size / (n - 1))).alias("x"), (F.col("j") * (size / (n - 1))).alias("y"), F.lit(offset).alias("z"))


def shell(spark: SparkSession, n: int) -> DataFrame:
    """Grid points on the faces of the unit cube centred at the origin."""
    grid = _span(spark, n, "i").join(_span(spark, n, "j")).join(_span(spark, n, "k"))
    on_face = F.col("i").isin(0, n - 1) | F.col("j").isin(0, n - 1) | F.col("k").isin(0, n - 1)
    at = lambda c: (F.col(c) / (n - 1) - 0.5)
    return grid.where(on_face).select(((F.col("i") * n + F.col("j")) * n + F.col("k")).alias("id"), at("i").alias("x"), at("j").alias("y"), at("k").alias("z"))


def sample_rectangles(rects: DataFrame, step: float) -> DataFrame:
    """Distinct grid points of axis-aligned rectangles given as (x0, y0, z0, x1, y1, z1), edges included."""
    steps = {c: F.greatest(F.lit(1), F.ceil((F.col(f"{c}1") - F.col(f"{c}0")) / step)).cast("int") for c in "xyz"}
    out = rects
    for c in "xyz":
        flat = F.col(f"{c}1") == F.col(f"{c}0")
        index = F.when(flat, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), steps[c]))
        out = out.withColumn(f"n{c}", steps[c]).withColumn(f"i{c}", F.explode(index))
    return out.select(*[(F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * (F.col(f"i{c}") / F.col(f"n{c}"))).alias(c) for c in "xyz"]).distinct()


def union_rectangles(boxes: DataFrame) -> DataFrame:
    """Exposed rectangles of a union of axis-aligned boxes (box_id, x0, y0, z0, x1, y1, z1).

    All boxes' cuts divide space into cells; a rectangle between two cells is
    exposed where just one of them is inside a box. ``side`` is the axis and
    sign of the outward normal.
    """
    inside = None
    cuts = {}
    for c in "xyz":
        ends = boxes.select(F.col(f"{c}0").alias("v")).unionByName(boxes.select(F.col(f"{c}1").alias("v"))).distinct()
        cuts[c] = ends.agg(F.array_sort(F.collect_set("v")).alias(f"cuts_{c}"))  # at most two cuts per box
    inside = boxes.join(cuts["x"]).join(cuts["y"]).join(cuts["z"])
    for c in "xyz":
        low, high = F.array_position(f"cuts_{c}", F.col(f"{c}0")).cast("int"), F.array_position(f"cuts_{c}", F.col(f"{c}1")).cast("int")
        inside = inside.withColumn(f"i{c}", F.explode(F.sequence(low, high - 1)))
    cells = inside.select("ix", "iy", "iz", "cuts_x", "cuts_y", "cuts_z").distinct()
    out = None
    for c in "xyz":
        for sign in (-1, 1):
            other = cells.select(*[(F.col(f"i{a}") - (sign if a == c else 0)).alias(f"i{a}") for a in "xyz"])
            open_faces = cells.join(other, ["ix", "iy", "iz"], "left_anti")
            ends = []
            for a in "xyz":
                low, high = F.element_at(f"cuts_{a}", F.col(f"i{a}")), F.element_at(f"cuts_{a}", F.col(f"i{a}") + 1)
                plane = high if sign > 0 else low
                ends += [(plane if a == c else low).alias(f"{a}0"), (plane if a == c else high).alias(f"{a}1")]
            part = open_faces.select(F.lit(f"{'+' if sign > 0 else '-'}{c}").alias("side"), *ends)
            out = part if out is None else out.unionByName(part)
    return out


#: Analytic clouds by name, as axis-aligned boxes (centre, extents) whose surfaces are sampled.
CASES: dict[str, Sequence[tuple[tuple[float, float, float], tuple[float, float, float]]]] = {
    "cube": [((0, 0, 0), (1, 1, 1))],
    "thin_box": [((0, 0, 0), (2, 1, 0.1))],
    "l_shape": [((0.5, 0, 0), (2, 1, 1)), ((0, 0.75, 0), (1, 1.5, 1))],
    "close_layers": [((0, 0, 0), (1, 1, 0)), ((0, 0, 0.08), (1, 1, 0))],
    "thin_appendage": [((0, 0, 0), (1, 1, 1)), ((0.75, 0, 0), (0.5, 0.1, 0.1))],
}


def case_cloud(spark: SparkSession, name: str, step: float) -> DataFrame:
    """The exposed surface of an analytic case, sampled."""
    bounds = [(i, *(float(c - e / 2) for c, e in zip(centre, extent)), *(float(c + e / 2) for c, e in zip(centre, extent))) for i, (centre, extent) in enumerate(CASES[name])]
    boxes = spark.createDataFrame(bounds, "box_id int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    flat = any(0 in extent for _, extent in CASES[name])
    return sample_rectangles(boxes if flat else union_rectangles(boxes), step)
