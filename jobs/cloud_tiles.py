"""From a table of observations to tiles that a fit can start from.

A cloud that is to be fitted is thinned first, so that a densely observed patch
does not outweigh a sparse one: every occupied evaluation cell keeps one point,
the one nearest to its centre, and says how many observations and distinct
positions stand behind it and how many of the 26 cells around it are occupied.
Cells are dealt into cubic tiles, each a partition of the output that can be
read, fitted or replaced alone.

    python -m jobs.cloud_tiles --input TABLE --output FOLDER [--config jobs/cloud_tiles.json]

Writes ``FOLDER/cells`` (all occupied cells), ``FOLDER/tiles`` (partitioned by
``tile``) and ``FOLDER/summary`` (one row a tile). A rerun replaces all three
with the same rows.
"""

from __future__ import annotations

import argparse
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import log, read_config
from orthant.functions.scalar import finite
from orthant.operators.cells import CELL, cell_adjacency, distinct_positions, with_cells

DEFAULTS: dict[str, Any] = {
    "format": "parquet",
    "id": "id",
    "x": "x",
    "y": "y",
    "z": "z",
    "width": 1.0,
    "cells_per_tile": 16,
    "least_neighbours": 0,
}
TILES = "tile string, ci long, cj long, ck long, id long, x double, y double, z double, n long, positions long, neighbours int, weight double"


def occupied_cells(points: DataFrame, width: float) -> DataFrame:
    """One row for each cell (from the origin, ``width`` wide) of ``points`` (``id``, ``x``, ``y``, ``z``).

    ``n`` observations at ``positions`` places, and the place nearest to the
    cell's centre with its smallest id, ties to the smaller id. Places are
    counted before cells are, so a place that repeats is one row a task.
    """
    celled = with_cells(distinct_positions(points), width, (0.0, 0.0, 0.0))
    off = [F.col(a) - (F.col(c) + 0.5) * width for a, c in zip("xyz", CELL)]
    far = off[0] * off[0] + off[1] * off[1] + off[2] * off[2]
    best = F.min(F.struct(far.alias("far"), F.col("first_id").alias("id"), "x", "y", "z")).alias("best")
    found = celled.groupBy(*CELL).agg(F.sum("n").alias("n"), F.count("*").alias("positions"), best)
    return found.select(*CELL, "best.id", "best.x", "best.y", "best.z", "n", "positions")


def with_neighbours(found: DataFrame) -> DataFrame:
    """``found`` with ``neighbours``, the number of occupied cells that touch the cell."""
    pairs = cell_adjacency(found)
    ends = pairs.select("src.*").unionByName(pairs.select("dst.*"))
    around = ends.groupBy(*CELL).agg(F.count("*").cast("int").alias("neighbours"))
    return found.join(around, list(CELL), "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))


def tiles(found: DataFrame, cells_per_tile: int) -> DataFrame:
    """``found`` with its ``tile`` and the ``weight`` of each observation: equal mass for each cell, 1 on average."""
    total = F.broadcast(found.agg(F.sum("n").alias("rows_n"), F.count("*").alias("cells_n")))  # one row
    tile = F.concat_ws("_", *[F.floor(F.col(c) / cells_per_tile).cast("string") for c in CELL])
    out = found.join(total).withColumn("weight", (F.col("rows_n") / F.col("cells_n")) / F.col("n"))
    return out.withColumn("tile", tile).select("tile", *CELL, "id", "x", "y", "z", "n", "positions", "neighbours", "weight")


def run(spark: SparkSession, source: str, output: str, config: dict[str, Any] | None = None) -> dict[str, int]:
    """Tile the table at ``source`` into ``output``; returns what was read and written. Rows without a finite place are left out."""
    settings = DEFAULTS | (config or {})
    if settings["width"] <= 0 or settings["cells_per_tile"] < 1:
        raise ValueError("width and cells_per_tile must be above zero")
    rows = spark.read.format(settings["format"]).load(source)
    points = rows.select(F.expr(settings["id"]).cast("long").alias("id"), *[F.expr(settings[a]).cast("double").alias(a) for a in "xyz"])
    occupied_cells(points.where(finite(*"xyz")), settings["width"]).write.mode("overwrite").parquet(f"{output}/cells")
    found = with_neighbours(spark.read.parquet(f"{output}/cells")).where(F.col("neighbours") >= settings["least_neighbours"])
    dealt = tiles(found, settings["cells_per_tile"])
    # Rebalanced by tile: a tile is few files, and one with many cells is split among tasks.
    dealt.hint("rebalance", "tile").write.mode("overwrite").partitionBy("tile").parquet(f"{output}/tiles")
    written = read_tiles(spark, output)
    ends = [e for a in "xyz" for e in (F.min(a).alias(f"{a}_low"), F.max(a).alias(f"{a}_high"))]
    summary = written.groupBy("tile").agg(F.count("*").alias("cells"), F.sum("n").alias("n"), F.sum("positions").alias("positions"), *ends)
    summary.coalesce(1).write.mode("overwrite").parquet(f"{output}/summary")  # one row a tile
    kept = spark.read.parquet(f"{output}/cells").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = {"rows_read": rows.count(), "rows_kept": kept, "cells_written": written.count()}  # of Parquet, a count reads no column
    log.info("read %d rows of %s, of which %d have a place; wrote %d cells to %s/tiles", out["rows_read"], source, out["rows_kept"], out["cells_written"], output)
    return out


def read_tiles(spark: SparkSession, output: str) -> DataFrame:
    names = [c.split()[0] for c in TILES.split(", ")]
    return spark.read.schema(TILES).parquet(f"{output}/tiles").select(*names)


def main(argv: list[str] | None = None) -> None:
    import logging

    parser = argparse.ArgumentParser(prog="jobs.cloud_tiles", description="Thin a table of observations into tiles.")
    parser.add_argument("--input", required=True, help="table of observations, in the configured format")
    parser.add_argument("--output", required=True, help="folder for cells, tiles and summary")
    parser.add_argument("--config", help="JSON file with settings")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("cloud_tiles").getOrCreate()
    try:
        run(spark, args.input, args.output, read_config(spark, args.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
