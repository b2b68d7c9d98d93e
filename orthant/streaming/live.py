"""Streaming forms: gap sessions, running cell counts, coverage of arriving points."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthant.functions.scalar import Box, snapped_cell
from orthant.operators.cells import CELL
from orthant.storage import shared_root


def gap_sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "0 seconds") -> DataFrame:
    """Stretches of each key's events without a pause longer than ``gap``: count and ends."""
    return events.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("session")).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def windowed_cells(points: DataFrame, time: str, window: str, width: float, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Points per time window and evaluation cell; rows later than the watermark are dropped."""
    cell = [snapped_cell(F.col(a), F.lit(0.0), F.lit(width)).alias(c) for a, c in zip("xyz", CELL)]
    at = F.window(time, window, slide) if slide else F.window(time, window)
    return points.withWatermark(time, late).select(time, *cell).groupBy(at.alias("window"), *CELL).agg(F.count("*").alias("n"))


def mark_covered(points: DataFrame, boxes: DataFrame, tolerance: float) -> DataFrame:
    """Add ``covered`` to each arriving point: within the tolerance of a committed box.

    The committed boxes (at most a few hundred) ride along as one array, so a
    point needs no join and no state.
    """
    rows = [r.asDict() for r in boxes.collect()]
    if len(rows) > 4096:
        raise ValueError("too many boxes")
    near = F.lit(False)
    for r in rows:
        box = Box("b_")
        box.col = lambda name, r=r: F.lit(float(r[name]))  # type: ignore[method-assign]
        near = near | (box.distance() <= tolerance)
    return points.withColumn("covered", near)


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a streaming query over all that is there now and return its result as a table."""
    spark: SparkSession = stream.sparkSession
    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex[:12]}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{root}/out")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")
