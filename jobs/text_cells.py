"""A growing corpus as a cloud: where its documents crowd and where they stand alone.

Each document is a point: the mean length of its words, the share of words that
are distinct, times four, and the share of its characters outside white space
that are not lower-case letters, times four. Points are counted by evaluation
cell as clouds are, so junk, lists and shouting show as thinly occupied cells
beside the bulk of the prose, and a change in what arrives shows as new cells.

    python -m jobs.text_cells --input FOLDER --output FOLDER [--config jobs/text_cells.json]

New files are taken by a file stream with a checkpoint in ``OUTPUT/checkpoint``.
Each batch adds its cells as one partition of ``OUTPUT/deltas``, replaced as a
whole if the batch is run again, so a run that was broken off loses and doubles
nothing. ``OUTPUT/cells``, partitioned by ``shelf`` (the language), is the sum
of the deltas. Texts are read once, in the run in which their file is new. The
checkpoint and the deltas belong together: remove both or neither.
"""

from __future__ import annotations

import argparse
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import log, read_config
from orthant.operators.cells import CELL, with_cells

DEFAULTS: dict[str, Any] = {"format": "parquet", "id": "doc_id", "text": "text", "shelf": "lang", "width": 0.25, "files_per_batch": 64}
_DELTA = "shelf string, ci long, cj long, ck long, n long, words long, first_doc long, last_doc long"
_WORD = r"[^\x20\x09-\x0D]+"


def document_points(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shelf: str = "lang") -> DataFrame:
    """``id``, ``shelf``, ``words`` and the place ``x``, ``y``, ``z`` of each document, from its whole text.

    A text without words (null, empty, white space) stands at the origin. A
    shelf is 'lang-' and the language, nothing for a null one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.concat(F.lit("lang-"), F.coalesce(F.col(shelf).cast("string"), F.lit(""))).alias("shelf"),
        F.regexp_extract_all(whole, F.lit(_WORD), F.lit(0)).alias("found"),
        F.length(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")).alias("letters"),
        F.length(F.regexp_replace(whole, r"[\x20\x09-\x0Da-z]+", "")).alias("other"),
    )
    words = F.size("found")
    share = lambda part, of: F.when(of > 0, part / F.when(of > 0, of)).otherwise(0.0)
    return rows.select(
        "id",
        "shelf",
        words.cast("long").alias("words"),
        share(F.col("letters"), words).alias("x"),
        (share(F.size(F.array_distinct("found")), words) * 4.0).alias("y"),
        (share(F.col("other"), F.col("letters")) * 4.0).alias("z"),
    )


def _summed(rows: DataFrame, n: Column, words: str, first: str, last: str) -> DataFrame:
    return rows.groupBy("shelf", *CELL).agg(n.alias("n"), F.sum(words).alias("words"), F.min(first).alias("first_doc"), F.max(last).alias("last_doc"))


def run(spark: SparkSession, source: str, output: str, config: dict[str, Any] | None = None) -> dict[str, int]:
    """Add the files of ``source`` (a folder or a pattern of paths, with at least one file) that are new since the last run to ``output``; returns what was read and written."""
    settings = DEFAULTS | (config or {})
    if settings["width"] <= 0 or settings["files_per_batch"] < 1:
        raise ValueError("width and files_per_batch must be above zero")
    names = [settings["id"], settings["text"], settings["shelf"]]
    schema = spark.read.format(settings["format"]).load(source).select(*names).schema
    stream = spark.readStream.format(settings["format"]).schema(schema).option("maxFilesPerTrigger", settings["files_per_batch"]).load(source)
    taken = []

    def add(batch: DataFrame, number: int) -> None:
        taken.append(number)
        celled = with_cells(document_points(batch, *names), settings["width"], (0.0, 0.0, 0.0))
        delta = _summed(celled, F.count("*"), "words", "id", "id").withColumn("batch", F.lit(number))
        delta.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/deltas")

    spark.createDataFrame([], f"{_DELTA}, batch long").write.mode("append").partitionBy("batch").parquet(f"{output}/deltas")  # the folder, where nothing has come yet
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    deltas = spark.read.schema(f"{_DELTA}, batch long").parquet(f"{output}/deltas")
    whole = _summed(deltas, F.sum("n"), "words", "first_doc", "last_doc")
    whole.hint("rebalance", "shelf").write.mode("overwrite").partitionBy("shelf").parquet(f"{output}/cells")
    fresh = deltas.where(F.col("batch").isin(taken)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = {"rows_read": fresh, "batches": len(taken), "cells": read_cells(spark, output).count()}
    log.info("took %d new rows of %s in %d batches; %s/cells has %d cells", out["rows_read"], source, out["batches"], output, out["cells"])
    return out


def read_cells(spark: SparkSession, output: str) -> DataFrame:
    names = [c.split()[0] for c in _DELTA.split(", ")]
    return spark.read.schema(_DELTA).parquet(f"{output}/cells").select(*names)


def main(argv: list[str] | None = None) -> None:
    import logging

    parser = argparse.ArgumentParser(prog="jobs.text_cells", description="Count the documents of a growing folder by evaluation cell.")
    parser.add_argument("--input", required=True, help="folder or pattern to which files of documents are added")
    parser.add_argument("--output", required=True, help="folder for checkpoint, deltas and cells")
    parser.add_argument("--config", help="JSON file with settings")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("text_cells").getOrCreate()
    try:
        run(spark, args.input, args.output, read_config(spark, args.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
