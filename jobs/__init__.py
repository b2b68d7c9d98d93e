"""Runnable jobs over the engine's operators: ``python -m jobs.cloud_tiles`` and ``python -m jobs.text_cells``."""

from __future__ import annotations

import json
import logging
from typing import Any

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def read_config(spark: SparkSession, path: str | None, defaults: dict[str, Any]) -> dict[str, Any]:
    """``defaults`` with what the JSON file at ``path`` (any file system of Spark's) says; unknown names are refused."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | given
