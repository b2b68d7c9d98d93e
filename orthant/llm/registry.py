"""Queries of this subpackage for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthant.llm import mixing

    return mixing.query(_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthant.llm import licenses

    return licenses.query(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthant.llm.chunk_dedup import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthant.llm.near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


_OP3 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       coalesce(doc_id = min(doc_id) OVER g, (min(doc_id) OVER g) IS NULL) AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthant.llm import secrets

    return secrets.query(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthant.llm import quality

    return quality.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthant.llm import pieces

    return pieces.query(_table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthant.llm import chat

    return chat.query(_table(spark, sf_dir, "conversations"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthant.llm import langid

    return langid.query(_table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthant.llm import ann

    return ann.query(_table(spark, sf_dir, "embeddings"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthant.llm import filter_audit

    return filter_audit.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthant.llm import embed_dedup

    return embed_dedup.query(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator, by the function's name."""
    return {f.__name__: f for f in (op1_mix, op2_licenses, op3_exact_dedup, op4_near_dup, op5_secrets, op6_quality, op7_pieces, op8_chat, op9_language, op10_neighbours, op11_audit, op12_embed_dedup)}


def oracle_sql() -> dict[str, str]:
    from orthant.llm import chat, filter_audit, licenses, mixing, secrets

    return {"op1_mix": mixing.ORACLE, "op2_licenses": licenses.oracle(), "op3_exact_dedup": _OP3, "op5_secrets": secrets.oracle(), "op8_chat": chat.oracle(), "op11_audit": filter_audit.ORACLE}
