"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orthant.llm.chunk_dedup import exact_duplicates
from orthant.llm.langid import UNDETERMINED, predictor, train
from orthant.llm.mixing import mixed_documents
from orthant.llm.near_dup import near_duplicates
from orthant.llm.pieces import encode_documents
from orthant.storage import as_table, materialize, release, ship


def least_score(languages: int) -> float:
    """Score below which a language counts as undetermined: a twentieth of the way from an even spread to certainty."""
    return 1 / languages + 0.05 * (1 - 1 / languages)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a determinable language: null text, no letter in it, or a score below ``least_score``.

    No language is rejected as such; a row without ``lang`` gets the predicted
    one. Where no row can train, there is no score and every text with a
    letter stays as it is.
    """
    ship(spark)
    model = train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    (found,) = _fresh(docs, 1)
    named = docs.withColumn(found, predictor(model)("text"))
    known = (F.col(found)["lang"] != UNDETERMINED) & (F.col(found)["score"] >= least_score(len(model.languages)))
    filled = {"lang": F.coalesce(F.col("lang"), F.col(found)["lang"]).alias("lang")}
    return named.where(known).select(*[filled.get(c, F.col(f"`{c}`")) for c in docs.columns])


def _fresh(docs: DataFrame, n: int) -> list[str]:
    """``n`` names that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    return [name for name in (f"pipeline_{k}" for k in range(len(taken) + n)) if name not in taken][:n]


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of the row, the same each time it is read, and the name of its column.

    A plain table has it in its files: number of the file and place in it.
    Anything else is written once and then read as such. The table of files
    has one row a file and is written, so no name passes through the driver.
    """
    docs = as_table(docs)
    place = docs.metadataColumn("_metadata")
    key, path, at, name, number = _fresh(docs, 5)
    files = docs.select(place["file_path"].alias(name)).distinct()
    files = materialize(files.select(name, (F.row_number().over(Window.orderBy(name)) - 1).cast("long").alias(number)), "files")
    placed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], place["file_path"].alias(path), place["row_index"].alias(at))
    placed = placed.join(files, F.col(path) == F.col(name))
    return placed.withColumn(key, F.col(number) * (1 << 40) + F.col(at)).drop(path, at, name, number), key


def _one_of_each(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame], group: str) -> DataFrame:
    """One row of each ``group`` that ``grouped`` finds among rows of ``doc_id`` and ``text``.

    The operator sees a key of the row as doc_id, so rows that repeat a doc_id
    or have none are told apart. The row with the smallest doc_id stays (null
    last), and of rows equal in it the first by key.
    """
    keyed, key = _keyed(docs)
    decided = grouped(keyed.select(F.col(key).alias("doc_id"), "text"))
    found = decided.select(F.col("doc_id").alias("row"), F.col(group).alias("group"))
    own = keyed.select(F.col(key).alias("own_row"), F.col("doc_id").cast("long").alias("own_id"))
    place = F.struct(F.col("own_id").isNull().alias("none"), "own_id", "row")
    kept = found.join(own.hint("merge"), F.col("row") == F.col("own_row")).groupBy("group").agg(F.min(place)["row"].alias("kept_row"))
    (kept_row,) = _fresh(keyed, 1)
    kept = materialize(kept.select(F.col("kept_row").alias(kept_row)), "kept")
    release(decided)
    return keyed.join(kept.hint("merge"), F.col(key) == F.col(kept_row), "left_semi").drop(key)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space one row stays, with the smallest doc_id."""
    ship(spark)
    return _one_of_each(docs, exact_duplicates, "keep_id")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, with the smallest doc_id."""
    ship(spark)
    return _one_of_each(docs, near_duplicates, "component_id")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring sources to their target shares: rows repeat or leave, one row per source is cut."""
    ship(spark)
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the text they decode to."""
    ship(spark)
    return encode_documents(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("sentencepiece", sentencepiece),
]

#: The recurrent network has no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
