"""Mixing sources to target weights by distributed prefix sums over hash-random keys.

Every row gets a random but reproducible key, the MD5 of its doc_id and text
followed by its place in the input, a file and a row of it. Within a source rows are taken in key order
until the source's budget is met. The order is dealt out by (source, leading
digits of the key): the totals of these ranges are a small table with its own
running sums, and only the one range in which a source's budget ends is looked
into, by more digits where it is large and row by row where it is small. All
other rows are taken whole or not at all by comparing their key with the cut,
so no text is shuffled and no task holds a source or a group of equal rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthant.storage import as_table, materialize

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def _targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """``source``, ``source_size`` -> also ``target``: water-filling under cap * source_size.

    Sources in code-point order, null last, weigh ``weights`` in turn. Sorted
    by cap per weight, the capped sources are a prefix: source i is capped
    when the share left to it and all later ones by weight exceeds its cap.
    The windows span a table of one row a source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    table = table.withColumn("most", cap * F.col("source_size"))
    all_rows = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0))
    weight_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    table = table.withColumn("capped", F.col("most") < F.col("weight") * (left / weight_left))
    free = F.sum("source_size").over(all_rows) - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0)).over(all_rows)
    free_weight = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(all_rows)
    share = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("weight") * (free / free_weight))
    return table.select("source", "source_size", share.alias("target"))


#: Digits of the key by which ranges are formed, one after another: MD5 in steps, the whole of it, file, row of the file.
_DIGITS = (3, 6, 32, 40, 64, 74, 77, 80)
_ADDED = ("source_size", "target", "taken")


def row_key(table: DataFrame, doc_id: Column, text: Column) -> Column:
    """MD5 of a row's id and text, then of its file, and its row in it, which tell equal rows of a Parquet table apart.

    Unlike a number given while reading, the key is the same however the files
    are split among tasks.
    """
    place = table.metadataColumn("_metadata")
    content = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.concat(F.md5(content), F.md5(place["file_path"]), F.lpad(F.hex(place["row_index"]), 16, "0"))


def _cuts(slim: DataFrame, budget: DataFrame, range_rows: int) -> tuple[DataFrame, DataFrame]:
    """Where each source's budget ends: ``of, prefix`` of the range that holds the end, and its rows with the words ahead of them.

    ``slim``: ``of, n, key``; ``budget``: ``of, rest``, the words to take in key order.
    """
    ends = budget.select(F.col("of").alias("b"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"), "rest").where("rest > 0")
    settled = None
    for digits in _DIGITS:
        inside = slim.join(ends, F.col("of").eqNullSafe(F.col("b")) & F.startswith("key", "prefix"))
        parts = inside.groupBy("b", "before", "rest", F.substring("key", 1, digits).alias("part")).agg(F.sum("n").alias("words"), F.count("*").alias("held"))
        running = Window.partitionBy("b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("ahead", F.col("before") + F.coalesce(F.sum("words").over(running), F.lit(0)))
        found = parts.where((F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("words") >= F.col("rest")))
        found = materialize(found.select("b", F.col("part").alias("prefix"), F.col("ahead").alias("before"), "rest", "held"), "cuts")
        small = F.col("held") <= (range_rows if digits < _DIGITS[-1] else (1 << 62))
        done = found.where(small).drop("held")
        settled = done if settled is None else settled.unionByName(done)
        ends = found.where(~small).drop("held")
        if ends.isEmpty():
            break
    ends = materialize(settled, "ends")
    last = slim.join(ends, F.col("of").eqNullSafe(F.col("b")) & F.startswith("key", "prefix"))
    inside = Window.partitionBy("b").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)  # range_rows rows of a source
    last = last.select("b", "key", (F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("ahead"))
    return ends.select("b", "prefix"), materialize(last, "edge")


def _budgets(slim: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    sizes = materialize(slim.groupBy(F.col("of").alias("source")).agg(F.sum("n").alias("source_size")), "sources")
    budget = _targets(sizes, weights, cap).withColumn("whole", F.floor(F.col("target") + 0.5).cast("long"))
    budget = budget.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("whole") / F.col("source_size"))).otherwise(0).cast("long"))
    budget = budget.withColumn("rest", F.col("whole") - F.col("passes") * F.col("source_size"))
    return materialize(budget.select(F.col("source").alias("of"), "source_size", "target", "passes", "rest"), "budget")


def _decide(work: DataFrame, slim: DataFrame, weights: Sequence[int], cap: int, range_rows: int) -> DataFrame:
    """``work`` (``of, n, key``, more) with ``source_size``, ``target`` and ``taken``: one pass beside three small tables."""
    budget = _budgets(slim, weights, cap)
    ends, edge = _cuts(slim, budget.select("of", "rest"), range_rows)
    table = materialize(budget.join(ends, F.col("of").eqNullSafe(F.col("b")), "left").drop("b").withColumnRenamed("of", "its"), "decisions")
    edge = edge.withColumnsRenamed({"b": "e", "key": "e_key"})
    joined = work.join(table, F.col("of").eqNullSafe(F.col("its"))).join(edge, F.col("of").eqNullSafe(F.col("e")) & (F.col("key") == F.col("e_key")), "left")
    # Keys that begin with the cut's own digits are in the edge table; those before it are whole, those behind it are not taken.
    early = F.col("prefix").isNotNull() & (F.col("key") < F.col("prefix"))
    part = F.when(F.col("ahead").isNotNull(), F.greatest(F.lit(0), F.least("n", F.col("rest") - F.col("ahead")))).otherwise(F.when(early, F.col("n")).otherwise(0))
    return joined.withColumn("taken", (F.col("passes") * F.col("n") + part).cast("long")).drop("its", "passes", "rest", "prefix", "e", "e_key", "ahead")


def mix_sources(rows: DataFrame, *, key: Column | None = None, weights: Sequence[int] = (1, 2, 3), cap: int = 3, range_rows: int = 4096) -> DataFrame:
    """Words that a mix takes of each row of ``rows`` (``doc_id``, ``source``, ``size``, and others).

    The mix has as many words as the input. Source number i in code-point order
    (null last) gets a share by ``weights`` in turn, at most ``cap`` times its
    own size; what is above goes to the others by weight. Whole passes over the
    source are taken while they fit its budget, then rows in the order of
    ``key`` (by default of doc_id), and of the last row the words still
    missing. Adds ``source_size``, ``target`` and ``taken``, in the place of
    input columns of these names; any other column may have any name. Rows of
    size 0 take 0; an empty table gives an empty table. Of rows with equal
    doc_ids the first by file (in no order of its own) and row are taken first;
    rows equal in a key that is given are taken in any order. The tables of sources and
    of their cuts have one row a source.
    """
    kept = [c for c in rows.columns if c not in _ADDED]
    if key is None:
        rows = as_table(rows)
        key = row_key(rows, F.col("doc_id"), F.lit(""))
    work = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("source").alias("of"), F.col("size").cast("long").alias("n"), key.alias("key"))
    out = _decide(work, work.select("of", "n", "key"), weights, cap, range_rows)
    return out.select("row.*", *_ADDED)


def document_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size`` (words of the whole text, null: 0) and ``mix_key`` of each row, written once."""
    docs = as_table(docs)
    key = row_key(docs, F.col("doc_id").cast("long"), F.col("text"))
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), key.alias("mix_key")), "sizes")


def mixed_documents(docs: DataFrame, *, weights: Sequence[int] = (1, 2, 3), cap: int = 3, range_rows: int = 4096) -> DataFrame:
    """The mix itself: each row once per time it is taken, the last time cut to the words taken.

    Columns and their order are those of ``docs``, which needs ``doc_id``,
    ``source`` and ``text``; ``n_chars``, where present, follows a cut text. A
    null text has no words and is not taken; a text of any length is counted
    whole and moves to no other task. ``docs`` is read twice, and rows equal in
    doc_id and text are told apart by their file and row, so what is not a
    Parquet table is written as one first; which executors read it, and in
    what splits, makes no difference.
    """
    docs = as_table(docs)
    slim = document_sizes(docs).select(F.col("source").alias("of"), F.col("size").alias("n"), F.col("mix_key").alias("key"))
    work = docs.select(F.struct("*").alias("doc"), F.col("source").alias("of"), word_count(F.col("text")).alias("n"), row_key(docs, F.col("doc_id").cast("long"), F.col("text")).alias("key"))
    times = _decide(work, slim, weights, cap, range_rows).where("taken > 0")
    turns = times.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("n")))))
    need = F.least("n", F.col("taken") - (F.col("turn") - 1) * F.col("n"))
    words = F.regexp_extract_all(F.col("doc.text"), F.lit(WORD), F.lit(0))
    turns = turns.withColumn("cut", F.when(need < F.col("n"), F.array_join(F.slice(words, F.lit(1), need.cast("int")), " ")))
    fresh = {"text": F.coalesce("cut", F.col("doc.text")), "n_chars": F.coalesce(F.length("cut").cast(dict(docs.dtypes).get("n_chars", "long")), F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return turns.select(*[(fresh[c] if fresh.get(c) is not None else F.col("doc")[c]).alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return mix_sources(document_sizes(docs), key=F.col("mix_key")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::BIGINT::VARCHAR, '') || chr(10) || coalesce(text, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS most, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0) AS words_left,
             sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left
      FROM s WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, most < weight * (words_left::DOUBLE / weight_left::DOUBLE) AS capped FROM w),
t AS (SELECT source, source_size, CASE WHEN capped THEN most::DOUBLE ELSE weight * (
             (sum(source_size) OVER () - sum(CASE WHEN capped THEN most ELSE 0 END) OVER ())::DOUBLE
             / (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::DOUBLE) END AS target FROM c),
b AS (SELECT *, floor(target + 0.5e0)::BIGINT AS whole FROM t),
p AS (SELECT *, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS passes FROM b),
a AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, p.whole - p.passes * p.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM a
"""
