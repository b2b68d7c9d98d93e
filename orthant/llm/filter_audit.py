"""What filters remove alone, together and in any order, from one cube of their failure flags.

Every document gets one failure flag a filter. A SQL CUBE over the flags and the
part counts all combinations at once: the row of the cube in which the flags of
a set of filters are grouped by and all false, and the other flags are rolled
up, counts the documents that survive that set. A step of an order goes from
one set to the set with one filter more, so each step is a join of two rows of
this table, and no order is ever run over the documents.

The documents are first counted by part, flags and labels, which leaves at most
2 ** (filters + 2) rows a part for the cube to expand.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthant.storage import materialize, release

_SPACE = r"[\x20\x09-\x0D]+"


def document_flags(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, ``digest`` (of the whole text) and the failure flags A to D of every row.

    A null text is empty, a null ``lang`` the part ''. Words are what white
    space (space, tab to carriage return) separates.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    read = read.withColumn("words", F.filter(F.split("text", _SPACE), lambda w: w != ""))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flags = {
        "A": F.size("words") < 100,
        "B": 100 * F.size(F.array_distinct("words")) < 80 * F.size("words"),
        "C": 100 * capitals > 10 * F.length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }
    return read.select("doc_id", "part", F.sha2("text", 256).alias("digest"), *[value.alias(name) for name, value in flags.items()])


def with_copies(rows: DataFrame, flag: str = "E") -> DataFrame:
    """``rows`` (``doc_id``, ``digest``, more) counted as ``n``, with ``flag`` where a smaller doc_id has the same digest.

    Rows that are equal in all columns are one with a count. Only the row
    that holds the smallest doc_id of a digest meets its table by (digest,
    doc_id), so a text of which there are many copies is spread over all
    tasks. A row without a doc_id has no smaller one and does not fail.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id")).where(F.col("first_id").isNotNull())
    first = first.withColumnRenamed("digest", "first_digest")
    own = (F.col("digest") == F.col("first_digest")) & (F.col("doc_id") == F.col("first_id"))
    marked = counted.join(first, own, "left").withColumn(flag, F.col("doc_id").isNotNull() & F.col("first_id").isNull())
    return marked.drop("first_digest", "first_id")


def with_labels(rows: DataFrame, labels: DataFrame, marks: Mapping[str, Column]) -> DataFrame:
    """``rows`` (``doc_id``, ``digest``, more) with a boolean column for each of ``marks``, true where any label row of the doc_id has it.

    A row without a doc_id or a label has none of them. Rows without a doc_id
    are dealt out by their digest, as they find no partner anyway.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id"))
    known = known.agg(*[F.max(F.coalesce(mark, F.lit(False))).alias(name) for name, mark in marks.items()]).withColumn("label_salt", F.lit(""))
    salt = F.when(F.col("doc_id").isNull(), F.col("digest")).otherwise("")
    joined = rows.withColumn("salt", salt).join(known, (F.col("doc_id") == F.col("label_id")) & (F.col("salt") == F.col("label_salt")), "left")
    return joined.select(*rows.columns, *[F.coalesce(name, F.lit(False)).alias(name) for name in marks])


def survivors(profile: DataFrame, filters: str, measures: Mapping[str, Column]) -> DataFrame:
    """``part``, ``chosen`` (bits of the filters of a set, the first filter lowest) and each measure summed over what survives the set.

    ``profile`` has ``part``, ``n`` and a failure flag a filter. All 2 **
    filters sets are there for each part, with zeros where nothing survives.
    """
    summed = [F.sum(value).alias(name) for name, value in measures.items()]
    bits = [(F.lit(1) - F.grouping(f)) * (1 << i) for i, f in enumerate(filters)]
    cube = profile.cube("part", *filters).agg(F.grouping("part").alias("all_parts"), sum(bits[1:], bits[0]).cast("int").alias("chosen"), *summed)
    clean = ~F.lit(False)
    for f in filters:  # a flag that is rolled up is null
        clean = clean & ~F.coalesce(F.col(f), F.lit(False))
    found = cube.where((F.col("all_parts") == 0) & clean).select("part", "chosen", *measures)
    grid = profile.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("chosen"))
    return grid.join(found, ["part", "chosen"], "left").select("part", "chosen", *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in measures])


def interactions(profile: DataFrame, filters: str = "ABCDE", lost: Mapping[str, Column] | None = None) -> DataFrame:
    """One row for each part, order of ``filters`` and step of the order.

    ``profile`` has ``part``, ``n`` (documents) and a failure flag a filter;
    ``lost`` names more measures of which a step's loss is reported. Returns
    ``part``, ``filter_order``, ``step``, ``kept``, ``removed``,
    ``redundant``, ``unique_fails``, the measures and ``shapley``, zeros
    included; nothing for an empty profile. Orders grow as the factorial of
    the number of filters, so there can be seven at most.
    """
    if not 1 <= len(filters) <= 7 or len(set(filters)) < len(filters):
        raise ValueError("one to seven different filters are needed")
    spark, lost = profile.sparkSession, dict(lost or {})
    bit, every = {f: 1 << i for i, f in enumerate(filters)}, (1 << len(filters)) - 1
    sets = survivors(profile, filters, {"n": F.col("n"), **lost})

    # What each filter does apart from any order: its share of all orders, and what it alone fails.
    size = len(filters)
    pairs = [(f, s, s | bit[f], factorial(s.bit_count()) * factorial(size - 1 - s.bit_count())) for f in filters for s in range(every + 1) if not s & bit[f]]
    pairs = spark.createDataFrame(pairs, "filter string, without int, within int, orders long")
    ahead = sets.select("part", F.col("chosen").alias("without"), F.col("n").alias("n_without"), *[F.col(m).alias(f"{m}_without") for m in lost])
    behind = sets.select("part", F.col("chosen").alias("within"), "n", *lost)

    def step_pairs(table: DataFrame) -> DataFrame:
        """``table`` (at most orders times filters rows) with the survivors before and after each of its steps, in every part."""
        return ahead.join(F.broadcast(table), "without").join(behind, ["part", "within"])

    removed = F.col("n_without") - F.col("n")
    alone = step_pairs(pairs).groupBy("part", "filter").agg(
        F.sum(F.col("orders") * removed).alias("shapley"),
        F.sum(F.when(F.col("without") == 0, removed)).alias("fails"),
        F.sum(F.when(F.col("within") == every, removed)).alias("unique_fails"),
    )
    steps = []
    for order in permutations(filters):
        done = 0
        for i, f in enumerate(order):
            steps.append(("".join(order), i + 1, f, done, done | bit[f]))
            done |= bit[f]
    steps = spark.createDataFrame(steps, "filter_order string, step int, filter string, without int, within int")
    out = step_pairs(steps).join(alone, ["part", "filter"])
    return out.select(
        "part",
        "filter_order",
        "step",
        F.col("n").alias("kept"),
        removed.alias("removed"),
        (F.col("fails") - removed).alias("redundant"),
        "unique_fails",
        *[(F.col(f"{m}_without") - F.col(m)).alias(m) for m in lost],
        "shapley",
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five document filters over ``docs`` (``doc_id``, ``text``, ``lang``), with ``labels`` (``doc_id``, ``quality``, ``toxic``).

    A fails below 100 words, B where under 80 % of the words are distinct, C
    above 10 % capital letters, D with any of ``#$%&*|``, E where a smaller
    doc_id has the same text, whether that one is removed or not. Rows that
    repeat a doc_id count each; other columns may have any name. An empty
    text fails A alone (and E, if it is a copy). A doc_id with several label
    rows is good or toxic if any of them says so.
    """
    flags = materialize(document_flags(docs), "flags")
    marked = with_labels(with_copies(flags), labels, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    profile = materialize(marked.groupBy("part", *"ABCDE", "good", "toxic").agg(F.sum("n").alias("n")), "profile")
    release(flags)
    return interactions(profile, "ABCDE", {"good_lost": F.when(F.col("good"), F.col("n")).otherwise(0), "toxic_lost": F.when(F.col("toxic"), F.col("n")).otherwise(0)})


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
x AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS bits
  FROM d LEFT JOIN l USING (doc_id)),
p AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY part, bits),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
  SELECT '' AS filter_order, 0 AS done, 0 AS step
  UNION ALL SELECT filter_order || f, done | b, step + 1 FROM o, f WHERE (done & b) = 0),
q AS (SELECT filter_order AS whole FROM o WHERE step = 5),
s AS (SELECT q.whole AS filter_order, o.step, f.b, o.done - f.b AS before, o.done AS after
      FROM q JOIN o ON o.step > 0 AND starts_with(q.whole, o.filter_order) JOIN f ON f.f = right(o.filter_order, 1)),
r AS (
  SELECT part, filter_order, step, any_value(s.b) AS b,
         sum(CASE WHEN (bits & after) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN (bits & before) = 0 AND (bits & s.b) > 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN (bits & before) > 0 AND (bits & s.b) > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN bits = s.b THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN (bits & before) = 0 AND (bits & s.b) > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN (bits & before) = 0 AND (bits & s.b) > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM p, s GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley FROM r
"""
