"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

1. Each normalised text is cut where a word's hash says so, so equal passages
   give equal chunks wherever they stand. Its recipe is the ordered list of
   (64-bit, 32-bit) chunk hashes.
2. Chunk texts meet once, collapsed within each task first, to verify that a
   hash stands for one text. Where it does not, the identifier is widened by
   the SHA-256 of the chunk, for exactly the hashes concerned.
3. Documents are equal when their lists of verified identifiers are equal.
   Only these lists, a few per cent of the text, move from here on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthant.storage import materialize

WHITE = "[\\x20\\x09-\\x0D]+"


def with_chunks(df: DataFrame, mask: int = 127, longest: int = 8192) -> DataFrame:
    """Replace ``words`` by ``chunks``, which concatenate to the words joined by one space.

    A chunk ends after a word whose hash has no bit of ``mask`` set. A chunk of
    over ``longest`` bytes (one endless word, or no such word) is cut further,
    every ``longest`` characters from its start.
    """
    cut = F.transform("words", lambda w, i: F.when(F.xxhash64(w).bitwiseAND(F.lit(mask)) == 0, i + 1))
    df = df.withColumn("ends", F.array_distinct(F.concat(F.filter(cut, lambda i: i.isNotNull()), F.array(F.size("words")))))
    starts = F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1))
    pieces = F.zip_with(
        starts,
        "ends",
        lambda a, b: F.concat(F.array_join(F.slice("words", a + 1, b - a), " "), F.when(b < F.size("words"), " ").otherwise("")),
    )
    df = df.withColumn("chunks", pieces).drop("words", "ends")
    parts = F.transform(
        "chunks",
        lambda c: F.when(F.octet_length(c) > longest, F.regexp_extract_all(c, F.lit("(?s).{1,%d}" % longest), F.lit(0))).otherwise(F.array(c)),
    )
    oversize = F.exists("chunks", lambda c: F.octet_length(c) > longest)
    return df.withColumn("chunks", F.when(oversize, F.flatten(parts)).otherwise(F.col("chunks")))


def exact_duplicates(docs: DataFrame, *, mask: int = 127, longest: int = 8192, hash_bits: int = 64) -> DataFrame:
    """Group rows of ``docs`` (``doc_id``, ``text``) whose texts are equal up to white space.

    Each run of ASCII white space counts as one space; null counts as empty.
    Returns one row for each input row: ``doc_id``, ``keep_id`` (the smallest
    doc_id of the equal texts; null ids come last), ``group_size``, ``kept``
    and ``text_sha256`` of the normalised text. Of rows that also share the
    smallest doc_id all are kept: they cannot be told apart by doc_id. Other
    columns are ignored. ``hash_bits`` narrows the chunk hash, for tests.
    """
    words = F.split(F.coalesce("text", F.lit("")), WHITE, -1)
    step = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    step = with_chunks(step.withColumn("text_sha256", F.sha2(F.array_join("words", " "), 256)), mask, longest)
    narrow = (lambda h: h) if hash_bits >= 64 else (lambda h: h.bitwiseAND(F.lit((1 << hash_bits) - 1)))
    check = (lambda c: F.hash(c)) if hash_bits >= 64 else (lambda c: F.lit(0))
    recipe = F.transform("chunks", lambda c: F.struct(narrow(F.xxhash64(c)).alias("h"), check(c).alias("g"), F.lit(None).cast("string").alias("w")))
    cut = materialize(step.withColumn("recipe", recipe), "chunks")

    met = cut.select(F.explode(F.arrays_zip("recipe", "chunks")).alias("c"))
    met = met.select(F.col("c.recipe.h").alias("h"), F.col("c.recipe.g").alias("g"), F.col("c.chunks").alias("chunk"))
    texts = met.groupBy("h", "g", "chunk").agg(F.lit(1).alias("one"))
    clash = materialize(texts.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g"), "clash")
    slim = cut.select("doc_id", "text_sha256", "recipe")
    if not clash.isEmpty():
        slim = _widened(cut, clash)

    key = slim.withColumn("key", F.xxhash64("recipe"))
    groups = materialize(
        key.groupBy("key", "recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups"
    )
    # Both sides of this join are plain scans, so that skewed keys can be split.
    out = key.join(groups.withColumnRenamed("recipe", "theirs"), "key").where("recipe = theirs")
    return out.select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256"
    )


def _widened(cut: DataFrame, clash: DataFrame) -> DataFrame:
    """Recipes in which every hash of several texts carries the SHA-256 of its chunk."""
    rows = cut.withColumn("row", F.monotonically_increasing_id()).select(
        "row", "doc_id", "text_sha256", F.posexplode(F.arrays_zip("recipe", "chunks")).alias("at", "c")
    )
    marked = rows.select("*", F.col("c.recipe.h").alias("h"), F.col("c.recipe.g").alias("g")).join(clash.withColumn("hit", F.lit(True)), ["h", "g"], "left")
    part = F.struct("at", "h", "g", F.when(F.col("hit"), F.sha2("c.chunks", 256)).alias("w"))
    lists = marked.groupBy("row", "doc_id", "text_sha256").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return lists.select("doc_id", "text_sha256", F.transform("parts", lambda p: F.struct(p["h"].alias("h"), p["g"].alias("g"), p["w"].alias("w"))).alias("recipe"))
