"""License scan by diagonal voting, in DataFrame functions only.

All rolling word k-gram hashes of a text are joined to the positions where the
templates hold the same k-gram. A hit votes for the diagonal (position in the
text minus position in the template): a template that stands in a text as it
is puts all its votes on one diagonal, and one with words added or dropped
spreads them over neighbouring ones, which are merged. Merged spans are
verified by the share of the template they cover and by their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Phrases of the contract and their labels; every place counts.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Openings of well-known license notices, then whole texts of short licenses.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"),
)

_END = -7046029254386353131  # stands for the end of a text, where every text gets one row


def template_rows(phrase_k: int = 2, notice_k: int = 4) -> list[tuple]:
    """(template, label, k, position, k-gram, number of k-grams, number of words) of every template position."""
    rows, number = [], 0
    for k, pairs in ((phrase_k, [(label, words) for words, label in PHRASES]), (notice_k, NOTICES)):
        for label, text in pairs:
            words = text.split()
            grams = len(words) - k + 1
            if grams < 1:
                raise ValueError(f"a template has at least {k} words: {text[:40]}")
            rows += [(number, label, k, i, " ".join(words[i : i + k]), grams, len(words)) for i in range(grams)]
            number += 1
    return rows


def values_sql(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def _templates(spark: SparkSession, phrase_k: int, notice_k: int) -> DataFrame:
    table = spark.sql(
        f"SELECT * FROM VALUES {values_sql(template_rows(phrase_k, notice_k))} AS t(template, label, k, tpos, gram, grams, length)"
    )
    part = [F.get(F.split("gram", " "), F.lit(i)) for i in range(max(phrase_k, notice_k))]
    table = table.withColumn("h", F.xxhash64("k", *part))
    end = spark.sql(f"SELECT -1 template, '' label, 0 k, 0 tpos, '' gram, 0 grams, 0 length, {_END}L h")
    return F.broadcast(table.unionByName(end))  # a constant table: a row for each word of the templates


def license_spans(docs: DataFrame, *, phrase_k: int = 2, notice_k: int = 4, gap: int = 4, least: float = 0.5, stretch: float = 2.0) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``) with its verified license spans.

    A-Z count as a-z and words are runs of other characters than ASCII
    punctuation, space and control. Returns ``doc_id``, ``n_words`` and
    ``spans``: an array of (first, last, label, base, share), words from 0 and
    last exclusive, in order. Null counts as empty and has no words; a text of
    any length is read whole. Rows that repeat a doc_id and a text are counted
    before they meet and get equal rows back. Other columns are ignored.
    """
    # lower() folds all letters; two of them would become ASCII ones and are taken out first.
    fold = F.lower(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("K"), F.lit("ⓩ")), F.lit("İ"), F.lit("ⓩ")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), fold.alias("fold"))
    base = base.withColumn("words", F.regexp_extract_all("fold", F.lit(WORD), F.lit(0))).drop("fold")

    def hashes(k: int):
        return F.transform("words", lambda w, i: F.xxhash64(F.lit(k), w, *[F.get("words", i + j) for j in range(1, k)]))

    end = F.array(F.lit(_END).cast("long"))
    base = base.select("doc_id", "text_key", "words", F.size("words").alias("n_words"), F.concat(hashes(phrase_k), hashes(notice_k), end).alias("rolling"))
    # Outer: Spark would else infer a filter on the size and compute the array twice; it is never empty.
    hits = base.select("doc_id", "text_key", "words", "n_words", F.posexplode_outer("rolling").alias("at", "h"))
    hits = hits.join(_templates(docs.sparkSession, phrase_k, notice_k), "h")
    hits = hits.withColumn("pos", F.when(F.col("at") >= F.col("n_words"), F.col("at") - F.col("n_words")).otherwise(F.col("at")))
    same = F.array_join(F.expr("slice(words, pos + 1, k)"), " ") == F.col("gram")
    hits = hits.where((F.col("template") < 0) | same)
    hits = hits.select("doc_id", "text_key", "n_words", "template", "label", "k", "grams", "length", "pos", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    row = ["doc_id", "text_key"]
    # Positions seen and repeated rows are combined before the first shuffle; what follows is a row per diagonal.
    votes = hits.groupBy(*row, "n_words", "template", "label", "k", "grams", "length", "diagonal").agg(
        F.collect_set("tpos").alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("rows")
    )
    along = Window.partitionBy(*row, "template").orderBy("diagonal")
    far = (F.col("diagonal") - F.lag("diagonal").over(along)) > F.when(F.col("k") == phrase_k, 0).otherwise(gap)
    votes = votes.withColumn("fresh", F.coalesce(far, F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(along))
    runs = votes.groupBy(*row, "n_words", "template", "label", "k", "grams", "length", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("seen"), F.min("first").alias("first"), (F.max("last") + F.first("k")).alias("last"), F.max("rows").alias("rows")
    )
    runs = runs.withColumn("share", F.col("seen") / F.greatest("grams", F.lit(1))).withColumn("base", F.col("k") == phrase_k)
    fits = F.when(F.col("base"), F.col("seen") == F.col("grams")).otherwise(
        (F.col("share") >= least) & (F.col("last") - F.col("first") <= stretch * F.col("length"))
    )
    span = F.when((F.col("template") >= 0) & fits, F.struct("first", "last", "label", "base", "share"))
    out = runs.groupBy(*row, "n_words").agg(F.sort_array(F.collect_list(span)).alias("spans"), F.max(F.when(F.col("template") < 0, F.col("rows"))).alias("rows"))
    out = out.withColumn("lot", F.explode(F.expr("sequence(0L, (rows - 1) div 10000)")))  # lots bound the array of copies
    return out.withColumn("copy", F.explode(F.expr("sequence(1L, least(10000L, rows - 10000 * lot))"))).select("doc_id", "n_words", "spans")


def query(docs: DataFrame) -> DataFrame:
    found = license_spans(docs)
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first"])

    def names(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same scan in DuckDB SQL, on k-gram texts instead of hashes."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH t(template, label, k, tpos, gram, grams, length) AS (VALUES {values_sql(template_rows())}),
d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM d),
g AS (SELECT rid, pos, w || ' ' || lead(w) OVER p AS g2,
             w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p AS g4
      FROM w WINDOW p AS (PARTITION BY rid ORDER BY pos)),
h AS (SELECT rid, pos, t.* FROM g JOIN t ON g.g2 = t.gram AND t.k = 2
      UNION ALL SELECT rid, pos, t.* FROM g JOIN t ON g.g4 = t.gram AND t.k = 4),
v AS (SELECT rid, template, label, k, grams, length, pos - tpos AS diagonal, list(DISTINCT tpos) AS places,
             min(pos) AS p0, max(pos) AS p1 FROM h GROUP BY ALL),
f AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER o > CASE WHEN k = 2 THEN 0 ELSE 4 END, true)::INT AS fresh
      FROM v WINDOW o AS (PARTITION BY rid, template ORDER BY diagonal)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal) AS run FROM f),
u AS (SELECT rid, template, label, k, grams, length, run, len(list_distinct(flatten(list(places)))) AS seen, min(p0) AS p0, max(p1) + k AS p1 FROM r
      GROUP BY rid, template, label, k, grams, length, run),
s AS (SELECT *, seen::DOUBLE / grams AS share FROM u
      WHERE CASE WHEN k = 2 THEN seen = grams ELSE seen::DOUBLE / grams >= 0.5e0 AND p1 - p0 <= 2 * length END),
a AS (SELECT rid, count(*) FILTER (k = 2) AS n_base, min(p0) FILTER (k = 2) AS first_word, max(p0) FILTER (k = 2) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (k = 2) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
             max(share) AS score FROM s GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a USING (rid)
"""
