"""Secret scan over a trigram inverted index, in DataFrame functions only.

1. From each rule's regular expression a Boolean trigram query is derived: an
   OR of ANDs of trigrams that every match must hold, letters folded.
2. Every text is cut into its trigrams once; those that some clause names
   become postings (trigram, text) of the index.
3. Postings are intersected: a text is a candidate of a rule when it has all
   trigrams of one of the rule's clauses.
4. Candidates are verified by the expression itself. Rules without mandatory
   trigrams have no clause and scan every text, where it is read.
"""

from __future__ import annotations

import re
import re._parser as parser
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthant.storage import materialize, release


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax that Java, RE2 and Python share; ``group`` (0: all) must have ``least`` characters."""

    kind: str
    pattern: str
    fold: bool = False
    group: int = 0
    least: int = 1
    #: An expression with the same accepted matches that is faster to search for, if there is one.
    search: str | None = None

    @property
    def expression(self) -> str:
        return ("(?i)" if self.fold else "") + (self.search or self.pattern)


# The three kinds of the contract.
BASE = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", True, 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", False, 0, 16),
    Rule("hex", "[0-9a-f]+", False, 0, 32, "[0-9a-f]{32,}"),
)

#: Spans that the method adds: well-known public token formats.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]+"),
    Rule("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def trigram_query(pattern: str, most: int = 1024) -> list[frozenset[str]]:
    """Clauses of trigrams, letters folded; every match holds all trigrams of one clause at least.

    An empty list means that nothing is mandatory. The expression is expanded
    into the literal texts around its variable parts, while these are few.
    """

    def expand(nodes) -> list[list[str | None]]:
        """Alternative sequences of literal characters and None, which stands for any text."""
        forms: list[list[str | None]] = [[]]
        for op, value in nodes:
            name = str(op)
            if name == "LITERAL":
                parts = [[chr(value).lower()]]
            elif name == "SUBPATTERN":
                parts = expand(value[-1])
            elif name == "BRANCH":
                parts = [form for branch in value[1] for form in expand(branch)]
            elif name == "MAX_REPEAT" and value[0] == 0 and value[1] == 1:
                parts = [[], *expand(value[2])]
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
                inner = expand(value[2])
                parts = [form * value[0] + ([None] if value[1] != value[0] else []) for form in inner] if value[0] <= 4 else [[None]]
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value) and len(value) <= 8:
                parts = [[c] for c in sorted({chr(v).lower() for _, v in value})]
            else:
                parts = [[None]]
            forms = [a + b for a in forms for b in parts]
            if len(forms) > most:
                return [[None]]
        return forms

    clauses = set()
    for form in expand(parser.parse(pattern)):
        text = "".join(c if c is not None else "\0" for c in form)
        grams = frozenset(text[i : i + 3] for i in range(len(text) - 2) if "\0" not in text[i : i + 3])
        if not grams:
            return []
        clauses.add(grams)
    # A clause that holds all of another one adds nothing.
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def build_index(docs: DataFrame, rules: Sequence[Rule], piece: int = 4096) -> DataFrame:
    """Postings (``trigram``, ``doc_id``, ``text_key``) of the trigrams that the rules ask for.

    A text is cut in pieces of ``piece`` characters, each with two more of the
    next one, and a piece into the trigrams that begin at each of its places,
    so a text of any length takes the memory of one piece.
    """
    grams = sorted({g for rule in rules for clause in trigram_query(rule.pattern) for g in clause})
    low = _texts(docs).select("doc_id", "text_key", F.lower("text").alias("low"))
    pieces = low.select("doc_id", "text_key", F.explode(F.regexp_extract_all("low", F.lit(r"(?s)(?=(.{1,%d})).{1,%d}" % (piece + 2, piece)), F.lit(1))).alias("piece"))
    cut = F.regexp_extract_all("piece", F.lit("(?s)(?=(...))"), F.lit(1))
    return pieces.select("doc_id", "text_key", F.explode(F.array_distinct(F.filter(cut, lambda g: g.isin(grams)))).alias("trigram"))


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``doc_id``, ``text_key`` and the ``kinds`` whose query the text's postings satisfy."""
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    grams = sorted({g for clauses in queries.values() for clause in clauses for g in clause})
    asked = index.where(F.col("trigram").isin(grams)) if grams else index.limit(0)
    lists = asked.groupBy("doc_id", "text_key").agg(F.collect_set("trigram").alias("have"))

    def holds(clauses: list[frozenset[str]]) -> Column:
        tests = [F.size(F.array_except(F.array(*[F.lit(g) for g in sorted(c)]), "have")) == 0 for c in clauses]
        out = tests[0]
        for test in tests[1:]:
            out = out | test
        return out

    kinds = F.array_compact(F.array(*[F.when(holds(c), kind) for kind, c in queries.items() if c])) if grams else F.array().cast("array<string>")
    return lists.select("doc_id", "text_key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _matches(text: Column, rule: Rule) -> Column:
    """Accepted (start, kind number, kind, end) of a rule, offsets in code points."""
    p = rule.expression
    number = [r.kind for r in (*BASE, *MORE)].index(rule.kind) if rule in (*BASE, *MORE) else 99
    whole = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(p), F.lit(rule.group))
    gaps = F.split(text, p, -1)  # the text before each match and after the last
    parts = F.zip_with(F.slice(gaps, 1, F.size(whole)), F.arrays_zip(whole.alias("w"), groups.alias("g")), lambda gap, m: F.struct(F.length(gap).alias("a"), F.length(m["w"]).alias("n"), F.length(m["g"]).alias("g")))
    empty = F.array().cast("array<struct<s:int,n:int,g:int>>")

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["a"]
        hit = F.array(F.struct(begin.alias("s"), m["n"].alias("n"), m["g"].alias("g")))
        return F.struct((begin + m["n"]).alias("at"), F.concat(acc["found"], F.when(m["g"] >= rule.least, hit).otherwise(empty)).alias("found"))

    def shifted(acc: Column, block: Column) -> Column:
        own = F.transform(block["found"], lambda m: F.struct((m["s"] + acc["at"]).alias("s"), m["n"].alias("n"), m["g"].alias("g")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["lists"], F.array(own)).alias("lists"))

    # Running offsets within blocks of about the root of the number of matches, then over the blocks.
    size = F.greatest(F.size(parts), F.lit(1))
    stride = F.ceil(F.sqrt(size)).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), size, stride), lambda at: F.slice(parts, at, stride))
    folded = F.transform(blocks, lambda b: F.aggregate(b, F.struct(F.lit(0).alias("at"), empty.alias("found")), step))
    none = F.array().cast("array<array<struct<s:int,n:int,g:int>>>")
    spans = F.aggregate(folded, F.struct(F.lit(0).alias("at"), none.alias("lists")), shifted, lambda acc: F.flatten(acc["lists"]))
    return F.transform(spans, lambda m: F.struct(m["s"].alias("start"), F.lit(number).alias("number"), F.lit(rule.kind).alias("kind"), (m["s"] + m["n"]).alias("end")))


def secret_spans(docs: DataFrame, rules: Sequence[Rule] = (*BASE, *MORE), few: int = 100_000) -> DataFrame:
    """``doc_id``, ``text`` and ``spans`` of every row of ``docs`` (``doc_id``, ``text``).

    ``spans`` holds (start, number, kind, end) of each rule's accepted matches,
    leftmost and without overlap within a rule, in order of start, then of the
    rules. Null counts as empty; a text of any length is searched whole. Rows
    that repeat a doc_id and a text get equal rows back; other columns are
    ignored. Up to ``few`` candidates, counted first, go to the texts by a
    broadcast and no text moves; more meet them in a sort-merge join.
    """
    index = materialize(build_index(docs, rules), "postings")
    found = materialize(candidates(index, rules).withColumnsRenamed({"doc_id": "c_id", "text_key": "c_key"}), "candidates")
    release(index)
    texts = _texts(docs)
    same = texts["doc_id"].eqNullSafe(found["c_id"]) & (texts["text_key"] == found["c_key"])
    found = F.broadcast(found) if found.count() <= few else found.hint("merge")
    rows = texts.join(found, same, "left").select("doc_id", "text", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
    none = F.array().cast("array<struct<start:int,number:int,kind:string,end:int>>")
    lists = []
    for i, rule in enumerate(rules):
        asked = F.array_contains("kinds", rule.kind) if trigram_query(rule.pattern) else F.lit(True)
        test = asked & F.col("text").rlike(rule.expression)
        rows = rows.withColumn(f"m{i}", F.when(test, _matches(F.col("text"), rule)).otherwise(none))
        lists.append(F.col(f"m{i}"))
    return rows.select("doc_id", "text", F.array_sort(F.concat(*lists)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    found = secret_spans(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["number"] < len(BASE))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def oracle() -> str:
    """The rules alone in DuckDB SQL, without an index."""
    ctes, names = [], []
    for i, rule in enumerate((*BASE, *MORE)):
        p = rule.expression.replace("'", "''")
        ctes.append(rf"""
m{i} AS (SELECT rid, unnest(regexp_extract_all(t, '{p}', 0)) AS w, unnest(regexp_extract_all(t, '{p}', {rule.group})) AS g,
             unnest(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}', 0))]) AS gap,
             generate_subscripts(regexp_extract_all(t, '{p}', 0), 1) AS k FROM d WHERE regexp_matches(t, '{p}')),
s{i} AS (SELECT rid, {i} AS number, '{rule.kind}' AS kind, length(w) AS n, length(g) AS g,
             sum(length(gap)) OVER o + coalesce(sum(length(w)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM m{i} WINDOW o AS (PARTITION BY rid ORDER BY k))""")
        names.append(f"SELECT rid, number, kind, start::BIGINT AS a, (start + n)::BIGINT AS b FROM s{i} WHERE g >= {rule.least}")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),{','.join(ctes)},
u AS ({' UNION ALL '.join(names)}),
a AS (SELECT rid, count(*) FILTER (number = 0) AS n0, count(*) FILTER (number = 1) AS n1, count(*) FILTER (number = 2) AS n2,
             string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, number) FILTER (number < {len(BASE)}) AS base,
             string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, number) AS spans FROM u GROUP BY rid)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""
