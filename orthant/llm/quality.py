"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - weights . features), one weight per
hashed feature shared by all grades and thresholds in order, which gives an
expected grade and the tail probability P(grade >= k) that selection cuts at.
Features are the words and runs of signs present in the whole text and, as
tokens too, the count and share of repeated words, words in capitals and signs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthant.llm.kernels import SPACE, U64, mix, slices, span_hashes, text_buffers, word_spans
from orthant.llm.sampling import row_hash, row_sample
from orthant.storage import materialize

BUCKETS = 1 << 18
SLICE = 2_500_000  # bytes of text read at a time; bounds a worker's memory

_BREAK = np.ones(256, bool)
_BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False
_PLAIN = ~_BREAK | SPACE  # all but signs; digits are no signs
_PLAIN[48:58] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


def _counts(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[at[1:]] - sums[at[:-1]]


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each feature present; only buckets that ``wanted`` marks, if given."""
    raw, at = text_buffers(texts)
    n = len(at) - 1
    starts, ends, ptr = word_spans(raw, at, _BREAK)
    hashes = span_hashes(raw, starts, ends)
    row = np.repeat(np.arange(n), np.diff(ptr))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    shout = (ends - starts > 2) & _CAPITAL[raw[ends - 1]] if len(starts) else again
    s_starts, s_ends, s_ptr = word_spans(raw, at, _PLAIN)
    words, size = np.maximum(1, np.diff(ptr)), np.maximum(1, np.diff(at))
    counts = [(_counts(again, ptr), words), (_counts(shout, ptr), words), (np.diff(s_ptr), size), (words, words)]
    levels = [np.log2(1 + c).astype(np.int64) for c, _ in counts] + [(20 * c / whole).astype(np.int64) for c, whole in counts[:3]]
    with np.errstate(over="ignore"):
        tokens = [mix((level + 1000 * (k + 1)).astype(U64)) for k, level in enumerate(levels)]
        signs = mix(span_hashes(raw, s_starts, s_ends) + U64(1))
    bucket = (np.concatenate([hashes, signs, *tokens]) & U64(BUCKETS - 1)).astype(np.int64)
    row = np.concatenate([row, np.repeat(np.arange(n), np.diff(s_ptr))] + [np.arange(n)] * len(tokens))
    if wanted is not None:
        keep = wanted[bucket]
        row, bucket = row[keep], bucket[keep]
    key = np.unique(row * BUCKETS + bucket)
    return key // BUCKETS, key % BUCKETS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class OrdinalModel:
    weights: np.ndarray  # BUCKETS
    thresholds: np.ndarray  # grades - 1, rising

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades - 1, a row for each text."""
        row, bucket = features(texts, self.weights != 0)
        score = np.bincount(row, self.weights[bucket], minlength=len(texts))
        return _sigmoid(score[:, None] - self.thresholds)


def fit(row: np.ndarray, bucket: np.ndarray, grade: np.ndarray, grades: int, *, least_rows: int = 8, steps: int = 400, batch: int = 2048, rate: float = 0.05, prior: float = 1.0, seed: int = 5) -> OrdinalModel:
    """Maximum a posteriori fit, normal weights of precision ``prior``, by about ``steps`` steps of Adam.

    Grades weigh the same in total.

    Features of fewer than ``least_rows`` rows get no weight.
    """
    rng = np.random.default_rng(seed)
    used = np.flatnonzero(np.bincount(bucket, minlength=BUCKETS) >= least_rows)
    slot = np.full(BUCKETS, -1)
    slot[used] = np.arange(len(used))
    keep = slot[bucket] >= 0
    row, col = row[keep], slot[bucket[keep]]
    order = np.argsort(row, kind="stable")
    row, col = row[order], col[order]
    ptr = np.searchsorted(row, np.arange(len(grade) + 1))
    share = np.bincount(grade, minlength=grades)
    balance = len(grade) / (np.maximum(share, 1)[grade] * max(1, (share > 0).sum()))
    # Thresholds are the first one and the logs of the steps to the next, so they stay in order.
    p = [np.zeros(len(used)), np.concatenate(([-1.0], np.zeros(grades - 2)))]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    batches = max(1, -(-len(grade) // batch))
    epochs = -(-steps // batches)
    step, total = 0, epochs * batches
    for _ in range(epochs if len(grade) else 0):
        for own in np.array_split(rng.permutation(len(grade)), batches):
            cols = np.concatenate([col[ptr[i] : ptr[i + 1]] for i in own])
            rows = np.repeat(np.arange(len(own)), ptr[own + 1] - ptr[own])
            score = np.bincount(rows, p[0][cols], minlength=len(own))
            gaps = np.exp(p[1][1:])
            edges = np.concatenate(([-np.inf], p[1][0] + np.concatenate(([0.0], np.cumsum(gaps))), [np.inf]))
            y = grade[own]
            high, low = _sigmoid(edges[y + 1] - score), _sigmoid(edges[y] - score)
            mass = np.maximum(high - low, 1e-12)
            d_high, d_low = high * (1 - high) / mass, low * (1 - low) / mass
            weigh = balance[own] / len(own)
            d_score = (d_high - d_low) * weigh  # of the negative log likelihood
            grad = np.bincount(cols, d_score[rows], minlength=len(used)) + prior / len(grade) * p[0]
            d_edge = np.bincount(y + 1, -d_high * weigh, minlength=grades + 1) + np.bincount(y, d_low * weigh, minlength=grades + 1)
            inner = d_edge[1:-1]
            d_theta = np.concatenate(([inner.sum()], gaps * (inner[::-1].cumsum()[::-1][1:])))
            pace = rate * (1 - 0.9 * step / total)
            step += 1
            for x, g, m, v in zip(p, (grad, d_theta), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = p[0]
    return OrdinalModel(weights, p[1][0] + np.concatenate(([0.0], np.cumsum(np.exp(p[1][1:])))))


def train(docs: DataFrame, grades: DataFrame, *, levels: int = 3, per_grade: int = 4000, least_rows: int = 8, **options) -> OrdinalModel:
    """Fit on ``docs`` (``doc_id``, ``text``) that ``grades`` (``doc_id``, ``grade`` from 0) rates.

    At most ``per_grade`` rows of each grade train, by a hash of doc_id and
    text, each with its whole text; rows that repeat both count once. Null
    grades, ids and ids that ``docs`` lacks do not count; a doc_id rated twice
    counts with its lowest grade. Features of fewer than ``least_rows`` of
    these rows get no weight and stay on the executors. What the driver holds
    is bounded by ``levels * per_grade`` rows of ``BUCKETS`` features each,
    however long the texts are.
    """
    rated = grades.where(F.col("grade").between(0, levels - 1) & F.col("doc_id").isNotNull())
    rated = rated.groupBy(F.col("doc_id").cast("long").alias("rated_id")).agg(F.min("grade").cast("int").alias("grade"))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    slim = known.select("doc_id", row_hash(["doc_id", "text"]).alias("text_hash"))
    slim = materialize(slim.join(rated, F.col("doc_id") == F.col("rated_id")).select("doc_id", "text_hash", "grade"), "rated")
    chosen = row_sample(slim, "grade", ["doc_id", "text_hash"], per_grade).withColumnsRenamed({"grade": "its", "row_hash": "its_hash"})
    chosen = slim.join(chosen, (F.col("grade") == F.col("its")) & (row_hash(["doc_id", "text_hash"]) == F.col("its_hash")))
    chosen = materialize(chosen.select(F.col("doc_id").alias("rated_id"), F.col("text_hash").alias("rated_hash"), "grade").distinct(), "chosen")
    same = (F.col("doc_id") == F.col("rated_id")) & (row_hash(["doc_id", "text"]) == F.col("rated_hash"))
    found = known.join(chosen.hint("broadcast"), same)  # at most levels * per_grade rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE)):
            row, bucket = features(batch.column("text"))
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("rated_id"), batch.column("rated_hash"), batch.column("grade"), lists], ["id", "hash", "grade", "buckets"])

    lists = found.select("rated_id", "rated_hash", "grade", "text").mapInArrow(extract, "id long, hash long, grade int, buckets array<int>")
    lists = materialize(lists.groupBy("id", "hash", "grade").agg(F.min("buckets").alias("buckets")), "features")  # repeated rows once
    one = lists.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") >= least_rows)
    often = np.zeros(BUCKETS, bool)
    often[[r[0] for r in one.select("bucket").collect()]] = True  # at most BUCKETS rows

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("buckets")
            row, bucket = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy())), column.flatten().to_numpy()
            keep = often[bucket]
            cuts = np.searchsorted(row[keep], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), batch.column("grade"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(bucket[keep]))], ["id", "hash", "grade", "buckets"])

    table = lists.mapInArrow(prune, lists.schema).toArrow().sort_by([("id", "ascending"), ("hash", "ascending")])
    if not table.num_rows:
        return OrdinalModel(np.zeros(BUCKETS), np.arange(levels - 1) - 1.0)
    column = table.column("buckets").combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    return fit(np.repeat(np.arange(table.num_rows), sizes), column.flatten().to_numpy().astype(np.int64), table.column("grade").to_numpy(), levels, least_rows=least_rows, **options)


def scorer(model: OrdinalModel):
    """A vectorised column function: text -> array of P(grade >= k), k from 1."""

    @F.arrow_udf("array<double>")
    def score(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            array = array.cast(pa.large_string()).fill_null("")
            _, at = text_buffers(array)
            parts, first = [np.zeros((0, len(model.thresholds)))], 0
            while first < len(array):
                last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, "right")) - 1)
                parts.append(model.tails(array.slice(first, last - first)))
                first = last
            tails = np.concatenate(parts)
            cuts = np.arange(0, tails.size + 1, tails.shape[1], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(cuts), pa.array(tails.reshape(-1)))

    return score


def grade_of(quality: Column, toxic: Column) -> Column:
    """Toxic: 0; poor: 1; good: 2. Null where the rating is unknown."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def grade_documents(docs: DataFrame, model: OrdinalModel, least_tail: float = 0.1) -> DataFrame:
    """``doc_id``, ``expected_grade``, ``tails`` and ``kept`` of every row of ``docs`` (``doc_id``, ``text``).

    ``kept`` where the probability of the highest grade is ``least_tail`` or
    more. Null counts as the empty text, which holds no words. A text of any
    length is read whole. Equal texts get equal answers; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(model)("text").alias("tails"))
    expected = F.aggregate("tails", F.lit(0.0), lambda a, p: a + p)
    return rows.select("doc_id", expected.alias("expected_grade"), "tails", (F.element_at("tails", -1) >= least_tail).alias("kept"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document graded; the scale joins the two flags of ``labels`` (``grade_of``), as the tables hold no graded rating."""
    model = train(docs, labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")))
    graded = grade_documents(docs, model)
    return graded.select("doc_id", "expected_grade", F.get("tails", F.lit(0)).alias("p_not_toxic"), F.get("tails", F.lit(1)).alias("p_good"), "kept")
