"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a whole text byte by byte, labels every position with a
distribution over languages, and a document's distribution is the mean over
all its positions. A text is cut into even windows of at most ``CORE`` bytes
that are read side by side; the state of each direction is carried into a
window from the ``CONTEXT`` bytes beyond its edge, and only a text's own ends
start afresh. Trained here by backpropagation through time in numpy, on the
executors; one pass over the texts predicts them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthant.llm.kernels import LOWER, slices, text_buffers
from orthant.llm.sampling import row_hash, row_sample
from orthant.storage import materialize, release

CORE = 128
CONTEXT = 16
PIECE = 4096  # windows read side by side
SLICE = 2_500_000  # bytes of text read at a time; bounds a worker's memory
UNDETERMINED = "und"


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of the windows of each text, even within a text, and the texts' offsets among them."""
    size = np.diff(at)
    parts = -(-size // CORE)
    total = np.concatenate(([0], np.cumsum(parts)))
    step = np.arange(total[-1]) - np.repeat(total[:-1], parts)
    n, of = np.repeat(size, parts), np.repeat(parts, parts)
    begin, end = step * n // np.maximum(of, 1), (step + 1) * n // np.maximum(of, 1)
    return np.repeat(at[:-1], parts) + begin, end - begin, total


@dataclass
class Batch:
    """Windows in falling order of length: bytes by step and window, and the bytes beyond each edge where the text goes on."""

    rows: list[np.ndarray]  # per direction CORE x n, in reading order
    length: np.ndarray
    onward: list[np.ndarray]  # per direction the windows that have a context
    context: list[np.ndarray]  # per direction CONTEXT x len(onward), in reading order


def batch_of(raw: np.ndarray, begin: np.ndarray, length: np.ndarray, first: np.ndarray, last: np.ndarray) -> Batch:
    """``first`` and ``last`` mark the windows at which a text starts and ends."""
    cols = np.arange(CORE)[:, None]
    inside = cols < length
    pick = lambda place: LOWER[raw[np.where(inside, place, 0)]]
    rows = [pick(begin + cols), pick(begin + length - 1 - cols)]
    onward = [np.flatnonzero(~first), np.flatnonzero(~last)]
    steps = np.arange(CONTEXT)[:, None]
    context = [LOWER[raw[begin[onward[0]] - CONTEXT + steps]], LOWER[raw[begin[onward[1]] + length[onward[1]] + CONTEXT - 1 - steps]]]
    return Batch(rows, length, onward, context)


@dataclass
class ByteGru:
    """Weights: per direction and gate (update, reset, candidate) a byte table and a recurrent matrix, and an output matrix."""

    languages: list[str]
    table: list[np.ndarray] = field(default_factory=list)  # 2 x [3 x 256 x hidden]
    recur: list[np.ndarray] = field(default_factory=list)  # 2 x [3 x hidden x hidden]
    out: list[np.ndarray] = field(default_factory=list)  # 2 x [hidden x languages]
    bias: np.ndarray | None = None

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, seed: int) -> ByteGru:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        n = len(languages)
        return cls(
            languages,
            [draw(3, 256, hidden, scale=0.3) for _ in range(2)],
            [draw(3, hidden, hidden, scale=hidden**-0.5) for _ in range(2)],
            [draw(hidden, n, scale=0.3) for _ in range(2)],
            np.zeros(n, np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.recur, *self.out, self.bias]

    def _step(self, way: int, byte: np.ndarray, state: np.ndarray, room: np.ndarray, keep: list | None = None) -> None:
        """Read one byte in each window; ``state`` is changed in place. ``room`` holds six arrays of at least its size.

        Gates are piecewise linear (0 to 1) and the candidate is x / (1 + |x|): a fifth of the time that tanh takes.
        """
        n, (table, recur) = len(byte), (self.table[way], self.recur[way])
        z, r, new, fed, kept, spare = (x[:n] for x in room)
        for gate, to in ((0, z), (1, r)):
            np.take(table[gate], byte, axis=0, out=to, mode="clip")
            np.matmul(state, recur[gate], out=spare)
            to += spare
            to *= 0.25
            to += 0.5
            np.clip(to, 0, 1, out=to)
        np.take(table[2], byte, axis=0, out=new, mode="clip")
        np.matmul(state, recur[2], out=kept)
        np.multiply(kept, r, out=fed)
        new += fed
        np.abs(new, out=fed)
        fed += 1
        new /= fed
        if keep is not None:
            keep.append((byte, state.copy(), z.copy(), r.copy(), new.copy(), kept.copy()))
        state -= new
        state *= z
        state += new

    def _room(self, n: int) -> np.ndarray:
        return np.empty((6, n, self.out[0].shape[0]), self.bias.dtype)

    def starts(self, batch: Batch) -> list[np.ndarray]:
        """State of each direction in which its windows begin."""
        out = []
        for way in (0, 1):
            state = np.zeros((len(batch.length), self.out[way].shape[0]), self.bias.dtype)
            if len(batch.onward[way]):
                carried, room = state[: len(batch.onward[way])].copy(), self._room(len(batch.onward[way]))
                for byte in batch.context[way]:
                    self._step(way, byte, carried, room)
                state[batch.onward[way]] = carried
            out.append(state)
        return out

    def _read(self, way: int, batch: Batch, state: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of one direction by language, step and window."""
        length = batch.length
        steps = int(length[0]) if len(length) else 0
        logits, room = np.zeros((self.out[way].shape[1], steps, len(length)), self.bias.dtype), self._room(len(length))
        counts = np.searchsorted(-length, -np.arange(1, steps + 1), "right")  # windows that reach each step
        turned = np.ascontiguousarray(self.out[way].T)
        for t in range(steps):
            n = int(counts[t])
            self._step(way, batch.rows[way][t, :n], state[:n], room, keep)
            logits[:, t, :n] = turned @ state[:n].T
        return logits

    def positions(self, batch: Batch, keep: tuple[list, list] | None = None) -> np.ndarray:
        """Probabilities by language, place and window; places beyond a window's length mean nothing."""
        begin = self.starts(batch)
        logits = self._read(0, batch, begin[0], keep and keep[0])
        back = self._read(1, batch, begin[1], keep and keep[1])
        place = np.maximum(batch.length - 1 - np.arange(logits.shape[1])[:, None], 0) * logits.shape[2] + np.arange(logits.shape[2])
        for own, other, bias in zip(logits, back, self.bias):
            own += np.take(other.reshape(-1), place)
            own += bias
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits

    def gradients(self, batch: Batch, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over all positions, by backpropagation through time to the windows' first bytes."""
        kept: tuple[list, list] = ([], [])
        error = self.positions(batch, kept)
        length = batch.length
        error[label, :, np.arange(len(length))] -= 1
        error *= (np.arange(error.shape[1])[:, None] < length) / error.dtype.type(length.sum())
        tables, recurs, outs = [], [], []
        for way in (0, 1):
            recur, out = self.recur[way], self.out[way]
            d_recur, d_out = np.zeros_like(recur), np.zeros_like(out)
            seen, pushed = [], [[], [], []]
            back = np.zeros((len(length), out.shape[0]), recur.dtype)
            for t in range(len(kept[way]) - 1, -1, -1):
                byte, before, z, r, new, fed = kept[way][t]
                n = len(byte)
                e = error[:, t, :n] if way == 0 else error[:, length[:n] - 1 - t, np.arange(n)]
                d_out += (new + z * (before - new)).T @ e.T
                d = back[:n] + e.T @ out.T
                d_new = d * (1 - z) * (1 - np.abs(new)) ** 2
                d_z = d * (before - new) * (before.dtype.type(0.25) * ((z > 0) & (z < 1)))
                d_r = d_new * fed * (before.dtype.type(0.25) * ((r > 0) & (r < 1)))
                through = (d_z, d_r, d_new * r)
                back[:n] = d * z
                for gate in range(3):
                    d_recur[gate] += before.T @ through[gate]
                    back[:n] += through[gate] @ recur[gate].T
                seen.append(byte)
                for to, x in zip(pushed, (d_z, d_r, d_new)):
                    to.append(x)
            byte = np.concatenate(seen)
            order = np.argsort(byte, kind="stable")
            found, first = np.unique(byte[order], return_index=True)
            d_table = np.zeros_like(self.table[way])
            for gate in range(3):
                d_table[gate, found] = np.add.reduceat(np.concatenate(pushed[gate])[order], first, axis=0)
            tables.append(d_table)
            recurs.append(d_recur)
            outs.append(d_out)
        return [*tables, *recurs, *outs, error.sum(axis=(1, 2))]

    def fit(self, raw: np.ndarray, at: np.ndarray, label: np.ndarray, *, batch: int, steps: int, rate: float, seed: int) -> int:
        """Adam over shuffled windows of whole texts, once or until ``steps`` steps are done; the number of positions."""
        rng = np.random.default_rng(seed)
        begin, length, ptr = windows(at)
        if not len(begin):
            return 0
        text = np.repeat(np.arange(len(at) - 1), np.diff(ptr))
        first, last = (np.zeros(len(begin), bool) for _ in range(2))
        first[ptr[:-1][np.diff(ptr) > 0]] = last[ptr[1:][np.diff(ptr) > 0] - 1] = True
        m, v = ([np.zeros_like(p) for p in self.parameters()] for _ in range(2))
        passes = -(-steps // -(-len(begin) // batch))
        order = [own for _ in range(passes) for own in np.array_split(rng.permutation(len(begin)), -(-len(begin) // batch))]
        for step, own in enumerate(order, 1):
            own = own[np.argsort(-length[own], kind="stable")]
            part = batch_of(raw, begin[own], length[own], first[own], last[own])
            for p, g, a, b in zip(self.parameters(), self.gradients(part, label[text[own]]), m, v):
                a += np.float32(0.1) * (g - a)
                b += np.float32(0.001) * (g * g - b)
                p -= np.float32(rate) * (a / np.float32(1 - 0.9**step)) / (np.sqrt(b / np.float32(1 - 0.999**step)) + np.float32(1e-8))
        return int(length.sum())

    def documents(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of every text."""
        raw, at = text_buffers(texts)
        begin, length, ptr = windows(at)
        n = len(at) - 1
        total = np.zeros((n, max(1, len(self.languages))))
        if len(begin) and self.languages:
            full = np.flatnonzero(np.diff(ptr) > 0)
            first, last = (np.zeros(len(begin), bool) for _ in range(2))
            first[ptr[:-1][full]] = last[ptr[1:][full] - 1] = True
            sums = np.empty((len(begin), len(self.languages)))
            order = np.argsort(-length, kind="stable")
            piece = max(64, min(PIECE, 2_000_000 // (CORE * len(self.languages))))
            for i in range(0, len(begin), piece):
                own = order[i : i + piece]
                p = self.positions(batch_of(raw, begin[own], length[own], first[own], last[own]))
                p *= np.arange(p.shape[1])[:, None] < length[own]
                sums[own] = p.sum(axis=1).T
            total[full] = np.add.reduceat(sums, ptr[:-1][full], axis=0)
        best, mass = total.argmax(axis=1), total.sum(axis=1)
        score = np.divide(total.max(axis=1), mass, out=np.zeros(n), where=mass > 0).clip(0, 1)
        named, scores = [], score.copy()
        for i, text in enumerate(texts):
            known = mass[i] > 0 and any(c.isalpha() for c in text.as_py())
            named.append(self.languages[best[i]] if known else UNDETERMINED)
            scores[i] = score[i] if known else 0.0
        return named, scores


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, per_language: int) -> DataFrame:
    """``lang``, whole ``text`` and ``row_hash`` of at most ``per_language`` rows of each language."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    known = known.where("lang is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).where(F.col("text").rlike(r"\p{L}"))
    chosen = row_sample(known, "lang", ["doc_id", "text"], per_language).withColumnRenamed("lang", "its")
    chosen = materialize(chosen, "chosen").hint("broadcast")  # at most per_language rows of each language
    same = (F.col("lang") == F.col("its")) & (row_hash(["doc_id", "text"]) == F.col("row_hash"))
    found = known.join(chosen, same).groupBy("lang", "row_hash").agg(F.min("text").alias("text"))  # repeated rows once
    return materialize(found, "sample")


def train(docs: DataFrame, *, per_language: int = 100, hidden: int = 8, rounds: int = 6, parts: int = 4, batch: int = 128, steps: int = 12, rate: float = 0.03, seed: int = 7) -> ByteGru:
    """Fit the network on a bounded sample of the rows of ``docs`` that are not held out.

    The sample is ``per_language`` rows of each language at most, by a hash of
    doc_id and text, each read whole; rows that repeat both count once. Rows
    with a null lang or doc_id, or no letter in the text, do not train; without
    any row the model knows no language. Rows are dealt to partitions by their
    hash and sorted, so the weights do not depend on the number of executors or
    on the files of the table. In each round every one of ``parts``
    partitions reads its rows once, or until it has done ``steps`` steps, from
    the same weights, and the mean of theirs, weighted by positions, starts the
    next: only weights reach the driver, however long the texts are.
    """
    sample = training_rows(docs, per_language)
    dealt = sample.repartition(parts, "row_hash").sortWithinPartitions("row_hash", "lang").select("lang", "text")
    languages = sorted(r[0] for r in sample.select("lang").distinct().collect())
    model = ByteGru.fresh(languages, hidden, seed)
    if not languages:
        return model
    index = {name: i for i, name in enumerate(languages)}
    shapes = [p.shape for p in model.parameters()]
    for turn in range(rounds):
        pace = rate * (1 - 0.9 * turn / rounds)

        def epoch(batches: Iterator[pa.RecordBatch], model=model, turn=turn, pace=pace) -> Iterator[pa.RecordBatch]:
            local = ByteGru(languages, [p.copy() for p in model.table], [p.copy() for p in model.recur], [p.copy() for p in model.out], model.bias.copy())
            read = 0
            for part in (part for whole in batches for part in slices(whole, "text", SLICE)):
                raw, at = text_buffers(part.column("text"))
                label = np.array([index[x] for x in part.column("lang").to_pylist()])
                read += local.fit(raw, at, label, batch=batch, steps=steps, rate=pace, seed=seed + turn)
            flat = np.concatenate([p.reshape(-1) for p in local.parameters()]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([read]), pa.array([flat.tobytes()], pa.binary())], ["read", "weights"])

        got = [r for r in dealt.mapInArrow(epoch, "read long, weights binary").collect() if r["read"]]  # one row per partition
        got.sort(key=lambda r: (r["read"], bytes(r["weights"])))
        mean = sum(np.frombuffer(r["weights"], np.float32).astype(np.float64) * r["read"] for r in got) / sum(r["read"] for r in got)
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        fresh = [x.reshape(s).astype(np.float32) for x, s in zip(np.split(mean, cuts), shapes)]
        model = ByteGru(languages, fresh[:2], fresh[2:4], fresh[4:6], fresh[6])
    release(sample)
    return model


def predictor(model: ByteGru):
    """A vectorised column function: text -> struct of ``lang`` and ``score``."""

    @F.arrow_udf("struct<lang: string, score: double>")
    def identify(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            names: list[str] = []
            scores: list[np.ndarray] = []
            array = array.cast(pa.large_string()).fill_null("")
            _, at = text_buffers(array)
            first = 0
            while first < len(array):
                last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, "right")) - 1)
                got = model.documents(array.slice(first, last - first))
                names += got[0]
                scores.append(got[1])
                first = last
            values = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.float64())], ["lang", "score"])

    return identify


def identify_documents(docs: DataFrame, model: ByteGru) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row of ``docs`` (``doc_id``, ``text``).

    Whole texts are read. A null text, or one without a letter, is ``und``
    with score 0. Equal texts get equal answers; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), predictor(model)("text").alias("p"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def query(docs: DataFrame) -> DataFrame:
    return identify_documents(docs, train(docs))
