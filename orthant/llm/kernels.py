"""Numpy kernels over whole batches of text: word spans, word hashes, shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)

#: Bytes that separate words in the near-duplicate and mixing contracts.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Maps A-Z to a-z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=U64) * _ODD)

_RADIX, _INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_RADIX, _INVERSE)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``most`` bytes of text; a longer text is a run of its own."""
    _, at = text_buffers(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(at, at[first] + most, "right")) - 1
        last = max(first + 1, min(last, batch.num_rows))
        yield batch.slice(first, last - first)
        first = last


def word_spans(raw: np.ndarray, at: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the offsets of each row's words."""
    inside = ~separator[raw]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    edges = at[(at > 0) & (at < len(raw))]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER, piece: int = 1_000_000) -> np.ndarray:
    """A 64-bit hash of each span of bytes, after ``fold``.

    A polynomial hash over random byte values from prefix sums, taken piece
    by piece so that memory stays bounded whatever the length of the batch.
    """
    out = np.empty(len(starts), U64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + piece, "right")))
            low, high = int(starts[i]), int(ends[j - 1])
            up, down = _power_tables(high - low + 1)
            sums = np.zeros(high - low + 1, U64)
            np.cumsum(_BYTE[fold[raw[low:high]]] * up[: high - low], out=sums[1:])
            s, e = starts[i:j] - low, ends[i:j] - low
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * _ODD)
            i = j
    return out


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of every run of ``width`` words; fewer words make one run."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        n = max(1, len(words) - width + 1)
        out = np.full(n, min(width, len(words)), U64)
        for k in range(min(width, len(words))):
            out = mix(out * _ODD + words[k : k + n])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]
