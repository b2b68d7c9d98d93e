"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Words of many texts are laid out as one flat array of symbols. In each round
the rank of every neighbouring pair is looked up, the smallest rank of each
word is found by a segmented minimum, all places of it are merged from the
left at once, and the array is compacted; words without a pair drop out. Where
a merge brings up a pair of smaller rank than its own, the round is redone for
that word with its leftmost place alone, so the order is the library's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthant.llm.kernels import slices

SPACE = "▁"
_NONE = np.int32(2**31 - 1)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """Encoder and decoder for one BPE model file with byte fallback and identity normalisation."""

    def __init__(self, model_path: str, cache_bytes: int = 96_000_000, longest_cached: int = 256):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): i for i in plain}
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        rank_of_score = {s: r for r, s in enumerate(scores)}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.chars = {p: i for p, i in pieces.items() if len(p) == 1}
        keys, merged, ranks = [], [], []
        for piece, i in pieces.items():
            for k in range(1, len(piece)):
                left, right = pieces.get(piece[:k]), pieces.get(piece[k:])
                if left is not None and right is not None:
                    keys.append(left * n + right)
                    merged.append(i)
                    ranks.append(rank_of_score[model.get_score(i)])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.n = n
        self.keys = np.concatenate((np.array(keys, np.int64)[order], [np.iinfo(np.int64).max]))
        self.merged = np.concatenate((np.array(merged, np.int32)[order], [0])).astype(np.int32)
        self.ranks = np.concatenate((np.array(ranks, np.int32)[order], [_NONE])).astype(np.int32)
        per_score: dict[float, int] = {}
        for i in plain:
            per_score[model.get_score(i)] = per_score.get(model.get_score(i), 0) + 1
        self.shared = np.array([per_score[s] > 1 for s in scores])  # ranks that several pieces share
        self.bytes = [b""] * n
        for i in plain:
            self.bytes[i] = model.id_to_piece(i).replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        self.bytes[model.unk_id()] = " ⁇ ".encode()
        # Characters that no longer piece holds end a word, as does a space after another character.
        inner = {c for p in pieces if len(p) > 1 for c in p}
        if not inner <= set(self.chars) or any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("the model has pieces that this codec cannot cut into words")
        stop = "".join(re.escape(c) for c in "\n\t\r\"" if c not in inner)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}{stop}]*|[^{SPACE}{stop}]+" + (f"|[{stop}]+" if stop else ""))
        self.names = [str(i) for i in range(n)]
        self.cache: dict[str, tuple[bytes, str, bytes]] = {}
        self.cache_bytes, self.longest_cached, self.cached = cache_bytes, longest_cached, 0

    def _look_up(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray, rank: np.ndarray, to: np.ndarray) -> None:
        """Set rank and merged piece of the pairs that start at the places ``at``."""
        rank[at] = _NONE
        at = at[at < len(symbols) - 1]
        at = at[(word[at + 1] == word[at]) & (symbols[at] >= 0) & (symbols[at + 1] >= 0)]
        key = symbols[at].astype(np.int64) * self.n + symbols[at + 1]
        k = np.searchsorted(self.keys, key)
        hit = self.keys[k] == key
        rank[at[hit]], to[at[hit]] = self.ranks[k[hit]], self.merged[k[hit]]

    def _merge_rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, to = np.full(len(symbols), _NONE, np.int32), np.zeros(len(symbols), np.int32)
        self._look_up(symbols, word, np.arange(len(symbols)), rank, to)
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            segment = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(word))))
            least = np.minimum.reduceat(rank, starts)
            live = (least < _NONE)[segment]
            if not live.all():
                done.append((symbols[~live], word[~live]))
                symbols, word, rank, to = symbols[live], word[live], rank[live], to[live]
                continue
            place = np.flatnonzero(rank == least[segment])
            first = np.concatenate(([True], segment[place[1:]] != segment[place[:-1]]))
            fresh = np.concatenate(([True], place[1:] != place[:-1] + 1))
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            take = ((place - place[run]) % 2 == 0) & (first | ~self.shared[rank[place]])
            for _ in range(2):
                at = place[take]
                keep = np.ones(len(symbols), bool)
                keep[at + 1] = False
                new = symbols.copy()
                new[at] = to[at]
                new, own = new[keep], word[keep]
                new_rank, new_to = rank[keep], to[keep]
                fused = at - np.arange(len(at))  # places after compaction
                touched = np.concatenate((fused, fused[fused > 0] - 1))
                self._look_up(new, own, touched, new_rank, new_to)
                mine = segment[np.concatenate((at, at[fused > 0] - 1))]
                sooner = np.zeros(len(starts), bool)
                sooner[mine[new_rank[touched] < least[mine]]] = True
                redo = sooner[segment[place]] & take & ~first
                if not redo.any():
                    break
                take &= ~redo
            symbols, word, rank, to = new, own, new_rank, new_to
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; a word is text in which spaces are already marked."""
        lengths = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        distinct, back = np.unique(points, return_inverse=True)
        symbols = np.array([self.chars.get(chr(c), -int(c) - 1) for c in distinct], np.int32)[back]
        symbols, word = self._merge_rounds(symbols, np.repeat(np.arange(len(words)), lengths))
        cuts = np.searchsorted(word, np.arange(len(words) + 1))
        unknown = np.flatnonzero(symbols < 0)
        strange = set(word[unknown].tolist())
        out = []
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            ids = symbols[a:b]
            if i in strange:
                flat: list[int] = []
                for s in ids.tolist():
                    flat.extend([s] if s >= 0 else [self.byte_ids[x] for x in chr(-s - 1).encode()])
                ids = np.array(flat, np.int32)
            out.append(ids)
        return out

    def entries(self, texts: list[str]) -> Iterator[list[tuple[bytes, str, bytes]]]:
        """For each text, its words' (ids as int32 bytes, ids as text, decoded bytes).

        Words of up to ``longest_cached`` characters are remembered between
        calls, in about ``cache_bytes``; then the memory starts anew.
        """
        cut = [self.cut.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        here = set().union(*cut)
        found = {w: self.cache[w] for w in here if w in self.cache}
        wanted = [w for w in here if w not in found]
        if wanted:
            for w, ids in zip(wanted, self.encode_words(wanted)):
                each = ids.tolist()
                found[w] = (ids.tobytes(), ",".join([self.names[i] for i in each]), b"".join([self.bytes[i] for i in each]))
                if len(w) <= self.longest_cached:  # a longer word is as rare as it is large
                    self.cached += 400 + 3 * len(w) + sum(map(len, found[w]))  # objects and characters
                    self.cache[w] = found[w]
        entry = found.__getitem__
        for words in cut:
            yield list(map(entry, words))
        if self.cached > self.cache_bytes:
            self.cache, self.cached = {}, 0

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, the first space of the text dropped."""
        raw = self.decode_bytes(ids)
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _codec(model_path: str | None, cache_bytes: int, _made: dict = {}) -> PieceCodec:
    path = model_path or default_model()
    if path not in _made:
        _made[path] = PieceCodec(path)
    _made[path].cache_bytes = cache_bytes
    return _made[path]


def encode_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` (their text) of each row of ``docs`` (``doc_id``, ``text``).

    Null and empty texts have no ids and decode to the empty text. A text of
    any length is encoded whole. Equal rows give equal rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path, 48_000_000)  # beside the ids and texts that a batch returns
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = [np.frombuffer(b"".join([e[0] for e in words]), np.int32) for words in codec.entries(texts)]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                text = pa.array([codec.decode(x.tolist()) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat), text], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def query(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Token count and digests of each row; the digests are taken beside the encoding, so no ids move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path, 96_000_000)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                counts, ids, decoded = [], [], []
                for words in codec.entries([t or "" for t in part.column("text").to_pylist()]):
                    counts.append(sum([len(e[0]) for e in words]) // 4)
                    ids.append(sha(",".join([e[1] for e in words]).encode()))
                    raw = b"".join([e[2] for e in words])
                    decoded.append(sha(raw[1:] if raw[:1] == b" " else raw))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
