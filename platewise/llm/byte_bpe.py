"""Byte-level BPE encoding and decoding in numpy.

The distinct pieces of a batch are put into length buckets and encoded as padded matrices of token ids. Each round every row merges its leftmost pair
of least rank; ranks of pairs come from an open-addressing hash table in two arrays, rows without a mergeable pair leave the matrix, and as
all others have lost one id the matrix narrows by a column. Pieces longer than the widest bucket are merged with a heap, to the same result.
"""

from __future__ import annotations

import base64
import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from platewise.llm.common import col, slices

NONE = np.iinfo(np.int32).max
#: Upper lengths (bytes) of the buckets.
BUCKETS = (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 128, 256)
#: Cells of one matrix, and pieces remembered by a task.
CELLS, REMEMBERED = 1 << 18, 400_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Tokens and merge ranks of a rank file (base64 token and rank per line)."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        single = [self.ranks.get(bytes([b])) for b in range(256)]
        if None in single:
            raise ValueError("the vocabulary lacks single bytes")
        self.byte_ids = np.array(single, np.int32)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            tokens[r] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        get = self.ranks.get
        pairs = [(a << 32 | b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None]
        self.pairs: dict[int, int] | None = None
        self._build(np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int32))

    def _build(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        self.bits = max(4, int(8 * len(keys) + 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], ranks[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, ranks, slot = keys[rest], ranks[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where the two don't merge or one is padding (-1)."""
        keys = (left.astype(np.int64) << 32 | right).ravel()
        out = np.full(len(keys), NONE, np.int32)
        at = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys = keys[at]
        slot = self._slot(keys)
        while len(at):
            there = self.keys[slot]
            hit = there == keys
            out[at[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)

    def merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; one padded matrix for all."""
        out: list = [None] * len(pieces)
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(pieces))
        while len(rows):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), NONE, np.int32)
            done = least == NONE
            if done.any():
                for r, row in zip(rows[done].tolist(), ids[done]):
                    out[r] = row[row >= 0]
                on = ~done
                rows, ids, ranks, best, least = rows[on], ids[on], ranks[on], best[on], least[on]
                if not len(rows):
                    break
            n, width = ids.shape
            ids[np.arange(n), best] = least
            ids = ids[np.arange(width) != best[:, None] + 1].reshape(n, width - 1)
            ranks = ranks[np.arange(width - 1) != best[:, None]].reshape(n, width - 2)
            for shift in (-1, 0):
                row = np.flatnonzero((best + shift >= 0) & (best + shift < width - 2))
                at = best[row] + shift
                ranks[row, at] = self.pair_ranks(ids[row, at], ids[row, at + 1])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece: the same merges, the next one taken from a heap."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self.pair_ranks(ids[:-1], ids[1:]).tolist() + [NONE]
        ids = ids.tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        if self.pairs is None:
            self.pairs = dict(zip(self.keys.tolist(), self.values.tolist()))
        pairs = self.pairs

        def rank(i: int) -> None:
            j = after[i]
            ranks[i] = NONE if j >= len(ids) else pairs.get(ids[i] << 32 | ids[j], NONE)
            if ranks[i] != NONE:
                heapq.heappush(heap, (ranks[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if ranks[i] != r:
                continue
            j = after[i]
            ids[i], ids[j], ranks[j] = r, -1, NONE
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            rank(i)
            if before[i] >= 0:
                rank(before[i])
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        waiting: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(p) > BUCKETS[-1]:
                out[i] = self.merge_long(p)
            else:
                waiting.setdefault(bisect.bisect_left(BUCKETS, len(p)), []).append(i)
        for bucket, places in waiting.items():
            rows = CELLS // BUCKETS[bucket]
            for k in range(0, len(places), rows):
                now = places[k:k + rows]
                for i, ids in zip(now, self.merge_matrix([pieces[i] for i in now])):
                    out[i] = ids
        return out


class Encoder:
    """Ids of texts; remembers the ids of pieces it has met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.counts, self.starts, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids before each text and in all)."""
        if len(self.index) > REMEMBERED:
            self.forget()
        pieces = [self.split(t) for t in texts]
        new = list(set().union(*pieces).difference(self.index)) if pieces else []
        if new:
            found = self.vocabulary.encode_pieces([p.encode("utf-8") for p in new])
            counts = np.array([len(f) for f in found], np.int64)
            base = len(self.index)
            self.index.update(zip(new, range(base, base + len(new))))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.flat = np.concatenate([self.flat, *found])
        get = self.index.__getitem__
        at = np.array([i for ps in pieces for i in map(get, ps)], np.int64)
        counts = self.counts[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[at] - (ends - counts), counts) + np.arange(total)]
        last = np.cumsum([len(ps) for ps in pieces], dtype=np.int64)
        offsets = np.concatenate([[0], np.concatenate([[0], ends])[last]])
        return ids, offsets


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Columns `keep` and `ids` (array<int>) per row, as the tiktoken library's encode_ordinary gives them. Null counts as empty (no ids); repeated
    rows are encoded each; other columns are left out. `vocabulary` is a rank file that executors can open, `pattern` cuts texts into pieces."""
    path, pattern = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for part in slices(batches, "_text", 1 << 20):
            encoder = encoder or Encoder(Vocabulary(path), pattern)
            ids, offsets = encoder.encode([t or "" for t in part.column("_text").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), lists], [*keep, "ids"])

    source = docs.select(*[col(c) for c in keep], col(text).cast("string").alias("_text"))
    types = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "ids array<int>"]))


def decode(encoded: DataFrame, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """`encoded` with its `ids` decoded to bytes in the column `decoded` (which replaces one of that name). Null ids give null; an id that the vocabulary
    lacks is an error."""
    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    source = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = None
        for part in slices(batches, ids, 1 << 20):
            v = v or Vocabulary(path)
            lists = part.column(ids)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(v.lengths)):
                raise ValueError("an id outside the vocabulary")
            counts = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            sizes = v.lengths[flat]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            data = v.flat[np.repeat(v.starts[flat] - (ends - sizes), sizes) + np.arange(total)].tobytes()
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
            valid = lists.is_valid().to_pylist()
            texts = [data[a:b] if ok else None for a, b, ok in zip(bounds, bounds[1:], valid)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "decoded"])

    types = ", ".join(f"`{n}` {t}" for n, t in source.dtypes)
    return source.mapInArrow(run, f"{types}, decoded binary")
