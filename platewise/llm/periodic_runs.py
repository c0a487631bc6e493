"""Periodic runs of words, found online by catchers over completed power-of-two blocks.

A run is a stretch of words that repeats with a period, several times over, and that no neighbouring word extends. For every level B = 1, 2, 4, ... each completed block of B words
has a catcher. A word that is appended completes one suffix window of B words per level, and the window's name is compared with that of the block whose catcher is
waiting at a distance of B to 2B - 1 words. Equal names at that distance, and once more before the block, report a square; squares are extended to
both sides, word by word, and merge into runs. A run of period q with at least four periods holds such a block for the level with B <= q < 2B, so none is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import col, slices

#: A run has at least so many words and so many periods.
LEAST, TIMES = 6, 4
#: Words appended to the catchers at once.
APPENDED = 1 << 20


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of neighbouring halves made into the name of the whole."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


class Catchers:
    """Catchers over the words appended so far. `longest` bounds the periods that are sought (those of a run must fit four times into one text)."""

    def __init__(self, longest: int | None = None) -> None:
        self.longest = longest
        self.words = np.empty(0, np.int64)
        self.levels: list[tuple[int, int, np.ndarray]] = []  # (next window to compare, first window named, names)
        self.last: dict[int, list[int]] = {}  # of each period the stretch found last
        self.stretches: list[list[int]] = []  # [start, end, period]
        self.active: list[list[int]] = []  # those that hold one of the words appended last

    def append(self, words: np.ndarray) -> None:
        """Go on with more words (numbers; equal words have equal numbers)."""
        old = len(self.words)
        self.words = np.concatenate([self.words, words.astype(np.int64)])
        n = len(self.words)
        self.active = [s for s in self.active if s[1] == old]
        for s in self.active:
            s[1] = self._forward(old, s[2])
        level, names, first = 0, None, 0
        while n >= 1 << level and (self.longest is None or 4 << level <= self.longest):
            block = 1 << level
            if level == len(self.levels):
                self.levels.append((0, 0, np.empty(0, np.uint64)))
            done, start, kept = self.levels[level]
            ends = n - block + 1
            if level:
                lo = start + len(kept) - first
                more = mixed(names[lo: ends - first], names[lo + block // 2: ends - first + block // 2])
            else:
                more = mixed(words.astype(np.uint64), np.uint64(1) + words.astype(np.uint64))
            names, first = np.concatenate([kept, more]), start
            self._compare(block, max(done, 2 * block), ends, names, first)
            cut = max(first, n - 5 * block)
            self.levels[level] = (ends, cut, names[cut - first:].copy())
            level += 1

    def _compare(self, block: int, lo: int, hi: int, names: np.ndarray, first: int) -> None:
        """Let each suffix window lo .. hi - 1 meet its catcher."""
        for a in range(lo, hi, APPENDED):
            at = np.arange(a, min(hi, a + APPENDED))
            caught = (at // block - 1) * block
            hit = np.flatnonzero(names[at - first] == names[caught - first])
            at, caught = at[hit], caught[hit]
            before = 2 * caught - at
            keep = before >= 0
            keep[keep] = names[before[keep] - first] == names[caught[keep] - first]
            at, caught, before = at[keep], caught[keep], before[keep]
            if len(at):
                apart = ~self._inside(before, at + block, block)
                for i, s in zip(at[apart].tolist(), caught[apart].tolist()):
                    self._square(s, i - s, block)

    def _inside(self, lo: np.ndarray, hi: np.ndarray, below: int) -> np.ndarray:
        """Whether lo .. hi - 1 lies in a known run of a period less than `below`: then its square has no smallest period of its own."""
        runs = sorted((a, b) for a, b, p in self.active if p < below and b - a >= TIMES * p)
        if not runs:
            return np.zeros(len(lo), bool)
        starts, ends = np.array(runs).T
        at = np.searchsorted(starts, lo, side="right")
        return (at > 0) & (np.maximum.accumulate(ends)[at - 1] >= hi)

    def _square(self, s: int, p: int, block: int) -> None:
        """Two equal blocks at distance p, and the one before: extend, unless it lies in what is known."""
        lo, hi = s - p, s + p + block
        known = self.last.get(p)
        if known and known[0] <= lo and hi <= known[1]:
            return
        end = self._forward(s, p)
        if end < hi:  # the words between the blocks differ
            return
        stretch = [self._backward(s, p), end, p]
        self.last[p] = stretch
        self.stretches.append(stretch)
        self.active.append(stretch)

    def _forward(self, i: int, p: int) -> int:
        """First place from i on whose word differs from that p words before."""
        w, n, step = self.words, len(self.words), 64
        while i < n:
            far = min(n, i + step)
            differs = w[i:far] != w[i - p:far - p]
            k = int(differs.argmax())
            if differs[k]:
                return i + k
            i, step = far, min(step * 2, APPENDED)
        return n

    def _backward(self, i: int, p: int) -> int:
        """Least start of a stretch of period p that holds the words i .. i + p - 1."""
        w, step = self.words, 64
        while i > 0:
            far = max(0, i - step)
            differs = w[far:i] != w[far + p:i + p]
            if differs.any():
                return i - int(differs[::-1].argmax())
            i, step = far, min(step * 2, APPENDED)
        return 0

    def runs(self, least: int = LEAST) -> np.ndarray:
        """(start, length, period) of every run, by start, then period."""
        found = np.array([(a, b - a, p) for a, b, p in self.stretches if b - a >= max(least, TIMES * p)], np.int64).reshape(-1, 3)
        return found[np.lexsort((found[:, 2], found[:, 0]))]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts in a row, and where each text's begin (with the end of the last). Words are what spaces and the characters 9 to 13 part."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    values, offsets = parts.flatten(), parts.offsets.to_numpy()
    full = pc.greater(pc.binary_length(values), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return values.filter(full), before[offsets - offsets[0]]


def runs_of(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Runs within each of several texts whose word numbers stand in a row: (text of each run, (start, length, period) counted from its text's first word)."""
    sizes = np.diff(bounds)
    # A number of its own after each text, so that no stretch goes on into the next.
    apart = np.insert(ids.astype(np.int64), bounds[1:], -1 - np.arange(len(sizes)))
    catchers = Catchers(int(sizes.max(initial=0)))
    for a in range(0, len(apart), APPENDED):
        catchers.append(apart[a:a + APPENDED])
    found = catchers.runs(least)
    starts = bounds[:-1] + np.arange(len(sizes))
    owner = np.searchsorted(starts, found[:, 0], side="right") - 1
    found[:, 0] -= starts[owner]
    return owner, found


def collapsed(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), order: Callable[[tuple, int], np.ndarray | None] | None = None,
              least: int = LEAST) -> DataFrame:
    """Per row `keep`, `n_words`, `runs` (array of start, length, period, by start, then period) and `collapsed`, the words joined by a space without those that any run repeats (all
    of a run but its first period).

    `order` may give, from the values of `keep` and the number of words, the numbers of the words to read in place of the text as it stands (None: as it is).
    Null counts as an empty text: no words, no runs, an empty `collapsed`. Repeated rows are treated each; other columns are left out; an empty table gives an empty result. A text
    is worked on whole, whatever its length, in time n log n and with some forty bytes of memory a word."""
    names = list(keep)
    if {n.lower() for n in names} & {"n_words", "runs", "collapsed"}:
        raise ValueError("keep has the name of a column that is made here")
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            words, bounds = split_words(part.column(len(names)))
            if order:
                keys = zip(*(part.column(i).to_pylist() for i in range(len(names))))
                index = np.arange(len(words))
                for key, a, b in zip(keys, bounds.tolist(), bounds[1:].tolist()):
                    if (own := order(key, b - a)) is not None:
                        index[a:b] = a + own
                words = words.take(pa.array(index))
            ids = words.dictionary_encode().indices.to_numpy()
            owner, found = runs_of(ids, bounds, least)
            cover = np.zeros(len(ids) + 1, np.int64)
            begin = bounds[owner] + found[:, 0]
            np.add.at(cover, begin + found[:, 2], 1)
            np.add.at(cover, begin + found[:, 1], -1)
            left = np.cumsum(cover[:-1]) == 0
            ends = np.concatenate([[0], np.cumsum(left)])[bounds].astype(np.int32)
            rest = words.filter(pa.array(left)) if len(found) else words
            texts = pc.binary_join(pa.ListArray.from_arrays(ends, rest), " ")
            each = np.searchsorted(owner, np.arange(len(bounds))).astype(np.int32)
            lists = pa.ListArray.from_arrays(each, pa.StructArray.from_arrays([pa.array(c) for c in found.T.copy()], fields=list(kind)))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(np.diff(bounds).astype(np.int64)), lists, texts], [*names, "n_words", "runs", "collapsed"])

    source = docs.select(*[col(c) for c in names], col(text).cast("string").alias("_text"))
    types = dict(source.dtypes)
    made = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return source.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in names), made]))


def longest(runs: Column) -> Column:
    """(length, start, period) of the longest run; of equal ones the first, then that of the smallest period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    return F.when(F.size(runs) > 0, F.struct(best["length"].alias("length"), (-best["back"]).alias("start"), (-best["short"]).alias("period")))


def printed(runs: Column) -> Column:
    """A line `start,length,period` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
