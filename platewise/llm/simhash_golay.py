"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code is perfect: every 23-bit word lies within
three bits of exactly one of 4096 codewords. A segment's keys are the codeword indices of the word itself and of every word one
bit away (one to six different ones), so two segments at distance 0, 1 or 2 share a key: the word between them is a neighbour of both.
Of four differing bits at most two lie in the best two of three segments, so fingerprints within four bits share a pair of keys for some pair
of segments. Candidates with a common pair are verified by their differing bits; nothing within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import col, components, slices, staged, with_row_id

SHINGLE = 4
SEED = 42
RADIUS = 4
#: First bit and width of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the binary Golay code (fixed value): x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0xAE3
#: Fingerprints of one key that are compared in one go; larger buckets are cut into blocks and compared block by block.
BLOCK = 4096
#: Linked fingerprints a task remembers to leave out links it has already implied.
REMEMBERED = 1 << 18


def shingle_hashes(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every word shingle of UTF-8 `data`; bytes methods lower-case and split by ASCII rules only."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    return np.array([h(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as a signed 64-bit number."""
    n = len(hashes)
    if not n:
        return 0
    octets = hashes.view(np.uint8).reshape(n, 8)
    if n < 256:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ bits for k in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Columns `keep` and `fp` (bigint) per row. Null counts as empty; a text without words has fingerprint 0. Other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            fps = [majority(shingle_hashes(t or b"", shingle, seed)) for t in part.column("_text").cast(pa.binary()).to_pylist()]
            arrays = [part.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(fps, pa.int64())], [*keep, "fp"])

    source = docs.select(*[col(c) for c in keep], col(text).cast("string").alias("_text"))
    types = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "fp bigint"]))


def golay_table() -> np.ndarray:
    """Index of the nearest codeword for each of the 2^23 words."""
    index = np.arange(4096, dtype=np.uint32)
    words = np.zeros(4096, np.uint32)
    for i in range(12):
        words ^= np.where(index >> i & 1, np.uint32(GENERATOR << i), np.uint32(0)).astype(np.uint32)
    one = [1 << i for i in range(23)]
    errors = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]),
              *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])]
    table = np.empty(1 << 23, np.uint16)
    for e in errors:
        table[words ^ np.uint32(e)] = index
    return table


def segment_keys(table: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct keys of each word in a matrix of rows, -1 where a row has fewer."""
    near = np.concatenate([words[:, None], words[:, None] ^ (np.uint32(1) << np.arange(width, dtype=np.uint32))[None, :]], axis=1)
    keys = np.sort(table[near].astype(np.int32), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    keys = -np.sort(-keys, axis=1)
    return keys[:, : max(1, int((keys >= 0).sum(axis=1).max(initial=1)))]


def pair_keys(table: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of every combination of keys of two segments."""
    parts = [segment_keys(table, ((fps >> np.uint64(lo)) & np.uint64((1 << w) - 1)).astype(np.uint32), w) for lo, w in SEGMENTS]
    keys, rows = [], []
    for n, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = parts[i][:, :, None], parts[j][:, None, :]
        ok = (a >= 0) & (b >= 0)
        keys.append((np.int64(n << 24) | (a.astype(np.int64) << 12) | b)[ok])
        rows.append(np.nonzero(ok)[0])
    return np.concatenate(keys), np.concatenate(rows)


def forest(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within `radius` bits, directly or in steps, found breadth first: fewer links than fingerprints."""
    left, right, rest = [], [], fps
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            head, front = front[:64], front[64:]
            close = np.bitwise_count(head[:, None] ^ rest[None, :]) <= radius
            hit = close.any(axis=0)
            if hit.any():
                found = rest[hit]
                left.append(head[close[:, hit].argmax(axis=0)])
                right.append(found)
                front, rest = np.concatenate([front, found]), rest[~hit]
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


class Links:
    """Links of a task, without those that earlier ones imply; forgets all when it has grown to its bound."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def top(self, x: int) -> int:
        p = self.parent
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        out = []
        if not len(a):
            return out
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1).view(np.int64), axis=0)
        for x, y in pairs.tolist():
            s, t = self.top(x), self.top(y)
            if s != t:
                self.parent[s] = t
                out.append((x, y))
        if len(self.parent) > REMEMBERED:
            self.parent = {}
        return out


def matcher(block: int | None, radius: int = RADIUS):
    """A pass over rows (key, fp) sorted by key that yields links of each key's bucket (block -1) and, where a bucket has more rows than
    `block`, its rows with their block number as well, so that a second pass compares its blocks with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Links()
        held_key, held, number = None, np.empty(0, np.uint64), 0

        def out(links: list[tuple[int, int]], spilled: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            key = [np.full(len(links), 0, np.int64), *(np.full(len(f), k, np.int64) for k, _, f in spilled)]
            num = [np.full(len(links), -1, np.int64), *(np.full(len(f), n, np.int64) for _, n, f in spilled)]
            ab = np.array(links, np.int64).reshape(-1, 2)
            first = [ab[:, 0], *(f.view(np.int64) for _, _, f in spilled)]
            second = [ab[:, 1], *(np.zeros(len(f), np.int64) for _, _, f in spilled)]
            if links or spilled:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (key, num, first, second)], ["key", "block", "a", "b"])

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            """Work on the held rows of one key: all blocks that are full, and the rest if the key has ended."""
            nonlocal held, number
            while len(held) and (whole or (block and len(held) >= block)):
                now, held = (held[:block], held[block:]) if block else (held, held[:0])
                many = number > 0 or len(held) > 0 or not whole
                yield from out(known.add(*forest(now, radius)), [(held_key, number, now)] if block and many else [])
                number += 1

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            start = int(np.searchsorted(keys, held_key, side="right")) if held_key is not None else 0
            held = np.concatenate([held, fps[:start]])
            if start == len(keys):
                yield from flush(False)
                continue
            if held_key is not None:
                yield from flush(True)
            last = int(np.searchsorted(keys, keys[-1], side="left"))
            k, f = keys[start:last], fps[start:last]
            a, b = [], []
            edges = np.flatnonzero(np.diff(k, prepend=np.int64(-1), append=np.int64(-1)))
            sizes = np.diff(edges)
            small = np.repeat(sizes <= 8, sizes) if len(sizes) else np.empty(0, bool)
            for lag in range(1, min(8, len(k))):
                same = (k[lag:] == k[:-lag]) & small[lag:]
                i = np.flatnonzero(same)
                i = i[np.bitwise_count(f[i] ^ f[i + lag]) <= radius]
                a.append(f[i])
                b.append(f[i + lag])
            for s in np.flatnonzero(sizes > 8).tolist():
                lo, hi = int(edges[s]), int(edges[s + 1])
                if block and hi - lo > block:
                    held_key, held, number = int(k[lo]), f[lo:hi], 0
                    yield from flush(True)
                else:
                    x, y = forest(f[lo:hi], radius)
                    a.append(x)
                    b.append(y)
            if a:
                yield from out(known.add(np.concatenate(a), np.concatenate(b)), [])
            held_key, held, number = int(keys[-1]), fps[last:], 0
            yield from flush(False)
        if held_key is not None:
            yield from flush(True)

    return run


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect all within `radius` bits (4 at most)."""
    if radius > RADIUS:
        raise ValueError("the key scheme finds up to four differing bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = golay_table()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                fps = batch.column(0).slice(at, 2048).to_numpy(zero_copy_only=False).view(np.uint64)
                keys, rows = pair_keys(nearest, fps)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows].view(np.int64))], ["key", "fp"])

    rows = prints.select("fp").mapInArrow(keyed, "key bigint, fp bigint")
    found = staged(rows.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(
        matcher(block, radius), "key bigint, block bigint, a bigint, b bigint"), "links")
    near = found.filter("block < 0").select("a", "b")
    # Buckets of several blocks: every pair of blocks is a tile of its own, two blocks large.
    parts = found.filter("block >= 0").select("key", "block", F.col("a").alias("fp"))
    count = parts.groupBy("key").agg(F.max("block").alias("last"))
    tiles = parts.join(count, "key").select("key", "block", "fp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("other"))
    tiles = tiles.filter("block <> other").select(
        (F.shiftleft("key", 36).bitwiseOR(F.shiftleft(F.least("block", "other"), 18)).bitwiseOR(F.greatest("block", "other"))).alias("key"), "fp")
    across = tiles.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(
        matcher(None, radius), "key bigint, block bigint, a bigint, b bigint").select("a", "b")
    return near.union(across)


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = (), radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Per row of `docs`: `id_col`, `keep`, `fp` (bigint), `class_fp` (a fingerprint that names the class) and `component_id`, the smallest id reachable over
    links of `radius` differing bits.

    Null texts count as empty; texts without words have fingerprint 0 and are linked like any other. Repeated rows give repeated
    rows. Null ids are returned and ignored when the smallest is sought (null if a class has no other). Copies share a fingerprint and are
    compared once. Other columns are left out; an empty table gives an empty result."""
    marked = staged(fingerprints(docs, text, (id_col, *keep), shingle), "fingerprints")
    prints = staged(marked.groupBy("fp").agg(F.min(col(id_col)).alias("_first")), "prints")
    root = components(links(prints, radius)).withColumnRenamed("node", "fp")
    rooted = prints.join(root, "fp", "left").select("fp", "_first", F.coalesce("root", "fp").alias("_root"))
    smallest = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    # Written out, so that the last join has plain exchanges on both sides and Spark can split the rows of a large group of copies.
    classes = staged(rooted.join(smallest, "_root").select("fp", F.col("_root").alias("class_fp"), "component_id"), "classes")
    return marked.join(classes, "fp").select(col(id_col), *[col(c) for c in keep], "fp", "class_fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The row with the smallest id of each class of near duplicates (null ids last, of equal ids the first row scanned), with all its columns."""
    marked, row = with_row_id(docs)
    # Written once: another plan may cut the files otherwise and number the rows anew.
    marked = staged(marked, "numbered", "zstd")
    order = F.struct(col(id_col).isNull().alias("none"), col(id_col).alias("id"), col(row).alias("row"))
    best = near_duplicates(marked, text, id_col, (row,)).groupBy("class_fp").agg(F.min(order).alias("best"))
    return marked.join(best.select(F.col("best.row").alias(row)), row, "left_semi").drop(row)


def hex_of(fp: str = "fp"):
    """A bigint's bits as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
