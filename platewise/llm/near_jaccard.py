"""Near duplicates by the Jaccard similarity of their sets of word shingles.

Texts with equal sets are taken as one. Each set has 64 least values under as many permutations; sets that agree in all four values of one of 16 bands are
candidates, and a candidate counts only if its whole sets reach the similarity exactly. At similarity 0.8 a pair shares a band with probability
1 - (1 - 0.8^4)^16 = 0.9998, above it more often.

Before that, fingerprints of the sets are linked through Golay codewords (`simhash_golay`) and links whose whole sets reach the similarity hold; the bands then find what differs in
more bits than those links cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm import simhash_golay
from platewise.llm.common import col, components, discard, slices, staged, with_row_id
from platewise.llm.simhash_golay import SEED, majority, shingle_hashes

SHINGLE = 5
#: Similarity that makes two texts near duplicates, as a fraction of whole numbers.
LIKE, OF = 4, 5
BANDS, ROWS = 16, 4
#: Of 64 least values so many must agree before the sets are compared (0.8 gives 51 with a deviation of 3.2).
AGREE = 38
#: Buckets of more sets, or of sets of more bytes, are cut into blocks and compared block by block.
BLOCK, TILE_BYTES = 4096, 24 << 20
#: Up to so many sets of a bucket are all compared with each other at once.
FEW = 8


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of the permutations of 32-bit numbers."""
    of = lambda name: np.array([xxhash.xxh32_intdigest(f"{name} {k}") for k in range(BANDS * ROWS)], np.uint32)
    return of("factor") | np.uint32(1), of("summand")


def least_values(hashes: np.ndarray, factors: np.ndarray, summands: np.ndarray) -> np.ndarray:
    """Least value of a set under each permutation; all ones for an empty set."""
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    words = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(words), 8192):
        out = np.minimum(out, (factors[:, None] * words[None, at: at + 8192] + summands[:, None]).min(axis=1))
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key of the values of each band, for a matrix of rows."""
    parts = least.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        keys = (keys ^ parts[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def shingle_set(data: bytes | None) -> np.ndarray:
    return np.unique(shingle_hashes(data or b"", SHINGLE, SEED))


def marks(docs: DataFrame, text: str, id_col: str, row: str) -> DataFrame:
    """Per row: `id`, `row`, a 128-bit `digest` of its set, the set's size `n`, one byte of each least value `brief`, the keys of its bands, and its fingerprint `fp`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, summands = permutations()
        for part in slices(batches, "_text"):
            digests, sizes, least, prints = [], [], [], []
            for t in part.column("_text").cast(pa.binary()).to_pylist():
                own = shingle_set(t)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                least.append(least_values(own, factors, summands))
                prints.append(majority(own))
            least = np.array(least, np.uint32).reshape(-1, BANDS * ROWS)
            brief = [b.tobytes() for b in (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)]
            keys = pa.ListArray.from_arrays(np.arange(len(least) + 1, dtype=np.int32) * BANDS, pa.array(band_keys(least).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(brief, pa.binary()),
                                              keys, pa.array(prints, pa.int64())], ["id", "row", "digest", "n", "brief", "keys", "fp"])

    source = docs.select(col(id_col).alias("id"), col(row).alias("row"), col(text).cast("string").alias("_text"))
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, row bigint, digest binary, n bigint, brief binary, keys array<bigint>, fp bigint")


def sets_of(docs: DataFrame, text: str, row: str) -> DataFrame:
    """(node, shingles) per row: its number and its sorted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            found = [shingle_set(t).view(np.int64) for t in part.column("_text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select(col(row).alias("node"), col(text).cast("string").alias("_text")).mapInArrow(run, "node bigint, shingles array<bigint>")


def hopeful(brief: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs of rows may reach the similarity, by size and least values."""
    ok = OF * np.minimum(n[i], n[j]) >= LIKE * np.maximum(n[i], n[j])
    return ok & ((brief[i] == brief[j]).sum(axis=-1) >= AGREE)


def spanning(brief: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that connect what hopeful pairs connect, breadth first: fewer than rows."""
    rest = np.arange(len(n))
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            head, front = front[:16], front[16:]
            close = hopeful(brief, n, head[:, None], rest[None, :])
            hit = close.any(axis=0)
            if hit.any():
                yield head[close[:, hit].argmax(axis=0)], rest[hit]
                front, rest = np.concatenate([front, rest[hit]]), rest[~hit]


def rivals(brief: np.ndarray, n: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which rows form a hopeful pair with a row of another root. The most frequent root's rows are only met by the others."""
    names, inverse, counts = np.unique(root, return_inverse=True, return_counts=True)
    others, found = np.flatnonzero(inverse != counts.argmax()), np.zeros(len(n), bool)
    every = np.arange(len(n))
    for at in range(0, len(others) if len(names) > 1 else 0, 16):
        head = others[at: at + 16]
        close = (root[head][:, None] != root[None, :]) & hopeful(brief, n, head[:, None], every[None, :])
        found |= close.any(axis=0)
        found[head] |= close.any(axis=1)
    return found


def forest(shingles: np.ndarray, ends: np.ndarray, n: np.ndarray, brief: np.ndarray, root: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of rows whose whole sets reach the similarity, as many as connect all roots that such pairs connect. Row i has the sorted set shingles[ends[i]: ends[i + 1]]."""
    codes = np.unique(shingles, return_inverse=True)[1]
    root, own = np.unique(root, return_inverse=True)[1], np.zeros(int(codes.max(initial=-1)) + 1, bool)
    for i in range(len(n) - 1):
        rest = np.flatnonzero(root[i + 1:] != root[i]) + i + 1
        rest = rest[hopeful(brief, n, np.int64(i), rest)]
        if not len(rest):
            continue
        mine = codes[ends[i]: ends[i + 1]]
        own[mine] = True
        for at in range(0, len(rest), 1024):
            some = rest[at: at + 1024]
            some = some[root[some] != root[i]]
            if len(some):
                inside = own[np.concatenate([codes[ends[j]: ends[j + 1]] for j in some.tolist()])]
                shared = np.add.reduceat(inside, np.cumsum(n[some]) - n[some], dtype=np.int64)
                some = some[(LIKE + OF) * shared >= LIKE * (n[i] + n[some])]
                for j in some.tolist():
                    if root[j] != root[i]:
                        yield i, j
                        root[root == root[j]] = root[i]
        own[mine] = False


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column as tables that hold all rows of the tiles in them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column(0).to_numpy()
        cut = int(np.searchsorted(tile, tile[-1], side="left"))
        if held and (cut or held[-1].column(0)[-1].as_py() != tile[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]) if cut else pa.Table.from_batches(held)
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def tiles_of(table: pa.Table) -> list[tuple[int, int]]:
    tile = table.column(0).to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
    return list(zip(edges, edges[1:]))


def proposals(rows: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of rows (tile, node, n, brief): all hopeful ones of small tiles, in large ones those that connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tiles(batches):
            table = table.combine_chunks()
            tile, node, n = (table.column(k).to_numpy() for k in range(3))
            brief, spans, found = matrix(table.column(3)), tiles_of(table), []
            sizes = np.array([b - a for a, b in spans])
            small = np.repeat(sizes <= FEW, sizes)
            for lag in range(1, min(FEW, len(tile))):
                i = np.flatnonzero((tile[lag:] == tile[:-lag]) & small[lag:])
                i = i[hopeful(brief, n, i, i + lag)]
                found.append((i, i + lag))
            for a, b in (x for x in spans if x[1] - x[0] > FEW):
                found += [(i + a, j + a) for i, j in spanning(brief[a:b], n[a:b])]
            i, j = (np.concatenate([np.empty(0, np.int64), *(p[k] for p in found)]).astype(np.int64) for k in (0, 1))
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    return by_tile(rows.select("tile", "node", "n", "brief")).mapInArrow(run, "a bigint, b bigint").distinct()


def by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("tile")).sortWithinPartitions("tile", "node")


def undecided(rows: DataFrame) -> DataFrame:
    """Those of rows (tile, node, n, brief, root) that meet a hopeful row of another root in their tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tiles(batches):
            table = table.combine_chunks()
            n, root = (table.column(k).to_numpy() for k in (2, 4))
            brief, keep = matrix(table.column(3)), np.zeros(len(n), bool)
            for a, b in tiles_of(table):
                keep[a:b] = rivals(brief[a:b], n[a:b], root[a:b])
            yield from table.filter(pa.array(keep)).to_batches()

    rows = rows.select("tile", "node", "n", "brief", "root")
    return by_tile(rows).mapInArrow(run, "tile bigint, node bigint, n bigint, brief binary, root bigint")


def decided(rows: DataFrame) -> DataFrame:
    """Links (a, b) of rows (tile, node, n, brief, root, shingles): in each tile as many as connect all roots that pairs of sets of that similarity connect. Sets are compared where they
    are, so what leaves a task is fewer than its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tiles(batches):
            for a, b in tiles_of(table):
                part = table.slice(a, b - a).combine_chunks()
                node, n, root = (part.column(k).to_numpy() for k in (1, 2, 4))
                sets = part.column(5).combine_chunks()
                sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
                ends = np.concatenate([[0], np.cumsum(n)])
                pairs = list(forest(sets.flatten().to_numpy(), ends, n, matrix(part.column(3)), root))
                i, j = np.array(pairs, np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

    return by_tile(rows.select("tile", "node", "n", "brief", "root", "shingles")).mapInArrow(run, "a bigint, b bigint").distinct()


def sets_for(nodes: DataFrame, docs: DataFrame, text: str, row: str) -> DataFrame:
    """The staged sets of some rows, by `node`."""
    return staged(sets_of(docs.join(nodes.select(F.col("node").alias(row)).distinct(), row, "left_semi"), text, row), "sets")


def verified(pairs: DataFrame, docs: DataFrame, text: str, row: str) -> DataFrame:
    """The pairs whose whole sets reach the similarity, staged."""
    sets = sets_for(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs, text, row)
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b")), "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    out = staged(both.filter((LIKE + OF) * shared >= LIKE * (F.size("_a") + F.size("_b"))).select("a", "b"), "links")
    discard(sets)
    return out


def fingerprint_links(heads: DataFrame, docs: DataFrame, text: str, row: str) -> DataFrame:
    """Pairs (a, b) of `heads` (node, n, fp) that reach the similarity, of those that connect all fingerprints within four bits: the operator of `simhash_golay` on five-word sets."""
    prints = staged(heads.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    near = simhash_golay.links(prints.select("fp"))
    of = lambda side: prints.select(F.col("fp").alias(side), F.col("first").alias(f"_{side}"))
    apart = near.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    alike = heads.select("node", "fp").join(prints, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    size = lambda side: heads.select(F.col("node").alias(side), F.col("n").alias(f"_{side}"))
    pairs = apart.union(alike).join(size("a"), "a").join(size("b"), "b").filter(OF * F.least("_a", "_b") >= LIKE * F.greatest("_a", "_b"))
    pairs = staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    out = verified(pairs, docs, text, row)
    discard(prints, pairs)
    return out


def links(heads: DataFrame, docs: DataFrame, text: str, row: str, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of `heads` (node, n, brief, keys, fp) that reach the similarity and connect all pairs that share a band and do so. Fingerprints give the first ones.

    A first pass over the buckets proposes pairs that connect all hopeful ones, fewer than rows in large buckets, and verifies them. Where hopeful pairs of large buckets are still
    apart, their rows fetch their whole sets into the bucket's tiles and are compared there."""
    known = fingerprint_links(heads, docs, text, row)
    keys = heads.select("node", "n", F.explode("keys").alias("key"))
    sizes = staged(keys.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("total")).filter("c > 1"), "sizes")
    # Written out, so that the join has plain exchanges on both sides.
    buckets = staged(keys.select("node", "key").join(sizes, "key"), "buckets")
    blocks = F.greatest(F.ceil(F.col("c") / block), F.ceil(8 * F.col("total") / TILE_BYTES)).cast("bigint")
    own = F.pmod(F.xxhash64("node"), F.col("_blocks"))
    tiles = buckets.withColumn("_blocks", blocks).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
    tile = F.when(F.col("_blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")))
    rows = staged(tiles.select("node", tile.alias("tile"), "c").join(heads.select("node", "n", "brief"), "node"), "tiles")
    discard(sizes, buckets)
    first = staged(proposals(rows), "candidates")
    good = known.union(verified(first, docs, text, row))
    discard(first)
    large = rows.filter(F.col("c") > FEW)
    if large.isEmpty():
        discard(rows)
        return good
    large = large.join(components(good), "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_rows = staged(undecided(large), "undecided")
    discard(rows)
    if open_rows.isEmpty():
        return good
    sets = sets_for(open_rows, docs, text, row)
    more = staged(decided(open_rows.join(sets, "node")), "links")
    discard(sets, open_rows)
    return good.union(more)


def one_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """The row with the smallest id of each class of texts linked by similarity, directly or in steps (null ids last, of equal ids the first row numbered), with all its
    columns. Null counts as empty; texts without words are alike; texts of fewer words than a shingle are one shingle."""
    numbered, row = with_row_id(docs)
    # Written once: the numbers are made in one plan and read from then on.
    numbered = staged(numbered, "numbered", "zstd")
    marked = staged(marks(numbered, text, id_col, row), "marks")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    alike = marked.groupBy("digest").agg(F.min(order).alias("best"), F.first("n").alias("n"), F.first("brief").alias("brief"), F.first("keys").alias("keys"),
                                         F.first("fp").alias("fp"))
    heads = staged(alike.select(F.col("best.row").alias("node"), "best", "n", "brief", "keys", "fp"), "heads")
    discard(marked)
    root = components(links(heads, numbered, text, row, block))
    rooted = heads.select("node", "best").join(root, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    return numbered.join(rooted.select(F.col("best.row").alias(row)), row, "left_semi").drop(row)
