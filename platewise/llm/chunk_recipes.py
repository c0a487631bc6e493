"""Exact duplicates through content-defined chunks.

Texts are cut where a rolling hash of the last 32 bytes meets a mask, so equal passages give equal chunks wherever they stand. The chunks are
written once; each distinct chunk text gets a verified identifier (its hash, and its rank among the texts of that hash should several share it),
and two documents are equal when their ordered lists of identifiers are. After the chunks no text is moved again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import col, slices, staged, with_row_id

#: A cut is expected every so many bytes; chunks have at least a quarter of that and at most eight times it.
CHUNK = 2048


def gear_values() -> np.ndarray:
    """A pseudo-random 32-bit number per byte value."""
    return np.array([xxhash.xxh32_intdigest(bytes([i])) for i in range(256)], np.uint32)


def cut_points(data: bytes, gear: np.ndarray, chunk: int = CHUNK) -> list[int]:
    """Ends of the chunks of `data`, the last one being its length; an empty text is one empty chunk."""
    n = len(data)
    if n <= chunk // 4:
        return [n]
    h = gear[np.frombuffer(data, np.uint8)]
    # h[i] = sum of gear[data[i - j]] << j over the last 32 bytes, by doubling the width.
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    places = (np.flatnonzero((h >> np.uint32(32 - (chunk.bit_length() - 1))) == 0) + 1).tolist()
    ends, last = [], 0
    for p in [*places, n]:
        while p - last > 8 * chunk:
            last += 8 * chunk
            ends.append(last)
        if p - last >= chunk // 4 and p < n:
            ends.append(p)
            last = p
    if last < n:
        ends.append(n)
    return ends


def cut(docs: DataFrame, text: str, row: str, keep: tuple[str, ...], chunk: int = CHUNK, hash_bits: int = 64) -> DataFrame:
    """One row per chunk: the document's number `row`, the chunk's position `pos`, hash `h` and bytes `chunk`. The first row of a document also has
    `recipe` (its chunk hashes in order), the normalised text's `sha` and the columns `keep`, null elsewhere. White space counts as one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, gear, mask = re.compile(rb"[\x20\x09-\x0d]+"), gear_values(), (1 << hash_bits) - 1
        for part in slices(batches, "_text"):
            hs, chunks, recipes, shas, first, at, pos = [], [], [], [], [], [], []
            for i, data in enumerate(part.column("_text").cast(pa.binary()).to_pylist()):
                data = space.sub(b" ", data or b"")
                start, own = 0, []
                for end in cut_points(data, gear, chunk):
                    piece = data[start:end]
                    own.append((xxhash.xxh64_intdigest(piece) & mask) - (1 << 63))
                    chunks.append(piece)
                    start = end
                rest = [None] * (len(own) - 1)
                hs += own
                recipes += [own, *rest]
                shas += [hashlib.sha256(data).hexdigest(), *rest]
                first += [i, *rest]
                at += [i] * len(own)
                pos += range(len(own))
            kept = [part.column(i).take(pa.array(first, pa.int64())) for i in range(len(keep))]
            rows = part.column(len(keep)).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept, rows, pa.array(pos, pa.int32()), pa.array(hs, pa.int64()), pa.array(chunks, pa.binary()), pa.array(recipes, pa.list_(pa.int64())),
                 pa.array(shas, pa.string())], [*keep, "_row", "pos", "h", "chunk", "recipe", "sha"])

    source = docs.select(*[col(c) for c in keep], col(row).alias("_row"), col(text).cast("string").alias("_text"))
    types = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "_row bigint, pos int, h bigint, chunk binary, recipe array<bigint>, sha string"]))


def recipes(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK, hash_bits: int = 64) -> DataFrame:
    """Columns `keep`, `_row`, `sha` and `ids` per row: the document's ordered list of verified chunk identifiers (hash, rank).

    Chunk texts are grouped by their bytes, copies within a task first. A hash shared by several texts is rare; only chunks of such hashes
    are looked up again, by their bytes, to learn the rank of their text."""
    source, row = with_row_id(docs)
    cuts = staged(cut(source, text, row, keep, chunk, hash_bits), "chunks")
    shared = staged(cuts.select("h", "chunk").distinct().groupBy("h").count().filter("count > 1").select("h"), "shared")
    heads = cuts.filter(F.col("recipe").isNotNull()).select(*[col(c) for c in keep], "_row", "sha", "recipe")
    if shared.isEmpty():
        return heads.withColumn("ids", F.transform("recipe", lambda h: F.struct(h.alias("h"), F.lit(1).alias("rank")))).drop("recipe")
    doubtful = cuts.join(shared, "h", "left_semi")
    rank = F.row_number().over(Window.partitionBy("h").orderBy("chunk"))
    texts = doubtful.select("h", "chunk").distinct().withColumn("rank", rank)
    told = doubtful.join(texts, ["h", "chunk"]).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "rank"))).alias("told"))
    ids = F.transform("recipe", lambda h, i: F.struct(h.alias("h"), F.coalesce(F.try_element_at("told", i), F.lit(1)).alias("rank")))
    return heads.join(told, "_row", "left").withColumn("ids", ids).drop("recipe", "told")


def exact_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = (), chunk: int = CHUNK, hash_bits: int = 64) -> DataFrame:
    """Per row of `docs`: `id_col`, `keep`, `keep_id` (id of the row that stays), `group_size`, `kept` and `text_sha256` (of the normalised text).

    Null texts count as empty. Of equal texts the smallest id stays (null ids last, of equal ids the first row scanned), and exactly one row of a
    group is kept. Other columns are left out; an empty table gives an empty result. `keep` must not name the columns made here."""
    rows = recipes(docs, text, (id_col, *keep), chunk, hash_bits)
    order = F.struct(col(id_col).isNull().alias("none"), col(id_col).alias("id"), F.col("_row").alias("row"))
    # Written out, so that both sides of the join are plain exchanges and Spark can split the rows of a large group.
    groups = staged(rows.groupBy("ids").agg(F.min(order).alias("best"), F.count("*").alias("group_size")), "groups")
    return rows.join(groups, "ids").select(
        col(id_col), *[col(c) for c in keep], F.col("best.id").alias("keep_id"), "group_size", (F.col("_row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def deduplicated(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, one of each group of equal texts, with all their columns."""
    marked, row = with_row_id(docs)
    # Written once: another plan may cut the files otherwise and number the rows anew.
    marked = staged(marked, "numbered", "zstd")
    kept = exact_duplicates(marked, text, id_col, (row,)).filter("kept").select(col(row))
    return marked.join(kept, row, "left_semi").drop(row)
