"""Training-order materialisation of token sequences as fixed-stride binary shards.

Documents are encoded, joined by an end id and cut into sequences of equal length. Every sequence has an ordinal; a keyed Feistel network permutes the
ordinals, walking its cycles until it lands below their number, and so gives each sequence one global slot. Shard s holds slots s * shard_rows to
(s + 1) * shard_rows - 1 in order, each as the same number of bytes: a reader finds any slot by arithmetic and resumes by seeking.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import col, slices, staged
from platewise.llm.packing import encoder
from platewise.session import scratch_path

LENGTH = 2048
#: Sequences in a shard: 16 MB of 16-bit ids.
SHARD_ROWS = 4096
END_ID = PAD_ID = 1
ROUNDS = 6


class Permutation:
    """A keyed permutation of 0 .. n-1, vectorised over numpy arrays."""

    def __init__(self, n: int, key: int) -> None:
        self.n, self.key = n, key
        self.half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.low = np.uint64((1 << self.half) - 1)

    def _mix(self, x: np.ndarray, turn: int) -> np.ndarray:
        """splitmix64 finaliser of the half, the key and the round."""
        z = x + np.uint64((self.key * 0x9E3779B97F4A7C15 + (turn + 1) * 0xD1B54A32D192ED03) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))) & self.low

    def _network(self, x: np.ndarray, back: bool) -> np.ndarray:
        a, b = x >> np.uint64(self.half), x & self.low
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            a, b = (b ^ self._mix(a, turn), a) if back else (b, a ^ self._mix(b, turn))
        return (a << np.uint64(self.half)) | b

    def __call__(self, ordinals: np.ndarray, back: bool = False) -> np.ndarray:
        x = self._network(ordinals.astype(np.uint64), back)
        out = np.flatnonzero(x >= np.uint64(self.n))
        while len(out):
            x[out] = self._network(x[out], back)
            out = out[x[out] >= np.uint64(self.n)]
        return x.astype(np.int64)


def sequences(docs: DataFrame, text: str = "text", id_col: str = "doc_id", vocabulary: str | None = None, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """Rows (part, idx, n_tokens, doc_ids, ids): the partition's token stream cut every `length` ids, 16 bits each; only a partition's last sequence
    is shorter. `doc_ids` are the documents that have ids in it, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, tokenizer)
        part, idx, held, owners, filled = TaskContext.get().partitionId(), 0, [], [], 0
        end, rows = np.array([END_ID], "<u2"), []

        def close() -> None:
            nonlocal idx, held, owners, filled
            rows.append((part, idx, filled, owners, b"".join(held)))
            idx, held, owners, filled = idx + 1, [], [], 0

        def batch() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], ["part", "idx", "n_tokens", "doc_ids", "ids"])
            rows.clear()
            return out

        for piece in slices(batches, "_text"):
            for doc, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                ids = encode(t) if t else end[:0]
                if len(ids) and int(ids.max()) > 0xFFFF:
                    raise ValueError("the vocabulary has ids beyond 16 bits")
                ids = np.concatenate([ids.astype("<u2"), end])
                while len(ids):
                    take = min(len(ids), length - filled)
                    held.append(ids[:take].tobytes())
                    owners.append(doc)
                    filled, ids = filled + take, ids[take:]
                    if filled == length:
                        close()
            yield batch()
        if filled:
            close()
            yield batch()

    source = docs.select(col(id_col).cast("bigint"), col(text).cast("string").alias("_text"))
    return source.mapInArrow(run, "part int, idx bigint, n_tokens int, doc_ids array<bigint>, ids binary")


def materialise(docs: DataFrame, folder: str | None = None, key: int = 0, text: str = "text", id_col: str = "doc_id", vocabulary: str | None = None, length: int = LENGTH,
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write the shards and `order.json` to `folder` (default: a new one in the shared folder) and return the manifest, one row per sequence:
    `slot`, `shard`, `byte_offset`, `n_tokens`, `ids_crc32` (of the record without padding), `doc_ids`, `path`.

    A task writes whole shards, each to a name of its attempt first and then renamed, so a task that is run again leaves the same file. Null and
    empty texts are one end id; repeated rows are encoded each; null ids are null entries of `doc_ids`; other columns are left out. An empty table writes
    no shard and gives an empty manifest."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "shards")
    found = staged(sequences(docs, text, id_col, vocabulary, length), "sequences", "zstd")
    # One number per partition reaches the driver.
    counts = sorted((r["part"], r["n"]) for r in found.groupBy("part").agg(F.count("*").alias("n")).collect())
    total, before = 0, {}
    for part, n in counts:
        before[part] = total
        total += n
    shards = -(-total // shard_rows)
    stride = 2 * length
    where, base = arrow_fs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    with where.open_output_stream(f"{base}/order.json") as f:
        f.write(json.dumps({"sequences": total, "length": length, "bytes_per_id": 2, "stride": stride, "shard_rows": shard_rows, "shards": shards, "key": key,
                            "pad_id": PAD_ID}).encode())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permute, start = Permutation(total, key), np.zeros(max(before, default=0) + 1, np.int64)
        start[list(before)] = list(before.values())
        # ids cross the network compressed; shards hold them plain
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            slot = permute(start[b.column("part").to_numpy()] + b.column("idx").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((slot // shard_rows).astype(np.int32)), b.column("n_tokens"), b.column("doc_ids"),
                                              pa.array([pack(v) for v in b.column("ids").to_pylist()], pa.binary())],
                                             ["slot", "shard", "n_tokens", "doc_ids", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, at = arrow_fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor().decompress
        attempt = TaskContext.get().taskAttemptId()
        shard, stream = None, None

        def close() -> None:
            if stream:
                stream.close()
                final = f"{at}/shard-{shard:08d}.bin"
                if target.get_file_info(final).type != arrow_fs.FileType.NotFound:
                    target.delete_file(final)
                target.move(f"{at}/.shard-{shard:08d}.{attempt}", final)

        for b in batches:
            crcs, paths = [], []
            for s, n, ids in zip(*[b.column(n).to_pylist() for n in ("shard", "n_tokens", "ids")]):
                if s != shard:
                    close()
                    shard = s
                    stream = target.open_output_stream(f"{at}/.shard-{s:08d}.{attempt}")
                ids = unpack(ids)
                stream.write(ids)
                if n < length:
                    stream.write(np.full(length - n, PAD_ID, "<u2").tobytes())
                crcs.append(zlib.crc32(ids))
                paths.append(f"shard-{s:08d}.bin")
            slot = b.column("slot").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("slot"), b.column("shard"), pa.array(slot % shard_rows * stride), b.column("n_tokens"), pa.array(crcs, pa.int64()),
                                              b.column("doc_ids"), pa.array(paths, pa.string())],
                                             ["slot", "shard", "byte_offset", "n_tokens", "ids_crc32", "doc_ids", "path"])
        close()

    schema = "slot bigint, shard int, byte_offset bigint, n_tokens int, ids_crc32 bigint, doc_ids array<bigint>, path string"
    placed = found.mapInArrow(place, "slot bigint, shard int, n_tokens int, doc_ids array<bigint>, ids binary")
    placed = placed.repartitionById(max(1, shards), F.col("shard")).sortWithinPartitions("slot")
    return staged(placed.mapInArrow(write, schema), "manifest")


def read_slots(folder: str, first: int = 0) -> Iterator[np.ndarray]:
    """The sequences of a folder of shards in training order from slot `first` on, padded, read sequentially."""
    where, base = arrow_fs.FileSystem.from_uri(folder)
    with where.open_input_stream(f"{base}/order.json") as f:
        order = json.loads(f.read())
    for shard in range(first // order["shard_rows"], order["shards"]):
        with where.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
            f.seek(max(0, first - shard * order["shard_rows"]) * order["stride"])
            while record := f.read(order["stride"]):
                yield np.frombuffer(record, "<u2")
