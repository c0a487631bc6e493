"""Bounded-space online packing of token streams into fixed-length training sequences.

Each partition keeps a fixed number of open windows. What is left of a document after its full windows goes to the open window with the least
room that still holds it; when none does and all windows are open, the fullest is topped up with the start of the arriving piece and emitted. Windows
still open at a partition's end are merged with those of neighbouring partitions, group by group.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from platewise.llm.common import col, slices, staged

LENGTH = 2048
#: Open windows of a partition.
OPEN = 32
#: Partitions whose leftover windows are merged in one task: at most GROUP * OPEN * LENGTH ids.
GROUP = 16
END_ID = 1

PIECES = "doc_tokens bigint, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint"


def byte_bpe(path: str, tokenizer: str | None = None) -> Callable[[str], np.ndarray]:
    """Token ids of a text by the byte-level vocabulary in a rank file. `tokenizer` names the JSON file of the same vocabulary: texts that hold one of its added tokens are
    encoded by it, so that these become their own ids; without it they are ordinary text."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(tokenizer) if tokenizer else None
    added = [t.content for t in whole.get_added_tokens_decoder().values()] if whole else []

    def encode(text: str) -> np.ndarray:
        if any(t in text for t in added):
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return encoding.encode_to_numpy(text, disallowed_special=())

    return encode


def encoder(vocabulary: str | None, tokenizer: str | None) -> Callable[[str], np.ndarray]:
    """`byte_bpe` of the named files; without names of the public 50k byte-level vocabulary."""
    if vocabulary is None and tokenizer is None:
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return byte_bpe(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), tokenizer)


class Packer:
    """Open windows of one partition; `emit(piece, window, offset)` is called for every piece of a window that is closed."""

    def __init__(self, length: int, most: int, emit: Callable) -> None:
        self.length, self.most, self.emit = length, most, emit
        self.open: list[tuple[int, list]] = []  # (filled, pieces)

    def add(self, doc: int, ids: np.ndarray) -> None:
        """Place a document: whole windows at once, the rest best-fit. doc is handed on to `emit` with each piece."""
        n, start = len(ids), 0
        while n - start >= self.length:
            self.emit([(doc, start, ids[start:start + self.length])])
            start += self.length
        while start < n:
            rest = n - start
            fits = [i for i, (filled, _) in enumerate(self.open) if filled + rest <= self.length]
            if fits:
                at = max(fits, key=lambda i: self.open[i][0])
            elif len(self.open) < self.most:
                self.open.append((0, []))
                at = len(self.open) - 1
            else:
                at = max(range(len(self.open)), key=lambda i: self.open[i][0])
            filled, pieces = self.open[at]
            take = min(rest, self.length - filled)
            pieces.append((doc, start, ids[start:start + take]))
            self.open[at] = (filled + take, pieces)
            start += take
            if filled + take == self.length:
                self.emit(self.open.pop(at)[1])


def pack(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, length: int = LENGTH,
         open_windows: int = OPEN, group: int = GROUP, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: `keep`, `doc_tokens` (ids of the document with its end id), `start` and `length` of the piece, its `ids` (unsigned 32-bit,
    little-endian), `sequence_id` and `offset`. Every id lies in exactly one piece; sequences hold at most `length` ids and only those left over
    at the end of a merge group are short, cut so that each is a power of two long and needs no padding.

    Null texts count as empty (one piece holding the end id); repeated rows are packed each; other columns are left out; an empty table gives an
    empty result. `vocabulary` names a rank file and `tokenizer` the JSON file with its added tokens; executors open them at the same paths (default: the public 50k
    byte-level vocabulary)."""
    names = list(keep)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, tokenizer)
        task = TaskContext.get().partitionId()
        rows: list = []
        sequence = [task << 32]
        end = np.array([end_id], np.uint32)

        def emit(pieces: list, left: int | None = None) -> None:
            offset = 0
            for (kept, total), start, ids in pieces:
                rows.append((kept, total, start, len(ids), ids.tobytes(), sequence[0], offset, left))
                offset += len(ids)
            sequence[0] += 1

        packer = Packer(length, open_windows, emit)

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 8
            kept = [pa.array([k[i] for k in cols[0]], t) for i, t in enumerate(types)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
            out = pa.RecordBatch.from_arrays([*kept, *(pa.array(c, k) for c, k in zip(cols[1:], kinds))],
                                             [*names, "doc_tokens", "start", "length", "ids", "sequence_id", "offset", "left_in"])
            rows.clear()
            return out

        types = None
        for part in slices(batches, "_text"):
            types = [part.schema.field(i).type for i in range(len(names))]
            kept = list(zip(*[part.column(i).to_pylist() for i in range(len(names))])) if names else [()] * part.num_rows
            for k, t in zip(kept, part.column("_text").to_pylist()):
                ids = np.concatenate([encode(t), end]).astype("<u4") if t else end
                packer.add((k, len(ids)), ids)
            yield batch()
        for _, pieces in packer.open:
            emit(pieces, task)
        if types:
            yield batch()

    source = docs.select(*[col(c) for c in keep], col(text).cast("string").alias("_text"))
    kept_types = dict(source.dtypes)
    kept = "".join(f"`{c}` {kept_types[c]}, " for c in keep)
    done = staged(source.mapInArrow(first, f"{kept}{PIECES}, left_in int"), "pieces")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group, sequence and offset. A group's pieces are laid end to end and cut every `length` ids."""
        fields = [*names, "doc_tokens", "start", "length", "ids"]
        held, filled, current, sequence = [], 0, None, 0

        def close() -> list:
            """The held pieces as sequences: one, or one for each binary digit of their number of ids."""
            nonlocal held, filled, sequence
            out, offset, left = [], 0, filled
            room = length if filled == length else (1 << filled.bit_length() >> 1)
            for values, start, ids in held:
                while len(ids):
                    take = min(len(ids), room - offset)
                    out.append((*values, start, take, ids[:take].tobytes(), sequence, offset))
                    start, ids, offset = start + take, ids[take:], offset + take
                    if offset == room:
                        left -= room
                        sequence, offset, room = sequence + 1, 0, 1 << left.bit_length() >> 1
            held, filled = [], 0
            return out

        for batch in batches:
            rows, cols = [], [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            at = {n: i for i, n in enumerate(batch.schema.names)}
            for r in zip(*cols):
                if r[at["_group"]] != current:
                    rows += close()
                    current = r[at["_group"]]
                    sequence = (1 << 62) + (current << 32)
                ids, start = np.frombuffer(r[at["ids"]], "<u4"), r[at["start"]]
                while len(ids):
                    take = min(len(ids), length - filled)
                    held.append((r[: len(names) + 1], start, ids[:take]))
                    start, ids, filled = start + take, ids[take:], filled + take
                    if filled == length:
                        rows += close()
            types = [batch.schema.field(n).type for n in fields] + [pa.int64(), pa.int64()]
            cols = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [*fields, "sequence_id", "offset"])
        rows = close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [*fields, "sequence_id", "offset"])

    left = done.filter(F.col("left_in").isNotNull()).withColumn("_group", F.expr(f"left_in div {group}"))
    left = left.select(*[col(c) for c in keep], "doc_tokens", "start", "length", "ids", "_group", "sequence_id", "offset")
    merged = left.repartition(F.col("_group")).sortWithinPartitions("_group", "sequence_id", "offset").mapInArrow(merge, f"{kept}{PIECES}")
    return done.filter(F.col("left_in").isNull()).drop("left_in").unionByName(merged)
