"""Chat formatting with typed content parts.

Each turn is written as one segment between control strings. A visitor walks the turn's parts in order: text is escaped, images, audio and
documents become placeholders whose references and expanded token counts are recorded. Control strings inside texts are made harmless by a
backslash after their first character; those that already have some get one more, so the step can be undone exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import col, slices

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What counts as a control string in a text (fixed values): <|name|>, <s>, </s>, <<SYS>>, <</SYS>>, [INST], [/INST].
REST = r"(?=\|\w+\|>|/?s>|</?SYS>>|/?INST\])"
#: Tokens of an attachment: image patches of 28 x 28 pixels, audio frames of 80 ms, text of a page.
PATCH, FRAME_SECONDS, PAGE_TOKENS = 28, 0.08, 512
#: Tokens where the size is not given.
DEFAULT_TOKENS = {"image": 256, "audio": 375, "document": PAGE_TOKENS}
ATTACHMENTS = "array<struct<kind:string,ref:string,position:int,tokens:bigint>>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: str) -> str:
    return re.sub(r"([<\[])(\\*)" + REST, r"\1\2\\", text)


def unescape(text: str) -> str:
    return re.sub(r"([<\[])\\(\\*)" + REST, r"\1\2", text)


class Flatten:
    """Visitor of one turn's parts: `out` is the escaped text with placeholders, `found` the attachments in order."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.size = 0
        self.found: list[dict] = []

    def visit(self, part: dict) -> None:
        """Parts of an unknown or missing kind are taken for their text."""
        getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self._put(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        w, h = part.get("width"), part.get("height")
        self._attach("image", part, -(-w // PATCH) * -(-h // PATCH) if w and h else None)

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds")
        self._attach("audio", part, int(-(-seconds // FRAME_SECONDS)) if seconds else None)

    def visit_document(self, part: dict) -> None:
        pages = part.get("pages")
        self._attach("document", part, pages * PAGE_TOKENS if pages else None)

    def _attach(self, kind: str, part: dict, tokens: int | None) -> None:
        self.found.append({"kind": kind, "ref": part.get("ref"), "position": self.size, "tokens": DEFAULT_TOKENS[kind] if tokens is None else tokens})
        self._put(f"<|{kind}|>")

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: `conv`, `turn`, `formatted` (the segment), `loss_start` and `loss_length` (code points of the segment under the loss mask: the
    flattened content of roles in `learn`, else length 0), `attachments` (kind, reference, position in the flattened content, expanded tokens)
    and `expanded_tokens`. `content` is a string or an array of parts (see PART; missing fields count as null).

    A null role, content or part counts as empty. Repeated and tied turns are formatted each. Other columns are left out; an empty table gives an empty
    result. Concatenated by turn, the segments are the conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches if typed else slices(batches, "_content"):
            formatted, starts, lengths, found = [], [], [], []
            for r, c in zip(part.column("_role").to_pylist(), part.column("_content").to_pylist()):
                visitor = Flatten()
                for p in (c or []) if typed else [{"type": "text", "text": c}]:
                    visitor.visit(p or {})
                head = f"{TURN}{escape(r or '')}{TEXT}"
                formatted.append(f"{head}{''.join(visitor.out)}{END}\n")
                starts.append(len(head))
                lengths.append(visitor.size if r in learn else 0)
                found.append(visitor.found)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("position", pa.int32()), ("tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(formatted, pa.string()), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()), pa.array(found, kind),
                 pa.array([sum(a["tokens"] for a in f) for f in found], pa.int64())],
                [conv, turn, "formatted", "loss_start", "loss_length", "attachments", "expanded_tokens"])

    source = turns.select(col(conv), col(turn), col(role).cast("string").alias("_role"), col(content).alias("_content"))
    types = dict(source.dtypes)
    typed = types["_content"].startswith("array")
    return source.mapInArrow(run, f"`{conv}` {types[conv]}, `{turn}` {types[turn]}, formatted string, loss_start int, loss_length int, attachments {ATTACHMENTS}, expanded_tokens bigint")


def parse(segment: str) -> tuple[str, str]:
    """(role, content) of a formatted turn; placeholders stay as they are."""
    role, content = segment[len(TURN):-len(END) - 1].split(TEXT, 1)
    return unescape(role), unescape(content)


def read_back(formatted: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Digests of whole conversations, read from formatted turns: `n_turns`, `turns_sha256` (role, line feed, content, line feed per turn),
    `loss_chars` and `loss_sha256` (unescaped text under the loss mask) and `formatted_chars`.

    Turns are taken in order of `turn` (nulls first), ties in order of their segment. A conversation is read as a stream: a task holds one
    batch of turns and three running values, however long it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, done, state = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], None, [], None

        def close() -> None:
            done.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*done)) if done else [()] * 6
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for part in batches:
            kind = part.schema.field(0).type
            for c, s, start, length in zip(*[part.column(i).to_pylist() for i in range(4)]):
                if now != (c,):
                    if now:
                        close()
                    now, state = (c,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, content = parse(s)
                learnt = unescape(s[start:start + length])
                state[0] += 1
                state[1].update(f"{role}\n{content}\n".encode())
                state[2] += len(learnt)
                state[3].update(learnt.encode())
                state[4] += len(s)
            yield batch()
        if now:
            close()
            yield batch()

    kind = dict(formatted.dtypes)[conv]
    rows = formatted.select(col(conv), "formatted", "loss_start", "loss_length", col(turn).alias("_turn"))
    rows = rows.repartition(col(conv)).sortWithinPartitions(col(conv), "_turn", "formatted").drop("_turn")
    return rows.mapInArrow(run, f"`{conv}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
