"""Gradient-boosted trees of many outputs at once, grown level by level from histograms.

Features are cut into bins once, by quantiles. For every level of a round's trees one job makes, per output, the gradient sums of all (node, feature, bin): each
partition of the binned rows sums its own, sums of one output meet in a task, and that task picks the splits, so only splits come to the driver. No task
holds all rows, and no row of another output's model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions.dense import matrix
from platewise.session import cut_lineage

BINS = 64
#: Rows of a partition of the binned training rows.
PART_ROWS = 16384
#: Rounds after which the predictions so far are written, so that tasks need not walk older trees again.
KEPT_ROUNDS = 10


@dataclass
class Trees:
    """One round: a full binary tree for each output in level order. A row goes right if its bin of the node's feature is above `bin`."""

    feature: np.ndarray  # outputs x inner nodes
    bin: np.ndarray
    leaf: np.ndarray | None = None  # outputs x leaves, already scaled by the rate

    def nodes(self, b: np.ndarray, k: int, levels: int) -> np.ndarray:
        """Of each row of bins the node of output k that it reaches after so many levels, counted within the level."""
        at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for level in range(levels):
            node = at + (1 << level) - 1
            at = 2 * at + (b[rows, self.feature[k, node]] > self.bin[k, node])
        return at

    def add(self, b: np.ndarray, out: np.ndarray) -> None:
        depth = self.leaf.shape[1].bit_length() - 1
        for k in range(len(self.leaf)):
            out[:, k] += self.leaf[k, self.nodes(b, k, depth)]


@dataclass
class Boosted:
    cuts: list[np.ndarray]
    base: np.ndarray
    rounds: list[Trees] = field(default_factory=list)


def cut_points(df: DataFrame, x: str, bins: int = BINS) -> list[np.ndarray]:
    """Of each feature at most bins - 1 values; a row's bin is the number of them below its value. Exact quantiles up to ten thousand rows, approximate ones beyond."""
    long = df.select(F.posexplode(F.col(x).cast("array<double>")).alias("k", "v"))
    probs = [i / bins for i in range(1, bins)]
    found = long.groupBy("k").agg(F.percentile_approx("v", probs, 10_000).alias("q"), F.max("v").alias("top")).orderBy("k").collect()
    return [(q := np.unique(r["q"]))[q < r["top"]] for r in found]


def bin_rows(a: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, a.T)], axis=1).astype(np.uint8) if len(a) else np.zeros((0, len(cuts)), np.uint8)


def binned(df: DataFrame, x: str, y: str, cuts: list[np.ndarray], base: np.ndarray) -> DataFrame:
    """Rows (b, y, p): bins as bytes, outputs and predictions as 64-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b, t = bin_rows(matrix(batch.column(0)), cuts), matrix(batch.column(1))
                yield pa.record_batch({"b": [r.tobytes() for r in b], "y": [r.tobytes() for r in t], "p": [base.tobytes()] * len(b)}, schema=ROWS)

    dbl = lambda c: F.col(c).cast("array<double>")
    return df.select(dbl(x), dbl(y)).mapInArrow(run, "b binary, y binary, p binary")


ROWS = pa.schema([("b", pa.binary()), ("y", pa.binary()), ("p", pa.binary())])


def unpacked(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    of = lambda k, kind: np.frombuffer(b"".join(batch.column(k).to_pylist()), kind).reshape(batch.num_rows, -1)
    return of(0, np.uint8).reshape(-1, width), of(1, np.float64), of(2, np.float64).copy()


def advanced(rows: DataFrame, rounds: Sequence[Trees], width: int) -> DataFrame:
    """The rows with the predictions of some more rounds added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b, _, p = unpacked(batch, width)
                for trees in rounds:
                    trees.add(b, p)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in p], pa.binary())], schema=ROWS)

    return rows.mapInArrow(run, "b binary, y binary, p binary")


def sums(b: np.ndarray, g: np.ndarray, node: np.ndarray, many: int, bins: int) -> np.ndarray:
    """(2, nodes, features, bins): sums of the gradient and numbers of rows."""
    width = b.shape[1]
    at = ((node[:, None] * width + np.arange(width)) * bins + b).ravel()
    size = many * width * bins
    return np.stack([np.bincount(at, np.repeat(g, width), size), np.bincount(at, minlength=size)]).reshape(2, many, width, bins)


def best_splits(h: np.ndarray, penalty: float, least: float) -> tuple[np.ndarray, ...]:
    """Per node the feature and bin of the split of largest gain, and the leaf values left and right of it. Without a gain all rows go left and both values are the node's."""
    g, n = h.cumsum(axis=3)
    all_g, all_n = g[:, :1, -1:], n[:, :1, -1:]
    worth = g**2 / (n + penalty) + (all_g - g) ** 2 / (all_n - n + penalty) - all_g**2 / (all_n + penalty)
    worth = np.where((n >= least) & (all_n - n >= least), worth, -np.inf).reshape(len(g), -1)
    best = worth.argmax(axis=1)
    bins = h.shape[3]
    f, k, rows = best // bins, best % bins, np.arange(len(g))
    ok = worth[rows, best] > 1e-12 * np.maximum(1, all_g[:, 0, 0] ** 2)
    f, k = np.where(ok, f, 0), np.where(ok, k, 255)
    left_g, left_n = (np.where(ok, v[rows, f, np.minimum(k, bins - 1)], v[:, 0, -1]) for v in (g, n))
    whole = -all_g[:, 0, 0] / (all_n[:, 0, 0] + penalty)
    left = -left_g / (left_n + penalty)
    right = np.where(ok, -(all_g[:, 0, 0] - left_g) / (all_n[:, 0, 0] - left_n + penalty), whole)
    return f, k, left, right


def level_splits(rows: DataFrame, since: Sequence[Trees], now: Trees, level: int, width: int, bins: int, penalty: float, least: float, parts: int) -> list:
    """The splits of all outputs' nodes of one level: rows (output, features, bins, left, right)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpacked(batch, width) for batch in batches if batch.num_rows]
        if not held:
            return
        b, y, p = (np.concatenate(c) for c in zip(*held))
        for trees in since:
            trees.add(b, p)
        for k in range(y.shape[1]):
            h = sums(b, p[:, k] - y[:, k], now.nodes(b, k, level), 1 << level, bins)
            yield pa.record_batch({"k": pa.array([k], pa.int32()), "h": pa.array([h.tobytes()], pa.binary())})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = None, None

        def picked() -> pa.RecordBatch:
            f, k, left, right = best_splits(total, penalty, least)
            return pa.record_batch({"k": pa.array([own], pa.int32()), "f": [f.tolist()], "b": [k.tolist()], "left": [left.tolist()], "right": [right.tolist()]})

        for batch in batches:
            for k, h in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = np.frombuffer(h.as_buffer(), np.float64).reshape(2, 1 << level, width, bins)
                if k != own:
                    if own is not None:
                        yield picked()
                    own, total = k, h.copy()
                else:
                    total += h
        if own is not None:
            yield picked()

    each = rows.mapInArrow(partial, "k int, h binary")
    if parts > 1:  # a single partition has all sums of an output already, in order
        each = each.repartition("k").sortWithinPartitions("k")
    return each.mapInArrow(joined, "k int, f array<bigint>, b array<bigint>, left array<double>, right array<double>").collect()


def fit(train: DataFrame, x: str, y: str, rounds: int = 50, eta: float = 0.1, depth: int = 6, bins: int = BINS, penalty: float = 1.0, least: float = 1.0) -> Boosted:
    """Squared-error boosting of every output of `y`, from the mean on. The model, outputs x rounds x 2^depth numbers, is the driver's; rows are not. An empty table has no model."""
    if not 2 <= bins <= 256:
        raise ValueError("2 to 256 bins")
    source = cut_lineage(train.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")))
    n = source.count()
    if not n:
        raise ValueError("no training rows")
    mean = source.select(F.posexplode("y").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("v")).orderBy("k").collect()
    model = Boosted(cut_points(source, "x", bins), np.array([r["v"] for r in mean]))
    width, outputs = len(model.cuts), len(model.base)
    parts = -(-n // PART_ROWS)
    rows = cut_lineage(binned(source, "x", "y", model.cuts, model.base).repartition(parts))
    since: list[Trees] = []
    for _ in range(rounds):
        inner = (1 << depth) - 1
        now = Trees(np.zeros((outputs, inner), np.int64), np.full((outputs, inner), 255), np.zeros((outputs, 1 << depth)))
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            for r in level_splits(rows, since, now, level, width, bins, penalty, least, parts):
                now.feature[r["k"], first: first + many], now.bin[r["k"], first: first + many] = r["f"], r["b"]
                if level == depth - 1:
                    now.leaf[r["k"]] = eta * np.stack([r["left"], r["right"]], axis=1).ravel()
        model.rounds.append(now)
        since.append(now)
        if len(since) == KEPT_ROUNDS and len(model.rounds) < rounds:
            rows, since = cut_lineage(advanced(rows, since, width)), []
    return model


def predict(df: DataFrame, model: Boosted, x: str, name: str = "yhat") -> DataFrame:
    """Add the predictions of all outputs as an array."""

    @F.pandas_udf("array<double>")
    def score(v):
        import pandas as pd

        b = bin_rows(np.array(v.tolist(), np.float64).reshape(len(v), -1), model.cuts)
        out = np.tile(model.base, (len(b), 1))
        for trees in model.rounds:
            trees.add(b, out)
        return pd.Series(list(out), dtype=object)

    return df.withColumn(name, score(F.col(x).cast("array<double>")))
