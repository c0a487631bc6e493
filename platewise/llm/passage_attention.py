"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages of a fixed number of words; only the document has a label. Every passage becomes a vector (shares of character classes and of
their pairs, repeated and distinct words, word length), a layer encodes it, a gated attention layer says how much it counts, and the weighted mean of the
encoded passages gives the score. Labels teach all layers together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import col, discard, slices, staged
from platewise.llm.labelled import held_out, sample

#: Words of a passage; labelled documents, and passages of theirs, that are learnt from at most.
PASSAGE, SAMPLE, SAMPLE_PASSAGES = 64, 6_000, 120_000
HIDDEN, GATES, EPOCHS, BATCH, RATE, DECAY = 24, 16, 12, 64, 0.01, 1e-4
#: Character classes of the bytes of a text; what is in none of these sets has a class for itself, bytes above 127 another.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", ".", ",;:", "!", "?", "|", "*#$%&@^~=+_<>/\\", "\"'`()[]{}-"]
KINDS = len(CLASSES) + 2
WIDTH = KINDS + KINDS * KINDS + 4


def byte_kinds() -> np.ndarray:
    out = np.full(256, KINDS - 2, np.int64)
    for k, chars in enumerate(CLASSES):
        out[list(chars.encode())] = k
    out[128:] = KINDS - 1
    return out


def passages(texts: list[str], kinds: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of all passages, number of passages of each text). A text without words is one empty passage."""
    blocks, counts, extra = [], [], []
    for text in texts:
        words = text.split()
        n = max(1, -(-len(words) // size))
        counts.append(n)
        same = [a == b for a, b in zip(words, words[1:])]
        for k in range(n):
            own = words[k * size:(k + 1) * size]
            m = max(1, len(own))
            blocks.append(" ".join(own).encode())
            extra.append((sum(same[k * size:(k + 1) * size]) / m, len(set(own)) / m, sum(map(len, own)) / (10 * m), len(own) / size))
    sizes = np.array([len(b) for b in blocks])
    flat = kinds[np.frombuffer(b"".join(blocks), np.uint8)]
    owner = np.repeat(np.arange(len(blocks)), sizes)
    single = np.bincount(owner * KINDS + flat, minlength=len(blocks) * KINDS).reshape(len(blocks), KINDS)
    inside = owner[1:] == owner[:-1]
    pair = (owner[1:] * KINDS * KINDS + flat[:-1] * KINDS + flat[1:])[inside]
    double = np.bincount(pair, minlength=len(blocks) * KINDS * KINDS).reshape(len(blocks), KINDS * KINDS)
    share = np.maximum(sizes, 1)[:, None]
    return np.concatenate([single / share, double / share, np.array(extra)], axis=1).astype(np.float32), np.array(counts)


@dataclass
class Network:
    """Encoder h = tanh(x V + v), attention softmax over a document of (tanh(h A) * sigmoid(h G)) c, score sigmoid(sum of a h, weighted, . w + b)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, dict]:
        p = self.weights
        x = (x - self.mean) / self.scale
        starts = np.cumsum(counts) - counts
        h = np.tanh(x @ p["V"] + p["v"])
        t, g = np.tanh(h @ p["A"]), 1 / (1 + np.exp(-(h @ p["G"])))
        e = (t * g) @ p["c"]
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a /= np.repeat(np.add.reduceat(a, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["w"] + p["b"], -30, 30)))
        return y, {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "starts": starts}

    def gradients(self, y: np.ndarray, truth: np.ndarray, counts: np.ndarray, s: dict) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy by every weight."""
        p, n = self.weights, len(truth)
        d = (y - truth) / n
        dz = d[:, None] * p["w"]
        far = np.repeat(dz, counts, axis=0)
        da = (far * s["h"]).sum(axis=1)
        de = s["a"] * (da - np.repeat(np.add.reduceat(s["a"] * da, s["starts"]), counts))
        dt, dg = de[:, None] * p["c"] * s["g"] * (1 - s["t"] ** 2), de[:, None] * p["c"] * s["t"] * s["g"] * (1 - s["g"])
        dh = s["a"][:, None] * far + dt @ p["A"].T + dg @ p["G"].T
        du = dh * (1 - s["h"] ** 2)
        return {"V": s["x"].T @ du, "v": du.sum(axis=0), "A": s["h"].T @ dt, "G": s["h"].T @ dg, "c": (de[:, None] * s["t"] * s["g"]).sum(axis=0), "w": s["z"].T @ d,
                "b": np.array(d.sum())}


def train(x: np.ndarray, counts: np.ndarray, truth: np.ndarray, seed: int = 0) -> Network:
    """Adam over mini-batches of documents. With no row or one kind of label the score is the label's mean everywhere."""
    rng = np.random.default_rng(seed)
    shapes = {"V": (WIDTH, HIDDEN), "v": (HIDDEN,), "A": (HIDDEN, GATES), "G": (HIDDEN, GATES), "c": (GATES,), "w": (HIDDEN,), "b": ()}
    weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for k, s in shapes.items()}
    weights["c"], weights["w"] = rng.normal(0, 0.3, GATES), rng.normal(0, 0.3, HIDDEN)
    base = float(np.clip(truth.mean() if len(truth) else 0.5, 1e-3, 1 - 1e-3))
    weights["b"] = np.array(np.log(base / (1 - base)))
    net = Network(x.mean(axis=0) if len(x) else np.zeros(WIDTH), (x.std(axis=0) if len(x) else np.zeros(WIDTH)) + 0.02, weights)
    if not len(truth) or truth.min() == truth.max():
        weights["w"] = np.zeros(HIDDEN)
        return net
    starts = np.cumsum(counts) - counts
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    step = 0
    for _ in range(max(EPOCHS, 200 * BATCH // max(1, len(truth)))):
        order = rng.permutation(len(truth))
        for k in range(0, len(order), BATCH):
            docs = order[k:k + BATCH]
            own = counts[docs]
            rows = np.repeat(starts[docs] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            y, state = net.forward(x[rows], own)
            step += 1
            for name, g in net.gradients(y, truth[docs], own, state).items():
                g = g + DECAY * weights[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                weights[name] = weights[name] - RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE, text: str = "text", id_col: str = "doc_id", most: int = SAMPLE_PASSAGES) -> Network:
    """Train on at most `rows` labelled documents outside the held-out fold, shortest first as long as they have `most` passages together at most; their passage vectors,
    not their texts, come to the driver."""
    known = sample(docs, labels, label, rows, text, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = byte_kinds()
        for part in slices(batches, "_text"):
            x, counts = passages(part.column("_text").to_pylist(), kinds)
            ends = np.cumsum(counts).tolist()
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_label"), pa.array([x[a:b].tobytes() for a, b in zip([0, *ends], ends)], pa.binary())],
                                             ["_id", "_label", "x"])

    kinds = dict(known.dtypes)
    found = staged(known.select("_id", "_label", "_text").mapInArrow(run, f"_id {kinds['_id']}, _label {kinds['_label']}, x binary"), "passages")
    # A window over the sample's lengths, at most `rows` of them.
    size = F.sum("n").over(Window.orderBy("n", "_id").rowsBetween(Window.unboundedPreceding, 0))
    picked = found.select("_id", F.octet_length("x").alias("n")).withColumn("all", size).filter(F.col("all") <= most * WIDTH * 4).select("_id")
    got = found.join(F.broadcast(picked), "_id", "left_semi").collect()
    discard(found)
    got.sort(key=lambda r: r["_id"])
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in got]
    x = np.concatenate(bags) if bags else np.empty((0, WIDTH), np.float32)
    return train(x, np.array([len(b) for b in bags], np.int64), np.array([r["_label"] for r in got], float))


def score(docs: DataFrame, network: Network, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, `score` (0 to 1) and `n_passages` per row from the text alone. Null counts as empty, an empty text is one empty passage; repeated rows are scored each;
    other columns are left out; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = byte_kinds()
        for part in slices(batches, "_text", 1 << 20):
            x, counts = passages([t or "" for t in part.column("_text").to_pylist()], kinds)
            y, _ = network.forward(x, counts)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(y, pa.float64()), pa.array(counts, pa.int64())],
                                             [*keep, "score", "n_passages"])

    source = docs.select(*[col(c) for c in keep], col(text).cast("string").alias("_text"))
    types = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "score double, n_passages bigint"]))


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= threshold) and n_passages of every document."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages")
