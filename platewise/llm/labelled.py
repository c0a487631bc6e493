"""What the two text classifiers share: a bounded sample of labelled rows, logistic fitting and ranking measures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import col

#: Rows that are never learnt from: crc32 of the id as text leaves this remainder by FOLDS.
FOLDS, HELD_OUT = 5, 0


def held_out(id_col: str = "doc_id") -> Column:
    return (F.crc32(col(id_col).cast("string")) % FOLDS) == HELD_OUT


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, _text, _label) of at most `rows` labelled documents outside the held-out fold: those with the smallest hash of their id. An id with several labels or
    texts counts once, with the larger ones; null labels and ids are left out. The picked ids are at most `rows`, so they may be broadcast."""
    known = labels.filter(col(label).isNotNull() & col(id_col).isNotNull() & ~held_out(id_col)).groupBy(col(id_col).alias("_id")).agg(F.max(col(label)).alias("_label"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    source = docs.select(col(id_col).alias("_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("_text"))
    return source.join(F.broadcast(picked), "_id").groupBy("_id").agg(F.max("_text").alias("_text"), F.max("_label").alias("_label"))


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression with a Gaussian prior around `prior`, by Newton's method; no rows give the prior."""
    w = prior.astype(float).copy()
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - prior)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + strength * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w
