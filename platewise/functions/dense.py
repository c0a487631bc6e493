"""Numpy helpers used inside Arrow tasks on bounded tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """Equal-length list column as a 2-D array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def average_ranks(m: np.ndarray) -> np.ndarray:
    """Row-wise 1-based ranks, ties share their mean rank."""
    n, k = m.shape
    if k == 0:
        return m.copy()
    order = np.argsort(m, axis=1, kind="stable")
    s = np.take_along_axis(m, order, axis=1)
    idx = np.arange(k)
    new = np.ones((n, k), dtype=bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    first = np.maximum.accumulate(np.where(new, idx, 0), axis=1)
    end = np.ones((n, k), dtype=bool)
    end[:, :-1] = new[:, 1:]
    last = np.minimum.accumulate(np.where(end, idx, k - 1)[:, ::-1], axis=1)[:, ::-1]
    out = np.empty((n, k))
    np.put_along_axis(out, order, (first + last) / 2.0 + 1.0, axis=1)
    return out


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Centre rows and scale them to length 1; constant rows become NaN."""
    c = m - m.mean(axis=1, keepdims=True)
    length = np.sqrt((c * c).sum(axis=1, keepdims=True))
    flat = (m == m[:, :1]).all(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(flat, np.nan, c / length)


def centred_ranks(m: np.ndarray) -> np.ndarray:
    """Doubled centred ranks of each row. They are whole numbers, so their products are exact whatever the order of summation."""
    return 2 * average_ranks(m) - (m.shape[1] + 1)


def rank_correlations(m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Spearman correlation of pairs of rows, NaN where one is constant. Products of `centred_ranks` are exact, and a fraction that lies halfway between two decimals is not moved off it."""
    c = centred_ranks(m)
    gram = c @ c.T
    sq = np.diag(gram)
    with np.errstate(invalid="ignore", divide="ignore"):
        return gram[i, j] / np.sqrt(sq[i] * sq[j])


def nan_to_null(v: np.ndarray) -> pa.Array:
    return pa.array(v, type=pa.float64(), mask=np.isnan(v))
