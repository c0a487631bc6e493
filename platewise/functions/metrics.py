"""Row-wise metrics of vector columns, one numpy pass per Arrow batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.functions.dense import average_ranks, matrix, nan_to_null, unit_rows
from platewise.functions.vectors import COSINE_EPS


def metric_udf(names: list[str], compute: Callable[..., dict[str, np.ndarray]]) -> Callable[..., Column]:
    """A column function from vector columns to a struct of doubles; a row with a missing vector gives NULLs, NaN
    becomes NULL."""

    @F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def run(*columns: pa.Array) -> pa.Array:
        ok = np.ones(len(columns[0]), dtype=bool)
        for c in columns:
            ok &= c.is_valid().to_numpy(zero_copy_only=False)
        keep = pa.array(ok)
        out = {n: np.full(len(ok), np.nan) for n in names}
        if ok.any():
            for n, v in compute(*[matrix(c.filter(keep)) for c in columns]).items():
                out[n][ok] = v
        return pa.StructArray.from_arrays([nan_to_null(out[n]) for n in names], names)

    return lambda *cols: run(*[c.cast("array<double>") for c in cols])


def pearson(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (unit_rows(a) * unit_rows(b)).sum(axis=1)


def norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a * a).sum(axis=1))


def cosine(a: np.ndarray, b: np.ndarray, safe: bool = False) -> np.ndarray:
    na, nb = norms(a), norms(b)
    c = (a * b).sum(axis=1) / (na * nb + COSINE_EPS)
    return np.where((na == 0) | (nb == 0), np.nan, c) if safe else c


def l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return norms(a - b)


def rmse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return l2(a, b) / np.sqrt(max(a.shape[1], 1))


def spearman(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return pearson(average_ranks(a), average_ranks(b))


SCORES = ["rmse", "pearson", "spearman", "l2", "cosine"]
score_struct = metric_udf(SCORES, lambda y, p: {
    "rmse": rmse(y, p), "pearson": pearson(y, p), "spearman": spearman(y, p), "l2": l2(y, p), "cosine": cosine(y, p)})

PAIR = ["norm_rep_i", "norm_rep_j", "pearson", "spearman"]
pair_struct = metric_udf(PAIR, lambda a, b: {
    "norm_rep_i": norms(a), "norm_rep_j": norms(b), "pearson": pearson(a, b), "spearman": spearman(a, b)})

PROFILE = ["pearson", "pearson_topk", "cosine", "rmse"]
CENTROID = [f"{m}_{tag}" for tag in ("control", "systema") for m in PROFILE]


def centroid_struct(k: int) -> Callable[..., Column]:
    """Metrics of (y, yhat, centroid): on the vectors, and after subtracting the centroid from both; top-k genes by |y|,
    lower position first among equals."""

    def compute(y, p, c):
        top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :k]
        pick = lambda v: np.take_along_axis(v, top, axis=1)
        out = {}
        for tag, a, b in (("control", y, p), ("systema", y - c, p - c)):
            out |= {f"pearson_{tag}": pearson(a, b), f"pearson_topk_{tag}": pearson(pick(a), pick(b)),
                    f"cosine_{tag}": cosine(a, b, safe=True), f"rmse_{tag}": rmse(a, b)}
        return out

    return metric_udf(CENTROID, compute)


CASE = ["reference_target_pearson", "prediction_target_pearson", "reference_target_cosine", "prediction_target_cosine", "adaptation_pearson",
        "adaptation_cosine", "reference_target_l2", "prediction_target_l2", "target_norm", "reference_norm", "prediction_norm"]
case_struct = metric_udf(CASE, lambda y, ref, p: {
    "reference_target_pearson": pearson(ref, y), "prediction_target_pearson": pearson(p, y),
    "reference_target_cosine": cosine(ref, y), "prediction_target_cosine": cosine(p, y),
    "adaptation_pearson": pearson(p - ref, y - ref), "adaptation_cosine": cosine(p - ref, y - ref),
    "reference_target_l2": l2(ref, y), "prediction_target_l2": l2(p, y),
    "target_norm": norms(y), "reference_norm": norms(ref), "prediction_norm": norms(p)})
