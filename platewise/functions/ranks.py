"""Arrow UDFs: average ranks of a vector, float32 decoding, tail probabilities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.functions.dense import average_ranks


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def rank_avg(v: pd.Series) -> pd.Series:
    lengths = v.map(lambda a: -1 if a is None else len(a))
    out = pd.Series([None] * len(v), index=v.index, dtype=object)
    for k in lengths.unique():
        if k >= 0:
            picked = lengths == k
            block = np.array(v[picked].tolist(), dtype=np.float64).reshape(int(picked.sum()), k)
            out[picked] = pd.Series(list(average_ranks(block)), index=v.index[picked])
    return out


@F.arrow_udf(T.ArrayType(T.FloatType()))
def decode_f32(raw: pa.Array) -> pa.Array:
    """Little-endian float32 bytes to a vector; the batch's bytes are taken as they lie."""
    raw = raw.cast(pa.binary())
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    floats = np.frombuffer(data, "<f4", (ends[-1] - ends[0]) // 4, ends[0]) if data is not None and ends[-1] > ends[0] else np.empty(0, "<f4")
    return pa.ListArray.from_arrays(pa.array((ends - ends[0]) // 4, pa.int32()), pa.array(floats, pa.float32()), mask=raw.is_null())


@F.pandas_udf(T.BinaryType())
def encode_f32(v: pd.Series) -> pd.Series:
    return v.map(lambda a: None if a is None else np.asarray(a, dtype="<f4").tobytes())


def _log_gamma(a: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in a])


def _log_gamma_step(a: np.ndarray) -> np.ndarray:
    """log gamma(a + 1/2) - log gamma(a); the difference of large terms is taken by its series."""
    big = a > 1e3
    return np.where(big, 0.5 * np.log(a) - 1 / (8 * a) + 1 / (192 * a**3), _log_gamma(np.where(big, 1.0, a) + 0.5) - _log_gamma(np.where(big, 1.0, a)))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz), until every element stands still."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(x), 1 / guard(1 - (a + b) * x / (a + 1))
    h, m, on = d.copy(), 0, np.ones(len(x), bool)
    while on.any():
        m += 1
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / guard(1 + num * d)
            c = guard(1 + num / c)
            h = np.where(on, h * d * c, h)
        on &= np.abs(d * c - 1) > 4e-16
    return h


def t_tails(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail of Student's t through the incomplete beta function I_x(df / 2, 1 / 2) at x = df / (df + t^2)."""
    out = np.full(len(t), np.nan)
    ok = np.isfinite(t) & (df > 0)
    out[(np.isinf(t)) & (df > 0)] = 0.0
    # far beyond a million degrees of freedom the normal tail of t (1 - 1 / 4v) / sqrt(1 + t^2 / 2v), off by the order of 1 / v^2
    wide = ok & (df > 1e6)
    out[wide] = [math.erfc(abs(a) * (1 - 1 / (4 * v)) / math.sqrt(2 + a * a / v)) for a, v in zip(t[wide], df[wide])]
    ok &= ~wide
    a, t2 = df[ok] / 2, t[ok] ** 2
    x, y = df[ok] / (df[ok] + t2), t2 / (df[ok] + t2)
    b = np.full_like(a, 0.5)
    with np.errstate(divide="ignore"):
        front = np.exp(_log_gamma_step(a) - 0.5 * math.log(math.pi) - a * np.log1p(t2 / df[ok]) + 0.5 * np.log(y))
    low = x < (a + 1) / (a + 2.5)
    res = np.ones_like(a)
    res[low] = front[low] * _beta_fraction(a[low], b[low], x[low]) / a[low]
    res[~low] = 1 - front[~low] * _beta_fraction(b[~low], a[~low], y[~low]) / 0.5
    out[ok] = np.where(y == 0, 1.0, res)
    return out


def chi2_tails(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper tail of chi-square: regularised incomplete gamma by series below the mean, by continued fraction above, each until it stands still."""
    out = np.full(len(x), np.nan)
    ok = ~np.isnan(x) & (df > 0)
    out[ok & (x <= 0)], out[ok & np.isinf(x)] = 1.0, 0.0
    ok &= (x > 0) & np.isfinite(x)
    a, z = df[ok] / 2, x[ok] / 2
    delta = (z - a) / a
    stirling = 0.5 * np.log(a / (2 * math.pi)) - 1 / (12 * a) + 1 / (360 * a**3)
    lead = np.exp(-a * (delta - np.log1p(delta)) + np.where(a > 1e3, stirling, a * np.log(a) - a - _log_gamma(a)))
    low, res = z < a + 1, np.zeros_like(a)
    if low.any():
        n, w = a[low], z[low]
        term = total = 1 / n
        k = n.copy()
        while (np.abs(term) > np.abs(total) * 1e-17).any():
            k = k + 1
            term = term * w / k
            total = total + term
        res[low] = 1 - total * lead[low]
    if (~low).any():
        n, w = a[~low], z[~low]
        b, c = w + 1 - n, np.full_like(w, 1e300)
        d = 1 / b
        h, i, on = d.copy(), 0, np.ones(len(w), bool)
        while on.any():
            i += 1
            an = -i * (i - n)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(d == 0, 1e-300, d)
            c = b + an / c
            c = np.where(c == 0, 1e-300, c)
            h = np.where(on, h * d * c, h)
            on &= np.abs(d * c - 1) > 4e-16
        res[~low] = lead[~low] * h
    out[ok] = res
    return out


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_tails(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_tails(x.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([math.nan if v != v else math.erfc(abs(v) / math.sqrt(2.0)) for v in z.to_numpy(float)])
