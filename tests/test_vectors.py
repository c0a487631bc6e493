import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.functions import text as X
from platewise.functions import vectors as V
from platewise.functions.dense import average_ranks
from platewise.functions.ranks import chi2_tails, t_tails, decode_f32, encode_f32, rank_avg


def one(spark, expr, **arrays):
    df = spark.createDataFrame([tuple(arrays.values())], ", ".join(f"{k} array<double>" for k in arrays))
    return df.select(expr.alias("v")).first()[0]


def test_pearson_matches_numpy_and_is_null_for_constants(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=30).tolist(), rng.normal(size=30).tolist()
    assert one(spark, V.pearson(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert one(spark, V.pearson(F.col("a"), F.col("b")), a=[0.1, 0.1, 0.1], b=[1.0, 2.0, 3.0]) is None


def test_zero_vectors(spark):
    z, x = [0.0, 0.0], [1.0, 2.0]
    assert one(spark, V.cosine_distance(F.col("a"), F.col("b")), a=z, b=x) is None
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=z, b=x) == 0.0
    assert one(spark, V.tanimoto_distance(F.col("a"), F.col("b")), a=z, b=z) == 0.0
    assert one(spark, V.tanimoto_distance(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == 0.5


def test_distances(spark):
    a, b = [1.0, 2.0, 4.0], [2.0, 0.0, 1.0]
    assert one(spark, V.l2(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(math.sqrt(14))
    assert one(spark, V.rmse(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(math.sqrt(14 / 3))


def test_rank_ties(spark):
    assert one(spark, rank_avg(F.col("a")), a=[1.0, 1.0, 2.0]) == [1.5, 1.5, 3.0]
    assert average_ranks(np.array([[3.0, 1.0, 2.0], [5.0, 5.0, 5.0]])).tolist() == [[3, 1, 2], [2, 2, 2]]


def test_densify(spark):
    df = spark.createDataFrame([([(1, 2.0), (3, 4.0)],), ([],), ([(0, 1.0), (4, 5.0)],)], "e array<struct<pos:int,val:double>>")
    assert [r[0] for r in df.select(V.densify(F.col("e"), 5)).collect()] == [[0, 2, 0, 4, 0], [0] * 5, [1, 0, 0, 0, 5]]


def test_float32_round_trip(spark):
    df = spark.createDataFrame([([1.5, -2.25],)], "v array<double>")
    assert df.select(decode_f32(encode_f32(F.col("v")))).first()[0] == [1.5, -2.25]


def test_tails():
    t = t_tails(np.array([2.0, 0.0, 1.96, np.nan]), np.array([10, 3, 1e10, 4.0]))
    assert t[:3] == pytest.approx([0.07338803477074045, 1.0, math.erfc(1.96 / math.sqrt(2))], rel=1e-8) and np.isnan(t[3])
    c = chi2_tails(np.array([5.991464547107979, 0.5, 1e7, 9e6]), np.array([2, 3, 1e7, 1e7]))
    assert c[:2] == pytest.approx([0.05, math.erfc(0.5) + math.sqrt(1 / math.pi) * math.exp(-0.25)], rel=1e-9)
    assert c[2:] == pytest.approx([0.5 - 1 / (3 * math.sqrt(math.pi * 1e7)), 1.0], abs=1e-7)


def test_text(spark):
    df = spark.createDataFrame([("[('a', 5.0, 'uM'), ('b', 1.0, 'nM')]", "1e-3 uM", "24 h"), ("[]", "3 nM", "none")], "t string, d string, h string")
    rows = df.select(X.dose_from_tuples(F.col("t")), X.dose_value(F.col("d")), X.parse_number(F.col("h"))).collect()
    assert [tuple(r) for r in rows] == [("5.0 uM", 0.001, 24.0), (None, None, None)]
    p = spark.createDataFrame([(None,), (0.0,), (2e-5,), (0.25,)], "p double").select(X.p_text(F.col("p"))).collect()
    assert [r[0] for r in p] == ["n/a", "<1e-300", "2e-05", "0.250"]
    n = spark.createDataFrame([("[512, 256]",)], "l string").select(X.parameter_count(F.lit(10), X.layer_sizes(F.col("l")), F.lit(3))).first()[0]
    assert n == 10 * 512 + 512 + 512 * 256 + 256 + 256 * 3 + 3


@pytest.mark.parametrize("block, held", [(4096, 1 << 22), (2, 3)])
def test_average_vectors(spark, monkeypatch, block, held):
    from platewise.operators import profiles as P
    monkeypatch.setattr(P, "VECTOR_BLOCK", block)
    monkeypatch.setattr(P, "HELD_SUMS", held)
    rows = [("hot", 1, [float(i), 2.0, None, float(i % 3), 1.0]) for i in range(40)] + [("ragged", 1, [1.0]), ("ragged", 1, [3.0, 5.0, 7.0]), ("ragged", 1, None), ("none", 1, None), (None, 2, [4.0]),
            (None, 2, [8.0]), ("empty", 3, []), ("nan", 4, [float("nan"), 1.0]), ("nan", 4, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "g string, h int, v array<double>").repartition(5)
    got = {(r.g, r.h): r.m for r in P.average_vectors(df, ["g", "h"], "v", "m").collect()}
    nan = got.pop(("nan", 4))
    assert np.isnan(nan[0]) and nan[1] == 2.0
    assert got == {("hot", 1): [19.5, 2.0, None, pytest.approx(39 / 40), 1.0], ("ragged", 1): [2.0, 5.0, 7.0], ("none", 1): None, (None, 2): [6.0], ("empty", 3): None}


def test_rank_correlations_are_exact():
    """Equal sums of squares give the fraction itself, in any order of the columns and beside any other rows."""
    from platewise.functions.dense import rank_correlations

    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 12, (2, 25))
        m = np.stack([a, b, np.zeros(25, int), b[::-1]]).astype(float)
        ranks = lambda v: [2 * sum(y < x for y in v) + sum(y == x for y in v) - 25 for x in v]
        p, q = ranks(a.tolist()), ranks(b.tolist())
        top, left, right = sum(x * y for x, y in zip(p, q)), sum(x * x for x in p), sum(y * y for y in q)
        want = top / np.sqrt(left * right)
        order = rng.permutation(25)
        got = rank_correlations(m[:, order], np.array([0, 1, 0]), np.array([1, 3, 2]))
        assert got[0] == want == rank_correlations(m, np.array([0]), np.array([1]))[0] and np.isnan(got[2])


def test_rounded_is_round_without_a_decimal_per_value(spark):
    """Bit by bit what `F.round` gives: ties, their neighbours, large, tiny, infinite and missing values; and the usual value takes the short way."""
    from platewise.plans import catalog

    rng = np.random.default_rng(6)
    ties = (rng.integers(-10**7, 10**7, 400) + 0.5) / 1e6
    v = np.concatenate([ties, np.nextafter(ties, 9), np.nextafter(ties, -9), rng.normal(size=400), rng.normal(size=200) * 1e9, rng.normal(size=100) * 1e18,
                        [0.0, -0.0, -1e-9, 1e-300, 5e-7, -5e-7, 0.1515625, -0.1515625, 1e308, np.inf, -np.inf]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    for digits in (6, 2):
        rows = df.select(catalog.rounded(F.col("v"), digits), F.round("v", digits) + F.lit(0.0)).collect()
        assert [(a, np.signbit(a) if a is not None else None) for a, _ in rows] == [(b, np.signbit(b) if b is not None else None) for _, b in rows]
    assert "rint" in catalog.settle(df)._jdf.queryExecution().optimizedPlan().toString().lower()
