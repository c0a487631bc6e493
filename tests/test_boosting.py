"""Histogram boosting against a plain recursive version."""

import numpy as np
import pytest

from platewise.operators import boosting


def plain(x, y, cuts, rounds, eta, depth, penalty=1.0):
    """Predictions of one output: trees grown node by node, every threshold tried by masks."""
    base = y.mean()
    pred = np.full(len(y), base)

    def grow(rows, level):
        g = pred[rows] - y[rows]
        worth = lambda m: g[m].sum() ** 2 / (m.sum() + penalty)
        best = None
        if level < depth:
            for f, own in enumerate(cuts):
                for c in own:
                    left = x[rows, f] <= c
                    if left.any() and (~left).any():
                        gain = worth(left) + worth(~left) - worth(np.ones(len(rows), bool))
                        if gain > 1e-12 * max(1, g.sum() ** 2) and (best is None or gain > best[0] + 1e-12):
                            best = (gain, f, c)
        if best is None:
            return [(rows, -eta * g.sum() / (len(rows) + penalty))]
        left = x[rows, best[1]] <= best[2]
        return grow(rows[left], level + 1) + grow(rows[~left], level + 1)

    for _ in range(rounds):
        for rows, value in grow(np.arange(len(y)), 0):
            pred[rows] += value
    return pred


def frame(spark, x, y, parts):
    return spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "i bigint, x array<double>, y array<double>").repartition(parts)


@pytest.mark.parametrize("kept", [10, 2])
def test_every_output_like_a_plain_version(spark, monkeypatch, kept):
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", kept)
    monkeypatch.setattr(boosting, "PART_ROWS", 40)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(150, 4)), 1)
    x[:, 3] = 1.0
    y = np.stack([np.sin(x[:, 0]) + x[:, 1] + rng.normal(size=150) / 5, x[:, 1] * x[:, 2], np.full(150, 2.5)], axis=1)
    df = frame(spark, x, y, 3)
    model = boosting.fit(df, "x", "y", rounds=3, eta=0.3, depth=3, bins=16)
    got = np.array([r["yhat"] for r in boosting.predict(df, model, "x").orderBy("i").collect()])
    for k in range(3):
        assert np.allclose(got[:, k], plain(x, y[:, k], model.cuts, 3, 0.3, 3)), k
    assert np.allclose(got[:, 2], 2.5)


def test_learns_and_takes_unseen_values(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3))
    y = np.stack([np.where(x[:, 0] > 0, 2.0, -1.0) * (x[:, 1] > 0), x[:, 2] ** 2], axis=1)
    model = boosting.fit(frame(spark, x[:400], y[:400], 2), "x", "y", rounds=12, eta=0.3, depth=4)
    new = np.vstack([x[400:], [[9.0, 9.0, 9.0]]])
    got = np.array([r["yhat"] for r in boosting.predict(frame(spark, new, np.zeros((201, 2)), 2), model, "x").orderBy("i").collect()])
    assert ((got[:200] - y[400:]) ** 2).mean(axis=0).max() < 0.25 * y.var(axis=0).min() and np.isfinite(got).all()


def test_no_rows_and_bad_bins(spark):
    none = spark.createDataFrame([], "x array<double>, y array<double>")
    with pytest.raises(ValueError):
        boosting.fit(none, "x", "y")
    with pytest.raises(ValueError):
        boosting.fit(none, "x", "y", bins=1000)
