import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.functions.dense import average_ranks
from platewise.operators import cleaning as C
from platewise.operators import enrichment as E
from platewise.operators import observations as O
from platewise.operators import reports as B
from platewise.operators import scoring as M
from platewise.operators import splits as L
from platewise.operators import statistics as S
from platewise.sources import readers
from platewise.session import scratch_path


def test_bootstrap_interval_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(2.0, 1.0, 400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(999, float("nan"))], "i int, x double")
    a = S.bootstrap_mean(df, [], "x", ["i"], 300).first()
    b = S.bootstrap_mean(df.repartition(5), [], "x", ["i"], 300).first()
    assert a.n == 400 and a.mean == pytest.approx(x.mean()) and a.lo == pytest.approx(b.lo) and a.hi == pytest.approx(b.hi)
    se = x.std() / 20
    assert a.lo == pytest.approx(x.mean() - 1.96 * se, abs=0.6 * se) and a.hi == pytest.approx(x.mean() + 1.96 * se, abs=0.6 * se)


def test_cluster_bootstrap_is_wider_with_cluster_effects(spark):
    rng = np.random.default_rng(1)
    rows = [(c, f"{c}_{i}", float(m + rng.normal(0, 0.1))) for c, m in enumerate(rng.normal(0, 1, 25)) for i in range(20)]
    df = spark.createDataFrame(rows, "c int, i string, x double").withColumn("g", F.lit("all"))
    r = S.bootstrap_mean(df, ["g"], "x", ["i"], 200).first()
    k = S.cluster_bootstrap_mean(df, ["g"], "x", "c", 200).first()
    assert k.mean == pytest.approx(r.mean) and k.n_clusters == 25 and (k.hi - k.lo) > 2 * (r.hi - r.lo)


def test_wilcoxon_zero_differences(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 1.0), ("b", -2.0), ("b", 3.0), ("b", 3.0), ("b", 0.0)], "g string, d double")
    got = {r.g: r for r in S.wilcoxon(df, ["g"]).collect()}
    assert "a" not in got and (got["b"].n, got["b"].w_plus, got["b"].w_minus, got["b"].w) == (4, 8.0, 2.0, 2.0)
    assert got["b"].z == pytest.approx((2 - 5) / np.sqrt(4 * 5 * 9 / 24 - 6 / 48)) and 0 < got["b"].p < 1


def test_friedman(spark):
    blocks = [(1, 2, 3), (1, 3, 2), (2, 3, 1), (1, 2, 2)]
    rows = [(b, t, float(v)) for b, r in enumerate(blocks) for t, v in zip("xyz", r)] + [(9, "x", 1.0), (9, "y", 2.0)]
    r = S.friedman(spark.createDataFrame(rows, "b int, t string, v double"), ["b"], "t", "v", 3).first()
    ranks = np.array([[1, 2, 3], [1, 3, 2], [2, 3, 1], [1, 2.5, 2.5]])
    raw = 12 / (4 * 12) * (ranks.sum(0) ** 2).sum() - 3 * 4 * 4
    stat = raw / (1 - 6 / (4 * 3 * 8))
    assert r.n_blocks == 4 and r.stat == pytest.approx(stat) and r.w == pytest.approx(stat / 8) and r.p == pytest.approx(np.exp(-stat / 2))
    assert S.friedman(spark.createDataFrame(rows, "b int, t string, v double").filter("t <> 'z'"), ["b"], "t", "v", 2).first().stat is None


def test_cluster_ols_point_estimate(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 2))
    y = 1 + x @ [2.0, -0.5] + rng.normal(0, 0.3, 90)
    df = spark.createDataFrame([(int(i % 9), *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "g int, a double, b double, y double")
    got = {r.term: r for r in S.cluster_ols(df, "y", ["a", "b"], "g", 100).collect()}
    beta = np.linalg.lstsq(np.column_stack([np.ones(90), x]), y, rcond=None)[0]
    for n, v in zip(("intercept", "a", "b"), beta):
        assert got[n].coef == pytest.approx(v) and got[n].lo < v < got[n].hi
    assert got["a"].p == pytest.approx(0.01)


def group_key(seed, *parts):
    import hashlib
    digest = hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()
    return int(digest[:8], 16), int(digest[8:15], 16)


@pytest.mark.parametrize("block", [65_536, 7])
def test_cluster_intervals_like_concatenated_draws(spark, monkeypatch, block):
    """Every draw written out: clusters concatenated as drawn, least squares and means of the rows."""
    monkeypatch.setattr(S, "CLUSTER_BLOCK", block)
    monkeypatch.setattr(S, "REPLICATES", 9)
    rng = np.random.default_rng(6)
    n, boot = 120, 25
    x = rng.normal(size=(n, 2))
    g = rng.integers(0, 23, n)
    y = 1 + x @ [2.0, -0.5] + rng.normal(0, 0.3, n) + g % 5
    df = spark.createDataFrame([(int(k), *map(float, r), float(v), "p") for k, r, v in zip(g, x, y)], "g int, a double, b double, y double, h string").repartition(4)
    names = sorted(set(g.tolist()))
    members = [np.flatnonzero(g == c) for c in names]
    full = np.column_stack([np.ones(n), x])
    draws = lambda *key: [np.concatenate([members[i] for i in row]) for row in S.drawn_positions(len(names), np.arange(1, boot + 1), np.arange(1, len(names) + 1), *group_key(0, *key))]
    betas = np.array([np.linalg.lstsq(full[r], y[r], rcond=None)[0] for r in draws(0)])
    got = {r.term: r for r in S.cluster_ols(df, "y", ["a", "b"], "g", boot).collect()}
    for k, term in enumerate(("intercept", "a", "b")):
        above = (betas[:, k] > 0).mean()
        want = [*np.percentile(betas[:, k], [2.5, 97.5]), min(1, max(2 * min(above, 1 - above), 1 / boot))]
        assert [got[term].lo, got[term].hi, got[term].p] == pytest.approx(want)
    means = [y[r].mean() for r in draws("p")]
    row = S.cluster_bootstrap_mean(df, ["h"], "y", "g", boot).first()
    assert [row["mean"], row.lo, row.hi, row.n, row.n_clusters] == pytest.approx([y.mean(), *np.percentile(means, [2.5, 97.5]), n, len(names)])


@pytest.mark.parametrize("values, rows", [(512, 8192), (3, 11)])
@pytest.mark.parametrize("local, at_once", [(32_768, 125), (7, 6)])
def test_rank_intervals_of_ranges_ranked_where_they_are(spark, monkeypatch, values, rows, local, at_once):
    """The variable with the most values is ranked in its tasks, a hot value in parts, replicates a few at a time."""
    monkeypatch.setattr(S, "LOCAL_ROWS", local)
    monkeypatch.setattr(S, "AT_ONCE", at_once)
    test_rank_intervals_like_resampled_rows(spark, monkeypatch, values, rows)


def test_rank_intervals_send_no_ranks_of_the_finest_variable(spark, monkeypatch):
    """Written and sent vectors of replicates grow with the values of the coarse variable only."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(x), float(x + y)) for i, (x, y) in enumerate(zip(rng.integers(0, 8, 4000), rng.normal(size=4000)))], "i int, x double, y double")
    sent = []
    real = S.replicate_ranks
    monkeypatch.setattr(S, "replicate_ranks", lambda *a: sent.append((out := real(*a)).count()) or out)
    row = S.spearman_test(df, [], "x", "y", 10, ["i"]).first()
    assert row.lo < row.rho < row.hi and sum(sent) <= 9


def test_rank_intervals_of_replicates_dealt_over_tasks(spark, monkeypatch):
    """A task takes a block of rows and seven of the replicates."""
    monkeypatch.setattr(S, "TASK_REPLICATES", 7)
    monkeypatch.setattr(S, "LOCAL_ROWS", 11)
    test_rank_intervals_like_resampled_rows(spark, monkeypatch, 3, 11)


def test_ranks_are_sent_in_four_bytes_to_few_blocks(spark):
    """40,000 rows that the former blocks of 32,768 would have cut in two."""
    rows = spark.range(40_000).select((F.col("id") * 1.0).alias("_v0"), (F.col("id") % 5 * 1.0).alias("_v1"), (F.col("id") * 7).alias("_low"), (F.col("id") * 11).alias("_high")).withColumn("_all", F.lit(0))
    coded = S.coded_rows(rows, ["_all"], ["_v0", "_v1"])
    assert coded.select("_block").distinct().count() == 1
    assert {len(r.ranks) for r in S.replicate_ranks(coded, ["_all"], 1, 10).collect()} == {40}
    wide = np.array([[1, 2], [1 << 40, -1]])
    assert (S.unpacked_numbers([*S.packed_numbers(wide).to_pylist(), *S.packed_numbers(wide[:1]).to_pylist()], 2) == np.vstack([wide, wide[:1]])).all()


@pytest.mark.parametrize("values, rows", [(512, 8192), (3, 11)])
def test_rank_intervals_like_resampled_rows(spark, monkeypatch, values, rows):
    """Rows repeated as drawn and ranked anew, with ties, a hot value and two groups."""
    monkeypatch.setattr(S, "RANGE_VALUES", values)
    monkeypatch.setattr(S, "WEIGHED_ROWS", rows)
    rng = np.random.default_rng(12)
    boot, data, df_rows = 20, {}, []
    for g, n in (("p", 90), ("q", 45)):
        c = rng.integers(0, 6, n).astype(float)
        x = np.where(rng.random(n) < 0.4, 1.0, np.round(rng.normal(size=n), 1)) + c
        y = np.round(x + rng.normal(size=n), 1)
        data[g] = np.stack([x, y, c])
        df_rows += [(g, i, *map(float, r)) for i, r in enumerate(data[g].T)]
    df = spark.createDataFrame(df_rows, "g string, i int, x double, y double, c double").repartition(3)
    plain = {r.g: r for r in S.spearman_test(df, ["g"], "x", "y", boot, ["g", "i"]).collect()}
    part = {r.g: r for r in S.partial_spearman(df, ["g"], "x", "y", ["c"], boot, ["g", "i"]).collect()}
    for g, v in data.items():
        low, high = np.array([group_key(0, g, i) for i in range(v.shape[1])], np.uint64).T
        rhos, partials = [], []
        for w in S.poisson_counts(low, high, boot).T:
            r = np.corrcoef(average_ranks(np.repeat(v, w, axis=1)))
            rhos.append(r[0, 1])
            partials.append((r[0, 1] - r[0, 2] * r[1, 2]) / np.sqrt((1 - r[0, 2] ** 2) * (1 - r[1, 2] ** 2)))
        assert [plain[g].lo, plain[g].hi] == pytest.approx(np.percentile(rhos, [2.5, 97.5])) and plain[g].lo < plain[g].rho < plain[g].hi
        assert [part[g].lo, part[g].hi] == pytest.approx(np.percentile(partials, [2.5, 97.5]))


def test_partial_spearman_matches_residuals(spark):
    rng = np.random.default_rng(8)
    c = rng.normal(size=(120, 2))
    x, y = c[:, 0] + rng.normal(size=120), c[:, 0] - c[:, 1] + rng.normal(size=120)
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([x, y, c])], "x double, y double, c double, d double")
    got = S.partial_spearman(df, [], "x", "y", ["c", "d"]).first()
    rk = lambda v: np.argsort(np.argsort(v)) + 1.0
    a = np.column_stack([np.ones(120), rk(c[:, 0]), rk(c[:, 1])])
    res = lambda v: v - a @ np.linalg.lstsq(a, v, rcond=None)[0]
    assert got.rho == pytest.approx(np.corrcoef(res(rk(x)), res(rk(y)))[0, 1]) and got.n == 120


def test_variance_partition_recovers_components(spark):
    rng = np.random.default_rng(6)
    rows = []
    a, b = rng.normal(0, 2.0, (3, 20)), rng.normal(0, 1.0, (3, 15))
    for g in range(3):
        for i in range(20):
            for j in range(15):
                rows.append((f"g{g}", f"a{i}", f"b{j}", "one", float(a[g, i] + b[g, j] + rng.normal(0, 0.5))))
    df = spark.createDataFrame(rows, "gene string, cell_line string, drug string, time string, value double")
    got = S.variance_partition(df, "gene", "value", ["cell_line", "drug", "time"], df.filter("gene = 'g0'"))
    assert got.columns == ["gene", "cell_line", "drug", "Residuals"]
    for r in got.collect():
        assert r.cell_line + r.drug + r.Residuals == pytest.approx(1.0)
        g = int(r.gene[1])
        va, vb = a[g].var(ddof=1), b[g].var(ddof=1)
        assert r.cell_line == pytest.approx(va / (va + vb + 0.25), abs=0.05)


def test_ridge_and_pca_match_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 5)) + 3
    y = x @ rng.normal(size=(5, 3)) + rng.normal(0, 0.1, (80, 3))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "i int, x array<double>, y array<double>").repartition(3)
    coef = M.ridge_fit(df, "x", "y", 0.5)
    z = np.hstack([x, np.ones((80, 1))])
    reg = np.eye(6) * 0.5
    reg[-1, -1] = 0
    want = np.linalg.solve(z.T @ z + reg, z.T @ y)
    assert np.allclose(coef, want)
    got = np.array([r.yhat for r in M.linear_predict(df, "x", coef).orderBy("i").collect()])
    assert np.allclose(got, z @ want)
    model = O.fit_pca(df, "x", 2)
    pc = np.array([r.pc for r in O.apply_pca(df, model, "x", "pc").orderBy("i").collect()])
    centred = x - x.mean(0)
    s = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(pc), np.abs(centred @ s[2][:2].T), atol=1e-8)


def test_permutation_test_finds_a_planted_set(spark):
    rng = np.random.default_rng(9)
    scores = np.sort(rng.normal(size=200))[::-1]
    rank = spark.createDataFrame([("p", f"g{i}", float(v)) for i, v in enumerate(scores)], "profile string, symbol string, score double")
    sets = [("c", "top", f"g{i}") for i in range(20)] + [("c", "mixed", f"g{i}") for i in range(5, 200, 9)] + [("c", "tiny", "g1")]
    r = {x.term: x for x in E.permutation_test(E.ranked_list(rank, ["profile"]), spark.createDataFrame(sets, "collection string, term string, symbol string"), ["profile"], 60).collect()}
    assert set(r) == {"top", "mixed"}
    assert r["top"].es == pytest.approx(1.0) and r["top"].nes > 1.5 and r["top"].nominal_p == 0 and r["top"].fwer_p == 0
    assert r["mixed"].nominal_p > 0.05


def walked(scores, members):
    """Enrichment score of a set of positions by walking the list."""
    total = sum(abs(scores[i]) for i in members)
    run, up, down = 0.0, -np.inf, np.inf
    for i, s in enumerate(scores):
        down = min(down, run) if i in members else down
        run += abs(s) / total if i in members else -1 / (len(scores) - len(members))
        up = max(up, run) if i in members else up
    return up if up >= -down else down


def test_permutation_test_like_a_plain_one(spark):
    """Two lists, two collections, 70 permutations in blocks of 30: every number again from whole arrays of null scores."""
    rng = np.random.default_rng(11)
    n, perms = 50, 70
    lists = {p: np.sort(rng.normal(size=n))[::-1] for p in ("a", "b")}
    sets = {("c", "top"): list(range(15)), ("c", "mixed"): list(range(3, 50, 3)), ("c", "low"): list(range(30, 50)), ("d", "odd"): list(range(1, 40, 2))}
    ranked = spark.createDataFrame([(p, f"g{i:02d}", float(v)) for p, s in lists.items() for i, v in enumerate(s)], "profile string, symbol string, score double")
    terms = spark.createDataFrame([(c, t, f"g{i:02d}") for (c, t), m in sets.items() for i in m], "collection string, term string, symbol string")
    got = {(r.profile, r.collection, r.term): r for r in E.permutation_test(E.ranked_list(ranked, ["profile"]), terms, ["profile"], perms, seed=5, block=30).collect()}
    moved = E.permuted_ranks(n, np.arange(perms), 5)
    assert sorted(map(tuple, np.sort(moved, axis=1).tolist())) == [tuple(range(n))] * perms and len(set(map(tuple, moved.tolist()))) == perms
    assert set(got) == {(p, *k) for p in lists for k in sets}
    for p, scores in lists.items():
        null = {k: np.array([walked(scores, {int(row[i]) for i in m}) for row in moved]) for k, m in sets.items()}
        seen = {k: walked(scores, set(m)) for k, m in sets.items()}
        up, down = ({k: v[v >= 0].mean() for k, v in null.items()}, {k: -v[v < 0].mean() for k, v in null.items()})
        norm = lambda k, v: np.where(v >= 0, v / up[k], v / down[k])
        for k in sets:
            r, es, nes = got[(p, *k)], seen[k], float(norm(k, np.array(seen[k])))
            mates = [m for m in sets if m[0] == k[0]]
            pool = np.concatenate([norm(m, null[m]) for m in mates])
            pool = np.abs(pool[(pool >= 0) == (nes >= 0)])
            own = np.abs([v for m in mates for v in [float(norm(m, np.array(seen[m])))] if (v >= 0) == (nes >= 0)])
            fdr = min(1, (pool >= abs(nes)).mean() / (own >= abs(nes)).mean())
            ends = np.stack([norm(m, null[m]) for m in mates])
            fwer = (ends.max(axis=0) >= nes).mean() if nes >= 0 else (ends.min(axis=0) <= nes).mean()
            same = null[k][np.sign(null[k]) == np.sign(es)]
            assert [r.es, r.nes, r.nominal_p, r.fdr_q, r.fwer_p, r.set_size] == pytest.approx([es, nes, (np.abs(same) >= abs(es)).mean(), fdr, fwer, len(sets[k])]), (p, k)


def test_enrichment_score_by_walking_the_list(spark):
    rng = np.random.default_rng(10)
    scores = np.sort(rng.normal(size=60))[::-1]
    members = set(rng.choice(60, 17, replace=False).tolist())
    total = sum(abs(scores[i]) for i in members)
    run, best = 0.0, 0.0
    for i, s in enumerate(scores):
        run += abs(s) / total if i in members else -1 / (60 - 17)
        best = run if abs(run) > abs(best) else best
    rank = E.ranked_list(spark.createDataFrame([("p", f"g{i:02d}", float(v)) for i, v in enumerate(scores)], "profile string, symbol string, score double"), ["profile"])
    sets = spark.createDataFrame([("c", "t", f"g{i:02d}") for i in members], "collection string, term string, symbol string")
    assert E.enrichment_scores(E.hits_of(rank, sets, ["profile"]), ["profile"]).first().es == pytest.approx(best)


def test_checks_fail_loudly(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z")], "k int, w string")
    with pytest.raises(C.DataError):
        C.validated_join(b, a, ["k"], validate="one_to_one")
    with pytest.raises(C.DataError):
        C.strict_lookup(a.withColumn("k", F.col("k") + 1), b, ["k"])
    with pytest.raises(C.DataError):
        C.require_columns(a, ["missing"])
    assert C.validated_join(a, b, ["k"], validate="many_to_one").count() == 2


def test_right_closed_bins(spark):
    edges = [-0.4, -0.3999, -0.3, -0.2999, 1.0, 1.01]
    df = spark.createDataFrame([(v,) for v in edges], "v double")
    assert [r[0] for r in df.select(S.right_closed_bin(F.col("v"), -0.4, 0.1, 14)).collect()] == [None, 0, 0, 1, 13, None]


def test_dose_one_hot_edges(spark):
    df = spark.createDataFrame([(d,) for d in ("0.001 uM", "1 uM", "100 uM", "1000 uM")], "d string")
    assert [r[0].index(1.0) for r in df.select(O.dose_one_hot(F.col("d"))).collect()] == [0, 3, 5, 6]


def test_single_level_has_no_one_hot(spark):
    df = spark.createDataFrame([("24 h",), ("24 h",)], "time string")
    assert [r.f for r in O.one_hot(df, "time", "f").collect()] == [[], []]


def test_pinned_split_precedence_and_quadrants(spark):
    obs = spark.createDataFrame([("a", " s1"), ("b", "s2"), ("c", "s2"), ("c", "s3")], "cell_line string, smiles string").withColumn("smiles", F.trim("smiles"))
    lines = spark.createDataFrame([("a", "val"), ("b", "test")], "cell_line string, split string")
    comps = spark.createDataFrame([("s1 ", "test"), ("s2", "val")], "smiles string, split string")
    got = {(r.cell_line, r.smiles): r.split for r in L.pinned_split(obs, lines, comps).collect()}
    assert got == {("a", "s1"): "test", ("b", "s2"): "test", ("c", "s2"): "val", ("c", "s3"): "train"}
    train = spark.createDataFrame([("x", "s")], "cell_line string, smiles string")
    probe = spark.createDataFrame([("x", "s"), ("x", "n"), ("y", "s"), ("y", "n")], "cell_line string, smiles string")
    assert {(r.cell_line, r.smiles): r.quadrant for r in L.quadrants(probe, train).collect()} == {("x", "s"): "Q1", ("x", "n"): "Q2", ("y", "s"): "Q3", ("y", "n"): "Q4"}


def test_ragged_reader(spark):
    path = scratch_path(spark, "ragged")
    lines = ["cell_line,drug,dose,rmse", 'A,"Dapagliflozin ((2S)-1,2-propanediol, hydrate)",1 uM,0.5', "A,Dapagliflozin ((2S)-1,2-propanediol, hydrate),1 uM,0.5", "B,plain,2 uM,0.1"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    got = sorted(tuple(r) for r in readers.read_ragged(spark, path, ["cell_line"], "drug", ["dose", "rmse"]).collect())
    d = "Dapagliflozin ((2S)-1,2-propanediol, hydrate)"
    assert got == [("A", d, "1 uM", "0.5"), ("A", d, "1 uM", "0.5"), ("B", "plain", "2 uM", "0.1")]


def test_lasso_meets_its_optimality_conditions(spark):
    from platewise.operators import scoring
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6)) * [1, 5, 0.2, 1, 2, 1]
    x[:, 5] = 7.0
    y = np.stack([x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=200), rng.normal(size=200)], axis=1) + 4
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>")
    w = scoring.lasso_fit(df, "x", "y", 0.1)
    sd = x.std(axis=0)
    for k in range(2):
        r = y[:, k] - x @ w[:6, k] - w[6, k]
        assert abs(r.mean()) < 1e-9
        for j in range(5):
            slope = (x[:, j] - x[:, j].mean()) @ r / 200 / sd[j]
            assert slope == pytest.approx(0.1 * np.sign(w[j, k]), abs=1e-8) if w[j, k] else abs(slope) <= 0.1 + 1e-8
    assert (w[5] == 0).all() and w[0, 0] > 0.5 and (w[:5, 1] == 0).any()
    with pytest.raises(ValueError, match="reduce them"):
        scoring.gram(spark.createDataFrame([([0.0] * 6000, [1.0])], "x array<double>, y array<double>"), "x", "y")


def test_curve_optimum_stands_where_a_fine_grid_does(spark):
    rng = np.random.default_rng(21)
    x = rng.integers(1, 40, 400).astype(float)
    y = 0.6 + 0.25 * x / (7.0 + x) + rng.normal(0, 0.01, 400)
    got = {r.family: r for r in S.curve_optimum(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double"), "x", "y").collect()}
    assert set(got) == {"log", "sqrt", "power", "saturating", "michaelis_menten"}

    def fit(g):
        b, a = np.polyfit(g, y, 1)
        r2 = np.corrcoef(g, y)[0, 1] ** 2
        return r2, b, a

    shapes = {"power": lambda k: x**k, "saturating": lambda k: 1 - np.exp(-x / k), "michaelis_menten": lambda k: x / (k + x)}
    for name, g in shapes.items():
        r = got[name]
        near = [fit(g(r.k * f))[0] for f in np.linspace(0.5, 2, 301)]
        r2, b, a = fit(g(r.k))
        assert r.r2 >= max(near) - 1e-12 and [r.r2, r.slope, r.intercept] == pytest.approx([r2, b, a], rel=1e-6)
        assert all(fit(g(r.k * f))[0] <= r.r2 + 1e-12 for f in (0.999, 0.999999, 1.000001, 1.001))
        assert r.adj_r2 == pytest.approx(1 - (1 - r2) * 399 / 397)
    for name, g in (("log", np.log(x)), ("sqrt", np.sqrt(x))):
        assert [got[name].k, got[name].r2] == pytest.approx([1.0, fit(g)[0]])
    assert abs(got["michaelis_menten"].k - 7) < 3 and S.curve_optimum(spark.createDataFrame([], "x double, y double"), "x", "y").collect() == []


def test_baselines_with_gaps(spark):
    rows = [("Q1", "c1", 0.5, 0.4, None), ("Q1", "c1", 0.7, 0.9, 0.1), ("Q1", "c2", 0.3, None, float("nan")), ("Q1", "c2", 0.9, 0.2, 0.3), ("Q2", "c3", 0.1, 0.1, 0.1)]
    got = {(r.quadrant, r.baseline): r for r in B.compare_baselines(spark.createDataFrame(rows, "quadrant string, cell string, m double, a double, b double"), ["quadrant"], "cell", "m", ["a", "b"]).collect()}
    r = got[("Q1", "a")]
    assert [r.n_obs, r.n_obs_paired, r.n_cell_lines, r.n_cl_wins] == [4, 3, 2, 1]
    assert [r.micro_model, r.micro_baseline, r.macro_model, r.macro_baseline] == pytest.approx([0.6, 0.5, 0.6, (0.65 + 0.2) / 2])
    assert got[("Q1", "b")].n_obs_paired == 2 and got[("Q2", "a")].p_obs is None and got[("Q2", "a")].micro_diff == 0


def test_correlation_of_pairs_writes_and_moves_no_pair(spark, monkeypatch):
    """q_sar_corr makes its pairs where they are needed: no checkpoint of them, and their groups' means are broadcast."""
    from platewise.plans import queries_stats as Q
    from platewise.plans.all_queries import QUERIES

    written = []
    for module in (Q, S):
        monkeypatch.setattr(module, "cut_lineage", lambda df: written.append(df) or df)
    df = QUERIES["q_sar_corr"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not written and "SortMergeJoin" not in plan[plan.index("MapInArrow"):plan.index("FlatMapGroupsInArrow")]


def test_pair_correlations_send_sums_alone(spark, monkeypatch):
    """Correlations and intervals of the pairs of `sar_pairs`, again from whole arrays; a tile sends one row of sums per representation, never a pair. A constant side has no correlation."""
    import hashlib

    from platewise.operators import pairs as R

    rng = np.random.default_rng(12)
    rows = [(f"L{k % 2}", "1 uM", "24 h", "P", None if k == 4 else f"d{k}", f"s{k:02d}", rng.normal(size=8).tolist(),
             None if k % 7 == 3 else (rng.random(8) < 0.5).astype(float).tolist(), [1.0, 2.0]) for k in range(40)]
    df = spark.createDataFrame(rows, "cell_line string, dose string, time string, plate string, drug string, smiles string, expr array<double>, bits array<double>, flat array<double>")
    reps = {"bits": "tanimoto", "flat": "tanimoto"}
    unit = ["cell_line", "representation", "dose", "time", "plate", "drug_i", "drug_j"]
    sent, real = [], S.tile_apply
    monkeypatch.setattr(S, "tile_apply", lambda *a: sent.append((out := real(*a)).count()) or out)
    got = {(r.cell_line, r.representation): r for r in S.pair_correlations(df, reps, ["cell_line"], unit, 50, tile_rows=8).collect()}
    assert len(sent) == 2 and max(sent) <= 2 * 2 * 6  # representations, cell lines, tiles of up to three blocks
    pairs = R.sar_pairs(df, reps).collect()
    for (line, rep), r in got.items():
        mine = [p for p in pairs if p.cell_line == line and p[f"{rep}_dist"] is not None]
        x, y = np.array([p[f"{rep}_dist"] for p in mine]), np.array([p.pearson for p in mine])
        assert r.n == len(mine)
        if rep == "flat":
            assert r.r is None
            continue
        keys = [hashlib.md5("|".join(["0", line, rep, "1 uM", "24 h", "P", *(d for d in (p.drug_i, p.drug_j) if d is not None)]).encode()).hexdigest() for p in mine]
        w = S.poisson_counts(np.array([int(k[:8], 16) for k in keys]), np.array([int(k[8:15], 16) for k in keys]), 50).astype(float)
        m = lambda v: (w * v[:, None]).sum(0) / w.sum(0)
        boots = (m(x * y) - m(x) * m(y)) / np.sqrt((m(x * x) - m(x) ** 2) * (m(y * y) - m(y) ** 2))
        assert [r.r, r.lo, r.hi] == pytest.approx([np.corrcoef(x, y)[0, 1], *np.quantile(boots, [0.025, 0.975])])
    assert set(got) >= {("L0", "bits"), ("L1", "bits")}


def test_drawn_sums_are_those_of_the_counts(monkeypatch):
    monkeypatch.setattr(S, "DRAWN_ROWS", 7)
    monkeypatch.setattr(S, "DRAWN_REPLICATES", 4)
    rng = np.random.default_rng(13)
    low, high, values = rng.integers(0, 2**32, 30), rng.integers(0, 2**28, 30), rng.normal(size=(3, 30))
    assert np.allclose(S.drawn_sums(values, low, high, 9), values @ S.poisson_counts(low, high, 9))


def test_poisson_counts_are_the_draws_of_the_formula():
    low, high = np.array([0, 1, 2**32 - 1, 77], np.int64), np.array([5, 2**28 - 1, 0, 9], np.int64)

    def mix(x):
        for _ in range(2):
            x = ((x ^ (x >> 16)) * 73244475) % 2**32
        return x ^ (x >> 16)

    want = [[sum(mix((int(a) + mix((int(h) + b * 2654435769) % 2**32)) % 2**32) / 2**32 >= p for p in S.POISSON_CDF) for b in range(3, 9)] for a, h in zip(low, high)]
    assert S.poisson_counts(low, high, 6, 3).tolist() == want


def test_stored_cells_spread_over_tasks(spark):
    """No file of the stored cells holds most rows of its directory."""
    from platewise.plans.catalog import Tables
    from platewise.plans.queries_sources import stored_cells

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        folder = stored_cells(Tables(spark, "/root/testdata/sf0.001"))
        for part in "ab":
            sizes = [r["count"] for r in spark.read.parquet(f"{folder}/{part}").groupBy(F.input_file_name()).count().collect()]
            assert max(sizes) < 0.5 * sum(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_permutation_test_holds_a_bounded_part_of_the_null(spark, monkeypatch):
    """Many sets get smaller blocks of null scores, lists travel in pieces and sets are scored in bundles; every number stays the same."""
    rng = np.random.default_rng(14)
    n = 60
    ranked = E.ranked_list(spark.createDataFrame([(p, f"g{i:02d}", float(v)) for p in "ab" for i, v in enumerate(rng.normal(size=n))], "profile string, symbol string, score double"), ["profile"])
    terms = spark.createDataFrame([("c", f"t{t}", f"g{i:02d}") for t in range(9) for i in rng.permutation(n)[:15 + t]], "collection string, term string, symbol string")
    tested = lambda: {(r.profile, r.term): [r.set_size, r.es, r.nes, r.nominal_p, r.fdr_q, r.fwer_p] for r in E.permutation_test(ranked, terms, ["profile"], 50, seed=3, block=20).collect()}
    whole = tested()
    made, real = [], E.null_scores
    monkeypatch.setattr(E, "null_scores", lambda *a: made.append(real(*a)) or made[-1])
    for name, value in (("LIST_ROWS", 7), ("NULL_VALUES", 40), ("SCORED_VALUES", 33)):
        monkeypatch.setattr(E, name, value)
    small = tested()
    held = made[0].groupBy("profile", "block").agg(F.sum(F.size("es0")).alias("n")).collect()
    assert len(held) == 2 * 13 and max(r.n for r in held) <= 40
    assert set(small) == set(whole) and len(whole) == 18
    for k, v in whole.items():
        assert small[k] == pytest.approx(v)


def test_null_tails_shuffle_null_scores_once(spark):
    """Null scores meet the sets' means in the task that ranks them, and sets without a normalised score take no part."""
    null = spark.createDataFrame([("c", t, b, v) for t, rows in (("x", ([0.5, -0.2], [0.1, -0.4])), ("y", ([0.3, 0.2], [-0.6, 0.4])), ("z", ([9.0, 9.0], [9.0, 9.0]))) for b, v in enumerate(rows)],
                                 "collection string, term string, block int, es0 array<double>")
    seen = spark.createDataFrame([("c", "x", 1.0, 0.3, 0.3), ("c", "y", -0.8, 0.3, 0.6)], "collection string, term string, nes double, m_up double, m_down double")
    out = E.null_tails(null, seen, ["collection"], 2)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.term: r for r in out.groupBy("term").sum("n_reach", "n_pool", "n_beyond", "n_perm").collect()}
    assert sorted(got) == ["x", "y"]
    assert [*got["x"]][1:] == [3, 5, 2, 4]
    assert [*got["y"]][1:] == [2, 3, 2, 4]


def test_scores_are_dealt_over_more_tasks_as_rows_grow(spark, monkeypatch):
    """Joined and averaged in parts of so many measurements, with the same scores."""
    from platewise.plans import inputs as I
    from platewise.plans.catalog import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    few = rows(I.scores(t))
    monkeypatch.setattr(I, "SCORE_ROWS", 500)
    parts = -(-t.lineitem.count() // 500)
    many = I.scores(t)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert parts > 4 and f", {parts}), REPARTITION_BY_NUM" in plan
    assert rows(many) == few


def test_quadrant_gain_makes_the_scores_once(spark, monkeypatch):
    from platewise.plans import inputs as I
    from platewise.plans import queries_stats as Q
    from platewise.plans.catalog import Tables
    made = []
    real = I.scores
    monkeypatch.setattr(I, "scores", lambda t: made.append(1) or real(t))
    assert Q.quadrant_gain(Tables(spark, "/root/testdata/sf0.001")).count() > 0
    assert len(made) == 1
