"""Tiled pair operators against brute force, with hot groups and small tiles."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import pairs as R
from platewise.operators import profiles as P
from platewise.operators import scoring as S
from platewise.operators import splits as L
from platewise.plans import ordering


def wells(spark, sizes, width=6, seed=0):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for g, n in enumerate(sizes):
        for i in range(n):
            rows.append(("c1", f"d{g}", f"S{g}", "1.0 uM", "24 h", f"p{i % 3}", f"s{k}", rng.integers(0, 4, width).astype(float).tolist()))
            k += 1
    return spark.createDataFrame(rows, "cell_line string, drug string, smiles string, dose string, time string, plate string, sample string, expr array<double>"), rows


def brute(rows, mode):
    out = {}
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            a, b = sorted((rows[i], rows[j]), key=lambda r: (r[5], r[6]))
            if a[1] == b[1] and (a[5] == b[5]) == (mode == "intra"):
                x, y = np.array(a[7]), np.array(b[7])
                r = np.corrcoef(x, y)[0, 1] if x.std() and y.std() else None
                out[(a[1], a[6], b[6])] = r
    return out


@pytest.mark.parametrize("mode", ["intra", "inter"])
@pytest.mark.parametrize("tile", [4, 256])
def test_replicate_pairs(spark, mode, tile):
    df, rows = wells(spark, [25, 2, 1])
    got = {(r.drug, r.rep_i, r.rep_j): r.pearson for r in R.replicate_pairs(df, mode, tile_rows=tile).collect()}
    want = brute(rows, mode)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, abs=1e-9))


def test_weakest_and_mean_pairs(spark):
    df, rows = wells(spark, [25, 4, 1])
    want = {}
    for (d, _, _), r in brute(rows, "inter").items():
        want.setdefault(d, []).append(r)
    low = {r.drug: r for r in R.weakest_pairs(df, "inter", tile_rows=4).collect()}
    mean = {r.drug: r for r in R.mean_pair_pearson(df, "inter").collect()}
    for d, rs in want.items():
        ok = [r for r in rs if r is not None]
        assert low[d].n_pairs == len(rs) and low[d].min_repro == pytest.approx(min(ok)) and low[d].n_undefined == len(rs) - len(ok)
        assert mean[d].n_pairs == len(ok) and mean[d].mean_pearson == pytest.approx(np.mean(ok))
    assert set(low) == set(want)


@pytest.mark.parametrize("mode", ["intra", "inter"])
def test_sample_pairs(spark, mode):
    df, rows = wells(spark, [25, 3, 1])
    want = brute(rows, mode)
    for cap in (7, 10_000):
        got = [(r.drug, r.rep_i, r.rep_j) for r in R.sample_pairs(df, cap, mode).collect()]
        assert len(got) == len(set(got)) and set(got) <= set(want)
        for d in {k[0] for k in want}:
            n = sum(k[0] == d for k in want)
            assert sum(g[0] == d for g in got) == min(cap, n)


def test_sar_missing_embedding_keeps_pair(spark):
    rows = [("c", "1", "t", "p", f"d{i}", f"s{i}", [float(i), 1.0, float(i * i)], [1.0, 0.0, 1.0] if i != 2 else None) for i in range(4)]
    df = spark.createDataFrame(rows, "cell_line string, dose string, time string, plate string, drug string, smiles string, expr array<double>, bits array<double>")
    got = {(r.smiles_i, r.smiles_j): r.bits_dist for r in R.sar_pairs(df, {"bits": "tanimoto"}, tile_rows=2).collect()}
    assert len(got) == 6 and got[("s0", "s1")] == 0.0 and got[("s1", "s2")] is None


@pytest.mark.parametrize("tile", [7, 2048])
def test_sar_pairs_strip_by_strip(spark, monkeypatch, tile):
    """Every pair and metric as by brute force: copies, close vectors of great length, a constant one, missing and empty fingerprints."""
    monkeypatch.setattr(R, "SAR_STRIP", 50)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6))
    x[5:9], x[9:12], x[12] = x[5], 1e4 * x[9] * (1 + 1e-7 * rng.normal(size=(3, 6))), 2.0
    bits = [None if k % 7 == 0 else (rng.random(5) < (0 if k % 9 == 0 else 0.5)).astype(float).tolist() for k in range(40)]
    rows = [("c", "1", "t", "p", f"d{k}", f"s{k * 37 % 40}", x[k].tolist(), bits[k], None) for k in range(40)]
    df = spark.createDataFrame(rows, "cell_line string, dose string, time string, plate string, drug string, smiles string, expr array<double>, bits array<double>, none array<double>")
    got = {(r.smiles_i, r.smiles_j): r for r in R.sar_pairs(df, {"bits": "tanimoto", "none": "cosine"}, tile_rows=tile).collect()}
    assert len(got) == 40 * 39 // 2
    by_name = sorted(rows, key=lambda r: r[5])
    for a, b in itertools.combinations(by_name, 2):
        r, u, v = got[(a[5], b[5])], np.array(a[6]), np.array(b[6])
        assert (r.drug_i, r.drug_j) == (a[4], b[4]) and [r.delta_norm_i, r.delta_norm_j] == pytest.approx([np.linalg.norm(u), np.linalg.norm(v)])
        assert r.l2 == pytest.approx(np.linalg.norm(u - v), rel=1e-12, abs=1e-300) and r.mse == pytest.approx(((u - v) ** 2).mean(), rel=1e-12, abs=1e-300)
        assert r.cosine == pytest.approx(u @ v / (np.linalg.norm(u) * np.linalg.norm(v) + 1.1920929e-7))
        flat = np.ptp(u) == 0 or np.ptp(v) == 0
        assert r.pearson is None and r.spearman is None if flat else r.pearson == pytest.approx(np.corrcoef(u, v)[0, 1])
        if a[7] is None or b[7] is None:
            assert r.bits_dist is None
        else:
            one, two = np.array(a[7]), np.array(b[7])
            either = np.maximum(one, two).sum()
            assert r.bits_dist == pytest.approx(1 - (one * two).sum() / either if either else 0.0)
        assert r.none_dist is None


def test_sar_tile_never_holds_all_its_pairs(spark, monkeypatch):
    import pyarrow as pa

    held = {}
    monkeypatch.setattr(R, "tile_apply", lambda tiled, by, fn, schema: held.update(fn=fn, tiled=tiled))
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("c", "1", "t", "p", f"d{k}", f"s{k}", rng.normal(size=4).tolist()) for k in range(600)],
                               "cell_line string, dose string, time string, plate string, drug string, smiles string, expr array<double>")
    R.sar_pairs(df, {})
    tile = pa.Table.from_pandas(held["tiled"].toPandas())
    assert tile.num_rows == 600  # one block: a row goes to one tile
    sizes = [b.num_rows for b in held["fn"](iter(tile.to_batches(max_chunksize=100)))]
    assert sum(sizes) == 600 * 599 // 2 and max(sizes) <= R.SAR_STRIP


def test_sar_rows_of_a_large_group_are_sent_to_few_tiles(spark, monkeypatch):
    """A group of 15 blocks of two rows has eight larger ones, since these are still small: a row is sent eight times, and all pairs are there. Blocks grow to their limit only."""
    rng = np.random.default_rng(8)
    rows = [("c", "1", "t", "p", f"d{k}", f"s{k}", rng.normal(size=4).tolist(), rng.integers(0, 2, 5).astype(float).tolist()) for k in range(30)]
    df = spark.createDataFrame(rows, "cell_line string, dose string, time string, plate string, drug string, smiles string, expr array<double>, bits array<double>")
    sent, real = [], R.tile_apply
    monkeypatch.setattr(R, "tile_apply", lambda tiled, *a: sent.append(tiled.count()) or real(tiled, *a))
    want = {(f"s{i}", f"s{j}") for i in range(30) for j in range(30) if f"s{i}" < f"s{j}"}
    pairs = lambda: [(r.smiles_i, r.smiles_j) for r in R.sar_pairs(df, {"bits": "tanimoto"}, tile_rows=2).collect()]
    got = pairs()
    assert sent[0] == 8 * 30 and len(got) == len(want) and set(got) == want
    monkeypatch.setattr(R, "SAR_MOST_ROWS", 3)
    got = pairs()
    assert sent[1] == 10 * 30 and len(got) == len(want) and set(got) == want


def test_sar_pairs_make_the_wanted_columns_alone(spark):
    rng = np.random.default_rng(7)
    rows = [("c", "1", "t", "p", f"d{k}", f"s{k}", rng.normal(size=4).tolist(), rng.integers(0, 2, 5).astype(float).tolist(), 2.5) for k in range(12)]
    df = spark.createDataFrame(rows, "cell_line string, dose string, time string, plate string, drug string, smiles string, expr array<double>, bits array<double>, dose_um double")
    full = R.sar_pairs(df, {"bits": "tanimoto"})
    for some in (["drug_j", "pearson"], ["smiles_i", "smiles_j", "bits_dist"], ["cell_line", "l2", "delta_norm_i", "drug_i"]):
        part = R.sar_pairs(df, {"bits": "tanimoto"}, tile_rows=5, columns=some)
        flat = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
        assert part.columns == some and flat(part) == flat(full.select(*some))
    assert {r.dose_um for r in R.sar_pairs(df, {}, columns=["dose_um"], context=["dose_um"]).collect()} == {2.5}


def test_fingerprint_only_tiles_are_large_and_carry_no_other_vector(spark):
    """The sf0.1 compounds of q_sar_fingerprint_only, all in one context, are one tile, so each row is shuffled once; compounds without a fingerprint are left out."""
    from platewise.plans.queries_pairs import sar_rows
    from platewise.plans.catalog import Tables

    rows = sar_rows(Tables(spark, "/root/testdata/sf0.1")).withColumn("cell_line", F.lit("L"))
    held = {}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(R, "tile_apply", lambda tiled, by, fn, schema: held.update(tiled=tiled))
        R.sar_pairs(rows, {"ecfp": "tanimoto"}, required=["ecfp"])
    per_row = held["tiled"].groupBy("cell_line", "smiles").agg(F.count(F.lit(1)).alias("n"), F.count("ecfp").alias("bits"))
    assert {(r.n, r.bits) for r in per_row.select("n", "bits").distinct().collect()} == {(1, 1)} and "dense" not in held["tiled"].columns


def test_sar_export_parses_no_pair(spark):
    """Between the tiles of q_sar_export and its result no text is parsed, and its tiles send no column that it drops."""
    from platewise.plans.all_queries import QUERIES

    df = QUERIES["q_sar_export"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("FlatMapGroupsInArrow")]
    assert "regexp" not in above.lower() and "delta_norm" not in plan[:plan.index("FlatMapGroupsInArrow") + 600]
    assert {(r.dose_um, r.time_h) for r in df.collect()} == {(1.0, 24.0)}


def test_context_correlations_counts_constants_as_zero(spark):
    rows = [("a", "d1", [1.0, 2.0, 3.0]), ("b", "d1", [2.0, 4.0, 6.0]), ("a", "d2", [1.0, 1.0, 1.0]), ("b", "d2", [3.0, 1.0, 2.0]), ("c", "d2", [1.0, 2.0, 4.0])]
    df = spark.createDataFrame(rows, "cell_line string, drug string, expr array<double>").withColumn("dose", F.lit("1")).withColumn("time", F.lit("t"))
    got = {(r.cl_i, r.cl_j): (r.mean_delta_pearson, r.n_conditions) for r in R.context_correlations(df).collect()}
    assert got == {("a", "b"): (pytest.approx(0.5), 2), ("b", "a"): (pytest.approx(0.5), 2)}


def fingerprints(spark, n=120, width=16, seed=3):
    rng = np.random.default_rng(seed)
    base = (rng.random((12, width)) < 0.4).astype(float)
    pts = [np.abs(base[rng.integers(12)] - (rng.random(width) < 0.06)).tolist() for _ in range(n)]
    pts += [pts[0]] * 5 + [[0.0] * width] * 2
    return spark.createDataFrame([(i, p) for i, p in enumerate(pts)], "id bigint, bits array<double>"), np.array(pts)


def tanimoto(pts):
    both = pts @ pts.T
    either = pts.sum(1)[:, None] + pts.sum(1)[None, :] - both
    return 1 - np.divide(both, either, out=np.ones_like(both), where=either > 0)


@pytest.mark.parametrize("tile", [5, 1024])
def test_neighbour_pairs(spark, tile):
    df, pts = fingerprints(spark)
    d = tanimoto(pts)
    first = {tuple(p): i for i, p in reversed(list(enumerate(pts.tolist())))}
    reps = sorted(first.values())
    want = {(i, j) for i in reps for j in reps if i < j and d[i, j] <= 0.4}
    points = R.distinct_fingerprints(df, "id", "bits")
    assert {(r.id_i, r.id_j) for r in R.neighbour_pairs(points, 0.4, tile_rows=tile).collect()} == want


def test_neighbour_pairs_include_copies(spark, tmp_path):
    """q_neighbor_pairs returns every pair within the cutoff, those of vectors with equal fingerprints (empty ones, too) and all pairs of their copies, as its SQL does; a missing vector has none."""
    import duckdb

    from platewise.plans.all_queries import ORACLES, QUERIES

    pts = np.vstack([np.random.default_rng(6).normal(size=(12, 64)), -np.ones((3, 64))])[[*range(15), 0, 0, 5, 12]]
    rows = [(i, p.tolist()) for i, p in enumerate(pts)]
    folder = str(tmp_path)
    spark.createDataFrame([*((i, p, 0) for i, p in rows), (99, None, 0)], "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    d = tanimoto((pts > 0).astype(float))
    want = {(i, j): round(d[i, j], 6) for i in range(len(pts)) for j in range(i + 1, len(pts)) if d[i, j] <= 0.55}
    got = {(r.id_i, r.id_j): r.dist for r in QUERIES["q_neighbor_pairs"](spark, folder).collect()}
    assert got == want and {(0, 15), (0, 16), (15, 16), (5, 17), (12, 13), (13, 18)} <= set(got)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    assert {(i, j): v for i, j, v in con.execute(f"SELECT id_i, id_j, dist FROM ({ORACLES['q_neighbor_pairs']})").fetchall()} == want


def test_neighbour_tile_sends_its_pairs_in_strips(spark, monkeypatch):
    """A tile whose rows are all neighbours sends its pairs in small batches; it never makes one table of them."""
    import pyarrow as pa
    from pyspark.sql.group import GroupedData

    kept, real = [], GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, fn, schema: kept.append(fn) or real(self, fn, schema))
    R.neighbour_pairs(spark.range(4).select("id", F.array(F.col("id")).alias("words"), F.lit(8).alias("popcount")), 0.4)
    n = 700
    tile = pa.table({"pc1": [3] * n, "b1": [0] * n, "pc2": [3] * n, "b2": [0] * n, "_side": [0] * n, "id": list(range(n)), "words": [[7]] * n})
    sent = [(b.num_rows, set(zip(b["id_i"].to_pylist(), b["id_j"].to_pylist()))) for b in kept[0](iter(tile.to_batches()))]
    assert max(rows for rows, _ in sent) <= R.STRIP_PAIRS and sum(rows for rows, _ in sent) == n * (n - 1) // 2
    assert set().union(*(pairs for _, pairs in sent)) == {(i, j) for j in range(n) for i in range(j)}


def test_leader_clusters_equal_the_sequential_walk(spark):
    df, pts = fingerprints(spark)
    near = tanimoto(pts) <= 0.4
    n = len(pts)
    # copies of a fingerprint follow their first id
    first = {}
    for i, p in enumerate(pts.tolist()):
        first.setdefault(tuple(p), i)
    rep = [first[tuple(p)] for p in pts.tolist()]
    count = near.sum(1) - 1
    owner = {}
    for i in sorted(set(rep), key=lambda i: (-count[i], -i)):
        if i not in owner:
            for j in range(n):
                if near[i, j] and rep[j] not in owner:
                    owner[rep[j]] = i
            owner[i] = i
    got = {r.id: r.centroid for r in L.leader_clusters(df, "id", "bits", 0.4).collect()}
    assert got == {j: owner[rep[j]] for j in range(n)}


@pytest.mark.parametrize("head", [3, 8192])
def test_leader_clusters_write_no_neighbour_pairs(spark, monkeypatch, head):
    """Where a tenth of all pairs are neighbours, what is written grows with the points, not with the pairs."""
    rng = np.random.default_rng(5)
    pts = rng.integers(0, 2, (600, 64))
    written = []
    monkeypatch.setattr(L, "cut_lineage", lambda df: written.append((out := ordering.cut_lineage(df)).count()) or out)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts.astype(float))], "id bigint, bits array<double>")
    got = {r.id: (r.centroid, r.neighbours) for r in L.leader_clusters(df, "id", "bits", 0.55, **({} if head == 8192 else {"head": head})).collect()}
    near = tanimoto(pts.astype(float)) <= 0.55
    count, owner = near.sum(1) - 1, {}
    for i in sorted(range(600), key=lambda i: (-count[i], -i)):
        if i not in owner:
            owner |= {int(j): i for j in np.flatnonzero(near[i]) if j not in owner}
    assert got == {j: (owner[j], count[owner[j]]) for j in range(600)}
    assert max(written) <= 600


def test_fill_split_walk(spark):
    sizes = [5, 4, 3, 3, 2, 1, 1, 1, 1, 1, 1, 1]
    df = spark.createDataFrame(list(enumerate(sizes)), "o int, size int")
    got = {r.o: r.split for r in L.fill_split(df, [F.asc("o")], "o").collect()}
    n = dict(train=0, val=0, test=0)
    for o, s in enumerate(sizes):
        seen = sum(n.values()) + s
        part = "train" if n["train"] < 0.8 * seen else "val" if n["val"] < 0.1 * seen else "test"
        n[part] += s
        assert got[o] == part


@pytest.mark.parametrize("val, test", [(0.1, 0.1), (0.3, 0.0), (0.25, 0.05), (0.45, 0.45), (0.0, 0.2)])
def test_fill_split_over_runs_and_blocks(spark, val, test):
    rng = np.random.default_rng(int(100 * val))
    for sizes in (np.sort(rng.geometric(0.3, 400))[::-1], rng.integers(1, 40, 60), np.repeat([500, 1], [1, 300]), np.repeat([3, 1, 7], [90, 200, 50])):
        sizes = sizes.tolist()
        state, expect = L.walk((0, 0, 0), sizes, 1.0 - val - test, val)
        got = (0, 0, 0)
        for s, run in itertools.groupby(sizes):
            got = L.after_run(got, s, len(list(run)), 1.0 - val - test, val)
        assert got == state
    df = spark.createDataFrame(list(enumerate(sizes)), "o int, size int").repartition(4)
    got = {r.o: r.split for r in L.fill_split(df, [F.asc("o")], "o", val=val, test=test, block=37).collect()}
    assert [got[i] for i in range(len(sizes))] == expect


def test_numbered_places(spark):
    rng = np.random.default_rng(8)
    rows = [("hot" if i % 3 else None if i % 2 else "b", int(v)) for i, v in enumerate(rng.integers(0, 30, 500))]
    got = ordering.numbered(spark.createDataFrame(rows, "g string, v int").repartition(7), ["g"], [F.desc("v")], "r", "n").collect()
    for g in ("hot", "b", None):
        own = sorted((r.r, r.v, r.n) for r in got if r.g == g)
        want = sorted((v for k, v in rows if k == g), reverse=True)
        assert [r[0] for r in own] == list(range(1, len(want) + 1)) and [r[1] for r in own] == want and {r[2] for r in own} == {len(want)}


def test_ranks_of_infinite_values(spark):
    x = [float("inf"), float("-inf"), 1.0, 1.0 + 1e-12, -0.0, 1e300, -1e300, 5e-324, float("inf")]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    ranks = average_rank_map(np.array(x))
    assert [r.r for r in ordering.with_average_rank(df, [], "v", "r").collect()] and all(r.r == ranks[r.v] for r in ordering.with_average_rank(df, [], "v", "r").collect())


def test_values_close_together_beside_their_size_spread_over_ranges(spark):
    """Time stamps of one day: few coarse ranges, many fine ones."""
    rng = np.random.default_rng(3)
    x = (1.7e9 + rng.integers(0, 86_400, 3000)).tolist() + [-1.7e9 - 5, -1.7e9, 0.0]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    ranks = average_rank_map(np.array(x))
    assert all(r.r == ranks[r.v] for r in ordering.with_average_rank(df, [], "v", "r").collect())
    per = df.select(ordering.range_of(F.col("v")).alias("c"), ordering.range_of(F.col("v"), ordering.FINE).alias("f"), "v").distinct()
    assert per.select("c").distinct().count() < 6 and per.groupBy("f").count().agg(F.max("count")).first()[0] < 400
    assert per.filter(F.floor(F.col("f") / ordering.FINE) != F.col("c")).filter("v > 0").count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(d[i])[:4]}
    assert {(r.id, r.neighbour) for r in R.nearest_neighbours(df, "id", "v", 4, tile_rows=16).collect()} == want


def test_centroid_accuracy(spark):
    rows = [("a", "1", [0.0, 0.0], [0.1, 0.0]), ("a", "2", [1.0, 0.0], [0.0, 0.0]), ("a", "3", [0.0, 1.0], [0.0, 1.0]), ("b", "4", [0.0, 0.0], [1.0, 1.0]),
            ("c", "5", [0.0, 1.0], [0.0, 0.0]), ("c", "6", [1.0, 0.0], [0.0, 0.0])]
    df = spark.createDataFrame(rows, "ctx string, sample string, y array<double>, yhat array<double>")
    for tile in (1, 512):
        got = {r.sample: r.centroid_accuracy for r in S.centroid_accuracy(df, ["ctx"], F.col("sample"), ["sample"], tile).collect()}
        assert got == {"1": 1.0, "2": 0.0, "3": 1.0, "4": None, "5": 0.0, "6": 0.0}


def test_delta_uses_unweighted_control_mean_and_drops_unmatched(spark):
    rows = [("c", "k1", "p1", "DMSO", 10.0, [(0, 1.0)]), ("c", "k2", "p1", "DMSO", 1000.0, [(0, 3.0), (1, 2.0)]), ("c", "t1", "p1", "x", 5.0, [(0, 5.0)]), ("c", "t2", "p2", "x", 5.0, [(1, 1.0)])]
    df = spark.createDataFrame(rows, "cell_line string, sample string, plate string, drug string, total_umis double, entries array<struct<pos:int,val:double>>").withColumn("time", F.lit("24 h"))
    got = P.delta_of_sparse(df, "DMSO", 3).collect()
    assert [(r.sample, r.expr) for r in got] == [("t1", [3.0, -1.0, 0.0])]
    missing = P.unmatched_controls(df.filter("drug = 'DMSO'"), df.filter("drug <> 'DMSO'")).collect()
    assert [tuple(r) for r in missing] == [("c", "p2", "24 h")]


def test_pseudobulk_counts_cells_before_the_gene_filter(spark):
    cells = spark.createDataFrame([(1, "c", "s", "x"), (2, "c", "s", "x"), (3, "c", "z", "x")], "barcode int, cell_line string, sample string, drug string")
    measured = spark.createDataFrame([(1, "g1", 2.0), (1, "g2", 3.0), (1, "other", 9.0), (2, "other", 1.0)], "barcode int, gene string, cnt double")
    genes = P.gene_dimension(spark.createDataFrame([("g1",), ("g2",)], "gene string"))
    got = {r["sample"]: r for r in P.dense(P.log_normalize(P.sparse_pseudobulk(cells, measured, genes)), 2).collect()}
    assert got["s"].total_cells == 2 and got["s"].total_umis == 5.0
    assert got["s"].expr == pytest.approx([np.log1p(4000), np.log1p(6000)])
    assert got["z"].expr == [0.0, 0.0] and got["z"].total_umis == 0.0


@pytest.fixture
def force_ranges(monkeypatch):
    monkeypatch.setattr(ordering, "STEPS", 3)
    monkeypatch.setattr(ordering, "FINE", 2)


def test_ranks_and_quantiles_by_ranges(spark, force_ranges):
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g in "ab" for v in rng.integers(0, 40, 200)] + [("a", 7.0)] * 150 + [("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    q = {r.g: r for r in ordering.exact_quantiles(df, ["g"], "v", {"q": 0.3, "m": 0.5}).collect()}
    for g in "ab":
        x = np.array([v for k, v in rows if k == g and v is not None and v == v])
        assert q[g].q == pytest.approx(np.quantile(x, 0.3)) and q[g].m == pytest.approx(np.median(x))
        ranks = average_rank_map(x)
        got = ordering.with_average_rank(df.filter(F.col("g") == g), [], "v", "r").filter("r is not null").collect()
        assert len(got) == len(x) and all(r.r == ranks[r.v] for r in got)


def average_rank_map(x):
    s = np.sort(x)
    return {v: (np.searchsorted(s, v, "left") + np.searchsorted(s, v, "right") + 1) / 2 for v in set(x.tolist())}


def test_bh_by_ranges(spark, force_ranges):
    from platewise.operators.statistics import bh_fdr
    rng = np.random.default_rng(4)
    p = np.round(rng.random(80) ** 2, 2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(99, float("nan"))], "i int, p double")
    got = {r.i: r.q for r in bh_fdr(df, "p").collect()}
    order = np.argsort(p)
    q = np.minimum.accumulate((p[order] * len(p) / (np.arange(len(p)) + 1))[::-1])[::-1]
    for k, v in zip(order, q):
        assert got[int(k)] == pytest.approx(min(1, v))
    assert got[99] is None


def test_wide_distances_move_no_pair(spark):
    """Between the tiles and the result of q_sar_wide stands no aggregate and no exchange."""
    from platewise.plans.all_queries import QUERIES

    plan = QUERIES["q_sar_wide"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("FlatMapGroupsInArrow")]
    assert "Aggregate" not in above and "Exchange" not in above


def test_nearest_neighbours_among_copies_and_close_ones(spark, monkeypatch):
    """Copies tie by id, vectors closer together than single precision tells apart are ordered by their own distances, and a zero vector has no neighbour."""
    monkeypatch.setattr(R, "CLOSEST_ROWS", 7)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 5))
    v[10:30] = v[10]
    v[30:45] = v[30] * (1 + 1e-9 * rng.normal(size=(15, 5)))
    v[50] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    unit = v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, np.nan)
    want = {}
    for i in range(60):
        d = 1.0 - np.einsum("rc,rc->r", unit, np.broadcast_to(unit[i], unit.shape))
        want[i] = [j for _, j in sorted((x, j) for j, x in enumerate(d) if j != i and not np.isnan(x))[:4]]
    for tile in (9, 1000):
        got = {}
        for r in sorted(R.nearest_neighbours(df, "id", "v", 4, tile_rows=tile).collect(), key=lambda r: (r.id, r.rank)):
            got.setdefault(r.id, []).append(r.neighbour)
        assert got == {i: w for i, w in want.items() if w}


def test_neighbour_tiles_send_a_row_few_times(spark, monkeypatch):
    """20,000 fingerprints of as many set bits: three blocks, so a row goes to three tiles."""
    points = spark.range(20_000).select("id", F.array(F.col("id")).alias("words"), F.lit(1).alias("copies"), F.lit(8).alias("popcount"))
    sent = []
    real = R.band_tiles
    monkeypatch.setattr(R, "band_tiles", lambda *a: sent.append((out := real(*a)).count()) or out)
    R.neighbour_pairs(points, 0.4)
    assert sent[0] <= 3 * 20_000
