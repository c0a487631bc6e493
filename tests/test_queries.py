"""Every registered query with an oracle against DuckDB at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in NAMES.split():
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return c


def canonical(rows, cols):
    def cell(v):
        if v is None or isinstance(v, (str, bool)):
            return v
        if isinstance(v, (list, tuple)):
            return str([cell(x) for x in v])
        try:
            f = float(v)
        except (TypeError, ValueError):
            return str(v)
        return None if math.isnan(f) else round(f, 5) + 0.0
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


FAST = ["q_delta_profile", "q_pseudobulk", "q_repro_inter", "q_max_pairs", "q_filter_by_repro", "q_sar_table", "q_neighbor_pairs", "q_knn_cosine", "q_metrics_per_obs",
        "q_systema_metrics", "q_fill_split", "q_pinned_split", "q_bootstrap_ci", "q_wilcoxon", "q_bh_fdr", "q_gsea_edge", "q_stream_pseudobulk", "q_ragged_csv", "q_run_registry",
        "q_variance_partition", "q_long_statistics", "q_histogram"]


#: PLATEWISE_ALL_ORACLES=1 runs every oracle in one session (about ten minutes).
NAMES_TO_RUN = sorted(n for n in entry_points.oracle_sql() if n.startswith("q_")) if os.environ.get("PLATEWISE_ALL_ORACLES") else FAST


@pytest.mark.parametrize("name", NAMES_TO_RUN)
def test_query_equals_oracle(spark, con, name):
    df = entry_points.queries()[name](spark, SF)
    res = con.execute(entry_points.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(res.fetchall(), cols)


#: Queries that SQL cannot express, and the tests that hold their operators against brute force or optimality conditions.
BY_HAND = {"q_pca": "test_stats.py::test_ridge_and_pca_match_numpy", "q_ridge": "test_stats.py::test_ridge_and_pca_match_numpy", "q_lasso": "test_stats.py::test_lasso_meets_its_optimality_conditions",
           "q_gbt": "test_boosting.py::test_every_output_like_a_plain_version", "q_butina": "test_pairs.py::test_leader_clusters_equal_the_sequential_walk",
           "q_variance_components": "test_stats.py::test_variance_partition_recovers_components", "q_curve_optimum": "test_stats.py::test_curve_optimum_stands_where_a_fine_grid_does"}


def test_every_query_has_an_oracle_or_a_named_test():
    q, o = entry_points.queries(), entry_points.oracle_sql()
    assert set(o) <= set(q) and len(q) > 140
    q, o = ({n for n in names if n.startswith("q_")} for names in (q, o))
    assert q - o == set(BY_HAND)
    for where in BY_HAND.values():
        file, name = where.split("::")
        with open(os.path.join(os.path.dirname(__file__), file)) as f:
            assert f"def {name}(" in f.read(), where
