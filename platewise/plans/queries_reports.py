"""Sampling, result tables and the streaming pseudobulk."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.functions import text as X
from platewise.operators import pairs as R
from platewise.operators import profiles as P
from platewise.operators import reports as B
from platewise.operators import statistics as S
from platewise.operators import summaries as M
from platewise.plans import inputs as I
from platewise.plans.catalog import Tables, query
from platewise.plans.oracle import cte
from platewise.plans.queries_pairs import OBS, sar
from platewise.plans.queries_sources import run_text
from platewise.plans.queries_splits import smiles_split
from platewise.plans.queries_stats import BOOT, FACTORS, boot_sql, correlation_t, student_p
from platewise.session import scratch_path
from platewise.streaming import pseudobulk as Z

cte("wells", "SELECT o_orderkey, o_custkey::VARCHAR AS cell_line, CAST(year(o_orderdate) AS VARCHAR) AS plate FROM orders")


def wells(t: Tables):
    return t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("cell_line"), F.year("o_orderdate").cast("string").alias("plate"))


@query("q_min_plates", "SELECT * FROM wells WHERE cell_line IN (SELECT cell_line FROM wells GROUP BY 1 HAVING count(DISTINCT plate) >= 6)")
def min_plates(t):
    return B.lines_on_plates(wells(t), 6)


cte("line_plates", "SELECT o_orderkey, o_orderpriority AS cell_line, concat('PL', o_custkey % 500) AS plate FROM orders")


@query("q_sample_plates", """
SELECT * FROM line_plates WHERE plate IN (SELECT plate FROM (SELECT cell_line, plate, row_number() OVER (PARTITION BY cell_line ORDER BY md5(concat_ws('|', '42', cell_line, plate))) AS rn
 FROM (SELECT DISTINCT cell_line, plate FROM line_plates)) WHERE rn <= 20)
""")
def sample_plates(t):
    w = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("cell_line"), F.concat(F.lit("PL"), F.col("o_custkey") % 500).alias("plate"))
    return B.sample_plates(w, 20)


@query("q_sample_per_plate", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY plate ORDER BY md5(concat_ws('|', '42', plate, o_orderkey)), o_orderkey) AS rn FROM wells) WHERE rn <= 25
""")
def sample_per_plate(t):
    return B.sample_per_group(wells(t), ["plate"], ["o_orderkey"], 25)


@query("q_export_profiles", """
WITH e AS (SELECT DISTINCT cell_line, sample, plate, drug, dose, time FROM delta_long), a AS (SELECT * FROM e WHERE cell_line IN (SELECT cell_line FROM e GROUP BY 1 HAVING count(DISTINCT plate) >= 3)),
b AS (SELECT * FROM a WHERE plate IN (SELECT plate FROM (SELECT plate, row_number() OVER (PARTITION BY cell_line ORDER BY md5(concat_ws('|', '42', cell_line, plate))) AS rn FROM (SELECT DISTINCT cell_line, plate FROM a)) WHERE rn <= 2)),
k AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY plate ORDER BY md5(concat_ws('|', '42', plate, cell_line, sample)), cell_line, sample) AS rn FROM b) WHERE rn <= 15)
SELECT k.cell_line, k.sample, k.plate, k.drug, k.dose, k.time, d.gene_idx, d.value FROM k JOIN delta_long d USING (cell_line, sample, plate, drug, dose, time)
""", "value")
def export_profiles(t):
    """Sampled delta profiles written with their labels and read back in long form."""
    folder = scratch_path(t.spark, "export")
    B.export_profiles(I.delta(t), folder, 3, 2, 15)
    return t.spark.read.parquet(folder).select("cell_line", "sample", "plate", "drug", "dose", "time", F.posexplode("expr").alias("gene_idx", "value"))


cte("registry", r"""
SELECT regexp_extract(dir_name, '^(.*)_\d{4}-\d{2}-\d{2}_\d{6}$', 1) AS experiment, regexp_extract(dir_name, '_(\d{4}-\d{2}-\d{2}_\d{6})$', 1) AS stamp, run_id, val_spearman, test_pearson, n_train FROM run_text
""")


def registry(t: Tables):
    return B.run_registry(run_text(t), keep=None)


@query("q_best_run", "SELECT experiment, run_id, val_spearman FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY val_spearman DESC, stamp, run_id) AS rn FROM registry) WHERE rn = 1", "val_spearman")
def best_run(t):
    return M.best_per_group(registry(t), ["experiment"], "val_spearman", ["stamp", "run_id"]).select("experiment", "run_id", "val_spearman")


@query("q_perobs", """
SELECT experiment, run_id, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY val_spearman DESC, stamp, run_id) AS rn FROM registry) JOIN orders ON run_id = o_custkey WHERE rn = 1
""", "o_totalprice")
def perobs(t):
    best = M.best_per_group(registry(t), ["experiment"], "val_spearman", ["stamp", "run_id"]).select("experiment", "run_id")
    return best.join(t.orders.select(F.col("o_custkey").alias("run_id"), "o_orderkey", "o_totalprice"), "run_id")


cte("split_scores", "SELECT s.*, p.split FROM scores s JOIN smiles_split p USING (smiles)")


def split_scores(t: Tables):
    s = I.scores(t)
    return s.join(smiles_split(s), "smiles")


@query("q_run_stats", """
WITH b AS (SELECT * FROM split_scores WHERE NOT (arm = 'reference' AND substr(md5(drug), 1, 1) < '4')),
k AS (SELECT cell_line, drug, smiles, dose, time FROM b WHERE split = 'test' AND arm <> 'train_mean' GROUP BY ALL HAVING count(DISTINCT arm) = 2),
r AS (SELECT * FROM b WHERE split <> 'test' OR arm = 'train_mean' UNION ALL SELECT b.* FROM b SEMI JOIN k USING (cell_line, drug, smiles, dose, time) WHERE split = 'test' AND arm <> 'train_mean')
SELECT arm, split, count(*) AS n, avg(pearson) AS pearson_mean, avg(l2) AS l2_mean, stddev_pop(pearson) AS pearson_std, stddev_pop(l2) AS l2_std FROM r GROUP BY ALL
""", "pearson_mean l2_mean pearson_std l2_std")
def run_stats(t):
    b = split_scores(t).filter(~((F.col("arm") == "reference") & (F.substring(F.md5("drug"), 1, 1) < "4")))
    kept = B.shared_cohort(b, OBS, "arm", exempt=(F.col("split") != "test") | (F.col("arm") == "train_mean"))
    return B.run_statistics(kept, ["arm", "split"], ["pearson", "l2"])


@query("q_baseline_summary", """
SELECT arm, split, count(*) AS n, avg(pearson) AS pearson_mean, avg(rmse) AS rmse_mean, stddev_pop(pearson) AS pearson_std, stddev_pop(rmse) AS rmse_std FROM split_scores WHERE arm <> 'model' GROUP BY ALL
""", "pearson_mean rmse_mean pearson_std rmse_std")
def baseline_summary(t):
    s = split_scores(t)
    both = s.filter("arm = 'reference'").unionByName(s.filter("arm = 'train_mean'"))
    return B.run_statistics(both, ["arm", "split"], ["pearson", "rmse"])


@query("q_arm_substitution", """
WITH a AS (SELECT cell_line AS dataset, drug AS label, dose, arm = 'model' AS gated, pearson FROM scores WHERE arm = 'reference' OR (arm = 'model' AND substr(md5(drug), 1, 1) < '8'))
SELECT * FROM a WHERE gated UNION ALL SELECT * FROM a WHERE NOT gated AND NOT EXISTS (SELECT 1 FROM a g WHERE g.gated AND g.dataset = a.dataset AND g.label = a.label AND g.dose = a.dose)
""", "pearson")
def arm_substitution(t):
    s = I.scores(t).filter((F.col("arm") == "reference") | ((F.col("arm") == "model") & (F.substring(F.md5("drug"), 1, 1) < "8")))
    a = s.select(F.col("cell_line").alias("dataset"), F.col("drug").alias("label"), "dose", (F.col("arm") == "model").alias("gated"), "pearson")
    return B.substitute_arm(a, ["dataset", "label", "dose"], F.col("gated"))


@query("q_representation_coverage", """
WITH i AS (SELECT concat('v', vec_id) AS smiles FROM embeddings UNION SELECT concat('v', p_partkey) FROM part),
r AS (SELECT 'dense' AS representation, concat('v', vec_id) AS smiles, 64 AS d FROM embeddings UNION ALL SELECT 'ecfp', concat('v', vec_id), 64 FROM embeddings WHERE embedding[1] < 0.15::FLOAT)
SELECT representation, count(DISTINCT smiles) AS n_success, max(d) AS dimension, (SELECT count(*) FROM i) AS n_inputs, CASE WHEN (SELECT count(*) FROM i) = count(DISTINCT smiles) THEN 'none' ELSE concat((SELECT count(*) FROM i) - count(DISTINCT smiles), ' of ', (SELECT count(*) FROM i), ' inputs') END AS failures
FROM r SEMI JOIN i USING (smiles) GROUP BY 1
""")
def representation_coverage(t):
    v = lambda c: F.concat(F.lit("v"), c).alias("smiles")
    inputs = t.embeddings.select(v("vec_id")).union(t.part.select(v("p_partkey")))
    dense = t.embeddings.select(F.lit("dense").alias("representation"), v("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    parsed = t.embeddings.filter("embedding[0] < cast(0.15 as float)").select("vec_id")
    ecfp = I.fingerprints(t).join(parsed, "vec_id", "left_semi").select(F.lit("ecfp").alias("representation"), v("vec_id"), F.col("bits").alias("embedding"))
    return B.representation_coverage(inputs, dense.unionByName(ecfp))


@query("q_infer_method", """
SELECT l_orderkey, l_linenumber, l_partkey, txt, CASE WHEN p IS NULL THEN NULL WHEN contains(lower(txt), 'friedman') THEN 'Friedman test' WHEN contains(lower(txt), 'wilcoxon') OR contains(lower(txt), 'paired') THEN 'paired Wilcoxon signed-rank test'
 WHEN contains(lower(txt), 'spearman') THEN 'Spearman rank correlation' WHEN contains(lower(txt), 'slope') OR contains(lower(txt), 'curve') OR contains(lower(txt), 'ols') THEN 'regression' ELSE 'NA' END AS method
FROM (SELECT *, CASE l_linenumber WHEN 1 THEN 'Wilcoxon p' WHEN 2 THEN 'Friedman chi2' WHEN 3 THEN 'partial Spearman' WHEN 4 THEN 'Spearman rho' WHEN 5 THEN 'slope' WHEN 6 THEN 'mean CI' ELSE 'n' END AS txt, CASE WHEN l_tax > 0 THEN l_discount END AS p FROM lineitem)
""")
def infer_method(t):
    labels = F.array(*[F.lit(x) for x in ("Wilcoxon p", "Friedman chi2", "partial Spearman", "Spearman rho", "slope", "mean CI")])
    txt = F.coalesce(F.get(labels, F.col("l_linenumber") - 1), F.lit("n"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", txt.alias("txt"), F.when(F.col("l_tax") > 0, F.col("l_discount")).alias("_p")).withColumn("method", X.statistic_method(F.col("txt"), F.col("_p"))).drop("_p")


@query("q_output_check", "SELECT 'orders' AS output, true AS present, true AS has_rows UNION ALL SELECT 'none', true, false UNION ALL SELECT 'gone', false, false")
def output_check(t):
    folder = scratch_path(t.spark, "outputs")
    t.orders.write.parquet(f"{folder}/orders")
    t.orders.filter("o_orderkey < 0").write.parquet(f"{folder}/none")
    return B.output_check(t.spark, {n: f"{folder}/{n}" for n in ("orders", "none", "gone")})


cte("model_runs", """
SELECT experiment, stamp, run_id, val_spearman, n_train, CASE WHEN run_id % 3 = 0 THEN NULL ELSE run_id % 50 END AS n_pca, concat('[', 8 + run_id % 5, ', 16]') AS hidden_layers,
 100 AS input_dim, 25 AS output_dim, 8 + run_id % 5 AS h1, concat('R', run_id % 4) AS representation FROM registry
""")


def model_runs(t: Tables):
    k = F.col("run_id")
    return registry(t).select("experiment", "stamp", "run_id", "val_spearman", "n_train", F.when(k % 3 != 0, k % 50).alias("n_pca"),
                              F.concat(F.lit("["), 8 + k % 5, F.lit(", 16]")).alias("hidden_layers"), F.lit(100).alias("input_dim"), F.lit(25).alias("output_dim"),
                              F.concat(F.lit("R"), k % 4).alias("representation"))


@query("q_selected_models", """
SELECT m.experiment, run_id, val_spearman, n_trials, 2 AS depth, (100 * h1 + h1) + (h1 * 16 + 16) + (16 * 25 + 25) AS n_params, CASE WHEN n_pca IS NULL THEN 'none' ELSE concat('pca', n_pca) END AS compression
FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY val_spearman DESC, stamp, run_id) AS rn FROM model_runs) m JOIN (SELECT experiment, count(*) AS n_trials FROM model_runs GROUP BY 1) c USING (experiment) WHERE rn = 1
""", "val_spearman")
def selected_models(t):
    return B.selected_models(model_runs(t)).select("experiment", "run_id", "val_spearman", "n_trials", "depth", "n_params", "compression")


@query("q_scale_table", """
WITH d AS (SELECT 'R0' AS representation, 64 AS dimension UNION ALL SELECT 'R1', 128 UNION ALL SELECT 'R2', 32)
SELECT run_id, representation, coalesce(n_pca, dimension) AS treatment_size, (coalesce(n_pca, dimension) * h1 + h1) + (h1 * 16 + 16) + (16 * 25 + 25) AS n_params
FROM model_runs LEFT JOIN d USING (representation) WHERE coalesce(n_pca, dimension) IS NOT NULL
""")
def scale_table(t):
    native = t.region.filter("r_regionkey < 3").select(F.concat(F.lit("R"), "r_regionkey").alias("representation"),
                                                       F.when(F.col("r_regionkey") == 0, 64).when(F.col("r_regionkey") == 1, 128).otherwise(32).alias("dimension"))
    return B.scale_table(model_runs(t), native).select("run_id", "representation", "treatment_size", "n_params")


@query("q_sar_export", """
SELECT concat('pair_', substr(sha256(concat_ws(chr(31), least(concat_ws('|', cell_line, smiles_i), concat_ws('|', cell_line, smiles_j)), greatest(concat_ws('|', cell_line, smiles_i), concat_ws('|', cell_line, smiles_j)))), 1, 16)) AS pair_id,
 cell_line, 1.0::DOUBLE AS dose_um, 24.0::DOUBLE AS time_h, plate, smiles_i AS compound_i, smiles_j AS compound_j, pearson, spearman, ecfp_dist, dense_dist, NULL::DOUBLE AS graph_dist FROM sar
""", "dose_um time_h pearson spearman ecfp_dist dense_dist graph_dist")
def sar_export(t):
    """Dose and time are parsed where rows are, not in every pair, and a pair has only the columns that are exported."""
    kept = ["cell_line", "dose_um", "time_h", "plate", "smiles_i", "smiles_j", "pearson", "spearman", "ecfp_dist", "dense_dist"]
    return B.sar_export(sar(t, B.with_numbers, columns=kept, context=["dose_um", "time_h"]))


@query("q_performance_metrics", """
WITH u AS (UNPIVOT (SELECT arm, split, pearson, l2 FROM split_scores WHERE arm = 'model') ON pearson, l2 INTO NAME metric VALUE v),
f AS (UNPIVOT (SELECT arm, split, pearson, l2 FROM split_scores WHERE rmse < 40) ON pearson, l2 INTO NAME metric VALUE v),
a AS (SELECT arm, split, metric, avg(v) AS m, stddev_pop(v) AS s FROM u GROUP BY ALL), b AS (SELECT arm, split, metric, avg(v) AS m, stddev_pop(v) AS s FROM f GROUP BY ALL)
SELECT coalesce(a.arm, b.arm) AS arm, coalesce(a.split, b.split) AS split, coalesce(a.metric, b.metric) AS metric, coalesce(a.m, b.m) AS mean, coalesce(a.s, b.s) AS sd, CASE WHEN a.m IS NOT NULL THEN 'main' ELSE 'fallback' END AS source
FROM a FULL JOIN b ON a.arm = b.arm AND a.split = b.split AND a.metric = b.metric
""", "mean sd")
def performance_metrics(t):
    s = split_scores(t).select("arm", "split", "pearson", "l2", "rmse")
    return B.performance_table(s.filter("arm = 'model'"), s.filter("rmse < 40"), ["arm", "split"], ["pearson", "l2"])


@query("q_repro_performance", """
WITH g AS (SELECT *, (ceil(round((spearman + 1) / 0.1::DOUBLE, 9)) - 1)::INT AS bin FROM split_scores)
SELECT 'association' AS record, arm AS label, bin, count(*) AS n, avg(pearson) AS mean, NULL AS share FROM g WHERE bin >= 0 AND bin < 20 GROUP BY ALL HAVING count(*) >= 20
UNION ALL SELECT 'filter', split, NULL, count(*), avg(pearson), count(*) / (SELECT count(*) FROM split_scores)::DOUBLE FROM split_scores GROUP BY split HAVING count(*) >= 100
""", "mean share")
def repro_performance(t):
    s = split_scores(t)
    assoc = S.binned_means(s, ["arm"], "spearman", "pearson", -1.0, 0.1, 20, 20).select(F.lit("association").alias("record"), F.col("arm").alias("label"), "bin", "n", "mean")
    total = s.agg(F.count(F.lit(1)).alias("total")).scalar()
    flt = s.groupBy(F.col("split").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg("pearson").alias("mean")).filter("n >= 100")
    flt = flt.select(F.lit("filter").alias("record"), "label", "n", "mean", (F.col("n") / total.cast("double")).alias("share"))
    return assoc.unionByName(flt, allowMissingColumns=True)


@query("q_cell_line_performance", f"""
WITH m AS (FROM scores WHERE arm = 'model'), {boot_sql('m', 'dose, cell_line', 'pearson', 'cell_line, drug, smiles, dose, time')},
b AS (SELECT dose, cell_line, avg(pearson) FILTER (arm = 'reference') AS reference, avg(pearson) FILTER (arm = 'train_mean') AS train_mean FROM scores GROUP BY ALL)
SELECT dose, cell_line, mean, n, lo, hi, reference, train_mean, mean - reference AS gain_reference, mean - train_mean AS gain_train_mean FROM pt JOIN bd USING (dose, cell_line) JOIN b USING (dose, cell_line)
""", "mean lo hi reference train_mean gain_reference gain_train_mean")
def cell_line_performance(t):
    return B.cluster_performance(I.scores(t), ["dose"], "cell_line", OBS, BOOT)


@query("q_reference_similarity", """
WITH c AS (SELECT a.cell_line AS cl_i, b.cell_line AS cl_j, drug, dose, time, corr(a.v, b.v) AS r
  FROM cond_mean a JOIN cond_mean b USING (drug, dose, time, gene_idx) WHERE a.cell_line <> b.cell_line GROUP BY ALL)
SELECT CASE WHEN cl_i = 'MACHINERY' THEN cl_i ELSE lower(cl_i) END AS reference, CASE WHEN cl_j = 'MACHINERY' THEN cl_j ELSE lower(cl_j) END AS target, avg(CASE WHEN isnan(r) THEN 0 ELSE r END) AS similarity, count(*) AS n_conditions,
 true AS included, '' AS reason FROM c GROUP BY cl_i, cl_j HAVING count(*) >= 2
""", "similarity")
def reference_similarity(t):
    pairs = R.context_correlations(P.average_vectors(I.delta(t), ["cell_line", *P.TREATMENT]))
    names = t.customer.filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_mktsegment").alias("cell_line"), F.lower("c_mktsegment").alias("name")).distinct()
    return B.similarity_table(pairs, names)


@query("q_long_statistics", f"""
WITH a AS (SELECT level, n, slope, r, intercept, {student_p(correlation_t('r', 'n - 2'), 'n - 2')} AS p FROM (
 SELECT arm AS level, count(*)::DOUBLE AS n, regr_slope(pearson, rmse) AS slope, corr(pearson, rmse) AS r, regr_intercept(pearson, rmse) AS intercept FROM scores GROUP BY 1)),
b AS (SELECT arm AS level, avg(pearson) AS micro, count(*)::DOUBLE AS n FROM scores GROUP BY 1),
u AS (SELECT level, statistic, value, 'slope of errors, cell-line' AS analysis FROM (UNPIVOT a ON n, slope, r, intercept, p INTO NAME statistic VALUE value)
 UNION ALL SELECT level, statistic, value, 'mean score' FROM (UNPIVOT b ON micro, n INTO NAME statistic VALUE value))
SELECT level, statistic, value, analysis, CASE WHEN analysis LIKE 'slope%' THEN 'regression' END AS method, CASE WHEN analysis LIKE '%cell-line' THEN 'cell_line' ELSE 'observation' END AS unit,
 concat('stat_', substr(sha256(concat_ws(chr(31), analysis, level, statistic)), 1, 16)) AS id FROM u
""", "value")
def long_statistics(t):
    s = I.scores(t)
    means = s.groupBy("arm").agg(F.avg("pearson").alias("micro"), F.count(F.lit(1)).alias("n"))
    return B.long_statistics({"slope of errors, cell-line": S.line_fit(s, ["arm"], "rmse", "pearson"), "mean score": means}, ["arm"])


@query("q_vp_annotate", """
SELECT g.gene, factor AS component, ss / 100 AS fraction FROM factor_ss JOIN genes g USING (gene) WHERE factor <> 'total'
""", "fraction")
def vp_annotate(t):
    ss = S.factor_sums(I.long(t, I.profiles(t)), "gene", "value", FACTORS).filter("factor <> 'total'")
    wide = ss.join(I.genes(t).withColumnRenamed("gene_idx", "position"), "gene").groupBy("position").pivot("factor", FACTORS).agg(F.first("ss"))
    return B.annotate_components(wide, I.genes(t).withColumnRenamed("gene_idx", "position"), FACTORS)


@query("q_name_lookup", """
SELECT c_custkey, c_nationkey::VARCHAR AS id, coalesce(n, c_nationkey::VARCHAR) AS label FROM customer LEFT JOIN (SELECT n_nationkey, min(n_name) AS n FROM nation WHERE n_nationkey % 4 <> 0 GROUP BY 1) ON c_nationkey = n_nationkey
""")
def name_lookup(t):
    names = t.nation.filter("n_nationkey % 4 <> 0").select(F.col("n_nationkey").cast("string").alias("id"), "n_name")
    return B.name_lookup(t.customer.select("c_custkey", F.col("c_nationkey").cast("string").alias("id")), names, "id", "n_name", "label", ["n_name"])


@query("q_representation_id", """
SELECT p_partkey, r_name AS roster FROM part LEFT JOIN region ON lower(r_name) = lower(CASE p_partkey % 4 WHEN 0 THEN 'asia' WHEN 1 THEN 'Region_1' WHEN 2 THEN 'REGION_2' ELSE 'region_3' END)
""")
def representation_id(t):
    k = F.col("p_partkey") % 4
    label = F.when(k == 0, "asia + dose (gate)").when(k == 1, "Region_1 + dose (one-hot)").when(k == 2, "REGION_2").otherwise("region_3+dose (log10)")
    a = t.part.select("p_partkey", F.lower(X.representation_label(label)).alias("k"))
    return a.join(t.region.select(F.lower("r_name").alias("k"), F.col("r_name").alias("roster")), "k", "left").select("p_partkey", "roster")


@query("q_stream_pseudobulk", "SELECT cell_line, sample, gene, v AS value FROM bulk_sums", "value")
def stream_pseudobulk(t):
    """Measurements written as files by sample, read as a stream of a few files a trigger, summed in state."""
    folder, out, state = (scratch_path(t.spark, n) for n in ("cells", "sums", "state"))
    rows = I.counts(t).join(I.cell_meta(t).select("barcode", "cell_line", "sample"), "barcode").select("cell_line", "sample", "gene", "cnt")
    rows.repartition(F.col("sample")).write.parquet(folder)
    Z.run_to_table(Z.read_measurements(t.spark, folder, rows.schema, files_per_trigger=4), out, state)
    return Z.latest_sums(t.spark, out)
