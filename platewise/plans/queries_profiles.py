"""Grouped aggregation and the delta core."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.functions import text as X
from platewise.operators import pairs as R
from platewise.operators import profiles as P
from platewise.operators import summaries as M
from platewise.plans import inputs as I
from platewise.plans.catalog import Tables, query


@query("q_delta_profile", """
SELECT cell_line, sample, plate, drug, smiles, dose, time, gene, value FROM delta_long
""", "value")
def delta_profile(t: Tables):
    return I.long(t, I.delta(t)).select("cell_line", "sample", "plate", "drug", "smiles", "dose", "time", "gene", "value")


@query("q_pseudobulk", """
SELECT m.cell_line, m.sample, m.plate, m.drug, m.smiles, m.dose, m.time, total_cells, total_umis, g.gene, coalesce(v, 0) AS value
FROM bulk_meta m CROSS JOIN genes g LEFT JOIN bulk_sums s USING (cell_line, sample, gene)
""", "total_umis value")
def pseudobulk(t: Tables):
    return I.long(t, I.pseudobulks(t)).drop("gene_idx", "rep")


@query("q_average_expr", "SELECT cell_line, drug, smiles, dose, time, gene, avg(value) AS value FROM profile_long GROUP BY ALL", "value")
def average_expr(t: Tables):
    return I.long(t, P.average_vectors(I.profiles(t), ["cell_line", *P.TREATMENT])).drop("gene_idx")


@query("q_unmatched_controls", """
SELECT DISTINCT cell_line, plate, time, rep FROM cell_meta m WHERE drug <> 'DMSO' AND NOT EXISTS (SELECT 1 FROM cell_meta c
 WHERE c.drug = 'DMSO' AND c.dose = '0.1 uM' AND (c.cell_line, c.plate, c.time, c.rep) = (m.cell_line, m.plate, m.time, m.rep))
""")
def unmatched_controls(t: Tables):
    m = I.cell_meta(t)
    ctl = m.filter((F.col("drug") == I.CONTROL) & (F.col("dose") == "0.1 uM"))
    return P.unmatched_controls(ctl, m.filter(F.col("drug") != I.CONTROL), [*P.CONTROL_KEY, "rep"])


@query("q_delta_plate_only", """
SELECT p.sample, p.gene, p.value - c.m AS value FROM profile_long p
JOIN (SELECT plate, gene, avg(value) AS m FROM profile_long WHERE drug = 'DMSO' GROUP BY ALL) c USING (plate, gene) WHERE p.drug <> 'DMSO' AND p.cell_line = 'BUILDING'
""", "value")
def delta_plate_only(t: Tables):
    p = I.sparse_profiles(t).filter((F.col("drug") == I.CONTROL) | (F.col("cell_line") == I.REFERENCE_LINE))
    d = P.delta_of_sparse(p, I.CONTROL, I.panel_width(t), ["plate"])
    return I.long(t, d).select("sample", "gene", "value")


@query("q_delta_avg", "SELECT drug, smiles, dose, time, gene, avg(value) AS value FROM delta_long WHERE cell_line = 'BUILDING' GROUP BY ALL", "value")
def delta_avg(t: Tables):
    d = I.delta(t).filter(F.col("cell_line") == I.REFERENCE_LINE)
    return I.long(t, P.average_vectors(d, P.TREATMENT)).drop("gene_idx")


@query("q_condition_quality", """
WITH p AS (SELECT * REPLACE (CASE WHEN isnan(pearson) THEN NULL ELSE pearson END AS pearson) FROM treated_inter)
SELECT cell_line, drug, dose, time, count(*) AS n_pairs, count(pearson) AS n_defined, avg(pearson) AS mean_pearson, quantile_cont(pearson, 0.5) AS median_pearson,
 (avg(norm_rep_i) + avg(norm_rep_j)) / 2 AS mean_norm, len(list_distinct(list_concat(list(rep_i), list(rep_j)))) AS n_replicates FROM p GROUP BY ALL
""", "mean_pearson median_pearson mean_norm")
def condition_quality(t: Tables):
    return M.condition_quality(R.replicate_pairs(I.profiles(t).filter(F.col("drug") != I.CONTROL), "inter"), P.CONDITION)


@query("q_distribution_summary", """
SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS sd, quantile_cont(l_extendedprice, 0.25) AS q25,
 quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q75 FROM lineitem GROUP BY ALL
""", "mean sd q25 median q75")
def distribution_summary(t: Tables):
    return M.distribution_summary(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("q_histogram", """
WITH c AS (SELECT event_type, least(floor(value / 5.0::DOUBLE), 19)::INT AS bin, count(*) AS cnt FROM events WHERE value BETWEEN 0 AND 100 GROUP BY ALL),
w AS (SELECT event_type, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median FROM events WHERE isfinite(value::DOUBLE) GROUP BY 1),
s AS (SELECT *, unnest(range(20))::INT AS bin FROM w),
f AS (SELECT event_type, bin, n, mean, median, coalesce(cnt, 0) AS count FROM s LEFT JOIN c USING (event_type, bin))
SELECT event_type, bin, bin * 5.0::DOUBLE AS "left", (bin + 1) * 5.0::DOUBLE AS "right", (bin + 0.5::DOUBLE) * 5.0::DOUBLE AS midpoint, count,
 count / (n * 5.0::DOUBLE) AS density, count / greatest(1, max(count) OVER (PARTITION BY event_type))::DOUBLE AS peak, n, mean, median FROM f
""", 'density peak mean median')
def histogram(t: Tables):
    return M.histogram(t.events, ["event_type"], "value", 0.0, 100.0, 20)


@query("q_inventory", """
UNPIVOT (SELECT count(DISTINCT cell_line) AS n_cell_line, count(DISTINCT drug) AS n_drug, count(DISTINCT dose) AS n_dose, count(DISTINCT time) AS n_time,
 count(DISTINCT plate) AS n_plate, count(*) FILTER (drug <> 'DMSO') AS n_treated, count(*) FILTER (drug = 'DMSO') AS n_untreated FROM cell_meta)
ON COLUMNS(*) INTO NAME measure VALUE n
""")
def inventory(t: Tables):
    return M.inventory(I.cell_meta(t), ["cell_line", "drug", "dose", "time", "plate"], {"treated": "drug <> 'DMSO'", "untreated": "drug = 'DMSO'"})


@query("q_grouping_sets", """
WITH c AS (SELECT arm, dose, drug, avg(pearson) AS m FROM scores GROUP BY ALL)
SELECT arm, coalesce(dose, 'all') AS dose, count(*) AS n_clusters, avg(m) AS mean FROM c GROUP BY GROUPING SETS ((arm), (arm, dose))
""", "mean")
def grouping_sets(t: Tables):
    per = I.scores(t).groupBy("arm", "dose", "drug").agg(F.avg("pearson").alias("m"))
    out = per.groupingSets([["arm"], ["arm", "dose"]], "arm", "dose").agg(F.count(F.lit(1)).alias("n_clusters"), F.avg("m").alias("mean"))
    return out.withColumn("dose", F.coalesce("dose", F.lit("all")))


@query("q_unique_join", """
SELECT r_name, array_to_string(list_sort(list_distinct(list(trim(n)) FILTER (trim(n) <> ''))), ';') AS names
FROM region JOIN (SELECT n_regionkey, n_name AS n FROM nation UNION ALL SELECT n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN concat(' ', n_name) ELSE ' ' END FROM nation) ON r_regionkey = n_regionkey GROUP BY 1
""")
def unique_join(t: Tables):
    extra = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" "), "n_name")).otherwise(" ")
    n = t.nation.select("n_regionkey", F.col("n_name").alias("n")).unionByName(t.nation.select("n_regionkey", extra.alias("n")))
    return t.region.join(n, F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(X.unique_join(F.col("n")).alias("names"))


@query("q_micro_macro", """
SELECT arm, sum(s) / sum(c) AS micro, avg(s / c) AS macro, count(*) AS n_clusters, sum(c)::BIGINT AS n
FROM (SELECT arm, cell_line, sum(pearson) AS s, count(*) AS c FROM scores GROUP BY ALL) GROUP BY 1
""", "micro macro")
def micro_macro(t: Tables):
    return M.micro_macro(I.scores(t), ["arm"], "cell_line", "pearson")


@query("q_depth_summary", """
WITH m AS (SELECT b.* FROM bulk_meta b SEMI JOIN (SELECT sample FROM bulk_meta WHERE drug = 'DMSO') d ON b.sample = d.sample)
SELECT cell_line, count(*) AS n, avg(total_umis) AS mean, stddev_pop(total_umis) AS sd, quantile_cont(total_umis, 0.25) AS q25, quantile_cont(total_umis, 0.5) AS median,
 quantile_cont(total_umis, 0.75) AS q75 FROM m GROUP BY 1
""", "mean sd q25 median q75")
def depth_summary(t: Tables):
    b = I.sparse_bulks(t).select("cell_line", "sample", "drug", "total_umis")
    return M.distribution_summary(b.join(b.filter(F.col("drug") == I.CONTROL).select("sample"), "sample", "left_semi"), ["cell_line"], "total_umis")


@query("q_median_spread", """
WITH w AS (SELECT cell_line, drug, dose, avg(pearson) FILTER (arm = 'model') AS a, avg(pearson) FILTER (arm = 'reference') AS b, avg(pearson) FILTER (arm = 'train_mean') AS c
 FROM scores GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)
SELECT greatest(median(a), median(b), median(c)) - least(median(a), median(b), median(c)) AS spread, 3 AS n_arms FROM w
""", "spread")
def median_spread(t: Tables):
    return M.median_spread(I.scores(t), ["cell_line", "drug", "dose"], "arm", ["model", "reference", "train_mean"], "pearson")
