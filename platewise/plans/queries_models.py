"""Observations and features (O1-O17), scores and models (M1-M18), centroid-referenced evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.functions import vectors as V
from platewise.operators import observations as O
from platewise.operators import profiles as P
from platewise.operators import scoring as S
from platewise.plans import inputs as I
from platewise.plans.catalog import Tables, query
from platewise.plans.oracle import cte
from platewise.session import cut_lineage

KEY = ["cell_line", "sample"]
OBS = ["cell_line", "drug", "smiles", "dose", "time"]

cte("obs_long", """
SELECT t.*, r.delta_ref, u.avg_untrt_target FROM
 (SELECT cell_line, drug, smiles, dose, time, gene, gene_idx, avg(value) AS avg_delta_target FROM delta_long WHERE cell_line <> 'BUILDING' GROUP BY ALL) t
 JOIN (SELECT drug, dose, time, gene, avg(value) AS delta_ref FROM delta_long WHERE cell_line = 'BUILDING' GROUP BY ALL) r USING (drug, dose, time, gene)
 JOIN (SELECT cell_line, gene, avg(value) AS avg_untrt_target FROM profile_long WHERE drug = 'DMSO' GROUP BY ALL) u USING (cell_line, gene)
""")


def observations(t: Tables):
    d = cut_lineage(I.delta(t))
    return O.build_observations(I.sparse_profiles(t).filter(F.col("drug") == I.CONTROL), d, I.REFERENCE_LINE, I.panel_width(t))


@query("q_build_obs", "SELECT * EXCLUDE (gene) FROM obs_long", "avg_delta_target delta_ref avg_untrt_target")
def build_obs(t):
    v = F.posexplode(F.arrays_zip("avg_delta_target", "delta_ref", "avg_untrt_target")).alias("gene_idx", "v")
    return observations(t).select(*OBS, v).select(*OBS, "gene_idx", "v.*")


@query("q_ref_pool", """
SELECT drug, dose, time, count(*) AS pool_size, min(sample) AS first_sample FROM (SELECT DISTINCT drug, dose, time, sample FROM delta_long WHERE cell_line = 'BUILDING') GROUP BY ALL
""")
def ref_pool(t):
    return O.reference_pool(I.delta(t), I.REFERENCE_LINE).groupBy(*O.MATCH).agg(F.max("pool_size").alias("pool_size"), F.min("sample").alias("first_sample"))


DRAW_SQL = """
WITH pool AS (SELECT *, row_number() OVER (PARTITION BY drug, dose, time ORDER BY ('0x' || substr(md5('row|' || sample), 1, 8))::BIGINT % 1024, md5('row|' || sample)) - 1 AS pos,
   count(*) OVER (PARTITION BY drug, dose, time) AS n FROM (SELECT DISTINCT drug, dose, time, sample FROM delta_long WHERE cell_line = 'BUILDING')),
o AS (SELECT DISTINCT cell_line, drug, smiles, dose, time {epoch} FROM obs_long {epochs})
SELECT o.*, sample FROM o JOIN pool USING (drug, dose, time)
WHERE pos = ('0x' || substr(md5(concat_ws('|', '42', {key} cell_line, drug, smiles, dose, time)), 1, 8))::BIGINT % n
"""


@query("q_ref_draw", DRAW_SQL.format(epoch="", epochs="", key=""))
def ref_draw(t):
    d = cut_lineage(I.delta(t))
    obs = d.filter(F.col("cell_line") != I.REFERENCE_LINE).select(*OBS).distinct()
    return O.draw_reference(obs, O.reference_pool(d, I.REFERENCE_LINE)).drop("expr")


@query("q_resample_epochs", DRAW_SQL.format(epoch=", e::INT AS epoch", epochs=", (SELECT unnest(range(1, 6)) AS e)", key="epoch,"))
def resample_epochs(t):
    d = cut_lineage(I.delta(t))
    obs = d.filter(F.col("cell_line") != I.REFERENCE_LINE).select(*OBS).distinct()
    return O.draw_reference(obs, O.reference_pool(d, I.REFERENCE_LINE), epochs=5).drop("expr")


@query("q_ref_average", "SELECT drug, dose, time, gene_idx, avg(value) AS delta_ref FROM delta_long WHERE cell_line = 'BUILDING' GROUP BY ALL", "delta_ref")
def ref_average(t):
    d = P.average_vectors(I.delta(t).filter(F.col("cell_line") == I.REFERENCE_LINE), O.MATCH)
    return d.select(*O.MATCH, F.posexplode("expr").alias("gene_idx", "delta_ref"))


@query("q_time_onehot", """
SELECT barcode, CASE WHEN rep > 2 THEN 1 ELSE 0 END AS t0, CASE WHEN rep <= 2 THEN 1 ELSE 0 END AS t1 FROM cell_meta
""", "t0 t1")
def time_onehot(t):
    m = I.cell_meta(t).withColumn("time", F.when(F.col("rep") <= 2, "6 h").otherwise("24 h"))
    return O.one_hot(m, "time", "f").select("barcode", F.get("f", F.lit(0)).alias("t0"), F.get("f", F.lit(1)).alias("t1"))


cte("doses", """
SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN concat(p_size, 'e', p_partkey % 7 - 4, ' nM') ELSE concat(p_size, 'e', p_partkey % 7 - 4, ' uM') END AS dose,
 CASE WHEN p_size % 6 = 0 THEN NULL ELSE CAST(concat(p_size, 'e', p_partkey % 7 - 4) AS DOUBLE) END AS um FROM part
""")


def doses(t: Tables):
    unit = F.when(F.col("p_size") % 6 == 0, " nM").otherwise(" uM")
    return t.part.select("p_partkey", F.concat("p_size", F.lit("e"), F.col("p_partkey") % 7 - 4, unit).alias("dose"))


@query("q_dose_features", "SELECT p_partkey, dose, um AS dose_um, log10(um) AS dose_log10, ln(1 + um) AS dose_log1p FROM doses", "dose_um dose_log10 dose_log1p")
def dose_features(t):
    return doses(t).withColumns(O.dose_features(F.col("dose")))


@query("q_dose_onehot", """
SELECT p_partkey, (log10(um) > -3)::INT + (log10(um) > -2)::INT + (log10(um) > -1)::INT + (log10(um) > 0)::INT + (log10(um) > 1)::INT + (log10(um) > 2)::INT AS slot, 1.0::DOUBLE AS total
FROM doses WHERE um IS NOT NULL
""", "total")
def dose_onehot(t):
    v = doses(t).filter("dose like '% uM'").withColumn("v", O.dose_one_hot(F.col("dose")))
    return v.select("p_partkey", (F.array_position("v", 1.0) - 1).cast("int").alias("slot"), V.total(F.col("v")).alias("total"))


@query("q_concat_features", """
SELECT vec_id, pos, x FROM (SELECT vec_id, pos, x FROM emb_long WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 64 END, label FROM embeddings)
""", "x")
def concat_features(t):
    emb = F.when(F.col("vec_id") % 3 != 0, F.col("embedding"))
    v = O.concat_features(emb, F.array(F.col("label").cast("double")))
    return t.embeddings.select("vec_id", F.posexplode(v).alias("pos", "x"))


@query("q_dose_gate", "SELECT vec_id, pos, x * (1 / (1 + exp(-ln(1 + label))) - 0.5::DOUBLE) AS x FROM emb_long", "x")
def dose_gate(t):
    v = O.dose_gate(F.col("embedding"), F.log1p(F.col("label").cast("double")))
    return t.embeddings.select("vec_id", F.posexplode(v).alias("pos", "x"))


@query("q_random_embedding", """
SELECT p_partkey, i::INT AS pos, sqrt(-2 * ln((('0x' || substr(md5(concat_ws('|', p_name, '7', 'r', i)), 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE)) *
  cos(2 * pi() * ((('0x' || substr(md5(concat_ws('|', p_name, '7', 'a', i)), 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE)) AS x
FROM part, (SELECT unnest(range(8)) AS i)
""", "x")
def random_embedding(t):
    return t.part.select("p_partkey", F.posexplode(O.random_embedding(F.col("p_name"), 8, 7)).alias("pos", "x"))


@query("q_pca")
def pca(t):
    e = t.embeddings.withColumn("v", F.col("embedding").cast("array<double>"))
    train = e.filter(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 1) < "c")
    return O.apply_pca(e, O.fit_pca(train, "v", 8), "v", "pc").select("vec_id", F.posexplode("pc").alias("component", "score"))


# scores

cte("bundle_long", """
WITH y AS (SELECT *, CASE WHEN plate >= '1999' THEN 'test' ELSE 'train' END AS split FROM delta_long WHERE cell_line <> 'BUILDING')
SELECT y.cell_line, y.sample, y.plate, y.drug, y.smiles, y.dose, y.time, y.split, y.gene_idx, y.value AS y, r.v AS ref, p.v AS yhat FROM y
JOIN (SELECT drug, dose, time, gene_idx, avg(value) AS v FROM delta_long WHERE cell_line = 'BUILDING' GROUP BY ALL) r USING (drug, dose, time, gene_idx)
JOIN (SELECT cell_line, drug, dose, time, gene_idx, avg(value) AS v FROM y WHERE split = 'train' GROUP BY ALL) p USING (cell_line, drug, dose, time, gene_idx)
""")
SCORE_SQL = """sqrt(avg((y - {p}) ** 2)) AS rmse, corr(y, {p}) AS pearson, corr(ry, rp) AS spearman, sqrt(sum((y - {p}) ** 2)) AS l2,
 sum(y * {p}) / (sqrt(sum(y * y)) * sqrt(sum({p} * {p})) + 1.1920929e-7::DOUBLE) AS cosine"""
RANK_SQL = """rank() OVER (PARTITION BY cell_line, sample ORDER BY {c}) + (count(*) OVER (PARTITION BY cell_line, sample, {c}) - 1) / 2.0::DOUBLE AS {n}"""
cte("scored", f"""
WITH r AS (SELECT *, {RANK_SQL.format(c='y', n='ry')}, {RANK_SQL.format(c='yhat', n='rp')} FROM bundle_long)
SELECT cell_line, sample, plate, drug, smiles, dose, time, split, {SCORE_SQL.format(p='yhat')} FROM r GROUP BY ALL
""")
FIVE = "rmse pearson spearman l2 cosine"


@query("q_metrics_per_obs", "SELECT * REPLACE (" + ", ".join(f"CASE WHEN NOT isnan({m}) THEN round_even({m}, 2) END AS {m}" for m in FIVE.split()) + ") FROM scored", FIVE)
def metrics_per_obs(t):
    return S.score_rows(I.bundle(t).drop("ref"), digits=2)


@query("q_average_metrics", "SELECT split, " + ", ".join(f"round_even(avg({m}) FILTER (NOT isnan({m})), 4) AS {m}" for m in FIVE.split()) + " FROM scored GROUP BY 1", FIVE)
def average_metrics(t):
    return S.average_metrics(S.score_rows(I.bundle(t).drop("ref")), ["split"])


@query("q_safe_metrics", """
WITH z AS (SELECT vec_id, pos, x, CASE WHEN vec_id % 4 = 0 THEN 0.0::DOUBLE WHEN vec_id % 4 = 1 THEN 2.5::DOUBLE ELSE x * x END AS w FROM emb_long)
SELECT vec_id, CASE WHEN vec_id % 4 < 2 THEN NULL ELSE corr(x, w) END AS pearson, CASE WHEN vec_id % 4 < 2 THEN 0 ELSE corr(x, w) END AS pearson_or_zero,
 CASE WHEN vec_id % 4 = 0 THEN NULL ELSE sum(x * w) / sqrt(sum(x * x) * sum(w * w)) END AS cosine FROM z GROUP BY 1
""", "pearson pearson_or_zero cosine")
def safe_metrics(t):
    x = F.col("embedding").cast("array<double>")
    k = F.col("vec_id") % 4
    w = F.when(k == 0, F.transform(x, lambda v: v * 0.0)).when(k == 1, F.transform(x, lambda v: F.lit(2.5))).otherwise(F.transform(x, lambda v: v * v))
    e = t.embeddings.select("vec_id", x.alias("x"), w.alias("w"))
    return e.select("vec_id", V.pearson(F.col("x"), F.col("w")).alias("pearson"), F.coalesce(V.pearson(F.col("x"), F.col("w")), F.lit(0.0)).alias("pearson_or_zero"),
                    V.safe_cosine(F.col("x"), F.col("w")).alias("cosine"))


@query("q_losses", "SELECT avg((y - yhat) ** 2) AS mse, sqrt(avg((y - yhat) ** 2)) AS rmse, avg(abs((yhat - y) / (y + 1e-8::DOUBLE))) * 100 AS mape FROM bundle_long WHERE y <> 0", "mse rmse mape", digits=4)
def losses(t):
    b = I.bundle(t)
    keep = F.filter(F.arrays_zip("y", "yhat"), lambda e: e["y"] != 0)
    return S.losses(b.select(keep.alias("e")).select(F.col("e.y").alias("y"), F.col("e.yhat").alias("yhat")))


@query("q_baselines", f"""
WITH m AS (SELECT gene_idx, avg(y) AS v FROM bundle_long WHERE split = 'train' GROUP BY 1),
b AS (SELECT 'reference' AS method, * EXCLUDE (yhat, ref), ref AS q FROM bundle_long UNION ALL
 SELECT 'train_mean', b.* EXCLUDE (yhat, ref), v FROM bundle_long b JOIN m USING (gene_idx) UNION ALL SELECT 'zero', * EXCLUDE (yhat, ref), 0.0::DOUBLE FROM bundle_long),
r AS (SELECT *, rank() OVER (PARTITION BY method, cell_line, sample ORDER BY y) + (count(*) OVER (PARTITION BY method, cell_line, sample, y) - 1) / 2.0::DOUBLE AS ry,
 rank() OVER (PARTITION BY method, cell_line, sample ORDER BY q) + (count(*) OVER (PARTITION BY method, cell_line, sample, q) - 1) / 2.0::DOUBLE AS rp FROM b)
SELECT method, cell_line, sample, split, {SCORE_SQL.format(p='q')} FROM r GROUP BY ALL
""", FIVE)
def baselines(t):
    b = cut_lineage(I.bundle(t).drop("yhat"))
    return S.score_rows(S.baselines(b, b.filter("split = 'train'"))).select("method", "cell_line", "sample", "split", *S.METRICS)


@query("q_ridge")
def ridge(t):
    b = cut_lineage(I.bundle(t).drop("yhat"))
    coef = S.ridge_fit(b.filter("split = 'train'"), "ref", "y", 1.0)
    return S.score_rows(S.linear_predict(b, "ref", coef).drop("ref"))


@query("q_lasso")
def lasso(t):
    """Every gene of the panel from one pass over the training rows."""
    b = cut_lineage(I.bundle(t).drop("yhat"))
    coef = S.lasso_fit(b.filter("split = 'train'"), "ref", "y", 0.001)
    long = F.posexplode(F.arrays_zip("y", "yhat")).alias("gene_idx", "v")
    return S.linear_predict(b.filter("split = 'test'"), "ref", coef).select(*KEY, long).select(*KEY, "gene_idx", "v.y", "v.yhat")


@query("q_gbt")
def gbt(t):
    """Every gene, 50 rounds of depth 6."""
    b = cut_lineage(I.bundle(t).drop("yhat"))
    return S.per_gene_trees(b.filter("split = 'train'"), b.filter("split = 'test'"), "ref", "y", KEY)


@query("q_best_epoch", """
SELECT * FROM (SELECT l_suppkey AS run, l_linenumber AS epoch, avg(l_discount) AS val_avg_pearson, 'max' AS direction FROM lineitem GROUP BY l_suppkey, l_linenumber
 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY round(avg(l_discount), 9) DESC, l_linenumber) = 1)
UNION ALL SELECT * FROM (SELECT l_suppkey, l_linenumber, avg(l_quantity), 'min' FROM lineitem GROUP BY l_suppkey, l_linenumber
 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY round(avg(l_quantity), 9), l_linenumber) = 1)
""", "val_avg_pearson")
def best_epoch(t):
    h = t.lineitem.groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("epoch")).agg(
        F.round(F.avg("l_discount"), 9).alias("val_avg_pearson"), F.round(F.avg("l_quantity"), 9).alias("val_avg_l2"))
    a = S.best_epoch(h.drop("val_avg_l2"), ["run"], "val_avg_pearson").withColumn("direction", F.lit("max"))
    b = S.best_epoch(h.drop("val_avg_pearson"), ["run"], "val_avg_l2").withColumn("direction", F.lit("min"))
    return a.unionByName(b.withColumnRenamed("val_avg_l2", "val_avg_pearson"))


CASE_COLS = ("reference_target_pearson prediction_target_pearson reference_target_cosine prediction_target_cosine adaptation_pearson adaptation_cosine "
             "reference_target_l2 prediction_target_l2 target_norm reference_norm prediction_norm pearson_gain fractional_l2_reduction")
_cos = "sum({a} * {b}) / (sqrt(sum(({a}) ** 2)) * sqrt(sum(({b}) ** 2)) + 1.1920929e-7::DOUBLE)"
cte("case_scores", f"""
SELECT cell_line, sample, drug, smiles, dose, time, corr(ref, y) AS reference_target_pearson, corr(yhat, y) AS prediction_target_pearson,
 {_cos.format(a='ref', b='y')} AS reference_target_cosine, {_cos.format(a='yhat', b='y')} AS prediction_target_cosine,
 corr(yhat - ref, y - ref) AS adaptation_pearson, {_cos.format(a='(yhat - ref)', b='(y - ref)')} AS adaptation_cosine,
 sqrt(sum((ref - y) ** 2)) AS reference_target_l2, sqrt(sum((yhat - y) ** 2)) AS prediction_target_l2,
 sqrt(sum(y * y)) AS target_norm, sqrt(sum(ref * ref)) AS reference_norm, sqrt(sum(yhat * yhat)) AS prediction_norm,
 corr(yhat, y) - corr(ref, y) AS pearson_gain, 1 - sqrt(sum((yhat - y) ** 2)) / sqrt(sum((ref - y) ** 2)) AS fractional_l2_reduction
FROM bundle_long WHERE split = 'test' GROUP BY ALL
""")


def case_table(t: Tables):
    return S.case_metrics(I.bundle(t).filter("split = 'test'").drop("plate", "split"))


@query("q_case_metrics", "SELECT * FROM case_scores", CASE_COLS)
def case_metrics(t):
    return case_table(t)


# centroid-referenced evaluation

def with_centroid(t: Tables, context):
    b = cut_lineage(I.bundle(t).drop("ref"))
    means = S.context_means(b.filter("split = 'train'"), context)
    return b, means


@query("q_context_means", """
WITH c AS (SELECT cell_line, gene_idx, avg(y) AS v FROM bundle_long WHERE split = 'train' GROUP BY ALL)
SELECT cell_line, sample, gene_idx, v AS centroid FROM bundle_long JOIN c USING (cell_line, gene_idx) WHERE split = 'test'
""", "centroid")
def context_means(t):
    b, means = with_centroid(t, ["cell_line"])
    return S.attach_context(b.filter("split = 'test'"), means, ["cell_line"]).select(*KEY, F.posexplode("centroid").alias("gene_idx", "centroid"))



cte("centred", """
WITH c AS (SELECT cell_line, gene_idx, avg(y) AS c FROM bundle_long WHERE split = 'train' GROUP BY ALL),
d AS (SELECT cell_line, dose, gene_idx, avg(y) AS c2 FROM bundle_long WHERE split = 'train' GROUP BY ALL)
SELECT 'model' AS method, b.*, c, c2, yhat AS q FROM bundle_long b JOIN c USING (cell_line, gene_idx) JOIN d USING (cell_line, dose, gene_idx) WHERE split = 'test'
UNION ALL SELECT 'perturbed_mean', b.*, c, c2, c FROM bundle_long b JOIN c USING (cell_line, gene_idx) JOIN d USING (cell_line, dose, gene_idx) WHERE split = 'test'
""")
SYS = [f"{m}_{k}" for k in ("control", "systema") for m in ("pearson", "pearson_topk", "cosine", "rmse")]
SYS_SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY method, cell_line, sample ORDER BY abs(y) DESC, gene_idx) AS k FROM {src})
SELECT method, cell_line, sample, drug, dose, corr(y, q) AS pearson_control, corr(y, q) FILTER (k <= 20) AS pearson_topk_control,
 sum(y * q) / (sqrt(sum(y * y)) * sqrt(sum(q * q)) + 1.1920929e-7::DOUBLE) AS cosine_control, sqrt(avg((y - q) ** 2)) AS rmse_control,
 CASE WHEN max(abs(q - c)) > 0 THEN corr(y - c, q - c) END AS pearson_systema, CASE WHEN max(abs(q - c)) > 0 THEN corr(y - c, q - c) FILTER (k <= 20) END AS pearson_topk_systema,
 CASE WHEN max(abs(q - c)) > 0 THEN sum((y - c) * (q - c)) / (sqrt(sum((y - c) ** 2)) * sqrt(sum((q - c) ** 2)) + 1.1920929e-7::DOUBLE) END AS cosine_systema,
 sqrt(avg((y - q) ** 2)) AS rmse_systema FROM r GROUP BY ALL
"""


def systema(t: Tables, context):
    b, means = with_centroid(t, context)
    return S.centroid_metrics(S.attach_context(b.filter("split = 'test'"), means, context)).select("method", *KEY, "drug", "dose", *SYS)


cte("systema", SYS_SQL.format(src="centred"))


@query("q_systema_metrics", "SELECT * FROM systema", " ".join(SYS))
def systema_metrics(t):
    return systema(t, ["cell_line"])


@query("q_systema_by_dose", SYS_SQL.format(src="(SELECT * REPLACE (c2 AS c, CASE WHEN method = 'model' THEN q ELSE c2 END AS q) FROM centred)"), " ".join(SYS))
def systema_by_dose(t):
    return systema(t, ["cell_line", "dose"])


@query("q_topk_pearson", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY cell_line, sample ORDER BY abs(y) DESC, gene_idx) AS k FROM bundle_long)
SELECT cell_line, sample, corr(y, yhat) AS pearson_topk FROM r WHERE k <= 20 GROUP BY ALL
""", "pearson_topk")
def topk_pearson(t):
    b = I.bundle(t).withColumn("top", S.top_positions(F.col("y"), 20))
    return b.select(*KEY, V.pearson(S.take(F.col("y"), F.col("top")), S.take(F.col("yhat"), F.col("top"))).alias("pearson_topk"))


@query("q_centroid_accuracy", """
WITH d AS (SELECT cell_line, a.sample, b.sample AS other, sum((a.yhat - b.y) ** 2) AS d FROM bundle_long a JOIN bundle_long b USING (cell_line, gene_idx)
 WHERE a.split = 'test' AND b.split = 'test' GROUP BY ALL),
o AS (SELECT cell_line, sample, d AS own FROM d WHERE sample = other)
SELECT cell_line, sample, avg(CASE WHEN d > own THEN 1.0::DOUBLE ELSE 0 END) AS centroid_accuracy FROM d JOIN o USING (cell_line, sample) WHERE sample <> other GROUP BY ALL
""", "centroid_accuracy")
def centroid_accuracy(t):
    return S.centroid_accuracy(I.bundle(t).filter("split = 'test'"), ["cell_line"], F.col("sample"), KEY, 64)


@query("q_unique_conditions", """
SELECT cell_line, drug, dose, count(*) AS copies FROM (SELECT DISTINCT cell_line, sample, drug, dose FROM bundle_long) GROUP BY ALL HAVING count(*) > 1
""")
def unique_conditions(t):
    return S.repeated_conditions(I.bundle(t), ["cell_line"], ["drug", "dose"])


@query("q_systematic_variation", """
WITH c AS (SELECT cell_line, gene_idx, avg(y) AS c FROM bundle_long WHERE split = 'train' GROUP BY ALL)
SELECT cell_line, sample, split, sum(y * c) / (sqrt(sum(y * y)) * sqrt(sum(c * c)) + 1.1920929e-7::DOUBLE) AS cosine_to_perturbed_centroid,
 sqrt(sum(y * y)) AS response_norm, sqrt(sum((y - c) ** 2)) AS specific_norm FROM bundle_long JOIN c USING (cell_line, gene_idx) GROUP BY ALL
""", "cosine_to_perturbed_centroid response_norm specific_norm")
def systematic_variation(t):
    b, means = with_centroid(t, ["cell_line"])
    return S.systematic_variation(S.attach_context(b, means, ["cell_line"])).select(
        *KEY, "split", "cosine_to_perturbed_centroid", "response_norm", "specific_norm")


@query("q_systema_summary", """
WITH u AS (UNPIVOT (SELECT method, """ + ", ".join(SYS) + """ FROM systema) ON COLUMNS(* EXCLUDE (method)) INTO NAME metric VALUE v),
w AS (SELECT method, metric, CASE WHEN isnan(v) THEN NULL ELSE v END AS v FROM u),
k AS (SELECT method, metric, count(*) AS m FROM w GROUP BY ALL), t AS (SELECT method, count(*) AS n FROM systema GROUP BY 1),
a AS (SELECT m.method, c.metric, t.n FROM (SELECT DISTINCT method FROM systema) m, (SELECT unnest(""" + str(SYS) + """) AS metric) c JOIN t ON t.method = m.method)
SELECT a.method, a.metric, a.n, count(v) AS n_finite, avg(v) AS mean, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75
FROM a LEFT JOIN w ON a.method = w.method AND a.metric = w.metric GROUP BY ALL
""", "mean q25 median q75")
def systema_summary(t):
    return S.metric_summary(cut_lineage(systema(t, ["cell_line"])), ["method"], SYS)
