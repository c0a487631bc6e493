"""Leakage-free splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.functions.hashing import stable_id
from platewise.operators import pairs as R
from platewise.operators import splits as L
from platewise.plans import inputs as I
from platewise.plans.catalog import Tables, query
from platewise.plans.oracle import cte

SPLIT_OF = "CASE WHEN substr(md5({c}), 1, 1) < '{a}' THEN 'test' WHEN substr(md5({c}), 1, 1) < '{b}' THEN 'val' ELSE 'train' END"
cte("line_split", "SELECT DISTINCT cell_line, CASE cell_line WHEN 'MACHINERY' THEN 'test' WHEN 'FURNITURE' THEN 'val' ELSE 'train' END AS split FROM scores")
cte("smiles_split", f"SELECT DISTINCT smiles, {SPLIT_OF.format(c='smiles', a='3', b='5')} AS split FROM scores")
cte("obs_keys", "SELECT DISTINCT cell_line, drug, smiles, dose, time FROM scores")
cte("pinned", """
SELECT o.*, CASE WHEN l.split = 'test' OR s.split = 'test' THEN 'test' WHEN l.split = 'val' OR s.split = 'val' THEN 'val' ELSE 'train' END AS split
FROM obs_keys o LEFT JOIN line_split l USING (cell_line) LEFT JOIN smiles_split s USING (smiles)
""")
OBS = ["cell_line", "drug", "smiles", "dose", "time"]


def obs_keys(t: Tables):
    return I.scores(t).select(*OBS).distinct()


def line_split(df):
    c = F.col("cell_line")
    return df.select("cell_line").distinct().withColumn("split", F.when(c == "MACHINERY", "test").when(c == "FURNITURE", "val").otherwise("train"))


def smiles_split(df):
    h = F.substring(F.md5("smiles"), 1, 1)
    return df.select("smiles").distinct().withColumn("split", F.when(h < "3", "test").when(h < "5", "val").otherwise("train"))


def pinned(t: Tables, o=None):
    o = obs_keys(t) if o is None else o
    return L.pinned_split(o, line_split(o), smiles_split(o))


@query("q_butina")
def butina(t):
    return L.leader_clusters(I.fingerprints(t), "vec_id", "bits", 0.55)


@query("q_fill_split", """
WITH RECURSIVE c AS (SELECT *, row_number() OVER (ORDER BY s DESC, p_name, p_brand) AS o FROM (SELECT p_name, p_brand, count(*) AS s FROM part GROUP BY p_name, p_brand)),
w AS (SELECT 0::BIGINT AS o, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS d, '' AS split
 UNION ALL SELECT c.o, CASE WHEN a < 0.8::DOUBLE * (a + b + d + s) THEN a + s ELSE a END,
  CASE WHEN a < 0.8::DOUBLE * (a + b + d + s) THEN b WHEN b < 0.1::DOUBLE * (a + b + d + s) THEN b + s ELSE b END,
  CASE WHEN a < 0.8::DOUBLE * (a + b + d + s) OR b < 0.1::DOUBLE * (a + b + d + s) THEN d ELSE d + s END,
  CASE WHEN a < 0.8::DOUBLE * (a + b + d + s) THEN 'train' WHEN b < 0.1::DOUBLE * (a + b + d + s) THEN 'val' ELSE 'test' END
 FROM w JOIN c ON c.o = w.o + 1)
SELECT p_partkey, split FROM part JOIN c USING (p_name, p_brand) JOIN w USING (o)
""")
def fill_split(t):
    c = t.part.groupBy(F.concat_ws("|", "p_name", "p_brand").alias("k"), "p_name", "p_brand").agg(F.count(F.lit(1)).alias("size"))
    walked = L.fill_split(c, [F.desc("size"), F.asc("p_name"), F.asc("p_brand")], "k")
    return t.part.select("p_partkey", F.concat_ws("|", "p_name", "p_brand").alias("k")).join(walked, "k").select("p_partkey", "split")


@query("q_split_cell_lines", """
WITH c AS (SELECT c_nationkey::VARCHAR AS cell_line, count(*) AS n_obs FROM customer GROUP BY 1), e AS (SELECT *, n_obs >= 55 AND cell_line <> '7' AS ok FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY md5('42|' || cell_line)) AS rn, count(*) OVER (PARTITION BY ok) AS n FROM e)
SELECT cell_line, n_obs, CASE WHEN NOT ok THEN 'train' WHEN rn <= round_even(0.2 * n, 0) THEN 'val' WHEN rn <= round_even(0.2 * n, 0) + round_even(0.3 * n, 0) THEN 'test' ELSE 'train' END AS split FROM r
""")
def split_cell_lines(t):
    return L.split_cell_lines(t.customer.select(F.col("c_nationkey").cast("string").alias("cell_line")), 0.2, 0.3, 42, 55, ["7"])


@query("q_pinned_split", "SELECT * FROM pinned")
def pinned_split(t):
    return pinned(t).select(*OBS, "split")


@query("q_split_obs", "SELECT o.*, s.split FROM obs_keys o JOIN smiles_split s USING (smiles)")
def split_obs(t):
    o = obs_keys(t)
    return o.join(smiles_split(o), "smiles").select(*OBS, "split")


@query("q_train_repro_filter", """
WITH o AS (SELECT DISTINCT cell_line, sample, drug, dose, time, CASE WHEN plate >= '1999' THEN 'test' ELSE 'train' END AS split FROM profile_long WHERE drug <> 'DMSO'),
q AS (SELECT cell_line, drug, dose, time FROM treated_inter GROUP BY ALL HAVING avg(pearson) FILTER (NOT isnan(pearson)) >= 0.0)
SELECT o.* FROM o WHERE split <> 'train' OR EXISTS (SELECT 1 FROM q WHERE (q.cell_line, q.drug, q.dose, q.time) = (o.cell_line, o.drug, o.dose, o.time))
""")
def train_repro_filter(t):
    p = I.profiles(t).filter(F.col("drug") != I.CONTROL)
    obs = p.select("cell_line", "sample", "drug", "dose", "time", F.when(F.col("plate") >= "1999", "test").otherwise("train").alias("split"))
    return L.train_repro_filter(obs, R.mean_pair_pearson(p, "inter"), 0.0).select("cell_line", "sample", "drug", "dose", "time", "split")


@query("q_leak_check", """
SELECT smiles, count(DISTINCT split) AS n_splits FROM (SELECT smiles, split FROM smiles_split UNION ALL SELECT smiles, 'train' FROM smiles_split WHERE substr(md5(smiles), 2, 1) = '0') GROUP BY 1 HAVING count(DISTINCT split) > 1
""")
def leak_check(t):
    s = smiles_split(obs_keys(t))
    return L.leaks(s.unionByName(s.filter(F.substring(F.md5("smiles"), 2, 1) == "0").withColumn("split", F.lit("train"))))


@query("q_split_assignments", """
SELECT 'compound' AS kind, smiles AS member, split, split = 'test' AS held_out, concat('cmp_', substr(sha256(smiles), 1, 16)) AS id FROM smiles_split
UNION ALL SELECT 'cell_line', cell_line, split, split = 'test', concat('cl_', substr(sha256(cell_line), 1, 16)) FROM line_split
""")
def split_assignments(t):
    o = obs_keys(t)
    part = lambda df, kind, col, prefix: df.select(F.lit(kind).alias("kind"), F.col(col).alias("member"), "split",
                                                   (F.col("split") == "test").alias("held_out"), stable_id(prefix, F.col(col)).alias("id"))
    return part(smiles_split(o), "compound", "smiles", "cmp_").unionByName(part(line_split(o), "cell_line", "cell_line", "cl_"))


cte("quads", """
WITH tr AS (SELECT * FROM pinned WHERE split = 'train'), te AS (SELECT * FROM pinned WHERE split = 'test')
SELECT te.*, CASE WHEN a AND b THEN 'Q1' WHEN a THEN 'Q2' WHEN b THEN 'Q3' ELSE 'Q4' END AS quadrant FROM
 (SELECT te.*, cell_line IN (SELECT cell_line FROM tr) AS a, smiles IN (SELECT smiles FROM tr) AS b FROM te) te
""")


def quads(t: Tables, o=None):
    p = pinned(t, o)
    return L.quadrants(p.filter("split = 'test'"), p.filter("split = 'train'"))


@query("q_quadrants", "SELECT cell_line, drug, smiles, dose, time, quadrant FROM quads")
def quadrants(t):
    return quads(t).select(*OBS, "quadrant")


@query("q_strict_q4", """
SELECT cell_line, drug, smiles, dose FROM obs_keys WHERE cell_line IN (SELECT cell_line FROM quads WHERE quadrant = 'Q3') AND smiles IN (SELECT smiles FROM smiles_split WHERE split = 'test')
""")
def strict_q4(t):
    o = obs_keys(t)
    q3 = quads(t).filter("quadrant = 'Q3'").select("cell_line")
    return o.join(q3, "cell_line", "left_semi").join(smiles_split(o).filter("split = 'test'"), "smiles", "left_semi").select("cell_line", "drug", "smiles", "dose")


@query("q_split_counts", """
SELECT split, count(*) AS n_obs, count(DISTINCT smiles) AS n_compounds, count(DISTINCT cell_line) AS n_cell_lines, count(*) / (SELECT count(*) FROM pinned)::DOUBLE AS share FROM pinned GROUP BY 1
""", "share")
def split_counts(t):
    from pyspark.sql import Window
    c = L.split_counts(pinned(t), ["split"])
    return c.withColumn("share", F.col("n_obs") / F.sum("n_obs").over(Window.partitionBy(F.lit(0))))
