"""Filters, projections, cleaning and quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.functions import text as X
from platewise.functions.hashing import stable_id
from platewise.operators import cleaning as C
from platewise.operators import profiles as P
from platewise.plans import inputs as I
from platewise.plans.catalog import Tables, query
from platewise.plans.oracle import cte

cte("instances", """
SELECT CAST(o_orderkey AS VARCHAR) AS sample_id,
  CASE o_orderpriority WHEN '5-LOW' THEN 'ctl_vehicle' WHEN '4-NOT SPECIFIED' THEN 'trt_sh' ELSE 'trt_cp' END AS pert_type,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'DMSO' ELSE concat('P', o_custkey) END AS pert_id,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN '0' ELSE '1' END AS qc_pass,
  concat('PL', o_custkey % 500) AS det_plate, CASE WHEN quarter(o_orderdate) <= 2 THEN '6 h' ELSE '24 h' END AS pert_itime,
  CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '' ELSE concat(quarter(o_orderdate), ' uM') END AS pert_idose,
  c_mktsegment AS cell_iname
FROM orders JOIN customer ON o_custkey = c_custkey
""")
cte("compound_rows", """
SELECT concat('P', p_partkey) AS pert_id,
  CASE p_size % 10 WHEN 0 THEN '' WHEN 1 THEN 'restricted' WHEN 2 THEN NULL ELSE concat('C', p_name) END AS canonical_smiles,
  p_brand AS inchi_key, p_name AS cmap_name FROM part
UNION ALL
SELECT concat('P', p_partkey), concat('N', p_name), concat(p_brand, 'x'), p_name FROM part WHERE p_size % 7 = 0
""")
cte("kept_wells", """
SELECT * FROM instances WHERE ((pert_type = 'ctl_vehicle' AND pert_id = 'DMSO') OR pert_type = 'trt_cp') AND qc_pass = '1'
""")


def instances(t: Tables):
    o = t.orders.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    pri, key, quarter = F.col("o_orderpriority"), F.col("o_orderkey"), F.quarter("o_orderdate")
    ctl = pri == "5-LOW"
    return o.select(
        key.cast("string").alias("sample_id"),
        F.when(ctl, C.CONTROL_TYPE).when(pri == "4-NOT SPECIFIED", "trt_sh").otherwise(C.TREATED_TYPE).alias("pert_type"),
        F.when(ctl, C.CONTROL_ID).otherwise(F.concat(F.lit("P"), F.col("o_custkey"))).alias("pert_id"),
        F.when((F.col("o_orderstatus") == "F") & (key % 3 == 0), "0").otherwise("1").alias("qc_pass"),
        F.concat(F.lit("PL"), F.col("o_custkey") % 500).alias("det_plate"),
        F.when(quarter <= 2, "6 h").otherwise("24 h").alias("pert_itime"),
        F.when(ctl, "").when(key % 11 == 0, F.lit(None)).when(key % 13 == 0, "").otherwise(F.concat(quarter, F.lit(" uM"))).alias("pert_idose"),
        F.col("c_mktsegment").alias("cell_iname"))


def compounds(t: Tables):
    digit = F.col("p_size") % 10
    pid = F.concat(F.lit("P"), F.col("p_partkey")).alias("pert_id")
    first = t.part.select(pid, F.when(digit == 0, "").when(digit == 1, "restricted").when(digit == 2, F.lit(None))
                          .otherwise(F.concat(F.lit("C"), F.col("p_name"))).alias("canonical_smiles"),
                          F.col("p_brand").alias("inchi_key"), F.col("p_name").alias("cmap_name"))
    second = t.part.filter(F.col("p_size") % 7 == 0).select(
        pid, F.concat(F.lit("N"), F.col("p_name")).alias("canonical_smiles"),
        F.concat(F.col("p_brand"), F.lit("x")).alias("inchi_key"), F.col("p_name").alias("cmap_name"))
    return first.unionByName(second)


PLATE_KEY = ["det_plate", "pert_itime", "cell_iname"]


@query("q_filter_ctl_trt", "SELECT sample_id, pert_type, pert_id, cell_iname FROM kept_wells")
def filter_ctl_trt(t):
    return C.control_or_treated(instances(t)).select("sample_id", "pert_type", "pert_id", "cell_iname")


@query("q_has_control_semi", """
SELECT sample_id, pert_id, det_plate, pert_itime, cell_iname FROM kept_wells k WHERE EXISTS (
  SELECT 1 FROM kept_wells c WHERE c.pert_type = 'ctl_vehicle' AND c.det_plate = k.det_plate AND c.pert_itime = k.pert_itime AND c.cell_iname = k.cell_iname)
""")
def has_control_semi(t):
    return C.with_control_on_plate(C.control_or_treated(instances(t)), PLATE_KEY).select("sample_id", "pert_id", *PLATE_KEY)


@query("q_annotate_left", """
SELECT sample_id, pert_id, canonical_smiles, inchi_key, cmap_name FROM kept_wells LEFT JOIN compound_rows USING (pert_id)
""")
def annotate_left(t):
    return C.control_or_treated(instances(t)).join(compounds(t), "pert_id", "left").select(
        "sample_id", "pert_id", "canonical_smiles", "inchi_key", "cmap_name")


@query("q_first_per_group", """
SELECT pert_id, canonical_smiles, arg_min(cmap_name, inchi_key) AS cmap_name
FROM compound_rows GROUP BY pert_id, canonical_smiles
""")
def first_per_group(t):
    return C.first_per_group(compounds(t), ["pert_id", "canonical_smiles"], "cmap_name", ["inchi_key"])


@query("q_valid_smiles", """
SELECT sample_id, pert_id, coalesce(canonical_smiles, '') AS smiles, CASE WHEN pert_type = 'ctl_vehicle' THEN 'NA' ELSE pert_idose END AS dose
FROM kept_wells LEFT JOIN compound_rows USING (pert_id)
WHERE pert_type = 'ctl_vehicle' OR coalesce(canonical_smiles, '') NOT IN ('', 'restricted')
""")
def valid_smiles(t):
    df = C.control_or_treated(instances(t)).join(compounds(t), "pert_id", "left")
    ctl = C.is_control(F.col("pert_type"), F.col("pert_id"))
    return df.filter(C.valid_structure(F.col("canonical_smiles"), ctl)).select(
        "sample_id", "pert_id", F.coalesce("canonical_smiles", F.lit("")).alias("smiles"),
        F.when(ctl, "NA").otherwise(F.col("pert_idose")).alias("dose"))


@query("q_required_cols", """
SELECT cell_iname AS cell_line, sample_id AS sample, det_plate AS plate, pert_id AS drug, pert_idose AS dose, pert_itime AS time
FROM kept_wells WHERE pert_idose IS NOT NULL AND pert_idose <> ''
""")
def required_cols(t):
    df = C.complete_rows(C.control_or_treated(instances(t)), ["cell_iname", "sample_id", "det_plate", "pert_id", "pert_idose", "pert_itime"])
    return df.select(F.col("cell_iname").alias("cell_line"), F.col("sample_id").alias("sample"), F.col("det_plate").alias("plate"),
                     F.col("pert_id").alias("drug"), F.col("pert_idose").alias("dose"), F.col("pert_itime").alias("time"))


@query("q_trim_all", """
SELECT trim(concat('  ', p_name, ' ')) AS p_name, trim(concat(p_brand, '   ')) AS p_brand, p_partkey FROM part
""")
def trim_all(t):
    padded = t.part.select(F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("p_name"), F.concat("p_brand", F.lit("   ")).alias("p_brand"), "p_partkey")
    return C.trim_all(padded)


@query("q_gene_allowlist", """
SELECT barcode, gene, cnt FROM counts WHERE gene IN (SELECT p_brand FROM part WHERE p_size = 1 AND p_type = 'PROMO')
""", "cnt")
def gene_allowlist(t):
    allowed = t.part.filter("p_size = 1 and p_type = 'PROMO'").select(F.col("p_brand").alias("gene"))
    return C.restrict(I.counts(t), allowed, ["gene"])


cte("sample_text", """
SELECT concat('S', p_partkey) AS sample,
  CASE WHEN p_size % 13 = 0 THEN '[]' WHEN p_size % 5 = 0 THEN concat('[(''', p_name, ''', ', p_size, '.5, ''uM''), (''x'', 1.0, ''nM'')]')
  ELSE concat('[(''', p_name, ''', ', p_size, 'e-3, ''uM'')]') END AS drugname_drugconc FROM part
""")


def sample_text(t: Tables):
    size, name = F.col("p_size"), F.col("p_name")
    return t.part.select(
        F.concat(F.lit("S"), "p_partkey").alias("sample"),
        F.when(size % 13 == 0, "[]")
        .when(size % 5 == 0, F.concat(F.lit("[('"), name, F.lit("', "), size, F.lit(".5, 'uM'), ('x', 1.0, 'nM')]")))
        .otherwise(F.concat(F.lit("[('"), name, F.lit("', "), size, F.lit("e-3, 'uM')]"))).alias("drugname_drugconc"))


@query("q_dose_regex", r"""
SELECT sample, concat_ws(' ', regexp_extract(drugname_drugconc, '\(''([^'']+)'',\s*([\d\.eE+-]+),\s*''([^'']+)''\)', 2),
  regexp_extract(drugname_drugconc, '\(''([^'']+)'',\s*([\d\.eE+-]+),\s*''([^'']+)''\)', 3)) AS dose
FROM sample_text WHERE regexp_matches(drugname_drugconc, '\(''([^'']+)'',\s*([\d\.eE+-]+),\s*''([^'']+)''\)')
""")
def dose_regex(t):
    return sample_text(t).select("sample", X.dose_from_tuples(F.col("drugname_drugconc")).alias("dose")).dropna(subset=["dose"])


@query("q_lookup_strict", """
SELECT l_orderkey AS sample, p_name AS dose, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
""")
def lookup_strict(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("sample"), F.col("l_partkey").alias("k"))
    joined = C.strict_lookup(rows, t.part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("dose")), ["k"])
    return joined.groupBy("sample", "dose").agg(F.count(F.lit(1)).alias("n"))


@query("q_patch_values", """
SELECT s.p_partkey AS drug, coalesce(m.smiles, CASE WHEN s.p_size % 4 = 0 THEN '' ELSE s.p_name END) AS smiles, 'v1' AS batch
FROM part s LEFT JOIN (SELECT p_partkey, concat('fix', p_brand) AS smiles FROM part WHERE p_size % 8 = 0) m USING (p_partkey)
""")
def patch_values(t):
    base = t.part.select(F.col("p_partkey").alias("drug"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_name")).alias("smiles"))
    patch = t.part.filter("p_size % 8 = 0").select(F.col("p_partkey").alias("drug"), F.concat(F.lit("fix"), "p_brand").alias("smiles"))
    return C.patch_values(base, patch, "drug", "smiles").withColumn("batch", F.lit("v1"))


@query("q_missing_structures", """
SELECT p_brand AS drug, count(*) AS n_rows FROM part WHERE p_size % 4 = 0 AND p_brand <> 'Brand#11' GROUP BY 1
""")
def missing_structures(t):
    base = t.part.select(F.col("p_brand").alias("drug"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_name")).alias("smiles"))
    return C.missing_structures(base, "Brand#11")


@query("q_dup_check", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1
""")
def dup_check(t):
    return C.duplicate_rows(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ignore=["l_quantity"])


@query("q_qc_filter", """
WITH f AS (SELECT *, total_cells >= 6 AND total_umis >= 600 AS qc_pass FROM bulk_meta),
bad AS (SELECT cell_line FROM f GROUP BY 1 HAVING avg(CASE WHEN qc_pass THEN 0.0 ELSE 1.0 END) > 0.46)
SELECT cell_line, sample, total_cells, total_umis, qc_pass FROM f WHERE cell_line NOT IN (SELECT cell_line FROM bad)
""", "total_umis")
def qc_filter(t):
    flagged = C.qc_flag(I.sparse_bulks(t), 6, 600)
    return C.drop_failing_lines(flagged, 0.46).select("cell_line", "sample", "total_cells", "total_umis", "qc_pass")


@query("q_log_normalize", """
SELECT cell_line, sample, gene, round_even(total_umis, 2) AS total_umis, value FROM profile_long
""", "total_umis value")
def log_normalize(t):
    return I.long(t, I.profiles(t)).select("cell_line", "sample", "gene", "total_umis", "value")


@query("q_distinct_compounds", "SELECT DISTINCT trim(drug) AS drug, trim(smiles) AS smiles FROM cell_meta WHERE drug <> 'DMSO'")
def distinct_compounds(t):
    return C.distinct_compounds(I.cell_meta(t))


@query("q_choose_dose_time", """
SELECT barcode, drug, dose, time FROM cell_meta WHERE time IN ('24 h') AND (drug = 'DMSO' OR dose IN ('1.0 uM', '10.0 uM'))
""")
def choose_dose_time(t):
    return C.choose_dose_time(I.cell_meta(t), ["1.0 uM", "10.0 uM"], ["24 h"]).select("barcode", "drug", "dose", "time")


@query("q_gene_mask", """
WITH shared AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS new_idx FROM
  (SELECT DISTINCT p_brand AS gene FROM part WHERE p_size <= 25 AND p_brand LIKE 'Brand#1%'))
SELECT cell_line, sample, new_idx AS pos, gene, value FROM profile_long JOIN shared USING (gene)
""", "value")
def gene_mask(t):
    shared = P.gene_dimension(t.part.filter("p_size <= 25 and p_brand like 'Brand#1%'").select(F.col("p_brand").alias("gene")))
    cut = P.keep_positions(I.profiles(t), P.panel_positions(I.genes(t), shared))
    out = P.to_long(cut.select("cell_line", "sample", "expr")).withColumnRenamed("gene_idx", "pos")
    return out.join(shared.withColumnRenamed("gene_idx", "pos"), "pos").select("cell_line", "sample", "pos", "gene", "value")


@query("q_parse_number", r"""
SELECT p_partkey, TRY_CAST(nullif(regexp_extract(concat(p_name, ' ', p_retailprice, ' uM'), '([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)', 1), '') AS DOUBLE) AS num FROM part
""", "num")
def parse_number(t):
    return t.part.select("p_partkey", X.parse_number(F.concat_ws(" ", "p_name", F.col("p_retailprice").cast("string"), F.lit("uM"))).alias("num"))


@query("q_stable_id", """
SELECT o_orderkey, concat('obs_', substr(sha256(concat_ws(chr(31), cast(o_custkey AS VARCHAR), o_orderpriority,
  coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END, 'NA'))), 1, 16)) AS obs_id FROM orders
""")
def q_stable_id(t):
    status = F.when(F.col("o_orderstatus") == "F", F.lit(None)).otherwise(F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", stable_id("obs_", F.col("o_custkey"), F.col("o_orderpriority"), status).alias("obs_id"))


@query("q_signature", """
SELECT count(*) AS n_rows, bit_xor(h) AS xor_hash, CAST(sum(h) AS VARCHAR) AS sum_hash FROM (
  SELECT ('0x' || substr(md5(concat_ws('|', cast(o_orderkey AS VARCHAR), o_orderpriority)), 1, 8))::BIGINT AS h FROM orders)
""")
def signature(t):
    return C.set_signature(t.orders, ["o_orderkey", "o_orderpriority"])


@query("q_fdr_class", """
SELECT l_orderkey, l_linenumber, l_partkey, q, CASE WHEN q < 0.001 THEN '***' WHEN q < 0.01 THEN '**' WHEN q < 0.05 THEN '*' ELSE 'n.s.' END AS stars,
  CASE WHEN q < 0.05 AND l_quantity >= 25 THEN 'significant up' WHEN q < 0.05 THEN 'significant down' ELSE 'not significant' END AS class
FROM (SELECT *, l_discount * l_tax * 5 AS q FROM lineitem)
""", "q")
def fdr_class(t):
    q = F.col("l_discount") * F.col("l_tax") * 5
    label = F.when((q < 0.05) & (F.col("l_quantity") >= 25), "significant up").when(q < 0.05, "significant down").otherwise("not significant")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", q.alias("q"), X.stars(q).alias("stars"), label.alias("class"))


@query("q_fmt_p", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p IS NULL THEN 'n/a' WHEN p < 1e-300 THEN '<1e-300'
  WHEN p < 1e-3 THEN format('{:.0e}', p) ELSE format('{:.3f}', p) END AS p_text
FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN NULL ELSE exp(-l_quantity * l_discount * 10) END AS p FROM lineitem)
""")
def fmt_p(t):
    p = F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.exp(-F.col("l_quantity") * F.col("l_discount") * 10))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.p_text(p).alias("p_text"))


@query("q_param_count", """
SELECT p_partkey, (p_size * 64 + 64) + (64 * (p_size + 2) + p_size + 2) + ((p_size + 2) * 25 + 25) AS n_params FROM part
""")
def param_count(t):
    layers = X.layer_sizes(F.concat(F.lit("[64, "), F.col("p_size") + 2, F.lit("]")))
    return t.part.select("p_partkey", X.parameter_count(F.col("p_size"), layers, F.lit(25)).alias("n_params"))


@query("q_to_json", """
SELECT p_partkey, concat('{"name":"', p_name, '","price":', CASE WHEN p_size % 9 = 0 THEN 'null' ELSE cast(p_size AS VARCHAR) END, '}') AS metrics FROM part
""")
def to_json(t):
    price = F.when(F.col("p_size") % 9 != 0, F.col("p_size"))
    return t.part.select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), price.alias("price")), {"ignoreNullFields": "false"}).alias("metrics"))
