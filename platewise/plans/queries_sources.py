"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import cleaning as C
from platewise.operators import reports as B
from platewise.plans import inputs as I
from platewise.plans.catalog import Tables, query
from platewise.plans.oracle import cte
from platewise.session import scratch_path
from platewise.sources import readers as S
from platewise.sources import writers as W


def stored_cells(t: Tables) -> str:
    """Folder of cell files in their stored shape, several files in two directories: two list columns and eight texts, known by position only."""
    n = F.transform(F.array("l_quantity", "l_linenumber"), lambda x: x.cast("double"))
    text = lambda c: F.col(c).cast("string")
    cells = t.lineitem.select(
        F.array("l_partkey", "l_suppkey").alias("c0"), n.alias("c1"), F.concat(F.lit("D"), "l_suppkey").alias("c2"), text("l_linenumber").alias("c3"), text("l_orderkey").alias("c4"),
        text("l_returnflag").alias("c5"), text("l_shipdate").alias("c6"), text("l_returnflag").alias("c7"), text("l_partkey").alias("c8"), text("l_linestatus").alias("c9"))
    folder = scratch_path(t.spark, "cells")
    for part, flag in (("a", "c7 = 'N'"), ("b", "c7 <> 'N'")):
        cells.filter(flag).repartition(F.col("c4")).write.parquet(f"{folder}/{part}")
    return folder


CELLS = """
SELECT l_orderkey::VARCHAR AS barcode, concat('D', l_suppkey) AS drug, l_returnflag AS cell_line, l_linestatus AS plate, l_partkey AS gene, l_quantity AS value FROM lineitem
UNION ALL SELECT l_orderkey::VARCHAR, concat('D', l_suppkey), l_returnflag, l_linestatus, l_suppkey, l_linenumber FROM lineitem
"""


@query("q_scan_cells", CELLS, "value")
def scan_cells(t):
    return S.explode_cells(S.read_cells(t.spark, stored_cells(t)).select("barcode", "drug", "cell_line", "plate", "genes", "expressions"))


@query("q_scan_cells_panel", f"SELECT * FROM ({CELLS}) WHERE gene IN (SELECT p_partkey FROM part WHERE p_size > 25)", "value")
def scan_cells_panel(t):
    """The same scan restricted to a gene panel; the lists are exploded and joined in one pass."""
    cells = S.read_cells(t.spark, stored_cells(t)).select("barcode", "drug", "cell_line", "plate", "genes", "expressions")
    return S.explode_cells(cells, keep=t.part.filter("p_size > 25").select(F.col("p_partkey").alias("gene")))


@query("q_tsv_scan", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS p_name, p_brand FROM part")
def tsv_scan(t):
    path = scratch_path(t.spark, "tsv")
    name = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")).alias("p_name")
    W.write_tsv(t.part.select(F.col("p_partkey").cast("string").alias("p_partkey"), name, "p_brand"), path)
    return S.read_tsv(t.spark, path, ["p_partkey", "p_name", "p_brand"])


@query("q_align_instances", """
SELECT o_orderkey, c_mktsegment AS cell_line, l_partkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
""", "l_quantity")
def align_instances(t):
    inst = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("cell_line"))
    return t.lineitem.join(inst, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "cell_line", "l_partkey", "l_quantity")


@query("q_gene_subset", "SELECT vec_id, list_transform([1, 5, 9, 33, 64], lambda i: embedding[i]::DOUBLE) AS expr FROM embeddings")
def gene_subset(t):
    from platewise.operators.profiles import keep_positions
    return keep_positions(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("expr")), [0, 4, 8, 32, 63])


@query("q_csv_roundtrip", """
SELECT o_orderkey, concat(o_orderpriority, ', ', o_orderstatus) AS label, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS v, 'semicolon' AS via FROM orders
UNION ALL SELECT o_orderkey, concat(o_orderpriority, ', ', o_orderstatus), CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END, 'gzip' FROM orders
""", "v")
def csv_roundtrip(t):
    v = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("v")
    df = t.orders.select("o_orderkey", F.concat_ws(", ", "o_orderpriority", "o_orderstatus").alias("label"), v)
    schema = "o_orderkey bigint, label string, v double"
    a, b = scratch_path(t.spark, "semi"), scratch_path(t.spark, "gz")
    W.write_semicolon_csv(df, a)
    W.write_csv_gz(df, b)
    first = t.spark.read.csv(a, sep=";", header=True, schema=schema).withColumn("via", F.lit("semicolon"))
    return first.unionByName(t.spark.read.csv(b, header=True, schema=schema, nullValue="NA").withColumn("via", F.lit("gzip")))


RAGGED_TAIL = ["dose", "rmse", "pearson"]
cte("ragged_rows", """
SELECT concat('L', p_size) AS cell_line, concat(p_name, ' ((2S)-1,', p_partkey % 7, '-', p_type, ', hydrate)') AS drug, concat(p_size, '.0 uM') AS dose,
 CAST(p_partkey % 100 AS DOUBLE) / 4 AS rmse, CAST(p_partkey % 8 AS DOUBLE) / 8 AS pearson, p_partkey FROM part
""")


def ragged_file(t: Tables) -> str:
    """Score lines whose drug field holds commas, quoted in every third row only."""
    drug = F.concat("p_name", F.lit(" ((2S)-1,"), F.col("p_partkey") % 7, F.lit("-"), "p_type", F.lit(", hydrate)"))
    shown = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('"'), drug, F.lit('"'))).otherwise(drug)
    line = F.concat_ws(",", F.concat(F.lit("L"), "p_size"), shown, F.concat("p_size", F.lit(".0 uM")),
                       ((F.col("p_partkey") % 100) / 4).cast("string"), ((F.col("p_partkey") % 8) / 8).cast("string"))
    path = scratch_path(t.spark, "ragged")
    t.part.select(line.alias("value")).write.text(path)
    return path


@query("q_ragged_csv", "SELECT cell_line, drug, dose, rmse, pearson FROM ragged_rows", "rmse pearson")
def ragged_csv(t):
    df = S.read_ragged(t.spark, ragged_file(t), ["cell_line"], "drug", RAGGED_TAIL)
    return df.withColumn("rmse", F.col("rmse").cast("double")).withColumn("pearson", F.col("pearson").cast("double"))


@query("q_ragged_metrics", "SELECT rmse, pearson FROM ragged_rows", "rmse pearson")
def ragged_metrics(t):
    return S.read_ragged_metrics(t.spark, ragged_file(t), RAGGED_TAIL[1:], "cell_line,drug")


@query("q_embed_decode", "SELECT vec_id, pos, x FROM emb_long", "x")
def embed_decode(t):
    folder = scratch_path(t.spark, "embeds")
    W.write_embeddings(t.embeddings.select("vec_id", "embedding"), folder, "plain")
    return S.read_embeddings(t.spark, folder).select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))


@query("q_multi_repr", """
SELECT 'plain' AS representation, vec_id, x AS first_value FROM emb_long WHERE pos = 0 UNION ALL SELECT 'bits', vec_id, CASE WHEN x > 0 THEN 1 ELSE 0 END FROM emb_long WHERE pos = 0
""", "first_value")
def multi_repr(t):
    folder = scratch_path(t.spark, "reprs")
    W.write_embeddings(t.embeddings.select("vec_id", "embedding"), folder, "plain")
    W.write_embeddings(I.fingerprints(t).select("vec_id", F.col("bits").alias("embedding")), folder, "bits")
    return S.read_embeddings(t.spark, folder).select("representation", "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("first_value"))


@query("q_gmt_sizes", """
SELECT term, count(DISTINCT gene) AS n_genes, min(gene) AS first_gene FROM (SELECT p_brand AS term, concat('G', p_size) AS gene FROM part UNION ALL SELECT p_type, concat('G', p_size) FROM part) GROUP BY 1
""")
def gmt_sizes(t):
    gene = F.concat(F.lit("G"), "p_size")
    long = t.part.select(F.col("p_brand").alias("term"), gene.alias("gene")).unionByName(t.part.select(F.col("p_type").alias("term"), gene.alias("gene")))
    sets = long.groupBy("term").agg(F.collect_set("gene").alias("genes")).withColumn("source", F.lit("local"))
    path = scratch_path(t.spark, "gmt")
    W.write_gmt(sets, path)
    return S.read_gmt(t.spark, path).select("term", F.size("genes").cast("bigint").alias("n_genes"), F.array_min("genes").alias("first_gene"))


@query("q_partitioned_sink", "SELECT o_orderkey, o_orderstatus AS split, o_orderpriority AS baseline FROM orders")
def partitioned_sink(t):
    path = scratch_path(t.spark, "parts")
    W.write_partitioned(t.orders.select("o_orderkey", F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("baseline")), path, ["baseline", "split"])
    return t.spark.read.parquet(path)


@query("q_chunk_union", "SELECT p_partkey AS gene, p_retailprice AS plate_share, p_size AS residual FROM part", "plate_share")
def chunk_union(t):
    folder = scratch_path(t.spark, "chunks")
    for i, cond in enumerate(("p_size <= 25", "p_size > 25")):
        t.part.filter(cond).select(F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("cell_line:plate"), F.col("p_size").alias("Residuals")) \
            .write.csv(f"{folder}/vp_chunk{i}.csv", header=True)
    df = S.read_chunks(t.spark, f"{folder}/*_chunk*.csv", f"{folder}/vp.csv", "gene BIGINT, `cell_line:plate` DOUBLE, Residuals INT", {"cell_line:plate": "plate_share", "Residuals": "residual"})
    return df.select(F.col("gene").cast("bigint").alias("gene"), F.col("plate_share").cast("double").alias("plate_share"), F.col("residual").cast("int").alias("residual"))


cte("run_text", """
SELECT concat('exp', c_nationkey, '_', c_mktsegment, '_', strftime(max(o_orderdate), '%Y-%m-%d_%H%M%S')) AS dir_name, c_custkey AS run_id,
  max(o_totalprice) / 600000 AS val_spearman, min(o_totalprice) / 600000 AS test_pearson, count(*) AS n_train
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey, c_mktsegment
""")


cte("experiment_meta", """
SELECT concat('exp', n_nationkey, '_', seg) AS experiment, r_name AS dataset, lower(seg) AS category, concat(n_name, ' ', seg) AS label FROM nation JOIN region ON n_regionkey = r_regionkey,
 (SELECT DISTINCT c_mktsegment AS seg FROM customer) WHERE n_nationkey % 7 <> 6
""")


@query("q_run_registry", r"""
WITH p AS (SELECT *, regexp_extract(dir_name, '_(\d{4}-\d{2}-\d{2}_\d{6})$', 1) AS stamp, regexp_extract(dir_name, '^(.*)_\d{4}-\d{2}-\d{2}_\d{6}$', 1) AS experiment FROM run_text)
SELECT experiment, stamp, run_id, val_spearman, test_pearson, n_train, dataset, category, label FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY stamp, run_id) AS rn FROM p JOIN experiment_meta USING (experiment)) WHERE rn <= 50
""", "val_spearman test_pearson")
def run_registry(t):
    return B.run_registry(run_text(t), 50, experiment_meta(t)).select("experiment", "stamp", "run_id", "val_spearman", "test_pearson", "n_train", "dataset", "category", "label")


def experiment_meta(t: Tables):
    """Data set, category and label of every experiment that is listed."""
    seg = F.col("c_mktsegment")
    lands = t.nation.filter("n_nationkey % 7 <> 6").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").distinct().join(lands, "n_nationkey").select(
        F.concat(F.lit("exp"), "n_nationkey", F.lit("_"), seg).alias("experiment"), F.col("r_name").alias("dataset"), F.lower(seg).alias("category"), F.concat_ws(" ", "n_name", seg).alias("label"))


def run_text(t: Tables):
    """Run folders (one per customer) and the text of their summaries."""
    r = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey", "c_nationkey", "c_mktsegment").agg(
        F.max("o_orderdate").alias("ts"), F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"), F.count(F.lit(1)).alias("n"))
    name = F.concat(F.lit("exp"), "c_nationkey", F.lit("_"), "c_mktsegment", F.lit("_"), F.date_format("ts", "yyyy-MM-dd_HHmmss"))
    body = F.concat(F.lit("val_spearman = "), (F.col("hi") / 600000).cast("string"), F.lit("\ntest_pearson = "), (F.col("lo") / 600000).cast("string"),
                    F.lit("\nn_train = "), F.col("n").cast("string"), F.lit("\nnote = \"x\"\n"))
    return r.select(name.alias("dir_name"), F.col("c_custkey").alias("run_id"), body.alias("summary"))


@query("q_validate_bundle", """
SELECT count(*) AS n_rows, count(*) FILTER (len(embedding) <> 64) AS n_bad_shape, count(*) FILTER (NOT list_bool_and(list_transform(embedding, lambda x: isfinite(x)))) AS n_not_finite FROM embeddings
""")
def validate_bundle(t):
    return B.validate_bundle(C.require_columns(t.embeddings, ["vec_id", "embedding", "label"]), ["embedding"], 64)
