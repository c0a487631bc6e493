"""Perturbation-shaped inputs derived from the given tables (Spark side of `plans.oracle`).

A cell is an order, a gene a part brand, a count an ordered quantity; the customer's market segment
plays the cell line, the order year the plate, the order priority the treatment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators import profiles as P
from platewise.plans.catalog import Tables
from platewise.session import cut_lineage

REFERENCE_LINE = "BUILDING"
CONTROL = "DMSO"


def dose_of(status: Column) -> Column:
    return F.when(status == "F", "0.1 uM").when(status == "O", "1.0 uM").otherwise("10.0 uM")


def cell_meta(t: Tables) -> DataFrame:
    """One row per cell with the labels of its well."""
    o = t.orders.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    plate = F.year("o_orderdate").cast("string")
    rep = F.quarter("o_orderdate").cast("bigint")
    drug = F.when(F.col("o_orderpriority") == "5-LOW", CONTROL).otherwise(F.col("o_orderpriority"))
    dose = dose_of(F.col("o_orderstatus"))
    return o.select(
        F.col("o_orderkey").alias("barcode"), F.col("c_mktsegment").alias("cell_line"), plate.alias("plate"),
        rep.alias("rep"), drug.alias("drug"), dose.alias("dose"), F.lit("24 h").alias("time"),
        F.concat_ws("_", plate, rep.cast("string"), drug, dose).alias("sample"), F.concat(F.lit("S"), drug).alias("smiles"),
    )


def counts(t: Tables) -> DataFrame:
    """Long measurements (barcode, gene, cnt)."""
    return t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("barcode"), F.col("p_brand").alias("gene"), F.col("l_quantity").alias("cnt"))


def genes(t: Tables) -> DataFrame:
    return P.gene_dimension(t.part.select(F.col("p_brand").alias("gene")))


def panel_width(t: Tables) -> int:
    """Size of the gene panel, a number every dense vector needs."""
    return t.part.select("p_brand").distinct().count()


def sparse_bulks(t: Tables) -> DataFrame:
    return P.sparse_pseudobulk(cell_meta(t), counts(t), genes(t))


def pseudobulks(t: Tables) -> DataFrame:
    return P.dense(sparse_bulks(t), panel_width(t))


def sparse_profiles(t: Tables) -> DataFrame:
    return P.log_normalize(sparse_bulks(t))


def profiles(t: Tables) -> DataFrame:
    """Log-normalised wide profiles, one row per (cell_line, sample)."""
    return P.dense(sparse_profiles(t), panel_width(t))


def delta(t: Tables) -> DataFrame:
    return P.delta_of_sparse(sparse_profiles(t), CONTROL, panel_width(t))


def long(t: Tables, wide: DataFrame) -> DataFrame:
    return P.to_long(wide, genes(t))


def fingerprints(t: Tables) -> DataFrame:
    """0/1 fingerprints of the embedding table."""
    return t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0)).alias("bits"))


#: Measurements that a task of `scores` joins, and averages.
SCORE_ROWS = 1_000_000


def scores(t: Tables) -> DataFrame:
    """Per-observation score table of three arms. Joined rows are dealt by observation before they are averaged, over tasks whose number grows with the rows, so that a task's sort and
    its table of means keep their size."""
    parts = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-t.lineitem.count() // SCORE_ROWS))
    o = t.orders.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    base = t.lineitem.repartition(parts, "l_orderkey").join(o.repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    arm = F.when(F.col("l_returnflag") == "A", "reference").when(F.col("l_returnflag") == "N", "model").otherwise("train_mean")
    keyed = base.select(
        arm.alias("arm"), F.col("c_mktsegment").alias("cell_line"), F.concat(F.lit("D"), F.col("l_suppkey")).alias("drug"),
        F.concat(F.lit("S"), F.expr("l_suppkey div 2")).alias("smiles"), dose_of(F.col("o_orderstatus")).alias("dose"),
        F.lit("24 h").alias("time"), "l_discount", "l_tax", "l_quantity", "l_extendedprice")
    return keyed.repartition(parts, "arm", "cell_line", "drug", "smiles", "dose", "time").groupBy("arm", "cell_line", "drug", "smiles", "dose", "time").agg(
        (F.avg("l_discount") * 20 - 1).alias("pearson"), (F.avg("l_tax") * 25 - 1).alias("spearman"),
        F.avg("l_quantity").alias("l2"), (F.avg(F.col("l_discount") + F.col("l_tax")) * 5).alias("cosine"),
        (F.avg("l_extendedprice") / 1000).alias("rmse"))


def bundle(t: Tables) -> DataFrame:
    """Prediction bundle: per treated profile of a target line the truth `y`, the reference delta `ref` and a
    prediction `yhat` (mean of the training plates). The delta table is written once and read by all branches."""
    d = cut_lineage(delta(t))
    target = d.filter(F.col("cell_line") != REFERENCE_LINE).withColumn("split", F.when(F.col("plate") >= "1999", "test").otherwise("train"))
    match = ["drug", "dose", "time"]
    ref = P.average_vectors(d.filter(F.col("cell_line") == REFERENCE_LINE), match, "expr", "ref")
    pred = P.average_vectors(target.filter("split = 'train'"), P.CONDITION, "expr", "yhat")
    return target.withColumnRenamed("expr", "y").drop("rep", "total_cells", "total_umis").join(ref, match).join(pred, P.CONDITION)
