"""Helpers shared by the corpus operators: table access, staging, batches of bounded bytes, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.session import scratch_path

#: Bytes of text that a Python task works on at once (a single longer text is still taken whole).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or `name_1`, `name_2`, ... if the frame already has such a column (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out, n = name, 0
    while out.lower() in taken:
        n += 1
        out = f"{name}_{n}"
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name}`")


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a frame once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).option("parquet.compression.codec.zstd.level", "6").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_in = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove what `staged` wrote for these frames. Only for tables that nothing reads any more: all that was made from them is written itself."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_in)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_row_id(df: DataFrame, name: str = "__row") -> tuple[DataFrame, str]:
    """Number rows by scan position. The numbers hold within one plan only, since another may cut the files otherwise: where they are used twice, stage the result."""
    name = fresh(df, name)
    return df.withColumn(name, F.monotonically_increasing_id()), name


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts (or 32-bit lists) of one piece hold about `limit` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        sizes = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
        sizes = pc.fill_null(sizes, 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected `edges` (a, b bigint): one row (node, root) per linked node except the roots
    themselves; root is the smallest node of its component. Alternates large-star and small-star steps, each an aggregate and
    an equi-join, until only stars are left; every round is written to the shared folder."""
    e = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("s"))
        last, e = e, staged(small.select("s.u", F.col("s.m").alias("v")).filter("u <> v").distinct(), "edges")
        discard(last)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(e: DataFrame) -> bool:
    """Whether every node points to one other at most and nothing points on from there."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("out")).union(e.select(F.col("v").alias("node"), F.lit(0).alias("out")))
    return ends.groupBy("node").agg(F.sum("out").alias("n"), F.min("out").alias("low")).filter("n > 1 OR (n = 1 AND low = 0)").isEmpty()
