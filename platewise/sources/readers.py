"""Text, CSV, gene-set and embedding sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.functions.ranks import decode_f32


def string_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_tsv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Tab-separated text, every column a string, an empty field stays ''."""
    return spark.read.csv(path, sep="\t", header=True, schema=string_schema(names)).na.fill("")


def read_semicolon_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, sep=";", header=True, schema=schema, nullValue="NA")


def read_ragged(spark: SparkSession, path: str, lead: Sequence[str], free: str, tail: Sequence[str], header: bool = True) -> DataFrame:
    """Comma-separated lines whose one free-text field may hold unquoted commas: the first fields and the
    last fields are fixed, what is left between them is joined again."""
    lines = spark.read.text(path)
    if header:
        lines = lines.filter(~F.col("value").startswith(",".join([*lead, free])))
    parts = F.split("value", ",")
    n, n_lead, n_tail = F.size("p"), len(lead), len(tail)
    middle = F.array_join(F.slice("p", F.lit(n_lead + 1), n - n_lead - n_tail), ",")
    quoted = middle.startswith('"') & middle.endswith('"')
    text = F.when(quoted, F.expr("substring(m, 2, length(m) - 2)")).otherwise(F.col("m"))
    rows = lines.select(parts.alias("p")).filter(F.size("p") >= n_lead + n_tail + 1).withColumn("m", middle)
    return rows.select(
        *[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(lead)], text.alias(free),
        *[F.element_at("p", i - n_tail).alias(c) for i, c in enumerate(tail)])


def read_ragged_metrics(spark: SparkSession, path: str, tail: Sequence[str], header_start: str) -> DataFrame:
    """Only the trailing numeric fields of a ragged file."""
    p = F.split("value", ",")
    return spark.read.text(path).filter(~F.col("value").startswith(header_start)).select(
        *[F.element_at(p, i - len(tail)).try_cast("double").alias(c) for i, c in enumerate(tail)])


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """Gene-set lines (term, source, genes...) to one row per term with distinct genes."""
    p = F.split("value", "\t")
    return spark.read.text(path).select(
        F.get(p, F.lit(0)).alias("term"), F.get(p, F.lit(1)).alias("source"),
        F.array_sort(F.array_distinct(F.filter(F.slice(p, F.lit(3), F.greatest(F.size(p) - 2, F.lit(0))), lambda g: g != ""))).alias("genes"))


#: Columns of a stored cell file by position; the names in the files are not relied on.
CELL_COLUMNS = ["genes", "expressions", "drug", "sample", "barcode", "cell_line", "moa", "smiles", "pubchem", "plate"]


def read_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Every cell file below a folder: two list columns (gene ids, values) and eight text columns, taken by position."""
    raw = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    if len(raw.columns) < len(CELL_COLUMNS):
        raise ValueError(f"a cell file needs {len(CELL_COLUMNS)} columns")
    return raw.select(raw.columns[:len(CELL_COLUMNS)]).toDF(*CELL_COLUMNS)


def explode_cells(cells: DataFrame, genes: str = "genes", values: str = "expressions", keep: DataFrame | None = None) -> DataFrame:
    """List columns of a cell table to long rows; with `keep` (allowed gene ids) the rest is dropped at once."""
    rest = [c for c in cells.columns if c not in (genes, values)]
    long = cells.select(*rest, F.explode(F.arrays_zip(F.col(genes).alias("gene"), F.col(values).alias("value"))).alias("e"))
    long = long.select(*rest, F.col("e.gene").alias("gene"), F.col("e.value").cast("double").alias("value"))
    return long if keep is None else long.join(keep, "gene", "left_semi")


def read_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Every `<representation>/embeds.parquet` below a folder as one table; float32 bytes are decoded."""
    raw = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/embeds\.parquet", 1)
    return raw.select(name.alias("representation"), *[F.col(c) for c in raw.columns if c != "embedding"],
                      decode_f32(F.col("embedding")).alias("embedding"))


def read_chunks(spark: SparkSession, pattern: str, merged: str, schema: str, rename: dict[str, str]) -> DataFrame:
    """All chunk files of a pattern, or the merged file when there is no chunk, read by `schema`; columns renamed."""
    paths = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    hits = paths.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(paths)
    source = pattern if hits is not None and len(hits) > 0 else merged
    return spark.read.csv(source, header=True, schema=schema).withColumnsRenamed(rename)
