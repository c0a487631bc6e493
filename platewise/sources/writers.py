"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions.ranks import encode_f32


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, emptyValue="", nullValue="")


def write_semicolon_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep=";", header=True)


def write_csv_gz(df: DataFrame, path: str) -> None:
    """Compressed table with NULL as NA; fields with commas are quoted."""
    df.write.csv(path, header=True, compression="gzip", nullValue="NA")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    df.write.partitionBy(*by).parquet(path)


def write_gmt(sets: DataFrame, path: str) -> None:
    """(term, source, genes) to gene-set lines: distinct genes in order, terms sorted in ranges."""
    genes = F.array_sort(F.array_distinct("genes"))
    sets.orderBy("term").select(F.concat_ws("\t", F.concat(F.array("term", "source"), genes)).alias("value")).write.text(path)


def write_embeddings(df: DataFrame, folder: str, representation: str) -> None:
    df.withColumn("embedding", encode_f32(F.col("embedding"))).write.parquet(f"{folder}/{representation}/embeds.parquet")
