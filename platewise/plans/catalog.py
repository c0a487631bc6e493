"""Registry of named queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.plans.oracle import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


@dataclass(frozen=True)
class Tables:
    """The input tables of one scale directory, read lazily by name."""

    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        object.__setattr__(self, name, df)
        return df


def rounded(value: Column, digits: int) -> Column:
    """`F.round` of a double, without its decimal per value: a whole number over a power of ten is that decimal's double, too. Values whose scaled fraction lies near one half, where the
    error of the product could decide, and large ones go through `F.round` itself."""
    scaled, scale = value * F.lit(10.0 ** digits), F.lit(10.0 ** digits)
    whole = F.rint(scaled)
    clear = (F.abs(scaled - whole) < 0.499) & (F.abs(scaled) < 1e12)
    return F.when(clear, whole / scale).otherwise(F.round(value, digits)) + F.lit(0.0)


def settle(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles and turn NaN into NULL, so that two engines can be compared."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.dataType.simpleString() in ("double", "float"):
            c = F.when(~F.isnan(c), rounded(c.cast("double"), digits)).alias(field.name)
        out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None, floats: str = "", digits: int = DIGITS):
    """Register `fn(tables) -> DataFrame` under `name`; `sql` may use the shared CTEs by name."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return settle(fn(Tables(spark, sf_dir)), digits)

        QUERIES[name] = run
        if sql is not None:
            body = sql.strip().rstrip(";")
            if floats:
                cols = ", ".join(
                    f"CASE WHEN NOT isnan(CAST({c} AS DOUBLE)) THEN round(CAST({c} AS DOUBLE), {digits}) + 0.0::DOUBLE END AS {c}"
                    for c in floats.split()
                )
                body = f"SELECT * REPLACE ({cols}) FROM (\n{body}\n)"
            ORACLES[name] = with_ctes(body)
        return fn

    return wrap
