"""Grouped summaries: quantiles, histograms, inventories, two-level means."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.plans.ordering import exact_quantiles
from platewise.session import cut_lineage

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def distribution_summary(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float] | None = None) -> DataFrame:
    """Count, mean, population deviation and exact quantiles of the finite values per group."""
    by = list(by)
    ok = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    base = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return base.join(exact_quantiles(ok, by, value, probs or QUARTILES), by)


def histogram(df: DataFrame, by: Sequence[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Equal bins [a, b), the last one closed; midpoint, count, density over all finite values, share of the peak; empty bins are present. `n`, `mean`
    and `median` describe all finite values of the group, those outside the bins too."""
    by = list(by)
    width = (hi - lo) / bins
    v = F.col(value)
    index = F.least(F.floor((v - lo) / width), F.lit(bins - 1)).cast("int")
    df = df.filter(v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v) < float("inf")))
    whole = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).join(exact_quantiles(df, by, value, {"median": 0.5}), by)
    counted = df.filter((v >= lo) & (v <= hi)).groupBy(*by, index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = whole.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = spine.join(counted, by + ["bin"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
    g = Window.partitionBy(*by)
    return full.select(*by, "bin", (F.lit(lo) + F.col("bin") * width).alias("left"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("right"),
                       (F.lit(lo) + (F.col("bin") + 0.5) * width).alias("midpoint"), "count", (F.col("count") / (F.col("n") * width)).alias("density"),
                       (F.col("count") / F.greatest(F.max("count").over(g), F.lit(1).cast("bigint"))).alias("peak"), "n", "mean", "median")


def inventory(df: DataFrame, distinct: Sequence[str], flags: dict[str, str]) -> DataFrame:
    """Distinct counts and conditional counts, one row per measure."""
    row = df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in distinct], *[F.count_if(F.expr(e)).alias(f"n_{n}") for n, e in flags.items()])
    return row.unpivot([], row.columns, "measure", "n")


def micro_macro(df: DataFrame, by: Sequence[str], cluster: str, value: str) -> DataFrame:
    """Mean over observations next to the mean of cluster means."""
    per = df.groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    return per.groupBy(*by).agg((F.sum("s") / F.sum("c")).alias("micro"), F.avg(F.col("s") / F.col("c")).alias("macro"),
                                F.count(F.lit(1)).alias("n_clusters"), F.sum("c").alias("n"))


def best_per_group(df: DataFrame, by: Sequence[str], score: str, tie: Sequence[str], largest: bool = True) -> DataFrame:
    """Row with the best finite score per group, first by `tie` among equals. The best score is a hash aggregate of numbers; only the rows that reach it
    are compared by `tie`."""
    rest = [c for c in df.columns if c not in by]
    ok = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    best = ok.groupBy(*by).agg((F.max(score) if largest else F.min(score)).alias("_best"))
    level = ok.join(best, list(by)).filter(F.col(score) == F.col("_best"))
    return level.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in tie])).alias("r")).select(*by, "r.*")


def condition_quality(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per condition: pairs, defined pairs, mean and median Pearson, mean norm, distinct replicates on either side."""
    by, pairs = list(by), cut_lineage(pairs)
    base = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count("pearson").alias("n_defined"), F.avg("pearson").alias("mean_pearson"),
        ((F.avg("norm_rep_i") + F.avg("norm_rep_j")) / 2).alias("mean_norm"))
    reps = pairs.select(*by, F.explode(F.array("rep_i", "rep_j")).alias("rep")).groupBy(*by).agg(F.count_distinct("rep").alias("n_replicates"))
    return base.join(reps, by).join(exact_quantiles(pairs, by, "pearson", {"median_pearson": 0.5}), by, "left")


def median_spread(df: DataFrame, by: Sequence[str], arm: str, arms: Sequence[str], value: str) -> DataFrame:
    """Range of per-arm medians over the rows that have every arm."""
    wide = df.groupBy(*by).pivot(arm, list(arms)).agg(F.first(value)).dropna(subset=list(arms))
    long = wide.unpivot(list(by), list(arms), "arm", "v")
    med = exact_quantiles(long, ["arm"], "v", {"median": 0.5})
    return med.agg((F.max("median") - F.min("median")).alias("spread"), F.count(F.lit(1)).alias("n_arms"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
