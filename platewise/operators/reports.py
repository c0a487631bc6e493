"""Run registry, shared cohorts and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.session import cut_lineage


def shared_cohort(df: DataFrame, keys: Sequence[str], arm: str, exempt: Column | None = None) -> DataFrame:
    """Restrict every arm to the observation keys present in all arms; exempt rows bypass the restriction. A key that an arm has twice is an error."""
    exempt = F.lit(False) if exempt is None else exempt
    bound = df.filter(~exempt)
    per = bound.groupBy(*keys, arm).agg(F.count(F.lit(1)).alias("_c"))
    n_arms = per.agg(F.count_distinct(arm).alias("_arms"))
    once = F.when(F.max("_c") > 1, F.raise_error(F.lit("a key stands several times in one arm"))).otherwise(F.count(F.lit(1)))
    keep = per.groupBy(*keys).agg(once.alias("_n")).join(F.broadcast(n_arms), F.col("_n") == F.col("_arms")).select(*keys)
    return bound.join(keep, list(keys), "left_semi").unionByName(df.filter(exempt))


def run_registry(runs: DataFrame, keep: int | None = None, experiments: DataFrame | None = None) -> DataFrame:
    """Run folders to a table: time stamp and experiment from the name, numbers from `key = value` lines of the summary; all runs, or the first `keep` of each experiment by time (the
    window keeps only those before the shuffle). `experiments` (experiment and its columns, one row each) is joined on; runs of experiments it does not list are left out."""
    from platewise.functions.text import RUN_STAMP
    pairs = F.map_from_entries(F.transform(
        F.filter(F.split("summary", "\n"), lambda s: s.contains(" = ")),
        lambda s: F.struct(F.trim(F.substring_index(s, " = ", 1)), F.trim(F.substring_index(s, " = ", -1)))))
    parsed = runs.select("run_id", F.regexp_extract("dir_name", RUN_STAMP, 1).alias("stamp"),
                         F.regexp_replace("dir_name", RUN_STAMP, "").alias("experiment"), pairs.alias("kv"))
    typed = parsed.filter("stamp <> ''").select(
        "run_id", "stamp", "experiment", *[F.try_element_at("kv", F.lit(c)).try_cast(k).alias(c)
                                           for c, k in (("val_spearman", "double"), ("test_pearson", "double"), ("n_train", "bigint"))])
    if experiments is not None:
        typed = typed.join(experiments, "experiment")
    if keep is None:
        return typed
    order = Window.partitionBy("experiment").orderBy("stamp", "run_id")
    return typed.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= keep)


def validate_bundle(df: DataFrame, vectors: Sequence[str], width: int) -> DataFrame:
    """Shape and finiteness of the vector columns in one aggregate."""
    bad_shape = F.lit(False)
    not_finite = F.lit(False)
    for v in vectors:
        bad_shape |= F.size(v) != width
        not_finite |= F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad_shape).alias("n_bad_shape"), F.count_if(not_finite).alias("n_not_finite"))


def filter_sweep(arms: DataFrame, base: DataFrame, arm: str, bin_: str, keys: Sequence[str], metric: str, least: int = 100, n_boot: int = 1000) -> DataFrame:
    """Mean of each arm per bin of the base table, difference to the base on shared keys with its bootstrap interval, signed-rank p, and q over all (arm, bin) tests. Only
    bins in which the base has `least` rows or more are kept."""
    from platewise.operators.statistics import bh_fdr, bootstrap_mean, wilcoxon
    kept = base.groupBy(bin_).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= least).select(bin_)
    base = base.join(kept, bin_, "left_semi")
    j = arms.select(arm, *keys, F.col(metric).alias("_v")).join(base.select(bin_, *keys, F.col(metric).alias("_b")), list(keys))
    j = cut_lineage(j.withColumn("d", F.round(F.col("_v") - F.col("_b"), 12)))
    means = j.groupBy(arm, bin_).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.avg("d").alias("diff"))
    bounds = bootstrap_mean(j, [arm, bin_], "d", [arm, bin_, *keys], n_boot).select(arm, bin_, "lo", "hi")
    tests = wilcoxon(j, [arm, bin_]).select(arm, bin_, "p")
    return bh_fdr(means.join(bounds, [arm, bin_], "left").join(tests, [arm, bin_], "left"), "p")


def compare_baselines(df: DataFrame, by: Sequence[str], cluster: str, model: str, baselines: Sequence[str]) -> DataFrame:
    """One row per group and baseline: rows, rows with both values, clusters, micro and macro means of model and baseline with their differences, clusters won, and two signed-rank tests, over rows
    and over cluster means. Means skip missing values; a test of differences that are all zero has no p."""
    from platewise.operators.statistics import wilcoxon
    by = list(by)
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("baseline"), F.nanvl(F.col(b).cast("double"), F.lit(None).cast("double")).alias("b")) for b in baselines]))
    long = df.select(*by, cluster, F.nanvl(F.col(model).cast("double"), F.lit(None).cast("double")).alias("m"), pairs.alias("p")).select(*by, cluster, "m", "p.*")
    on = [*by, "baseline"]
    per = long.groupBy(*on, cluster).agg(F.count(F.lit(1)).alias("_n"), F.count(F.col("m") - F.col("b")).alias("_np"), F.sum("m").alias("_sm"), F.count("m").alias("_cm"), F.sum("b").alias("_sb"),
                                         F.count("b").alias("_cb")).withColumns({"_am": F.try_divide("_sm", "_cm"), "_ab": F.try_divide("_sb", "_cb")})
    per = per.withColumn("d", F.round(F.col("_am") - F.col("_ab"), 9))
    micro = lambda v: F.try_divide(F.sum(f"_s{v}"), F.sum(f"_c{v}"))
    out = per.groupBy(*on).agg(F.sum("_n").alias("n_obs"), F.sum("_np").alias("n_obs_paired"), F.count(F.lit(1)).alias("n_cell_lines"), micro("m").alias("micro_model"), micro("b").alias("micro_baseline"),
                               F.avg("_am").alias("macro_model"), F.avg("_ab").alias("macro_baseline"), F.count_if(F.col("d") > 0).alias("n_cl_wins"))
    out = out.withColumns({"micro_diff": F.col("micro_model") - F.col("micro_baseline"), "macro_diff": F.col("macro_model") - F.col("macro_baseline")})
    rows = wilcoxon(long.withColumn("d", F.round(F.col("m") - F.col("b"), 9)), on).select(*on, F.col("p").alias("p_obs"))
    lines = wilcoxon(per, on).select(*on, F.col("p").alias("p_cellline"))
    return out.join(rows, on, "left").join(lines, on, "left")


def cluster_gains(df: DataFrame, by: Sequence[str], cluster: str, model: str, baseline: str, n_boot: int = 1000) -> DataFrame:
    """Mean over clusters of the mean paired gain, with an interval over clusters, macro means of both sides, clusters, rows, and clusters that gain."""
    from platewise.operators.statistics import bootstrap_mean
    by = list(by)
    both = df.dropna(subset=[model, baseline])
    per = both.groupBy(*by, cluster).agg(F.avg(model).alias("_m"), F.avg(baseline).alias("_b"), F.avg(F.col(model) - F.col(baseline)).alias("gain"), F.count(F.lit(1)).alias("_n"))
    sums = per.groupBy(*by).agg(F.avg("_m").alias("model_macro"), F.avg("_b").alias("baseline_macro"), F.sum("_n").alias("n_obs"), F.count_if(F.round("gain", 9) > 0).alias("wins"))
    return bootstrap_mean(per, by, "gain", [*by, cluster], n_boot).withColumnsRenamed({"mean": "estimate", "n": "n_cell_lines"}).join(sums, by)


def compare_by_cluster(paired: DataFrame, by: Sequence[str], cluster: str) -> DataFrame:
    """Micro and macro means of two arms, clusters won, signed-rank test over clusters."""
    from platewise.operators.statistics import wilcoxon
    by = list(by)
    per = paired.groupBy(*by, cluster).agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("d", F.round(F.col("sa") / F.col("n") - F.col("sb") / F.col("n"), 9))
    out = per.groupBy(*by).agg(
        (F.sum("sa") / F.sum("n")).alias("micro_a"), (F.sum("sb") / F.sum("n")).alias("micro_b"),
        F.avg(F.col("sa") / F.col("n")).alias("macro_a"), F.avg(F.col("sb") / F.col("n")).alias("macro_b"),
        F.avg(F.col("sa") / F.col("n") - F.col("sb") / F.col("n")).alias("macro_diff"), F.count_if(F.col("d") > 0).alias("wins"), F.count(F.lit(1)).alias("n_lines"))
    return out.join(wilcoxon(per, by).select(*by, "w", "p"), by, "left")


# sampling

def lines_on_plates(df: DataFrame, min_plates: int, line: str = "cell_line", plate: str = "plate") -> DataFrame:
    """Rows of cell lines measured on at least `min_plates` plates."""
    enough = df.groupBy(line).agg(F.count_distinct(plate).alias("_n")).filter(F.col("_n") >= min_plates)
    return df.join(enough.select(line), line, "left_semi")


def sample_plates(df: DataFrame, k: int, seed: int = 42, line: str = "cell_line", plate: str = "plate") -> DataFrame:
    """k plates per cell line in md5 order; a plate kept for one line is kept for all. The window sees distinct
    (line, plate) pairs and keeps k before the shuffle."""
    from platewise.functions.hashing import md5_key
    pairs = df.select(line, plate).distinct()
    kept = pairs.withColumn("_rn", F.row_number().over(Window.partitionBy(line).orderBy(md5_key(seed, line, plate)))).filter(F.col("_rn") <= k)
    return df.join(kept.select(plate).distinct(), plate, "left_semi")


def sample_per_group(df: DataFrame, by: Sequence[str], key: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """k rows per group in md5 order; each task keeps k per group before the shuffle."""
    from platewise.functions.hashing import md5_key
    w = Window.partitionBy(*by).orderBy(md5_key(seed, *by, *key), *key)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def export_profiles(df: DataFrame, folder: str, min_plates: int, max_plates: int, max_per_plate: int, key: str = "sample", seed: int = 42) -> None:
    """Write vectors with their labels after the plate and row sampling: lines on enough plates, some plates per line, some rows per plate. Vector and
    labels stand in one row, so they cannot fall out of step."""
    kept = sample_per_group(sample_plates(lines_on_plates(df, min_plates), max_plates, seed), ["plate"], ["cell_line", key], max_per_plate, seed)
    kept.select("expr", "sample", "cell_line", "plate", "drug", "dose", "time").write.mode("overwrite").parquet(folder)


# result tables

def run_statistics(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation of every metric, all runs and splits in one aggregate."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics])


def substitute_arm(df: DataFrame, keys: Sequence[str], is_replacement: Column) -> DataFrame:
    """Replacement rows take the place of plain rows with the same keys; plain rows without one stay. Fails when a
    key has two replacements."""
    from platewise.operators.cleaning import DataError
    new, plain = df.filter(is_replacement), df.filter(~is_replacement)
    if not new.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise DataError(f"several replacements for one {list(keys)}")
    return plain.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def representation_coverage(inputs: DataFrame, embeddings: DataFrame, key: str = "smiles") -> DataFrame:
    """Distinct inputs and successes per representation, vector length, and a summary of failures."""
    n_in = inputs.select(key).distinct().agg(F.count(F.lit(1)).alias("n_inputs")).withColumn("_k", F.lit(0))
    ok = embeddings.join(inputs.select(key).distinct(), key, "left_semi").groupBy("representation").agg(
        F.count_distinct(key).alias("n_success"), F.max(F.size("embedding")).alias("dimension")).withColumn("_k", F.lit(0))
    out = ok.join(F.broadcast(n_in), "_k").drop("_k")
    failed = F.col("n_inputs") - F.col("n_success")
    return out.withColumn("failures", F.when(failed == 0, "none").otherwise(F.concat(failed, F.lit(" of "), F.col("n_inputs"), F.lit(" inputs"))))


def name_lookup(df: DataFrame, names: DataFrame, key: str, name: str, out: str, order: Sequence[str]) -> DataFrame:
    """Display name of an id, the first one by `order`; the id itself when there is none."""
    first = names.groupBy(key).agg(F.min_by(name, F.struct(*[F.col(o) for o in order])).alias(out))
    return df.join(first, key, "left").withColumn(out, F.coalesce(out, F.col(key).cast("string")))


def selected_models(runs: DataFrame, by: str = "experiment") -> DataFrame:
    """Best run per experiment with the number of trials and derived fields."""
    from platewise.functions.text import layer_sizes, parameter_count
    from platewise.operators.summaries import best_per_group
    trials = runs.groupBy(by).agg(F.count(F.lit(1)).alias("n_trials"))
    best = best_per_group(runs, [by], "val_spearman", ["stamp", "run_id"]).join(trials, by)
    layers = layer_sizes(F.col("hidden_layers"))
    return best.withColumn("depth", F.size(layers)).withColumn("n_params", parameter_count(F.col("input_dim"), layers, F.col("output_dim"))) \
        .withColumn("compression", F.when(F.col("n_pca").isNull(), "none").otherwise(F.concat(F.lit("pca"), F.col("n_pca"))))


def scale_table(runs: DataFrame, native: DataFrame, key: str = "representation") -> DataFrame:
    """Effective treatment size (components, else native length) and parameter count; incomplete rows dropped."""
    from platewise.functions.text import layer_sizes, parameter_count
    j = runs.join(native, key, "left").withColumn("treatment_size", F.coalesce("n_pca", "dimension"))
    j = j.withColumn("n_params", parameter_count(F.col("treatment_size"), layer_sizes(F.col("hidden_layers")), F.col("output_dim")))
    return j.dropna(subset=["treatment_size", "n_params"])


SAR_COLUMNS = ["pair_id", "cell_line", "dose_um", "time_h", "plate", "compound_i", "compound_j", "pearson", "spearman", "ecfp_dist", "dense_dist", "graph_dist"]


def with_numbers(df: DataFrame) -> DataFrame:
    """Add dose and time as numbers."""
    from platewise.functions.text import parse_number
    return df.withColumns({"dose_um": parse_number(F.col("dose")), "time_h": parse_number(F.col("time"))})


def sar_export(pairs: DataFrame) -> DataFrame:
    """Pair table with ids, numeric dose and time, and a fixed column list; absent distances are NULL columns. Pairs that bring the numbers along (`with_numbers`) are not parsed."""
    from platewise.functions.hashing import pair_id
    out = pairs.withColumn("pair_id", pair_id("pair_", F.concat_ws("|", "cell_line", "smiles_i"), F.concat_ws("|", "cell_line", "smiles_j")))
    out = out if "dose_um" in out.columns else with_numbers(out)
    out = out.withColumnsRenamed({"smiles_i": "compound_i", "smiles_j": "compound_j"})
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("double").alias(c) for c in SAR_COLUMNS])


def performance_table(main: DataFrame, fallback: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric x group means and deviations from the main source, from the fallback where it has none, with the status."""
    by = [*by, "metric"]
    side = lambda df, n: df.unpivot(by[:-1], list(metrics), "metric", "v").groupBy(*by).agg(F.avg("v").alias(f"mean_{n}"), F.stddev_pop("v").alias(f"sd_{n}"))
    j = side(main, "a").join(side(fallback, "b"), by, "full")
    return j.select(*by, F.coalesce("mean_a", "mean_b").alias("mean"), F.coalesce("sd_a", "sd_b").alias("sd"),
                    F.when(F.col("mean_a").isNotNull(), "main").otherwise("fallback").alias("source"))


def cluster_performance(scores: DataFrame, setting: Sequence[str], cluster: str, keys: Sequence[str], n_boot: int = 1000) -> DataFrame:
    """Per (setting, cluster) mean and interval of the model, means of the two baselines and gains over them."""
    from platewise.operators.statistics import bootstrap_mean
    by = [*setting, cluster]
    ci = bootstrap_mean(scores.filter("arm = 'model'"), by, "pearson", keys, n_boot)
    base = scores.groupBy(*by).pivot("arm", ["reference", "train_mean"]).agg(F.avg("pearson"))
    return ci.join(base, by).withColumn("gain_reference", F.col("mean") - F.col("reference")).withColumn("gain_train_mean", F.col("mean") - F.col("train_mean"))


def similarity_table(pairs: DataFrame, names: DataFrame, min_n: int = 2) -> DataFrame:
    """Reference-target similarity with display names, inclusion flag and reason."""
    left = names.select(F.col("cell_line").alias("cl_i"), F.col("name").alias("reference_name"))
    right = names.select(F.col("cell_line").alias("cl_j"), F.col("name").alias("target_name"))
    ok = F.col("n_conditions") >= min_n
    return pairs.join(left, "cl_i", "left").join(right, "cl_j", "left").select(
        F.coalesce("reference_name", "cl_i").alias("reference"), F.coalesce("target_name", "cl_j").alias("target"), F.col("mean_delta_pearson").alias("similarity"),
        "n_conditions", ok.alias("included"), F.when(ok, "").otherwise("fewer than two shared conditions").alias("reason"))


def long_statistics(tables: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Stack tests and intervals in one schema with id, method and level."""
    from platewise.functions.hashing import stable_id
    from platewise.functions.text import statistic_method
    parts = []
    for label, df in tables.items():
        values = [f.name for f in df.schema.fields if f.name not in keys and f.dataType.simpleString() in ("double", "bigint", "int")]
        wide = df.select(F.concat_ws("|", *[k for k in keys if k in df.columns]).alias("level"), *[F.col(v).cast("double").alias(v) for v in values])
        parts.append(wide.unpivot(["level"], values, "statistic", "value").withColumn("analysis", F.lit(label)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    has_p = F.max(F.when(F.col("statistic") == "p", F.col("value"))).over(Window.partitionBy("analysis", "level"))
    unit = F.when(F.col("analysis").contains("compound-cluster"), "compound").when(F.col("analysis").contains("cell-line"), "cell_line").otherwise("observation")
    return out.withColumn("method", statistic_method(F.col("analysis"), has_p)).withColumn("unit", unit).withColumn("id", stable_id("stat_", F.col("analysis"), F.col("level"), F.col("statistic")))


def annotate_components(vp: DataFrame, genes: DataFrame, components: Sequence[str]) -> DataFrame:
    """Variance rows joined to the gene table by position, components unpivoted, percent to fraction."""
    long = vp.unpivot(["position"], list(components), "component", "percent")
    return long.join(genes, "position").select("gene", "component", (F.col("percent") / 100).alias("fraction"))


def output_check(spark, paths: dict[str, str]) -> DataFrame:
    """Whether each expected output exists and holds a row."""
    rows = []
    for name, path in paths.items():
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
        rows.append((name, bool(there), bool(there) and not spark.read.parquet(path).limit(1).isEmpty()))
    return spark.createDataFrame(rows, "output string, present boolean, has_rows boolean")
