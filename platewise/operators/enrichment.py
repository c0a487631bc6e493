"""Case selection, preranked gene-set enrichment and pathway comparison."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.hashing import mix32, mix_narrow
from platewise.functions.text import normalise_symbol
from platewise.operators.cleaning import DataError
from platewise.operators.summaries import union_all
from platewise.plans.ordering import cumulative_counts, exact_quantiles, numbered, with_average_ranks
from platewise.session import cut_lineage


def aligned(a: DataFrame, b: DataFrame, keys: Sequence[str], va: str, vb: str) -> DataFrame:
    """Check of two keyed vector tables: rows matched, missing on either side, repeated keys, largest difference."""
    keys = list(keys)
    side = lambda df, c, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n{n}"), F.min_by(c, F.lit(0)).alias(f"_v{n}"))
    j = side(a, va, "a").join(side(b, vb, "b"), keys, "full")
    diff = F.array_max(F.zip_with("_va", "_vb", lambda x, y: F.abs(x - y)))
    return j.agg(F.count_if(F.col("_na").isNotNull() & F.col("_nb").isNotNull()).alias("n_matched"),
                 F.count_if(F.col("_nb").isNull()).alias("n_only_a"), F.count_if(F.col("_na").isNull()).alias("n_only_b"),
                 F.count_if((F.col("_na") > 1) | (F.col("_nb") > 1)).alias("n_repeated"), F.max(diff).alias("max_abs_diff"))


def percentile_score(df: DataFrame, column: str, name: str, higher_is_better: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """0..1 by average rank; reversed if a low value is better. Undefined for a single row."""
    by = list(by)
    p = F.try_divide(F.col("before") + (F.col("cnt") - 1) / 2.0, (F.col("n") - 1).cast("double"))
    scores = cumulative_counts(df, by, column).select(*by, column, (p if higher_is_better else 1 - p).alias(name))
    return df.join(scores, by + [column], "left")


def case_thresholds(metrics: DataFrame) -> DataFrame:
    """One row: median target norm, lowest decile of the reference and highest decile of the prediction correlation."""
    names = ["target_norm", "reference_target_pearson", "prediction_target_pearson"]
    long = metrics.unpivot([], names, "metric", "v")
    q = exact_quantiles(long, ["metric"], "v", {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return q.agg(pick(names[0], "q50").alias("norm_median"), pick(names[1], "q10").alias("ref_q10"), pick(names[2], "q90").alias("pred_q90")).withColumn("_k", F.lit(0))


def rank_cases(metrics: DataFrame, n_cases: int) -> DataFrame:
    """Shortlist by the maximin of three percentiles among cases of at least median norm; ties broken by gain,
    prediction, reference (low first) and norm. Thresholds and the median refer to all rows."""
    limits = F.broadcast(case_thresholds(metrics))
    eligible = metrics.withColumn("_k", F.lit(0)).join(limits, "_k").filter(F.col("target_norm") >= F.col("norm_median")).drop("_k")
    for c, n, up in (("reference_target_pearson", "divergence_percentile", False), ("prediction_target_pearson", "prediction_percentile", True),
                     ("pearson_gain", "gain_percentile", True)):
        eligible = percentile_score(eligible, c, n, up)
    scored = eligible.withColumn("maximin_score", F.least("divergence_percentile", "prediction_percentile", "gain_percentile"))
    order = [F.desc("maximin_score"), F.desc("pearson_gain"), F.desc("prediction_target_pearson"), F.asc("reference_target_pearson"), F.desc("target_norm")]
    top = scored.orderBy(*order).limit(n_cases)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    strict = (F.col("reference_target_pearson") <= F.col("ref_q10")) & (F.col("prediction_target_pearson") >= F.col("pred_q90"))
    return top.withColumn("objective_rank", place).withColumn("case_id", F.concat(F.lit("case_"), F.lpad(F.col("objective_rank").cast("string"), 2, "0"))) \
        .withColumn("meets_strict_rule", strict)


def strict_count(metrics: DataFrame) -> DataFrame:
    limits = F.broadcast(case_thresholds(metrics))
    j = metrics.withColumn("_k", F.lit(0)).join(limits, "_k")
    return j.agg(F.count_if((F.col("reference_target_pearson") <= F.col("ref_q10")) & (F.col("prediction_target_pearson") >= F.col("pred_q90"))
                            & (F.col("target_norm") >= F.col("norm_median"))).alias("n_strict"), F.count(F.lit(1)).alias("n_cases"))


def annotate_unique(df: DataFrame, annotation: DataFrame, on: str) -> DataFrame:
    """Many-to-one annotation that must be complete."""
    if not annotation.groupBy(on).count().filter("count > 1").isEmpty():
        raise DataError(f"annotation repeats {on}")
    out = df.join(annotation.withColumn("_hit", F.lit(True)), on, "left")
    if not out.filter("_hit is null").isEmpty():
        raise DataError(f"no annotation for some {on}")
    return out.drop("_hit")


def mapping_report(df: DataFrame, symbol: str, by: Sequence[str] = ()) -> DataFrame:
    """Ids, ids with a symbol after normalising, ids without an entry, distinct symbols, and rows whose symbol is not theirs alone. Symbols
    are counted first, so the report needs no distinct count."""
    per = df.groupBy(*by, normalise_symbol(F.col(symbol)).alias("_s"), F.col(symbol).isNull().alias("_none")).agg(F.count(F.lit(1)).alias("_n"))
    per = per.groupBy(*by, "_s").agg(F.sum("_n").alias("_n"), F.sum(F.when(F.col("_none"), F.col("_n")).otherwise(0)).alias("_none"))
    named = F.col("_s").isNotNull()
    of = lambda ok: F.sum(F.when(ok, F.col("_n")).otherwise(0))
    return per.groupBy(*by).agg(F.sum("_n").alias("n_ids"), of(named).alias("n_mapped"), F.sum("_none").alias("n_unmapped"),
                                F.count_if(named).alias("n_symbols"), of(named & (F.col("_n") > 1)).alias("n_duplicate_rows"))


def collapse_ranking(df: DataFrame, by: Sequence[str], symbol: str = "symbol", score: str = "score") -> DataFrame:
    """One score per gene: the largest absolute value, the positive one among equals. An aggregate."""
    ok = df.filter(F.col(symbol).isNotNull() & F.col(score).isNotNull())
    up, down = F.max(score), F.min(score)
    return ok.groupBy(*by, symbol).agg(F.when(up >= -down, up).otherwise(down).alias(score))


def ranked_list(df: DataFrame, by: Sequence[str], symbol: str = "symbol", score: str = "score") -> DataFrame:
    """Position 1..n by score descending, then symbol, and the list's length."""
    return numbered(df, by, [F.desc(score), F.asc(symbol)], "rank", "n_genes")


def hits_of(ranked: DataFrame, sets: DataFrame, by: Sequence[str], symbol: str = "symbol", lo: int = 15, hi: int = 500) -> DataFrame:
    """Ranked members of every gene set whose size inside the list is within lo..hi. Sizes are counted first, so members of other sets are not shuffled."""
    joined = ranked.join(sets.select("collection", "term", symbol).distinct(), symbol)
    keys = [*by, "collection", "term"]
    sizes = joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("set_size")).filter(F.col("set_size").between(lo, hi))
    return joined.join(sizes, keys)


def running_sums(hits: DataFrame, by: Sequence[str], weight: Column) -> DataFrame:
    """Running sum just before and just after each hit; between hits it only falls, so these are its extremes."""
    g = Window.partitionBy(*by, "collection", "term")
    run = g.orderBy("rank")
    k = F.row_number().over(run)
    total = F.sum("_w").over(g)
    cum = F.sum("_w").over(run.rowsBetween(Window.unboundedPreceding, 0))
    miss = F.try_divide(F.col("rank") - F.col("_kth"), (F.col("n_genes") - F.col("set_size")).cast("double"))
    h = hits.withColumn("_w", weight).withColumn("_kth", k).withColumn("_tot", total).withColumn("_cum", cum)
    return h.withColumn("after", F.try_divide("_cum", "_tot") - miss).withColumn("before", F.try_divide(F.col("_cum") - F.col("_w"), F.col("_tot")) - miss)


def enrichment_scores(hits: DataFrame, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Weight-1 preranked enrichment score: the running sum's value of largest absolute deviation."""
    weight = F.abs("score") if weight is None else weight
    r = running_sums(hits, by, weight)
    up, down = F.max("after"), F.min("before")
    return r.groupBy(*by, "collection", "term").agg(
        F.when(up >= -down, up).otherwise(down).alias("es"), F.max("set_size").alias("set_size"),
        F.max_by("rank", F.struct("after", -F.col("rank"))).alias("peak_up"), F.min_by("rank", F.struct("before", F.col("rank"))).alias("peak_down"))


def leading_edge(hits: DataFrame, scores: DataFrame, by: Sequence[str], symbol: str = "symbol") -> DataFrame:
    """Members up to the peak (positive score) or from it on (negative), joined by ';' in rank order; a set
    holds at most the upper size limit of genes."""
    keys = [*by, "collection", "term"]
    j = hits.join(scores.select(*keys, "es", "peak_up", "peak_down"), keys)
    edge = j.filter(F.when(F.col("es") >= 0, F.col("rank") <= F.col("peak_up")).otherwise(F.col("rank") >= F.col("peak_down")))
    genes = F.transform(F.array_sort(F.collect_list(F.struct("rank", symbol))), lambda e: e[symbol])
    return edge.groupBy(*keys).agg(F.array_join(genes, ";").alias("leading_edge_genes"), F.count(F.lit(1)).alias("n_edge"))


def permuted_ranks(n: int, perms: np.ndarray, seed: int) -> np.ndarray:
    """For each permutation the new position (from 0) of the gene at each position: genes in the order of a 32-bit mix of position, permutation and seed. The mix has an inverse
    for each permutation, so no two genes of a list share a key. Keys are sorted as numbers with the position in the lower half."""
    own = mix32((perms.astype(np.uint64) * np.uint64(2654435769) + np.uint64(seed)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    at = np.arange(n, dtype=np.uint32)
    places, out = at.astype(np.int32), np.empty((len(perms), n), np.int32)
    for row, key in zip(out, own):
        keys = mix_narrow(mix_narrow(at + key) ^ key).astype(np.uint64)
        keys <<= np.uint64(32)
        keys |= at
        keys.sort()
        row[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)] = places
    return out


def set_scores(positions: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Enrichment score of each set (a column) for each row of member positions; a row lists the members of all sets one after another. NaN without any weight."""
    n, sizes = len(weights), np.diff(np.append(starts, positions.shape[1]))
    owner = np.repeat(np.arange(len(starts)), sizes)
    place = np.sort(positions + owner * n, axis=1) - owner * n
    w = weights[place]
    total = np.add.reduceat(w, starts, axis=1)
    cum = np.cumsum(w, axis=1)
    cum = cum - np.repeat(cum[:, starts] - w[:, starts], sizes, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        miss = (place + 1 - (np.arange(len(owner)) - starts[owner] + 1)) / (n - sizes)[owner]
        share = np.repeat(total, sizes, axis=1)
        up = np.maximum.reduceat(cum / share - miss, starts, axis=1)
        down = np.minimum.reduceat((cum - w) / share - miss, starts, axis=1)
    return np.where(up >= -down, up, down)


#: Genes of a list that travel in one row; null scores that a task holds; set members and permutations of them that are scored in one go; least number of tasks for them.
LIST_ROWS, NULL_VALUES, SCORED_VALUES, NULL_TASKS = 65_536, 1 << 22, 1 << 20, 64


def null_scores(ranked: DataFrame, members: DataFrame, by: Sequence[str], n_perm: int, seed: int, block: int, runs: int = 1) -> DataFrame:
    """Per set of `members` (by, collection, term, ranks) and block of permutations: the observed score `es`, the scores `es0` under the permutations, and what of them a set's mean and tail
    need. A task takes one list and `runs` blocks, one after another; it holds the list's scores, its sets' members and the null scores of one block, which it sends on before the next."""
    by = list(by)
    keys, types = [*by, "collection", "term"], dict(members.dtypes)
    run = F.explode(F.sequence(F.lit(0), F.lit((n_perm - 1) // (block * runs)))).alias("_run")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    chunk = F.expr(f"(rank - 1) div {LIST_ROWS}").cast("int").alias("_chunk")
    lists = ranked.groupBy(*by, chunk).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("score").cast("double").alias("score")))).alias("l"))
    rows = members.select(*keys, F.col("ranks").cast("array<int>").alias("_ranks"), none("_chunk", "int"), none("_scores", "array<double>"), run).unionByName(
        lists.select(*by, none("collection", types["collection"]), none("term", types["term"]), none("_ranks", "array<int>"), "_chunk", F.col("l.score").alias("_scores"), run))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, chunks, number = [], {}, None
        for batch in batches:
            number = batch.column("_run")[0].as_py() if batch.num_rows else number
            of_list = batch.column("_chunk").is_valid()
            for c, v in zip(*(batch.column(n).filter(of_list) for n in ("_chunk", "_scores"))):
                chunks[c.as_py()] = np.abs(v.values.to_numpy(zero_copy_only=False))
            parts.append(batch.select([*keys, "_ranks"]).filter(pc.invert(of_list)))
        sets = pa.Table.from_batches(parts).combine_chunks() if parts else None
        if not sets:
            return
        weights = np.concatenate([chunks[c] for c in sorted(chunks)])
        lengths = pc.list_value_length(sets["_ranks"]).to_numpy().astype(np.int64)
        flat = sets["_ranks"].combine_chunks().flatten().to_numpy() - 1
        ends = np.cumsum(lengths)
        cuts = bundles(lengths, SCORED_VALUES)
        spans = [(i, j, flat[ends[i] - lengths[i]:ends[j - 1]], ends[i:j] - lengths[i:j] - (ends[i] - lengths[i])) for i, j in cuts]
        named, n = sets.select(keys), len(weights)
        seen = np.concatenate([set_scores(of[None, :].astype(np.int64), starts, weights)[0] for _, _, of, starts in spans])
        step = max(1, min(NULL_VALUES // n, SCORED_VALUES // max(len(of) for _, _, of, _ in spans)))
        for at in range(number * runs, (number + 1) * runs):
            perms = np.arange(at * block, min(n_perm, (at + 1) * block))
            if not len(perms):
                return
            null = np.empty((len(lengths), len(perms)))
            for k in range(0, len(perms), step):
                moved = permuted_ranks(n, perms[k:k + step], seed)
                for i, j, of, starts in spans:
                    null[i:j, k:k + step] = set_scores(moved.take(of, axis=1), starts, weights).T
            up, known = null >= 0, ~np.isnan(null)
            same = known & (np.sign(null) == np.sign(seen)[:, None])
            made = {"block": pa.array(np.full(len(null), at, np.int32)), "set_size": lengths, "es": seen,
                    "es0": pa.ListArray.from_arrays(np.arange(0, null.size + 1, null.shape[1], dtype=np.int32), pa.array(null.ravel())),
                    "n_up": up.sum(axis=1), "n_down": (known & ~up).sum(axis=1), "s_up": np.where(up, null, 0).sum(axis=1), "s_down": np.where(known & ~up, -null, 0).sum(axis=1),
                    "n_same": same.sum(axis=1), "n_far": (same & (np.abs(null) >= np.abs(seen)[:, None])).sum(axis=1)}
            out = pa.table({**{c: named[c] for c in keys}, **made})
            yield from out.to_batches(max_chunksize=max(1, SCORED_VALUES // null.shape[1]))

    made = "set_size bigint, es double, es0 array<double>, n_up bigint, n_down bigint, s_up double, s_down double, n_same bigint, n_far bigint"
    tasks = max(NULL_TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # dealt by a fixed number, since rows are small next to their permutations and would be put together
    return rows.repartition(tasks, *by, "_run").groupBy(*by, "_run").applyInArrow(score, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "block int", made]))


def bundles(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Sets in a row whose members are `most` at most together, or one set: first and last plus one."""
    ends, out, i = np.cumsum(lengths), [], 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - lengths[i] + most, side="right")))
        out.append((i, j))
        i = j
    return out


def null_tails(null: DataFrame, seen: DataFrame, scope: Sequence[str], blocks: int) -> DataFrame:
    """Per set and block of `null` (scope, term, block, es0) and `seen` (scope, term, nes, m_up, m_down): null scores of the scope and of the set's sign that reach its normalised score, and
    permutations whose extreme does. A task sees the sets of one scope and one block, so null scores are shuffled once; counts come from one sorted array of them, so they add up over blocks."""
    keys = [*scope, "term"]
    columns = [*keys, "n_reach", "n_pool", "obs_reach", "obs_all", "n_beyond", "n_perm"]

    def tails(scores: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        sets = scores.merge(of[["term", "nes", "m_up", "m_down"]], on="term")
        if not len(sets):
            return pd.DataFrame({c: [] for c in columns})
        nes = sets["nes"].to_numpy(float)
        es0 = np.stack(sets["es0"].to_numpy())
        with np.errstate(invalid="ignore", divide="ignore"):
            null = np.where(es0 >= 0, es0 / sets["m_up"].to_numpy(float)[:, None], es0 / sets["m_down"].to_numpy(float)[:, None])
        out = sets[keys].copy()
        reach, pool, seen, all_seen = (np.zeros(len(sets)) for _ in range(4))
        for side, same in ((nes >= 0, null >= 0), (nes < 0, null < 0)):
            sizes, own = np.sort(np.abs(null[same])), np.sort(np.abs(nes[side]))
            reach[side], pool[side] = len(sizes) - np.searchsorted(sizes, np.abs(nes[side])), len(sizes)
            seen[side], all_seen[side] = len(own) - np.searchsorted(own, np.abs(nes[side])), len(own)
        top, bottom = np.fmax.reduce(null, axis=0), np.fmin.reduce(null, axis=0)
        top, bottom = np.sort(top[~np.isnan(top)]), np.sort(bottom[~np.isnan(bottom)])
        beyond = np.where(nes >= 0, len(top) - np.searchsorted(top, nes), np.searchsorted(bottom, nes, side="right"))
        return out.assign(n_reach=reach, n_pool=pool, obs_reach=seen, obs_all=all_seen, n_beyond=beyond, n_perm=len(top))

    types = dict(null.dtypes)
    made = "n_reach double, n_pool double, obs_reach double, obs_all double, n_beyond double, n_perm double"
    dealt = seen.select(*keys, "nes", "m_up", "m_down", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    # Under names of its own, since it comes from the null scores.
    return null.select(*keys, "block", "es0").groupBy(*scope, "block").cogroup(dealt.toDF(*dealt.columns).groupBy(*scope, "block")).applyInPandas(
        tails, ", ".join([*(f"`{k}` {types[k]}" for k in keys), made]))


def permutation_test(ranked: DataFrame, sets: DataFrame, by: Sequence[str], n_perm: int = 5000, seed: int = 42, lo: int = 15, hi: int = 500, block: int = 250) -> DataFrame:
    """Normalised score, nominal p, FDR q and FWER from gene-label permutations.

    A permutation deals the genes to the positions anew and keeps the scores at the positions. Null scores are made by (list, block of permutations) in Arrow tasks, written once, and
    read twice: for the means that normalise them, and for the tails. What a set is compared with is its collection within its list.
    A list travels to a task per `block` permutations; where its sets are many, null scores are made and compared in smaller blocks, so that a task holds `NULL_VALUES` of them at most."""
    by = list(by)
    keys, scope = [*by, "collection", "term"], [*by, "collection"]
    members = cut_lineage(hits_of(ranked, sets, by, "symbol", lo, hi).groupBy(*keys).agg(F.sort_array(F.collect_list(F.col("rank").cast("bigint"))).alias("ranks")))
    most = (members.groupBy(*by).count() if by else members.agg(F.count(F.lit(1)).alias("count"))).agg(F.max("count")).first()[0] or 1
    runs = max(1, -(-block * most // NULL_VALUES))
    block = max(1, block // runs)
    null = cut_lineage(null_scores(ranked, members, by, n_perm, seed, block, runs))
    total = lambda c: F.sum(c).cast("double")
    seen = null.groupBy(*keys).agg(F.first("es").alias("es"), F.first("set_size").alias("set_size"), F.try_divide(total("s_up"), total("n_up")).alias("m_up"),
                                   F.try_divide(total("s_down"), total("n_down")).alias("m_down"), F.try_divide(total("n_far"), total("n_same")).alias("nominal_p"))
    nes = F.try_divide("es", F.when(F.col("es") >= 0, F.col("m_up")).otherwise(F.col("m_down")))
    seen = cut_lineage(seen.filter(~F.isnan("es")).withColumn("nes", nes))
    counted = null_tails(null, seen.filter("nes IS NOT NULL"), scope, (n_perm - 1) // block + 1)
    rate = F.try_divide(F.try_divide(total("n_reach"), total("n_pool")), F.try_divide(F.max("obs_reach"), F.max("obs_all")))
    rates = counted.groupBy(*keys).agg(F.least(F.lit(1.0), rate).alias("fdr_q"), F.try_divide(total("n_beyond"), total("n_perm")).alias("fwer_p"))
    return seen.select(*keys, "set_size", "es", "nes", "nominal_p").join(rates, keys, "left")


PROFILES = ["target", "reference", "prediction"]


def compare_pathways(enrichment: DataFrame, alpha: float = 0.05, delta: float = 1.0) -> DataFrame:
    """One row per set present in all three profiles: absolute differences to the target, sign agreement on significant
    target sets, and the target-specific rule (significant in the target, and the reference differs in sign or by `delta`)."""
    keys = ["collection", "term"]
    wide = enrichment.groupBy(*keys).pivot("profile", PROFILES).agg(F.first("nes").alias("nes"), F.first("fdr_q").alias("fdr"))
    full = wide.dropna(subset=[f"{p}_nes" for p in PROFILES])
    sig = F.col("target_fdr") < alpha
    gap = lambda p: F.abs(F.col(f"{p}_nes") - F.col("target_nes"))
    agree = lambda p: F.signum(f"{p}_nes") == F.signum("target_nes")
    return full.withColumns({"reference_abs_delta": gap("reference"), "prediction_abs_delta": gap("prediction"), "significant": sig,
                             "reference_sign_agrees": F.when(sig, agree("reference")), "prediction_sign_agrees": F.when(sig, agree("prediction")),
                             "target_specific": sig & (~agree("reference") | (gap("reference") >= delta))})


def pathway_summary(compared: DataFrame) -> DataFrame:
    """Counts, sign agreement, Spearman and mean absolute error per collection and over all (grouping sets)."""
    from platewise.operators.statistics import safe_corr
    scopes = union_all([compared.withColumn("scope", F.lit("all")), compared.withColumn("scope", F.col("collection"))])
    scopes = with_average_ranks(scopes, ["scope"], {f"{p}_nes": f"_r_{p}" for p in PROFILES})
    share = lambda c: F.avg(F.col(c).cast("double"))
    return scopes.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n_sets"), F.count_if("significant").alias("n_significant"), F.count_if("target_specific").alias("n_target_specific"),
        share("reference_sign_agrees").alias("reference_agreement"), share("prediction_sign_agrees").alias("prediction_agreement"),
        safe_corr(F.col("_r_reference"), F.col("_r_target")).alias("reference_spearman"), safe_corr(F.col("_r_prediction"), F.col("_r_target")).alias("prediction_spearman"),
        F.avg("reference_abs_delta").alias("reference_mae"), F.avg("prediction_abs_delta").alias("prediction_mae"))


def target_specific_list(compared: DataFrame) -> DataFrame:
    return compared.filter("target_specific").withColumn("error_reduction", F.col("reference_abs_delta") - F.col("prediction_abs_delta"))


def leading_edge_genes(edges: DataFrame, ranked: DataFrame, by: Sequence[str]) -> DataFrame:
    """Split a stored leading edge and look up rank and score of its genes."""
    g = edges.select(*by, "collection", "term", F.explode(F.split("leading_edge_genes", ";")).alias("symbol"))
    return g.join(ranked.select(*by, "symbol", "rank", "score"), [*by, "symbol"])


def gene_modules(rankings: DataFrame, edge: DataFrame, profiles: Sequence[str]) -> DataFrame:
    """Scores of module genes present in every profile, ordered by the first one, back in long form."""
    wide = rankings.join(edge.select("term", "symbol").distinct(), "symbol").groupBy("term", "symbol").pivot("profile", list(profiles)).agg(F.first("score"))
    full = wide.dropna(subset=list(profiles))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc(profiles[0]), F.asc("symbol")))
    return full.withColumn("gene_order", place).unpivot(["term", "symbol", "gene_order"], list(profiles), "profile", "score")


def candidate_union(candidates: DataFrame, enriched: DataFrame, key: str) -> DataFrame:
    """Candidates and enrichment rows in one table with record type and presence flags."""
    c = candidates.withColumn("record_type", F.lit("candidate"))
    e = enriched.withColumn("record_type", F.lit("enrichment"))
    both = union_all([c, e])
    seen = e.select(key).distinct().withColumn("has_enrichment", F.lit(True))
    return both.join(seen, key, "left").withColumn("has_enrichment", F.coalesce("has_enrichment", F.lit(False)))
