"""Resampling, rank tests, regressions and variance partition as Spark aggregates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.functions.hashing import md5_halves, md5_key, mix32
from platewise.functions.ranks import chi2_upper, normal_two_sided, t_two_sided
from platewise.operators.pairs import SAR_KEY, sar_strips, sar_tile, sar_tiles
from platewise.operators.summaries import union_all
from platewise.session import cut_lineage, written
from platewise.plans.ordering import cumulative_counts, least_from_top, numbered, one_group, tile_apply, with_average_ranks

N_BOOT = 1000
PAIR_TERMS = ["w", "x", "y", "xx", "xy", "yy"]
POISSON_CDF = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975]  # fixed values: P(X <= k), mean 1


def finite(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def mix_draws(x: np.ndarray, t: np.ndarray) -> None:
    """One round of the draws' mix of 32-bit numbers, in place; `t` is room of the same shape."""
    for _ in range(2):
        np.right_shift(x, 16, out=t)
        np.bitwise_xor(x, t, out=x)
        np.multiply(x, np.uint32(73244475), out=x)
    np.right_shift(x, 16, out=t)
    np.bitwise_xor(x, t, out=x)


def poisson_counts(low: np.ndarray, high: np.ndarray, n_boot: int, first: int = 1) -> np.ndarray:
    """Poisson(1) counts (rows x replicates, from replicate `first`), functions of a unit's 60-bit key (32 + 28 bits) and the replicate's number only. A draw counts the bounds that a
    32-bit number reaches; rows are taken in strips that stay in the processor's cache."""
    bounds = [np.uint32(math.ceil(p * 4294967296)) for p in POISSON_CDF]
    b = (np.arange(first, first + n_boot, dtype=np.uint64) * np.uint64(2654435769)).astype(np.uint32)
    low, high, out = low.astype(np.uint32), high.astype(np.uint32), np.empty((len(low), n_boot), np.int8)
    rows = max(1, 65_536 // max(n_boot, 1))
    x, t = (np.empty((min(rows, len(low)), n_boot), np.uint32) for _ in range(2))

    for i in range(0, len(low), rows):
        n = min(rows, len(low) - i)
        np.add(high[i:i + n, None], b[None, :], out=x[:n])
        mix_draws(x[:n], t[:n])
        np.add(x[:n], low[i:i + n, None], out=x[:n])
        mix_draws(x[:n], t[:n])
        count = out[i:i + n]
        np.greater_equal(x[:n], bounds[0], out=count.view(bool))
        for bound in bounds[1:]:
            count += x[:n] >= bound
    return out


#: Rows and replicates whose draws are made and weighed in one go; they stay near the processor.
DRAWN_ROWS, DRAWN_REPLICATES = 4096, 32


def drawn_sums(values: np.ndarray, low: np.ndarray, high: np.ndarray, n_boot: int) -> np.ndarray:
    """Sums of `values` (terms x rows) weighed by the `poisson_counts` of the rows, per term and replicate; the counts of all rows and replicates are never held."""
    bounds = [np.uint32(math.ceil(p * 4294967296)) for p in POISSON_CDF]
    b = (np.arange(1, 1 + n_boot, dtype=np.uint64) * np.uint64(2654435769)).astype(np.uint32)
    low, high, out = low.astype(np.uint32), high.astype(np.uint32), np.zeros((n_boot, len(values)))
    size = min(DRAWN_ROWS, len(low)) * min(DRAWN_REPLICATES, n_boot)
    room = [np.empty(size, kind) for kind in (np.uint32, np.uint32, np.int8, bool, float)]
    for i in range(0, len(low), DRAWN_ROWS):
        h, l = high[i:i + DRAWN_ROWS], low[i:i + DRAWN_ROWS]
        weighed = np.ascontiguousarray(values[:, i:i + DRAWN_ROWS].T)
        for j in range(0, n_boot, DRAWN_REPLICATES):
            own = b[j:j + DRAWN_REPLICATES, None]
            x, t, count, over, wide = (v[:len(own) * len(h)] for v in room)
            table = x.reshape(len(own), len(h))
            np.add(own, h, out=table)
            mix_draws(x, t)
            np.add(table, l, out=table)
            mix_draws(x, t)
            np.greater_equal(x, bounds[0], out=count.view(bool))
            for bound in bounds[1:]:
                np.greater_equal(x, bound, out=over)
                np.add(count, over.view(np.int8), out=count)
            np.copyto(wide, count)
            out[j:j + len(own)] += wide.reshape(table.shape) @ weighed
    return out.T


def unit_keys(seed: int, unit: Sequence[str]) -> list[Column]:
    if not unit:
        raise ValueError("name the columns that identify a resampled unit")
    low, high = md5_halves(md5_key(seed, *unit))
    return [low.alias("_low"), high.alias("_high")]


def replicate_sums(rows: DataFrame, by: Sequence[str], terms: Sequence[str], n_boot: int) -> DataFrame:
    """Per group and replicate `b` the sum of counts `w` and the weighted sums of `terms`. `rows` has `by`, `terms`, `_low` and `_high`. A task weighs its
    rows in blocks by one matrix product per group and block, and sends one array of replicates per group and term."""
    by, terms = list(by), list(terms)
    kinds = dict(rows.dtypes)

    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            keys = [pa.array([k[i] for k in held], types[i]) for i in range(len(by))]
            sums = pa.array([[{"w": float(v[0, j]), **{t: float(v[1 + n, j]) for n, t in enumerate(terms)}} for j in range(n_boot)] for v in held.values()],
                            pa.list_(pa.struct([("w", pa.float64()), *((t, pa.float64()) for t in terms)])))
            held.clear()
            return pa.RecordBatch.from_arrays([*keys, sums], [*by, "_s"])

        types = None
        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                counts = poisson_counts(part.column("_low").to_numpy(), part.column("_high").to_numpy(), n_boot)
                values = np.stack([np.ones(part.num_rows), *(part.column(t).to_numpy(zero_copy_only=False).astype(float) for t in terms)])
                places: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(*[part.column(c).to_pylist() for c in by]) if by else [()] * part.num_rows):
                    places.setdefault(key, []).append(i)
                for key, rows_of in places.items():
                    sums = values[:, rows_of] @ counts[rows_of]
                    held[key] = held[key] + sums if key in held else sums
            if len(held) > 256:
                yield out()
        if held:
            yield out()

    schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + "_s array<struct<w:double," + ",".join(f"{t}:double" for t in terms) + ">>"
    parts = rows.select(*by, *terms, "_low", "_high").mapInArrow(run, schema)
    long = parts.select(*by, F.posexplode("_s").alias("b", "_v"))
    return long.groupBy(*by, "b").agg(F.sum("_v.w").alias("w"), *[F.sum(f"_v.{t}").alias(t) for t in terms])


def percentile_bounds(replicates: DataFrame, by: Sequence[str], value: str = "m", ci: float = 95.0) -> DataFrame:
    """Percentile interval over replicates; a group holds one number per replicate."""
    a = (100.0 - ci) / 200.0
    return replicates.groupBy(*by).agg(F.percentile(value, a).alias("lo"), F.percentile(value, 1 - a).alias("hi"))


def bootstrap_mean(df: DataFrame, by: Sequence[str], value: str, unit: Sequence[str], n_boot: int = N_BOOT, ci: float = 95.0, seed: int = 0) -> DataFrame:
    """Mean with a percentile interval over rows. Rows get Poisson counts per replicate instead of drawn
    positions, which needs no row numbers and no join: weighted sums per (group, replicate) are combined on the
    map side, so n_boot numbers per group and task are shuffled whatever the number of rows."""
    by = list(by)
    ok = finite(df, value).select(*by, F.col(value).cast("double").alias("x"), *unit_keys(seed, unit))
    sums = replicate_sums(ok, by, ["x"], n_boot).withColumn("m", F.try_divide(F.col("x"), F.col("w")))
    point = ok.groupBy(*by).agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))
    return _attach(point, percentile_bounds(sums, by, "m", ci), by)


def _attach(point: DataFrame, bounds: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return point.join(bounds, list(by))
    return point.withColumn("_k", F.lit(0)).join(F.broadcast(bounds.withColumn("_k", F.lit(0))), "_k").drop("_k")


#: Clusters whose draws a task counts, and replicates it counts at a time.
CLUSTER_BLOCK, REPLICATES = 65_536, 50


def drawn_positions(k: int, replicates: np.ndarray, draws: np.ndarray, low: int, high: int) -> np.ndarray:
    """Position (0 to k - 1) of each draw (a column) of each replicate (a row): a function of the group's key (32 + 28 bits), the replicate and the draw."""
    mask = np.uint64(0xFFFFFFFF)
    own = mix32((replicates.astype(np.uint64) * np.uint64(2654435769) + np.uint64(low)) & mask)
    x = mix32(mix32((draws.astype(np.uint64)[None, :] + own[:, None]) & mask) ^ np.uint64(high))
    return ((x * np.uint64(k)) >> np.uint64(32)).astype(np.int64)


def cluster_replicates(clusters: DataFrame, by: Sequence[str], key: Sequence[str], terms: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """Whole clusters drawn with replacement, as many per replicate as there are clusters: sums of `terms` per group and replicate `b`. Input is one row per cluster, a group's name is part of
    the draw. A task has a block of numbered clusters and some replicates; it makes the draws in pieces, counts those that fall into its block and weighs its clusters by the counts, so
    a group of any number of clusters spreads over tasks and no draw becomes a row."""
    by, terms = list(by), list(terms)
    on = by or ["_all"]
    rows = clusters if by else clusters.withColumn("_all", F.lit(0))
    kinds = dict(rows.dtypes)
    low, high = md5_halves(md5_key(seed, *on))
    placed = numbered(rows.select(*on, *key, *terms), on, [F.col(c) for c in key], "_pos", "_k")
    placed = placed.select(*on, *[F.col(t).cast("double").alias(t) for t in terms], (F.col("_pos") - 1).alias("_pos"), "_k", low.alias("_low"), high.alias("_high"),
                           F.floor((F.col("_pos") - 1) / CLUSTER_BLOCK).alias("_block"), F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // REPLICATES))).alias("_part"))

    def run(table: pa.Table) -> pa.Table:
        at = table.column("_pos").to_numpy() - int(table.column("_block")[0].as_py()) * CLUSTER_BLOCK
        k, low, high = (int(table.column(c)[0].as_py()) for c in ("_k", "_low", "_high"))
        first = int(table.column("_part")[0].as_py()) * REPLICATES
        b = np.arange(first + 1, min(n_boot, first + REPLICATES) + 1)
        counts, start = np.zeros(len(b) * CLUSTER_BLOCK if k > CLUSTER_BLOCK else len(b) * k), int(table.column("_block")[0].as_py()) * CLUSTER_BLOCK
        width = len(counts) // len(b)
        for i in range(0, k, 8192):
            pos = drawn_positions(k, b, np.arange(i + 1, min(k, i + 8192) + 1), low, high) - start
            inside = (pos >= 0) & (pos < width)
            counts += np.bincount((pos + np.arange(len(b))[:, None] * width)[inside], minlength=len(counts))
        values = np.zeros((width, len(terms)))
        values[at] = np.stack([table.column(t).to_numpy() for t in terms], axis=1)
        sums = counts.reshape(len(b), width) @ values
        keys = [pa.array([table.column(c)[0].as_py()] * len(b), table.schema.field(c).type) for c in on]
        return pa.Table.from_arrays([*keys, pa.array(b.astype(np.int32)), *(pa.array(v) for v in sums.T)], [*on, "b", *terms])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in on), "b int", *(f"`{t}` double" for t in terms)])
    out = placed.groupBy(*on, "_block", "_part").applyInArrow(run, schema).groupBy(*on, "b").agg(*[F.sum(t).alias(t) for t in terms])
    return out if by else out.drop("_all")


def cluster_bootstrap_mean(df: DataFrame, by: Sequence[str], value: str, cluster: str, n_boot: int = N_BOOT, ci: float = 95.0, seed: int = 0) -> DataFrame:
    """Mean over rows, interval over resampled clusters from their sums and counts."""
    by = list(by)
    per = cut_lineage(finite(df, value).groupBy(*by, cluster).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_c")))
    reps = cluster_replicates(per, by, [cluster], ["_s", "_c"], n_boot, seed).select(*by, (F.col("_s") / F.col("_c")).alias("m"))
    point = per.groupBy(*by).agg((F.sum("_s") / F.sum("_c")).alias("mean"), F.sum("_c").alias("n"), F.count(F.lit(1)).alias("n_clusters"))
    return _attach(point, percentile_bounds(reps, by, "m", ci), by)


def paired_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Duplicates averaged on both sides, inner join, `d = a - b`."""
    side = lambda df, n: df.groupBy(*keys).agg(F.avg(metric).alias(n))
    return side(a, "a").join(side(b, "b"), list(keys)).dropna(subset=["a", "b"]).withColumn("d", F.col("a") - F.col("b"))


def paired_delta(a: DataFrame, b: DataFrame, keys: Sequence[str], metric: str = "pearson", by: Sequence[str] = (), n_boot: int = N_BOOT, seed: int = 0) -> DataFrame:
    d = paired_differences(a, b, keys, metric)
    by = list(by)
    means = d.groupBy(*by).agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    ci = bootstrap_mean(d, by, "d", keys, n_boot, seed=seed).withColumnsRenamed({"mean": "mean_diff", "n": "n_pairs"})
    test = wilcoxon(d.withColumn("d", F.round("d", 9)), by).select(*by, "p")
    return _attach(means, ci, by).join(test, by, "left") if by else _attach(_attach(means, ci, by), test, by)


def wilcoxon(df: DataFrame, by: Sequence[str], d: str = "d") -> DataFrame:
    """Two-sided signed-rank test with the tie-corrected normal approximation; zeros are dropped, a group of
    zeros only has no statistic. Works on counts of distinct absolute differences."""
    by = list(by)
    ok = finite(df, d).withColumn("_a", F.abs(d)).filter("_a > 0")
    cum = cumulative_counts(ok, by, "_a")
    plus = ok.groupBy(*by, "_a").agg(F.count_if(F.col(d) > 0).alias("_pos"))
    rank = F.col("before") + (F.col("cnt") + 1) / 2.0
    n = F.col("n").cast("double")
    sums = cum.join(plus, [*by, "_a"]).groupBy(*by).agg(
        F.sum(rank * F.col("_pos")).alias("w_plus"), F.sum(rank * (F.col("cnt") - F.col("_pos"))).alias("w_minus"),
        F.sum(F.pow("cnt", F.lit(3)) - F.col("cnt")).alias("ties"), F.max("n").alias("n"))
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    w = F.least("w_plus", "w_minus")
    out = sums.withColumn("w", w).withColumn("z", F.try_divide(w - n * (n + 1) / 4, F.sqrt(var)))
    return out.select(*by, "n", "w_plus", "w_minus", "w", "z").withColumn("p", normal_two_sided(F.col("z")))


def safe_corr(x: Column, y: Column) -> Column:
    """Aggregate Pearson correlation, NULL for a constant side."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def correlation_p(r: Column, n: Column, k: int = 0) -> Column:
    """Two-sided p of a correlation with k covariates removed (Student t, n - 2 - k degrees of freedom)."""
    free = n.cast("double") - 2 - k
    return t_two_sided(F.try_divide(r * F.sqrt(free), F.sqrt(1 - r * r)), free)


#: Distinct values of a range of `replicate_moments`, rows that a task weighs, rows of a range of the variable with the most values, replicates of a task, and those that it ranks at a time.
RANGE_VALUES, WEIGHED_ROWS, LOCAL_ROWS, TASK_REPLICATES, AT_ONCE = 512, 262_144, 524_288, 200, 20


def packed_numbers(v: np.ndarray) -> pa.Array:
    """Rows of whole numbers as bytes, four a number where all of them fit."""
    kind = np.int32 if not v.size or max(-int(v.min()), int(v.max())) < 1 << 31 else np.int64
    return pa.array([x.tobytes() for x in v.astype(kind, copy=False)], pa.binary())


def unpacked_numbers(raw: Sequence[bytes], n: int) -> np.ndarray:
    """The rows of `n` numbers each that `packed_numbers` made, of both widths."""
    if all(len(x) == 4 * n for x in raw):
        return np.frombuffer(b"".join(raw), np.int32).reshape(-1, n)
    return np.stack([np.frombuffer(x, np.int32 if len(x) == 4 * n else np.int64).astype(np.int64) for x in raw])


def coded_rows(rows: DataFrame, on: list[str], names: Sequence[str]) -> DataFrame:
    """Rows of `on`, `_low`, `_high` with, for each variable k, the place `_p{k}` of its value among the group's values, a range `_r{k}` of places and a part `_s{k}` of `_n{k}` of the range's
    rows. Ranges of variable 0 are cut by rows, so only one that holds a value of many rows has several parts; the others are cut by distinct values. `_block` is a part of a range of variable 0."""
    for k, v in enumerate(names):
        if k:
            places = numbered(rows.groupBy(*on, v).agg(F.count(F.lit(1)).alias("_c")), on, [F.col(v)], f"_p{k}").withColumn(f"_r{k}", F.floor((F.col(f"_p{k}") - 1) / RANGE_VALUES))
        else:
            places = numbered(rows.select(*on, v), on, [F.col(v)], "_first").groupBy(*on, v).agg(F.min("_first").alias("_p0"), F.count(F.lit(1)).alias("_c"))
            places = places.withColumn("_r0", F.floor((F.col("_p0") - 1) / LOCAL_ROWS))
        sizes = places.groupBy(*on, f"_r{k}").agg(F.ceil(F.sum("_c") / (WEIGHED_ROWS if k else 2 * LOCAL_ROWS)).alias(f"_n{k}"))
        rows = rows.join(places.drop("_c").join(sizes, [*on, f"_r{k}"]), [*on, v]).withColumn(f"_s{k}", F.pmod(F.xxhash64("_low", "_high"), F.col(f"_n{k}")))
    codes = [F.col(f"_{c}{k}").cast("bigint").alias(f"_{c}{k}") for k in range(len(names)) for c in "prsn"]
    return cut_lineage(rows.select(*on, "_low", "_high", *codes, F.concat_ws("|", "_r0", "_s0").alias("_block")))


def replicate_ranks(coded: DataFrame, on: list[str], k: int, n_boot: int) -> DataFrame:
    """(on, p, ranks) of each distinct value of variable k: twice its average rank in every replicate, as whole numbers of four or eight bytes. Counts of (range, replicate) are summed up over ranges; within a range
    a task counts by value. No window holds a replicate, and a value of many rows is counted in parts. Of variable 0 only ranges of several parts give their values; the others, whose
    rows are in one task that ranks them itself, give as place -2 - range twice the rows of all ranges before."""
    kinds = dict(coded.dtypes)
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in on)

    def vectors(column: pa.ChunkedArray) -> np.ndarray:
        return unpacked_numbers(column.to_pylist(), n_boot).astype(np.int64)

    def told(table: pa.Table, p: np.ndarray, v: np.ndarray) -> pa.Table:
        first = lambda c: pa.array([table.column(c)[0].as_py()] * len(p), table.schema.field(c).type)
        return pa.Table.from_arrays([*(first(c) for c in on), first("r"), pa.array(p), packed_numbers(v)], [*on, "r", "p", "v"])

    def counted(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("p").to_numpy(), kind="stable")
        p, low, high = (table.column(c).to_numpy()[order] for c in ("p", "_low", "_high"))
        if k == 0 and table.column("n")[0].as_py() == 1:
            p = np.full(len(p), -1)
        values, code = np.unique(p, return_inverse=True)
        out = np.zeros((len(values), n_boot), np.int64)
        for i in range(0, len(p), 2048):
            own = code[i:i + 2048]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            out[own[starts]] += np.add.reduceat(poisson_counts(low[i:i + 2048], high[i:i + 2048], n_boot), starts, axis=0, dtype=np.int64)
        return told(table, values, out)

    def ranked(table: pa.Table) -> pa.Table:
        """Ranks within the range, and as value -1 the range's sums."""
        values, code = np.unique(table.column("p").to_numpy(), return_inverse=True)
        v = np.zeros((len(values), n_boot), np.int64)
        np.add.at(v, code, vectors(table.column("v")))
        if values[0] == -1:
            return told(table, np.array([-2 - table.column("r")[0].as_py(), -1]), np.vstack([np.zeros_like(v), v]))
        upto = v.cumsum(axis=0)
        return told(table, np.append(values, -1), np.vstack([2 * upto - v + 1, upto[-1]]))

    def lifted(table: pa.Table, below: pa.Table) -> pa.Table:
        more = np.zeros(n_boot, np.int64)
        more[below.column("b").to_numpy()] = below.column("o").to_numpy()
        return told(table, table.column("p").to_numpy(), vectors(table.column("v")) + 2 * more)

    schema = f"{keys}, r bigint, p bigint, v binary"
    source = coded.select(*on, F.col(f"_r{k}").alias("r"), F.col(f"_s{k}").alias("s"), F.col(f"_n{k}").alias("n"), F.col(f"_p{k}").alias("p"), "_low", "_high")
    inner = cut_lineage(source.groupBy(*on, "r", "s").applyInArrow(counted, schema).groupBy(*on, "r").applyInArrow(ranked, schema))

    def spread(batches):
        for batch in batches:
            n = batch.num_rows
            at = pa.array(np.repeat(np.arange(n), n_boot))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (*on, "r")), pa.array(np.tile(np.arange(n_boot), n)), pa.array(unpacked_numbers(batch.column("v").to_pylist(), n_boot).astype(np.int64).ravel())],
                                             [*on, "r", "b", "t"])

    totals = inner.filter("p = -1").drop("p").mapInArrow(spread, f"{keys}, r bigint, b bigint, t bigint")
    before = Window.partitionBy(*on, "b").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*on, "r", "b", F.coalesce(F.sum("t").over(before), F.lit(0).cast("bigint")).alias("o"))
    out = inner.filter("p <> -1").groupBy(*on, "r").cogroup(renamed(offsets).groupBy(*on, "r")).applyInArrow(lifted, schema)
    return out.select(*on, "p", F.col("v").alias("ranks"))


def renamed(df: DataFrame) -> DataFrame:
    """The frame with columns of its own, for a cogroup with one that it comes from."""
    return df.toDF(*df.columns)


def most_values_first(rows: DataFrame, names: Sequence[str]) -> list[int]:
    """Numbers of the variables, the one with the most distinct values (by estimate) first."""
    found = rows.agg(*[F.approx_count_distinct(v).alias(f"d{k}") for k, v in enumerate(names)]).first()
    return sorted(range(len(names)), key=lambda k: (-found[k], k))


def replicate_moments(rows: DataFrame, by: Sequence[str], names: Sequence[str], n_boot: int) -> DataFrame:
    """Per group and replicate `b`: the drawn rows `n`, sums `s{i}` and products `s{i}_{j}` of the variables' doubled average ranks among the drawn rows. `rows` has `by`, `names`, `_low` and
    `_high`. Tasks hold a block of rows that are close in the variable with the most values, which they rank themselves, and some replicates' ranks of the other variables' values in it."""
    rows, on = one_group(rows, by)
    kinds = dict(rows.dtypes)
    p, order = len(names), most_values_first(rows, names)
    coded = coded_rows(rows, on, [names[k] for k in order])
    part = F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // TASK_REPLICATES))).alias("_part")
    tables = []
    for k in range(p):
        place = F.col(f"_p{k}") if k else F.when(F.col("_n0") == 1, -2 - F.col("_r0")).otherwise(F.col("_p0"))
        wanted = coded.select(*on, "_block", place.alias("p")).distinct()
        found = wanted.join(replicate_ranks(coded, on, k, n_boot), [*on, "p"]).select(*on, "_block", part, "p", "ranks")
        share = F.expr(f"substring(ranks, cast(_part * {TASK_REPLICATES} * (length(ranks) div {n_boot}) + 1 as int), cast({TASK_REPLICATES} * (length(ranks) div {n_boot}) as int))")
        tables.append(found.withColumn("ranks", share).withColumn("k", F.lit(k)))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    made = ["n", *(f"s{i}" for i in range(p)), *(f"s{i}_{j}" for i, j in pairs)]
    at = [order.index(i) for i in range(p)]

    def moments(block: pa.Table, table: pa.Table) -> pa.Table:
        first = int(block.column("_part")[0].as_py()) * TASK_REPLICATES
        own_boot = min(TASK_REPLICATES, n_boot - first)
        ks, values = table.column("k").to_numpy(), table.column("p").to_numpy()
        raw = table.column("ranks")
        places, own, found = [], [block.column(f"_p{k}").to_numpy() for k in range(p)], []
        local = block.column("_n0")[0].as_py() == 1
        for k in range(p):
            mine = np.flatnonzero(ks == k)
            mine = mine[np.argsort(values[mine])]
            found.append(unpacked_numbers(raw.take(pa.array(mine)).to_pylist(), own_boot))
            places.append(np.unique(own[0], return_inverse=True)[1] if local and k == 0 else np.searchsorted(values[mine], own[k]))
        by_place = np.argsort(places[0], kind="stable")
        places = [x[by_place] for x in places]
        low, high = block.column("_low").to_numpy()[by_place], block.column("_high").to_numpy()[by_place]
        starts = np.flatnonzero(np.diff(places[0], prepend=-1))
        out = []
        for b in range(0, own_boot, AT_ONCE):
            width = min(AT_ONCE, own_boot - b)
            ranks = [np.ascontiguousarray(x[:, b:b + width]).astype(float) for x in found]
            drawn = poisson_counts(low, high, width, first + b + 1)
            if local:
                counts = np.add.reduceat(drawn, starts, axis=0, dtype=np.int64)
                ranks[0] = 2 * counts.cumsum(axis=0) - counts + 1 + found[0][0, b:b + width].astype(np.int64)
            sums = np.zeros((len(made), width))
            for i in range(0, len(low), 4096):
                w = drawn[i:i + 4096].astype(float)
                r = [ranks[k][x[i:i + 4096]].astype(float) for k, x in enumerate(places)]
                r = [r[k] for k in at]
                wr = [w * x for x in r]
                sums += np.stack([w.sum(axis=0), *(x.sum(axis=0) for x in wr), *(np.einsum("rb,rb->b", wr[a], r[c]) for a, c in pairs)])
            out.append(sums)
        keys = [pa.array([block.column(c)[0].as_py()] * own_boot, block.schema.field(c).type) for c in on]
        return pa.Table.from_arrays([*keys, pa.array(np.arange(first + 1, first + own_boot + 1)), *(pa.array(v) for v in np.concatenate(out, axis=1))], [*on, "b", *made])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in on), "b bigint", *(f"{c} double" for c in made)])
    rows = coded.select(*on, "_block", part, "_low", "_high", "_n0", *[f"_p{k}" for k in range(p)])
    out = rows.groupBy(*on, "_block", "_part").cogroup(renamed(union_all(tables)).groupBy(*on, "_block", "_part")).applyInArrow(moments, schema)
    out = out.groupBy(*on, "b").agg(*[F.sum(c).alias(c) for c in made])
    return out if by else out.drop(*on)


def partial_correlation(c: Callable[[int, int], Column], covariates: int) -> Column:
    """Correlation of variables 0 and 1 without the covariates 2, 3, ..., from all pairwise ones."""
    def partial(i: int, j: int, given: tuple[int, ...]) -> Column:
        if not given:
            return c(min(i, j), max(i, j))
        k, rest = given[-1], given[:-1]
        a, b, d = partial(i, j, rest), partial(i, k, rest), partial(j, k, rest)
        return F.try_divide(a - b * d, F.sqrt((1 - b * b) * (1 - d * d)))

    return partial(0, 1, tuple(range(2, 2 + covariates)))


def rank_bounds(rows: DataFrame, by: Sequence[str], names: Sequence[str], n_boot: int, ci: float = 95.0) -> DataFrame:
    """Bootstrap interval of the (partial) rank correlation of the first two names, each replicate ranked anew."""
    sums = replicate_moments(rows, by, names, n_boot)
    n = F.nullif(F.col("n"), F.lit(0.0))
    cov = lambda i, j: F.col(f"s{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / n
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    found = sums.select(*by, *[F.try_divide(cov(i, j), F.sqrt(cov(i, i) * cov(j, j))).alias(f"_c{i}_{j}") for i, j in pairs])
    return percentile_bounds(found.select(*by, partial_correlation(lambda i, j: F.col(f"_c{i}_{j}"), len(names) - 2).alias("m")).filter("m IS NOT NULL"), by, "m", ci)


def spearman_test(df: DataFrame, by: Sequence[str], x: str, y: str, n_boot: int | None = None, unit: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Spearman correlation with p and, if asked, a bootstrap interval whose replicates are ranked anew."""
    by = list(by)
    ok = finite(df, x, y)
    if n_boot:  # written once: the point and the replicates read it many times
        ok = cut_lineage(ok.select(*by, x, y, *unit_keys(seed, unit)))
    ranked = with_average_ranks(ok, by, {x: "_rx", y: "_ry"})
    point = ranked.groupBy(*by).agg(safe_corr(F.col("_rx"), F.col("_ry")).alias("rho"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    if n_boot:
        rows = ok.select(*by, F.col(x).alias("_v0"), F.col(y).alias("_v1"), "_low", "_high")
        point = _attach(point, rank_bounds(rows, by, ["_v0", "_v1"], n_boot), by)
    return point.withColumn("p", correlation_p(F.col("rho"), F.col("n")))


def line_fit(df: DataFrame, by: Sequence[str], x: str, y: str, unit: Sequence[str] | None = None, n_boot: int = N_BOOT, ci: float = 95.0, seed: int = 0) -> DataFrame:
    """Least-squares line with r and p of groups of three rows or more; with `unit` also a bootstrap interval of the slope."""
    by = list(by)
    out = _line(df, by, x, y)
    if unit is None:
        return out
    s = pair_sums(df, by, x, y, unit, n_boot, seed)
    n = F.nullif("w", F.lit(0.0))
    slope = F.try_divide(F.col("xy") - F.col("x") * F.col("y") / n, F.col("xx") - F.col("x") * F.col("x") / n)
    return _attach(out, percentile_bounds(s.select(*by, slope.alias("m")), by, "m", ci), by)


def pair_sums(df: DataFrame, by: Sequence[str], x: str, y: str, unit: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """Per group and replicate the weighted sums of x, y, their squares and their product, about the means of all rows, so that sums of squares keep their digits."""
    by = list(by)
    ok = finite(df, x, y).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *unit_keys(seed, unit))
    means = ok.groupBy(*by).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    c = _attach(ok, means, by).withColumns({"x": F.col("x") - F.col("_mx"), "y": F.col("y") - F.col("_my")})
    return replicate_sums(c.withColumns({"xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y")}), by, ["x", "y", "xx", "xy", "yy"], n_boot)


#: Rows of a block of `pair_correlations`, whose pairs cost far more than rows, and least number of tasks that its tiles are dealt over.
CORRELATION_ROWS, CORRELATION_TASKS = 1024, 256


def pair_correlations(df: DataFrame, representations: dict[str, str], by: Sequence[str], unit: Sequence[str], n_boot: int = N_BOOT, ci: float = 95.0, seed: int = 0,
                      key: Sequence[str] = SAR_KEY, tile_rows: int = CORRELATION_ROWS) -> DataFrame:
    """Per group `by` (columns of `key`) and representation the Pearson correlation of chemical distance and profile similarity over the pairs of `sar_pairs`, with a percentile interval over
    resampled pairs; `unit` names a pair by columns of `key`, `representation` and, last, the two drugs.

    Pairs are made twice where their rows are, for the moments and for the replicates, and never leave a task: a tile sends one row of sums per representation. Moments are about the tile's
    means, and replicates about the means of all pairs, so that sums of squares keep their digits."""
    by, key, reps = list(by), list(key), dict(representations)
    wanted = ["pearson", *(f"{r}_dist" for r in reps)]
    types = "".join(f"`{c}` string, " for c in by)
    group = [*by, "representation"]

    def defined(table: pa.Table) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(representation, first compounds, second compounds, distances, similarities) of the pairs that have both, strip by strip."""
        for i, j, values in sar_strips(table, reps, wanted):
            for r in reps:
                ok = np.flatnonzero(~np.isnan(values[f"{r}_dist"]) & ~np.isnan(values["pearson"]))
                if len(ok):
                    yield r, i[ok], j[ok], values[f"{r}_dist"][ok], values["pearson"][ok]

    def named(table: pa.Table, made: dict[str, dict[str, object]]) -> pa.RecordBatch:
        cols = {c: pa.repeat(table[c][0], len(made)) for c in by} | {"representation": pa.array(list(made), pa.string())}
        return pa.RecordBatch.from_pydict(cols | {c: pa.array([m[c] for m in made.values()]) for c in next(iter(made.values()))})

    def moments_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sar_tile(batches)
        for r, _, _, x, y in defined(table):
            mx, my = x.mean(), y.mean()
            yield named(table, {r: {"n": len(x), "mx": mx, "my": my, "xx": ((x - mx) ** 2).sum(), "xy": ((x - mx) * (y - my)).sum(), "yy": ((y - my) ** 2).sum(),
                                    "x0": x.min(), "x1": x.max(), "y0": y.min(), "y1": y.max()}})

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sar_tile(batches)
        text = lambda c: [None if v is None else v.encode() for v in table[c].to_pylist()]
        drugs = [b"" if v is None else b"|" + v for v in text("drug")]
        held = {}
        for r, i, j, x, y in defined(table):
            fixed = [r if c == "representation" else table[c][0].as_py() for c in unit[:-2]]
            start = "|".join([str(seed), *(c for c in fixed if c is not None)]).encode()
            digests = b"".join([hashlib.md5(start + drugs[a] + drugs[b], usedforsecurity=False).digest() for a, b in zip(i.tolist(), j.tolist())])
            words = np.frombuffer(digests, ">u4").reshape(-1, 4)
            x, y = x - table[f"_mx_{r}"][0].as_py(), y - table[f"_my_{r}"][0].as_py()
            sums = drawn_sums(np.stack([np.ones(len(x)), x, y, x * x, x * y, y * y]), words[:, 0], words[:, 1] >> np.uint32(4), n_boot)
            held[r] = held[r] + sums if r in held else sums
        if held:
            yield named(table, {r: dict(zip(PAIR_TERMS, v.tolist())) for r, v in held.items()})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            cols = {c: pa.array([k[i] for k in held], pa.string()) for i, c in enumerate(group)}
            made = {c: pa.array([v[i].tolist() for v in held.values()], pa.list_(pa.float64())) for i, c in enumerate(PAIR_TERMS)}
            held.clear()
            return pa.RecordBatch.from_pydict(cols | made)

        for batch in batches:
            for k in range(batch.num_rows):
                name = tuple(batch.column(c)[k].as_py() for c in group)
                sums = np.stack([batch.column(c)[k].values.to_numpy() for c in PAIR_TERMS])
                held[name] = held[name] + sums if name in held else sums
            if len(held) > 256:
                yield out()
        if held:
            yield out()

    tiled = lambda rows, *more: sar_tiles(rows, list(reps), key, tile_rows, context=more, tasks=CORRELATION_TASKS)
    parts = written(tile_apply(tiled(df), key, moments_of, types + "representation string, n bigint, " + ", ".join(f"{c} double" for c in ("mx", "my", "xx", "xy", "yy", "x0", "x1", "y0", "y1"))), "moments")
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    whole = parts.groupBy(*group).agg(F.sum("n").alias("_n"), mean("mx").alias("_mx"), mean("my").alias("_my"), (F.min("x0") == F.max("x1")).alias("_fx"), (F.min("y0") == F.max("y1")).alias("_fy"))
    dx, dy = F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my")
    about = lambda c, d: F.sum(F.col(c) + F.col("n") * d)
    whole = whole.withColumnsRenamed({c: f"_of_{c}" for c in group})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]
    r = F.try_divide(about("xy", dx * dy), F.sqrt(about("xx", dx * dx) * about("yy", dy * dy)))
    moments = written(parts.join(whole, reduce(and_, same)).select(*group, "n", "mx", "my", "xx", "xy", "yy", "_n", "_mx", "_my", "_fx", "_fy").groupBy(*group).agg(
        F.first("_n").alias("n"), F.first("_mx").alias("_mx"), F.first("_my").alias("_my"), F.when(~(F.first("_fx") | F.first("_fy")), r).alias("r")), "moments")
    means = [F.max(F.when(F.col("representation") == r, F.col(f"_m{v}"))).alias(f"_m{v}_{r}") for r in reps for v in "xy"]
    near = df.join(moments.groupBy(*by).agg(*means), by) if by else df.crossJoin(F.broadcast(moments.agg(*means)))
    arrays = ", ".join(f"{c} array<double>" for c in PAIR_TERMS)
    sums = tile_apply(tiled(near, *[f"_m{v}_{r}" for r in reps for v in "xy"]), key, sums_of, f"{types}representation string, {arrays}").mapInArrow(merged, f"{types}representation string, {arrays}")
    long = sums.select(*group, F.posexplode(F.arrays_zip(*PAIR_TERMS)).alias("b", "_v")).groupBy(*group, "b").agg(*[F.sum(f"_v.{c}").alias(c) for c in PAIR_TERMS])
    n = F.nullif("w", F.lit(0.0))
    cov = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / n
    m = F.try_divide(cov("x", "y", "xy"), F.sqrt(cov("x", "x", "xx") * cov("y", "y", "yy")))
    return _attach(moments.select(*group, "n", "r"), percentile_bounds(long.select(*group, m.alias("m")).filter("m IS NOT NULL AND NOT isnan(m)"), group, "m", ci), group)


def _line(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    a = finite(df, x, y).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop(x, y), F.var_pop(x)).alias("slope"),
        F.avg(x).alias("_mx"), F.avg(y).alias("_my"), safe_corr(F.col(x), F.col(y)).alias("r"))
    out = a.filter("n >= 3").withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx")).drop("_mx", "_my")
    return out.withColumn("p", correlation_p(F.col("r"), F.col("n")))


def partial_spearman(df: DataFrame, by: Sequence[str], x: str, y: str, covariates: Sequence[str], n_boot: int | None = None, unit: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Rank correlation of x and y with the covariates' ranks removed, from pairwise rank correlations; if asked with a bootstrap interval over rows, each replicate ranked anew."""
    by, names = list(by), [x, y, *covariates]
    ok = finite(df.select(*dict.fromkeys([*by, *names, *unit])), *names)
    if n_boot:  # written once, as in `spearman_test`
        ok = cut_lineage(ok.select(*by, *names, *unit_keys(seed, unit)))
    ranked = with_average_ranks(ok, by, {c: f"_r_{c}" for c in names})
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    row = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[
        safe_corr(F.col(f"_r_{names[i]}"), F.col(f"_r_{names[j]}")).alias(f"_c{i}_{j}") for i, j in pairs])
    k = len(covariates)
    out = row.withColumn("rho", partial_correlation(lambda i, j: F.col(f"_c{i}_{j}"), k)).filter(F.col("n") >= k + 3).select(*by, "n", "rho")
    if n_boot:
        rows = ok.select(*by, *[F.col(c).alias(f"_v{i}") for i, c in enumerate(names)], "_low", "_high")
        out = _attach(out, rank_bounds(rows, by, [f"_v{i}" for i in range(len(names))], n_boot), by)
    return out.withColumn("p", correlation_p(F.col("rho"), F.col("n"), k))


def cluster_ols(df: DataFrame, y: str, xs: Sequence[str], cluster: str, n_boot: int = N_BOOT, ci: float = 95.0, seed: int = 0) -> DataFrame:
    """y ~ 1 + xs with cluster-bootstrap intervals and p. Clusters shrink to their cross products, replicates add
    those, and only small systems are solved in Arrow batches."""
    names = ["intercept", *xs]
    p = len(names)
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    products = {f"a{i}_{j}": cols[i] * cols[j] for i in range(p) for j in range(i, p)} | {f"b{i}": cols[i] * F.col(y) for i in range(p)}
    per = cut_lineage(finite(df, y, *xs).groupBy(cluster).agg(*[F.sum(e).alias(n) for n, e in products.items()]))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(rows: pd.DataFrame) -> pd.Series:
        """Least-squares solutions of a batch of systems at once; of least length where one is singular."""
        a = np.stack([np.stack([rows[f"a{min(i, j)}_{max(i, j)}"].to_numpy(float) for j in range(p)], axis=1) for i in range(p)], axis=1)
        b = np.stack([rows[f"b{i}"].to_numpy(float) for i in range(p)], axis=1)
        return pd.Series(list((np.linalg.pinv(a, hermitian=True) @ b[:, :, None])[:, :, 0]), dtype=object)

    packed = F.struct(*[F.col(n).cast("double").alias(n) for n in products])
    whole = per.agg(*[F.sum(n).alias(n) for n in products]).select(solve(packed).alias("beta"))
    reps = cluster_replicates(per, [], [cluster], list(products), n_boot, seed)
    label = F.array(*[F.lit(n) for n in names])
    long = lambda d, v: d.select(F.posexplode("beta").alias("i", v)).withColumn("term", F.get(label, F.col("i"))).drop("i")
    boots = long(reps.select(solve(packed).alias("beta")), "v")
    a = (100.0 - ci) / 200.0
    share = F.avg((F.col("v") > 0).cast("double"))
    ci_rows = boots.groupBy("term").agg(F.percentile("v", a).alias("lo"), F.percentile("v", 1 - a).alias("hi"),
                                        F.least(F.lit(1.0), F.greatest(2 * F.least(share, 1 - share), 1.0 / F.count("v"))).alias("p"))
    return long(whole, "coef").join(ci_rows, "term")


def friedman(df: DataFrame, block: Sequence[str], treatment: str, value: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Friedman statistic with tie correction and Kendall's W over complete blocks; a block has k rows."""
    by, block = list(by), list(block)
    ok = finite(df, value).groupBy(*by, *block, treatment).agg(F.avg(value).alias("v"))
    w = Window.partitionBy(*by, *block)
    full = ok.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") == k)
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, *block, "v"))
    ranked = full.withColumn("_t", same).withColumn("_rank", F.rank().over(w.orderBy("v")) + (F.col("_t") - 1) / 2.0)
    # sum over rows of t^2 - 1 equals sum over tie groups of t^3 - t
    ties = ranked.groupBy(*by).agg(F.sum(F.col("_t") * F.col("_t") - 1).alias("ties"), (F.count(F.lit(1)) / k).alias("n"))
    sums = ranked.groupBy(*by, treatment).agg(F.sum("_rank").alias("R")).groupBy(*by).agg(F.sum(F.col("R") * F.col("R")).alias("ss"))
    n, kk = F.col("n"), float(k)
    raw = 12 / (n * kk * (kk + 1)) * F.col("ss") - 3 * n * (kk + 1)
    stat = F.when((n >= 2) & F.lit(k >= 3), F.try_divide(raw, 1 - F.col("ties") / (n * kk * (kk * kk - 1))))
    out = _attach(ties, sums, by).withColumn("stat", stat).withColumn("w", F.col("stat") / (n * (kk - 1)))
    return out.select(*by, F.col("n").cast("bigint").alias("n_blocks"), "stat", "w").withColumn("p", chi2_upper(F.col("stat"), F.lit(kk - 1)))


def bh_fdr(df: DataFrame, p: str, by: Sequence[str] = (), name: str = "q") -> DataFrame:
    """Benjamini-Hochberg: q = min over p' >= p of p' m / rank, capped at 1; undefined p stays undefined."""
    by = list(by)
    q = least_from_top(df, by, p, lambda v, n, rank: v * n / rank, "_q").select(*by, p, F.least(F.lit(1.0), F.col("_q")).alias(name))
    return df.join(q, [*by, p], "left")


def right_closed_bin(v: Column, lo: float, width: float, bins: int) -> Column:
    """0-based bin (a, b]; a value at or below the lowest edge or above the last falls out."""
    k = F.ceil(F.round((v - lo) / width, 9)).cast("int") - 1
    return F.when((k >= 0) & (k < bins), k)


def binned_means(df: DataFrame, by: Sequence[str], x: str, y: str, lo: float, width: float, bins: int, min_n: int,
                 unit: Sequence[str] | None = None, n_boot: int = N_BOOT) -> DataFrame:
    by = list(by)
    b = finite(df, x, y).withColumn("bin", right_closed_bin(F.col(x), lo, width, bins)).dropna(subset=["bin"])
    mid = F.lit(lo) + (F.col("bin") + 0.5) * width
    if unit is None:
        out = b.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"))
    else:
        out = bootstrap_mean(b, [*by, "bin"], y, unit, n_boot)
    return out.filter(F.col("n") >= min_n).withColumn("mid", mid)


CURVES = {"log": (lambda x, k: F.log(x), 2), "sqrt": (lambda x, k: F.sqrt(x), 2), "power": (lambda x, k: F.pow(x, k), 3),
          "saturating": (lambda x, k: 1 - F.exp(-x / k), 3), "michaelis_menten": (lambda x, k: x / (k + x), 3)}


def curve_fits(df: DataFrame, x: str, y: str, grids: dict[str, list[float]]) -> DataFrame:
    """Families y = a + b g(x; k): the single nonlinear parameter runs over a grid, the rest is linear; the best grid
    point per family by R2, adjusted for the number of parameters. Rows first shrink to sums per distinct x."""
    v = finite(df, x, y).groupBy(F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy"))
    frames = []
    for name, (g, n_par) in CURVES.items():
        grid = F.array(*[F.lit(float(k)) for k in grids.get(name, [1.0])])
        e = v.withColumn("k", F.explode(grid)).withColumn("g", g(F.col("x"), F.col("k")))
        s = e.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("g")).alias("sg"), F.sum(F.col("n") * F.col("g") ** 2).alias("sgg"),
                               F.sum(F.col("g") * F.col("sy")).alias("sgy"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"))
        n = F.col("n")
        cov, vg, vy = F.col("sgy") - F.col("sg") * F.col("sy") / n, F.col("sgg") - F.col("sg") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
        slope = F.try_divide(cov, vg)
        r2 = F.try_divide(cov * cov, vg * vy)
        row = s.select(F.lit(name).alias("family"), "k", slope.alias("slope"), ((F.col("sy") - slope * F.col("sg")) / n).alias("intercept"), r2.alias("r2"),
                       (1 - (1 - r2) * (n - 1) / (n - n_par)).alias("adj_r2"))
        frames.append(row.agg(F.max_by(F.struct("family", "k", "slope", "intercept", "r2", "adj_r2"), F.struct("r2", -F.col("k"))).alias("r")).select("r.*"))
    return union_all(frames)


#: Grid points of a level of `curve_optimum`, families whose parameter may be negative, and the bounds of each family's parameter.
GRID_POINTS, SIGNED, BOUNDS = 33, ("power",), {"power": (0.01, 10.0), "saturating": (0.001, 1e6), "michaelis_menten": (0.001, 1e6)}


def curve_optimum(df: DataFrame, x: str, y: str, tolerance: float = 1e-9, bounds: dict[str, tuple[float, float]] = BOUNDS) -> DataFrame:
    """Families y = a + b g(x; k) at the parameter of largest R2 within its bounds: nested grids, first over the logarithm, each next one around the best point of the last, until the
    parameter stands still. Every level is one aggregate over the table of distinct x, in which rows are only counted and added up; families without a parameter have k = 1."""
    sums = finite(df, x, y).groupBy(F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("sy"), F.sum(F.col(y).cast("double") ** 2).alias("syy"))
    v = cut_lineage(sums)
    n, sy, syy = v.agg(F.sum("n"), F.sum("sy"), F.sum("syy")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "family string, k double, slope double, intercept double, r2 double, adj_r2 double")
    mean, vy = sy / n, syy - sy * sy / n

    def fits(grid: dict[str, np.ndarray]) -> dict[str, list]:
        points = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(float(k)).alias("k")) for f, ks in grid.items() for k in ks]))
        g = F.coalesce(*[F.when(F.col("p.f") == f, CURVES[f][0](F.col("x"), F.col("p.k"))) for f in grid])
        e = v.select("x", "n", (F.col("sy") - F.col("n") * mean).alias("c"), points.alias("p")).select("p.f", "p.k", "n", "c", g.alias("g"))
        rows = e.groupBy("f", "k").agg(F.sum(F.col("n") * F.col("g")).alias("sg"), F.sum(F.col("n") * F.col("g") ** 2).alias("sgg"), F.sum(F.col("g") * F.col("c")).alias("cov")).collect()
        out: dict[str, list] = {f: [] for f in grid}
        for r in rows:
            vg = r["sgg"] - r["sg"] ** 2 / n
            r2 = r["cov"] ** 2 / (vg * vy) if vg > 0 and vy > 0 else 0.0
            out[r["f"]].append((r2, -r["k"], r["cov"] / vg if vg > 0 else 0.0, r["sg"]))
        return out

    done = {f: max(p) for f, p in fits({f: np.array([1.0]) for f in CURVES if f not in bounds}).items()}
    grid = {f: np.geomspace(lo, hi, GRID_POINTS) for f, (lo, hi) in bounds.items()}
    grid |= {f: np.concatenate([-grid[f][::-1], grid[f]]) for f in SIGNED if f in grid}
    while grid:
        best, ahead = {f: max(p) for f, p in fits(grid).items()}, {}
        for f, b in best.items():
            at = int(np.argmin(np.abs(grid[f] + b[1])))
            lo, hi = grid[f][max(0, at - 1)], grid[f][min(len(grid[f]) - 1, at + 1)]
            if hi - lo <= tolerance * abs(b[1]):
                done[f] = b
            else:
                ahead[f] = np.linspace(lo, hi, GRID_POINTS)
        grid = ahead
    rows = [(f, -b[1], b[2], mean - b[2] * b[3] / n, b[0], 1 - (1 - b[0]) * (n - 1) / (n - CURVES[f][1]) if n > CURVES[f][1] else None) for f, b in done.items()]
    return df.sparkSession.createDataFrame([(f, float(k), float(s), float(i), float(r), None if a is None else float(a)) for f, k, s, i, r, a in rows],
                                           "family string, k double, slope double, intercept double, r2 double, adj_r2 double")


def factor_sums(long: DataFrame, unit: str, value: str, factors: Sequence[str]) -> DataFrame:
    """Per (unit, factor) sum of squares between levels, the total as factor 'total'. All level sums come from one
    pass with grouping sets."""
    sets = [[F.col(unit), F.col(f)] for f in factors] + [[F.col(unit)]]
    sums = long.groupingSets(sets, F.col(unit), *[F.col(f) for f in factors]).agg(
        F.sum(value).alias("_t"), F.sum(F.col(value) ** 2).alias("_q"), F.count(F.lit(1)).alias("_n"),
        *[F.grouping(f).alias(f"_g{i}") for i, f in enumerate(factors)])
    name = F.coalesce(*[F.when(F.col(f"_g{i}") == 0, F.lit(f)) for i, f in enumerate(factors)], F.lit("total"))
    parts = sums.select(unit, name.alias("factor"), (F.col("_t") ** 2 / F.col("_n")).alias("_s"), "_t", "_q", "_n").groupBy(unit, "factor").agg(
        F.sum("_s").alias("_s"), F.sum("_t").alias("_t"), F.sum("_q").alias("_q"), F.sum("_n").alias("_n"))
    centre = F.col("_t") ** 2 / F.col("_n")
    return parts.select(unit, "factor", F.when(F.col("factor") == "total", F.col("_q")).otherwise(F.col("_s")).alias("_x"), centre.alias("_c")) \
        .select(unit, "factor", (F.col("_x") - F.col("_c")).alias("ss"))


def variance_partition(long: DataFrame, unit: str, value: str, factors: Sequence[str], design: DataFrame) -> DataFrame:
    """Variance fractions per unit (gene) by the method of moments for crossed or nested random factors.

    The expected sums of squares depend on level counts only; `design` has one row per observation (the same for every gene),
    and its few coefficients are computed by aggregates. Factors with one level are dropped, negative components
    set to 0, fractions sum to 1.
    """
    combos = cut_lineage(design.groupBy(*factors).agg(F.count(F.lit(1)).alias("c")))
    levels = combos.agg(F.sum("c").alias("N"), *[F.count_distinct(f).alias(f) for f in factors]).first()
    used = [f for f in factors if levels[f] > 1]
    n_obs, k = float(levels["N"]), len(used)

    sizes = {f: combos.groupBy(f).agg(F.sum("c").alias("c")).agg(F.sum(F.col("c").cast("double") ** 2)).first()[0] for f in used}
    m = np.zeros((k + 1, k + 1))
    for i, f in enumerate(used):
        for j, g in enumerate(used):
            part = n_obs
            if f != g:
                both = combos.groupBy(f, g).agg(F.sum("c").alias("c"))
                part = both.groupBy(f).agg((F.sum(F.col("c").cast("double") ** 2) / F.sum("c")).alias("v")).agg(F.sum("v")).first()[0]
            m[i, j] = part - sizes[g] / n_obs
        m[i, k] = levels[f] - 1
    m[k, :k] = [n_obs - sizes[g] / n_obs for g in used]
    m[k, k] = n_obs - 1
    inverse = np.linalg.pinv(m)
    ss = factor_sums(long, unit, value, used).groupBy(unit).pivot("factor", [*used, "total"]).agg(F.first("ss"))
    rhs = [F.col(f) for f in [*used, "total"]]
    comp = [F.greatest(sum((rhs[j] * F.lit(float(inverse[i, j])) for j in range(k + 1)), F.lit(0.0)), F.lit(0.0)) for i in range(k + 1)]
    names = [*used, "Residuals"]
    values = ss.select(unit, *[c.alias(f"v_{n}") for c, n in zip(comp, names)])
    whole = sum((F.col(f"v_{n}") for n in names), F.lit(0.0))
    return values.select(unit, *[F.try_divide(F.col(f"v_{n}"), whole).alias(n) for n in names])
