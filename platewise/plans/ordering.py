"""Exact ranks, quantiles and tiles that hold for hot groups.

Equal values are counted before any window runs. A group's distinct values are cut into ranges by a function of the value
alone, and ranges into finer ones, so a window sees only the distinct values of one fine range (relative distance 2e-7) or the fine ranges of one
coarse range, and the plan is the same lazy one for every size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.session import cut_lineage

STEPS = 1024  # ranges between a value and its double
FINE = 4096  # fine ranges of a range
BLOCKS = 8  # blocks of a group that make tiles enough to share the work


def range_of(value: Column, fine: int = 1) -> Column:
    """Number of the value's range, or of its fine range with `fine` of them in a range; it never falls as the value grows: the scaled logarithm, mirrored below zero. Infinite values have
    the outermost ranges."""
    v, steps = value.cast("double"), STEPS * fine
    step = F.floor(F.log2(F.abs(v)) * steps) + 1100 * steps
    end, far = F.lit(float("inf")), F.lit(4000 * steps).cast("bigint")
    return F.when(v == 0, 0).when(v == end, far).when(v == -end, -far).when(v > 0, step).otherwise(-step).cast("bigint")


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank", count: str | None = None) -> DataFrame:
    """Add the place 1, 2, ... of every row within its group in the given order, and the group's rows as `count`, without a window over a group.

    Rows are sorted over ranges cut by their numbers, ties included, and written once with their place in the range; only the rows of each (range, group), at
    most ranges plus groups of them, meet in a window. Rows equal in the whole order are numbered in any order."""
    df, on = one_group(df, by)
    keys = [F.col(c) for c in on] + list(order) + [F.col("_tie")]
    spread = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut_lineage(spread.drop("_tie").withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    whole = Window.partitionBy(*on)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = placed.groupBy("_part", *on).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n")).select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(on)], (before - F.col("_low") + 1).alias("_base"), F.sum("_n").over(whole).alias("_all_rows"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(on)]  # a null group is one, too
    out = placed.join(spans, reduce(and_, same, F.col("_part") == F.col("_p"))).withColumn(name, F.col("_at") + F.col("_base"))
    if count:
        out = out.withColumn(count, F.col("_all_rows"))
    return out.drop("_part", "_p", "_at", "_base", "_all_rows", *(f"_g{i}" for i in range(len(on))), *([] if by else ["_all"]))


def one_group(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The grouping columns, or a constant one where there are none."""
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def cumulative_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with `cnt`, `before` (rows with a smaller value) and `n` (rows of the group)."""
    df, on = one_group(df, by)
    freq = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*on, value).agg(F.count(F.lit(1)).alias("cnt"))
    freq = freq.withColumn("_f", range_of(F.col(value), FINE))
    over = Window.partitionBy(*on)
    fine = freq.groupBy(*on, "_f").agg(F.sum("cnt").alias("_t")).withColumn("_r", F.floor(F.col("_f") / FINE))
    coarse = fine.groupBy(*on, "_r").agg(F.sum("_t").alias("_c"))
    coarse = coarse.select(*on, "_r", (F.sum("_c").over(over.orderBy("_r")) - F.col("_c")).alias("_o"), F.sum("_c").over(over).alias("n"))
    within = F.sum("_t").over(Window.partitionBy(*on, "_r").orderBy("_f")) - F.col("_t")
    offsets = fine.join(coarse, on + ["_r"]).select(*on, "_f", (F.col("_o") + within).alias("_o"), "n")
    run = freq.withColumn("_c", F.sum("cnt").over(Window.partitionBy(*on, "_f").orderBy(value)) - F.col("cnt"))
    return run.join(offsets, on + ["_f"]).select(*by, value, "cnt", (F.col("_o") + F.col("_c")).alias("before"), "n")


def with_average_ranks(df: DataFrame, by: Sequence[str], ranks: dict[str, str]) -> DataFrame:
    """Add the 1-based average rank within `by` of each column named by `ranks` (column to new name); rows without a value get NULL. All
    ranks are taken from `df` itself, so several cost no more than their sum."""
    by, out = list(by), df
    for value, name in ranks.items():
        found = cumulative_counts(df, by, value).select(*by, value, (F.col("before") + (F.col("cnt") + 1) / 2.0).alias(name))
        out = out.join(found, by + [value], "left")
    return out


def with_average_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    return with_average_ranks(df, by, {value: name})


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles with linear interpolation, from cumulative counts instead of per-group value buffers."""
    cum = cumulative_counts(df, by, value)
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("cnt")), F.col(value)))
        aggs.append((at(lo) + (at(hi) - at(lo)) * F.max(pos - lo)).alias(name))
    return cum.groupBy(*by).agg(*aggs)


def least_from_top(df: DataFrame, by: Sequence[str], order: str, value: Callable[[Column, Column, Column], Column], name: str) -> DataFrame:
    """Per distinct `order` value: the minimum over all rows with order >= this one of `value(order, rows of the group, rows up to this value)`."""
    df, on = one_group(df, by)
    cum = cumulative_counts(df, on, order).withColumns({"_v": value(F.col(order), F.col("n"), F.col("before") + F.col("cnt")), "_r": range_of(F.col(order))})
    later = cum.groupBy(*on, "_r").agg(F.min("_v").alias("_m")).withColumn(
        "_m", F.min("_m").over(Window.partitionBy(*on).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)))
    inner = Window.partitionBy(*on, "_r").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    mins = cum.withColumn("_c", F.min("_v").over(inner)).join(later, on + ["_r"])
    return mins.select(*by, order, F.least("_c", F.coalesce("_m", F.col("_c"))).alias(name))


def tiles(df: DataFrame, by: Sequence[str], row_id: Column, tile_rows: int, most_rows: int | None = None) -> DataFrame:
    """Cut every group into blocks of about `tile_rows` rows and send each row to the block pairs it is part of. With `most_rows`, a group of more than `BLOCKS` blocks gets no more
    of them while its blocks are smaller than that, so that a row is sent less often.

    Adds `_p <= _q` (the block pair) and `_side` (0: first block, 1: second block). A group of one block is
    one tile; a hot group of n rows becomes (n / tile_rows)^2 / 2 independent tiles of bounded size.
    """
    by = list(by)
    blocks = lambda rows: F.ceil(F.count(F.lit(1)) / rows).cast("int")
    wanted = blocks(tile_rows)
    sizes = df.groupBy(*by).agg((F.least(wanted, F.greatest(F.lit(BLOCKS), blocks(most_rows))) if most_rows else wanted).alias("_nb"))
    placed = df.withColumn("_id", F.xxhash64(row_id)).join(sizes, by).withColumn("_b", F.pmod("_id", F.col("_nb")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("_nb") - 1), lambda k: F.struct(
        F.least(k, F.col("_b")).alias("p"), F.greatest(k, F.col("_b")).alias("q"), (k < F.col("_b")).cast("int").alias("side")))
    return placed.withColumn("_t", F.explode(pair)).withColumn("_p", F.col("_t.p")).withColumn("_q", F.col("_t.q")) \
        .withColumn("_side", F.col("_t.side")).drop("_t", "_id", "_nb", "_b")


def tile_apply(tiled: DataFrame, by: Sequence[str], fn: Callable, schema: str) -> DataFrame:
    """Run `fn(pyarrow.Table) -> pyarrow.Table`, or its form over iterators of batches, on every tile."""
    return tiled.groupBy(*by, "_p", "_q").applyInArrow(fn, schema)
