"""Vector scores of predictions, baselines, linear models and centroid-referenced evaluation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.functions import metrics as N
from platewise.functions import vectors as V
from platewise.functions.dense import matrix
from platewise.operators import boosting
from platewise.operators.cleaning import DataError, missing_keys
from platewise.operators.profiles import average_vectors
from platewise.operators.summaries import QUARTILES, best_per_group, union_all
from platewise.plans.ordering import exact_quantiles, tile_apply, tiles

METRICS = N.SCORES
TOP_K = 20


def score_rows(df: DataFrame, y: str = "y", yhat: str = "yhat", digits: int | None = None) -> DataFrame:
    """Five metrics per row; ties round to even."""
    out = df.withColumn("_m", N.score_struct(F.col(y), F.col(yhat))).drop(y, yhat)
    value = lambda m: F.col(f"_m.{m}") if digits is None else F.bround(F.col(f"_m.{m}"), digits)
    return out.select(*[c for c in out.columns if c != "_m"], *[value(m).alias(m) for m in METRICS])


def average_metrics(scored: DataFrame, by: Sequence[str], digits: int = 4) -> DataFrame:
    return scored.groupBy(*by).agg(*[F.bround(F.avg(m), digits).alias(m) for m in METRICS])


def losses(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Global losses over all values, combined from per-row sums."""
    a, b = F.col(y), F.col(yhat)
    ape = V.total(F.zip_with(a, b, lambda u, w: F.abs((w - u) / (u + F.lit(1e-8)))))
    s = df.select(F.size(a).alias("n"), V.squared_distance(a, b).alias("sq"), ape.alias("ape")).agg(
        F.sum("n").alias("n"), F.sum("sq").alias("sq"), F.sum("ape").alias("ape"))
    mse = F.col("sq") / F.col("n")
    return s.select(mse.alias("mse"), F.sqrt(mse).alias("rmse"), (F.col("ape") / F.col("n") * 100).alias("mape"))


def with_train_mean(df: DataFrame, train: DataFrame, y: str = "y", name: str = "train_mean") -> DataFrame:
    """Attach the mean training truth. The broadcast side is a single vector of panel length."""
    one = average_vectors(train.select(F.lit(1).alias("_one"), y), ["_one"], y, name)
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


def baselines(df: DataFrame, train: DataFrame) -> DataFrame:
    """Reference delta, training mean and zero as predictions of `y`."""
    both = with_train_mean(df, train)
    arm = lambda n, c: both.withColumn("method", F.lit(n)).withColumn("yhat", c).drop("train_mean", "ref")
    return union_all([arm("reference", F.col("ref")), arm("train_mean", F.col("train_mean")),
                      arm("zero", F.transform("y", lambda x: x * 0.0))])


DIRECTIONS = {"val_avg_pearson": "max", "val_avg_spearman": "max", "val_avg_cosine_sim": "max", "val_avg_l2": "min"}


def best_epoch(history: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Epoch with the best value of the metric in its own direction; the first among equals."""
    return best_per_group(history, by, metric, ["epoch"], DIRECTIONS[metric] == "max")


# linear and tree models

def gram_sums(df: DataFrame, x: str, y: str) -> DataFrame:
    """[X 1]'[X 1 | Y] as rows (i, j, s): each partition adds its products, one sum per cell is shuffled."""

    def part(batches):
        acc = None
        for batch in batches:
            if batch.num_rows:
                a = matrix(batch.column(0))
                a = np.hstack([a, np.ones((len(a), 1))])
                g = a.T @ np.hstack([a, matrix(batch.column(1))])
                acc = g if acc is None else acc + g
        if acc is not None:
            i, j = np.indices(acc.shape)
            yield pa.record_batch({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "s": acc.ravel()})

    dbl = lambda c: F.col(c).cast("array<double>")
    return df.select(dbl(x), dbl(y)).mapInArrow(part, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


MAX_FEATURES = 5000  # features + 1 of a linear fit whose products one process can hold and solve; reduce wider inputs first (fit_pca)


def gram(df: DataFrame, x: str, y: str) -> np.ndarray:
    """[X 1]'[X 1 | Y] on the driver: features x (features + outputs) numbers, whatever the number of rows."""
    sizes = df.agg(F.max(F.size(x)), F.max(F.size(y))).first()
    if max(sizes) >= MAX_FEATURES:
        raise ValueError(f"{max(sizes)} features or outputs; at most {MAX_FEATURES - 1} are solved in one process, reduce them first")
    cells = gram_sums(df, x, y).toPandas()
    g = np.zeros((cells.i.max() + 1, cells.j.max() + 1))
    g[cells.i, cells.j] = cells.s
    return g


def lasso_fit(df: DataFrame, x: str, y: str, penalty: float, tolerance: float = 1e-10) -> np.ndarray:
    """Lasso coefficients (features + intercept, outputs) of every output, features scaled to unit deviation, from one pass over the
    rows: cyclic coordinate descent on the moments, all outputs at once, until no coefficient moves."""
    g = gram(df, x, y)
    p = len(g) - 1
    n = g[p, p]
    mx, my = g[p, :p] / n, g[p, p + 1:] / n
    a, b = g[:p, :p] / n - np.outer(mx, mx), g[:p, p + 1:] / n - np.outer(mx, my)
    sd = np.sqrt(np.maximum(np.diag(a), 0))
    used = np.flatnonzero(sd > 1e-12)
    a, b = a[np.ix_(used, used)] / np.outer(sd[used], sd[used]), b[used] / sd[used, None]
    w, moved = np.zeros_like(b), 1.0
    while moved > tolerance * max(1.0, float(np.abs(b).max(initial=0))):
        moved = 0.0
        for k in range(len(used)):
            rho = b[k] - a[k] @ w + a[k, k] * w[k]
            now = np.sign(rho) * np.maximum(np.abs(rho) - penalty, 0) / a[k, k]
            moved = max(moved, float(np.abs(now - w[k]).max(initial=0)))
            w[k] = now
    full = np.zeros((p + 1, b.shape[1]))
    full[used] = w / sd[used, None]
    full[p] = my - mx @ full[:p]
    return full


def ridge_fit(df: DataFrame, x: str, y: str, penalty: float) -> np.ndarray:
    """Multi-output ridge coefficients (features + intercept, outputs); the intercept is not penalised."""
    g = gram(df, x, y)
    p = len(g)
    reg = np.eye(p) * penalty
    reg[-1, -1] = 0.0
    return np.linalg.solve(g[:, :p] + reg, g[:, p:])


def linear_predict(df: DataFrame, x: str, coef: np.ndarray, name: str = "yhat") -> DataFrame:
    w = df.sparkSession.sparkContext.broadcast(coef)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def predict(v):
        import pandas as pd
        a = np.array(v.tolist(), dtype=np.float64)
        return pd.Series(list(np.hstack([a, np.ones((len(a), 1))]) @ w.value)) if len(a) else pd.Series([], dtype=object)

    return df.withColumn(name, predict(F.col(x).cast("array<double>")))


def per_gene_trees(train: DataFrame, test: DataFrame, x: str, y: str, keys: Sequence[str], rounds: int = 50, eta: float = 0.1, depth: int = 6) -> DataFrame:
    """One model of boosted trees for every gene of the panel; predictions as long rows."""
    model = boosting.fit(train, x, y, rounds, eta, depth)
    long = F.posexplode(F.arrays_zip(F.col(y).alias("y"), F.col("yhat").alias("yhat"))).alias("gene_idx", "v")
    return boosting.predict(test, model, x).select(*keys, long).select(*keys, "gene_idx", "v.y", "v.yhat")



# centroid-referenced evaluation

def context_means(train: DataFrame, context: Sequence[str], y: str = "y", name: str = "centroid") -> DataFrame:
    return average_vectors(train, context, y, name)


def attach_context(df: DataFrame, means: DataFrame, context: Sequence[str], strict: bool = True) -> DataFrame:
    """Centroid of each row's context; a context absent from training is an error."""
    if strict and not missing_keys(df, means, context).isEmpty():
        raise DataError("a context has no training rows")
    return df.join(means, list(context))


def top_positions(y: Column, k: int = TOP_K) -> Column:
    """Positions of the k largest absolute values, lower position first among equals."""
    keyed = F.transform(y, lambda v, i: F.struct((-F.abs(v)).alias("a"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda e: e["i"])


def take(v: Column, positions: Column) -> Column:
    return F.transform(positions, lambda i: F.get(v, i))


def centroid_metrics(df: DataFrame, k: int = TOP_K) -> DataFrame:
    """Rows with y, yhat, centroid to metrics of the model and of the centroid as a prediction; `_control` on the
    vectors as they are, `_systema` after subtracting the centroid from both."""
    two = union_all([df.withColumn("method", F.lit("model")),
                     df.withColumn("yhat", F.col("centroid")).withColumn("method", F.lit("perturbed_mean"))])
    out = two.withColumn("_m", N.centroid_struct(k)(F.col("y"), F.col("yhat"), F.col("centroid"))).drop("y", "yhat", "centroid")
    return out.select(*[c for c in out.columns if c != "_m"], "_m.*")


def centroid_accuracy(df: DataFrame, context: Sequence[str], row_id: Column, keys: Sequence[str], tile_rows: int = 512) -> DataFrame:
    """Share of other truths in the context farther from the prediction than its own truth (strictly); NULL for a
    context of one row. Every tile adds counts per row, no distance leaves a task."""
    context, keys = list(context), list(keys)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", farther bigint, others bigint"

    def run(table: pa.Table) -> pa.Table:
        side = table["_side"].to_numpy()
        y, p = matrix(table["y"]), matrix(table["yhat"])
        farther, others = np.zeros(len(side), np.int64), np.zeros(len(side), np.int64)

        def add(rows, cols, own):
            if not len(rows) or not len(cols):
                return
            mine = ((p[rows] - y[rows]) ** 2).sum(axis=1)
            for r, row in enumerate(rows):
                d = ((p[row] - y[cols]) ** 2).sum(axis=1)
                hit = d > mine[r]
                if own:
                    hit[r] = False
                farther[row] += hit.sum()
                others[row] += len(cols) - (1 if own else 0)

        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if table["_p"][0].as_py() == table["_q"][0].as_py():
            add(a, a, True)
        else:
            add(a, b, False)
            add(b, a, False)
        return pa.table({**{c: table[c] for c in keys}, "farther": pa.array(farther), "others": pa.array(others)})

    need = list(dict.fromkeys([*context, *keys, "y", "yhat"]))
    counted = tile_apply(tiles(df.select(*need), context, row_id, tile_rows), context, run, schema)
    return counted.groupBy(*keys).agg(F.try_divide(F.sum("farther").cast("double"), F.sum("others").cast("double")).alias("centroid_accuracy"))


def repeated_conditions(df: DataFrame, context: Sequence[str], condition: Sequence[str]) -> DataFrame:
    return df.groupBy(*context, *condition).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def systematic_variation(df: DataFrame) -> DataFrame:
    """Cosine to the centroid, response norm, norm of what the centroid does not explain."""
    y, c = F.col("y"), F.col("centroid")
    cos = F.when((V.norm(y) > 0) & (V.norm(c) > 0), V.cosine(y, c))
    return df.withColumns({"cosine_to_perturbed_centroid": cos, "response_norm": V.norm(y), "specific_norm": V.l2(y, c)}).drop("y", "yhat", "centroid")


def metric_summary(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Rows, finite values, mean and quartiles per group and metric."""
    by = [*by, "metric"]
    long = df.unpivot(by[:-1], list(metrics), "metric", "v")
    base = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNotNull() & ~F.isnan("v")).alias("n_finite"),
                                 F.avg(F.when(~F.isnan("v"), F.col("v"))).alias("mean"))
    return base.join(exact_quantiles(long, by, "v", QUARTILES), by, "left")


def case_metrics(df: DataFrame) -> DataFrame:
    """Diagnostics of a prediction against reference and target (y, ref, yhat)."""
    out = df.withColumn("_m", N.case_struct(F.col("y"), F.col("ref"), F.col("yhat"))).drop("y", "ref", "yhat")
    return out.select(*[c for c in out.columns if c != "_m"], "_m.*").withColumn(
        "pearson_gain", F.col("prediction_target_pearson") - F.col("reference_target_pearson")).withColumn(
        "fractional_l2_reduction", 1 - F.try_divide("prediction_target_l2", "reference_target_l2"))
