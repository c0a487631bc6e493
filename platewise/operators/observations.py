"""Reference-to-target observations, reference pools and model features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions import text as X
from platewise.functions import vectors as V
from platewise.functions.hashing import md5_int, md5_key
from platewise.operators.pairs import numbered_rows
from platewise.operators.profiles import TREATMENT, average_vectors, mean_of_sparse

MATCH = ["drug", "dose", "time"]
OBSERVATION = ["cell_line", *TREATMENT]


def build_observations(untreated: DataFrame, delta: DataFrame, reference_line: str, width: int,
                       embeddings: DataFrame | None = None) -> DataFrame:
    """One row per (target line, treatment): untreated mean of the line (all plates), mean target delta (truth) and
    mean reference delta matched on (drug, dose, time) without the structure. Rows without a reference, or
    without an embedding when embeddings (smiles, embedding) are given, are dropped. `untreated` is sparse, `delta` dense.
    """
    base = mean_of_sparse(untreated, ["cell_line"], width, "avg_untrt_target")
    truth = average_vectors(delta.filter(F.col("cell_line") != reference_line), OBSERVATION, "expr", "avg_delta_target")
    ref = average_vectors(delta.filter(F.col("cell_line") == reference_line), MATCH, "expr", "delta_ref")
    obs = truth.join(ref, MATCH).join(base, "cell_line")
    if embeddings is not None:
        obs = obs.withColumn("smiles", F.trim("smiles")).join(embeddings.select(F.trim("smiles").alias("smiles"), "embedding"), "smiles")
    return obs


def reference_pool(delta: DataFrame, reference_line: str) -> DataFrame:
    """Replicates of the reference line in long form, numbered 0..n-1 inside (drug, dose, time)."""
    pool = delta.filter(F.col("cell_line") == reference_line)
    return numbered_rows(pool.select(*MATCH, "sample", "expr"), MATCH, ["sample"]).withColumnRenamed("group_rows", "pool_size")


def draw_reference(obs: DataFrame, pool: DataFrame, seed: int = 42, epochs: int | None = None) -> DataFrame:
    """One seeded replicate per observation, or per (observation, epoch). The drawn number is joined to
    the pool's numbering; no pool is gathered."""
    keys = list(OBSERVATION)
    drawn = obs.select(*keys) if epochs is None else obs.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    extra = [] if epochs is None else ["epoch"]
    sizes = pool.groupBy(*MATCH).agg(F.count(F.lit(1)).alias("n"))
    picked = drawn.join(sizes, MATCH).withColumn("pos", F.pmod(md5_int(md5_key(seed, *extra, *keys)), F.col("n")))
    return picked.join(pool.select(*MATCH, "pos", "sample", "expr"), [*MATCH, "pos"]).drop("n", "pos")


def one_hot(df: DataFrame, column: str, name: str) -> DataFrame:
    """0/1 vector over the sorted levels of a label column; a single level gives an empty vector. The levels of
    a time or dose label are few by nature and become literals of the plan."""
    levels = sorted(r[0] for r in df.select(column).distinct().collect())
    if len(levels) < 2:
        return df.withColumn(name, F.array().cast("array<double>"))
    return df.withColumn(name, F.array(*[(F.col(column) == v).cast("double") for v in levels]))


DOSE_EDGES = [-3.0, -2.0, -1.0, 0.0, 1.0, 2.0]  # fixed values: log10 of the dose in uM


def dose_features(dose: Column) -> dict[str, Column]:
    um = X.dose_value(dose)
    return {"dose_um": um, "dose_log10": F.log10(um), "dose_log1p": F.log1p(um)}


def dose_one_hot(dose: Column) -> Column:
    """Seven bins, closed on the right: the first edge that is not below the value, else the overflow bin."""
    edges = F.array(*[F.lit(e) for e in DOSE_EDGES])
    slot = V.let(F.log10(X.dose_value(dose)), lambda v: F.size(F.filter(edges, lambda e: e < v)))
    return F.transform(F.sequence(F.lit(0), F.lit(len(DOSE_EDGES))), lambda i: (i == slot).cast("double"))


def concat_features(*blocks: Column) -> Column:
    """Feature blocks in fixed order; an absent (NULL) block is skipped."""
    return F.concat(*[F.coalesce(b.cast("array<double>"), F.array().cast("array<double>")) for b in blocks])


def dose_gate(embedding: Column, dose_log: Column, beta: float = 1.0, bias: float = 0.0) -> Column:
    """Scale the embedding by sigmoid(dose * beta + bias) - sigmoid(bias)."""
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    return V.let(sigmoid(dose_log * beta + bias) - sigmoid(F.lit(bias)), lambda s: F.transform(embedding, lambda x: x.cast("double") * s))


def random_embedding(smiles: Column, width: int, seed: int = 42) -> Column:
    """Gaussian vector that depends on the structure and the seed only (Box-Muller on md5 uniforms)."""
    uniform = lambda tag, i: (md5_int(F.md5(F.concat_ws("|", smiles, F.lit(str(seed)), F.lit(tag), i.cast("string")))) + 1) / 4294967297.0
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i:
                       F.sqrt(-2 * F.log(uniform("r", i))) * F.cos(2 * F.pi() * uniform("a", i)))


def fit_pca(train: DataFrame, vector: str, k: int) -> PipelineModel:
    """Centre on the training rows and fit; moments are summed per partition, only the covariance is gathered."""
    features = train.select(array_to_vector(F.col(vector)).alias("_x"))
    return Pipeline(stages=[StandardScaler(inputCol="_x", outputCol="_c", withMean=True, withStd=False),
                            PCA(k=k, inputCol="_c", outputCol="_p")]).fit(features)


def apply_pca(df: DataFrame, model: PipelineModel, vector: str, name: str) -> DataFrame:
    out = model.transform(df.withColumn("_x", array_to_vector(F.col(vector))))
    return out.withColumn(name, vector_to_array("_p")).drop("_x", "_c", "_p")
