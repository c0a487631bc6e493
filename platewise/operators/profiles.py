"""Pseudobulk, normalisation, group means and control-subtracted profiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions import vectors as V

KEY = ["cell_line", "sample"]
META = ["plate", "rep", "drug", "smiles", "dose", "time"]
CONTROL_KEY = ["cell_line", "plate", "time"]
TREATMENT = ["drug", "smiles", "dose", "time"]
CONDITION = ["cell_line", "drug", "dose", "time"]


def gene_dimension(genes: DataFrame, name: str = "gene") -> DataFrame:
    """Distinct genes numbered from 0 by name. The window sees one row per gene of the panel
    (tens of thousands at most), never measurements."""
    return genes.select(name).distinct().select(name, (F.row_number().over(Window.orderBy(name)) - 1).alias("gene_idx"))


def sparse_sums(cells: DataFrame, measured: DataFrame, genes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Sum of counts per (key, gene). Counts of genes outside the panel are dropped before the shuffle;
    partial aggregation runs on the map side and a hot key is spread over its genes."""
    kept = measured.join(genes, "gene").select("barcode", "gene_idx", "cnt")
    return kept.join(cells.select("barcode", *key), "barcode").groupBy(*key, "gene_idx").agg(F.sum("cnt").alias("val"))


def sparse_pseudobulk(cells: DataFrame, measured: DataFrame, genes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Pseudobulks with sorted `entries` (pos, val); cells are counted before and counts after the gene filter.
    Only sums per (key, gene), one list of panel length per profile, meet in one row; labels are counted per
    combination first, so that cells shrink in a hash aggregate."""
    vectors = sparse_sums(cells, measured, genes, key).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(F.col("gene_idx").alias("pos"), "val"))).alias("entries"),
        F.sum("val").alias("total_umis"))
    labels = [c for c in META if c in cells.columns]
    kinds = cells.groupBy(*key, *labels).agg(F.count(F.lit(1)).alias("c"))
    meta = kinds.groupBy(*key).agg(*[F.min(c).alias(c) for c in labels], F.sum("c").alias("total_cells"))
    return meta.join(vectors, list(key), "left").select(
        *key, *labels, "total_cells", F.coalesce("total_umis", F.lit(0.0)).alias("total_umis"),
        F.coalesce("entries", F.array().cast("array<struct<pos:int,val:double>>")).alias("entries"))


def log_normalize(df: DataFrame, alpha: float = 10000.0, digits: int = 2) -> DataFrame:
    """ln(1 + alpha * v / sum) on the stored entries; absent genes stay zero, as does an empty profile."""
    s = F.col("total_umis")
    scaled = F.transform("entries", lambda e: F.struct(
        e["pos"].alias("pos"), F.when(s > 0, F.log1p(F.try_divide(e["val"] * alpha, s))).otherwise(0.0).alias("val")))
    return df.withColumn("entries", scaled).withColumn("total_umis", F.bround("total_umis", digits))


def dense(df: DataFrame, width: int) -> DataFrame:
    """Replace `entries` by the dense vector `expr`."""
    return df.withColumn("expr", V.densify(F.col("entries"), width)).drop("entries")


def mean_of_sparse(df: DataFrame, by: Sequence[str], width: int, name: str = "expr") -> DataFrame:
    """Element-wise mean of sparse profiles per group, unweighted over rows. Only stored entries are shuffled."""
    sums = df.select(*by, F.explode("entries").alias("e")).groupBy(*by, F.col("e.pos").alias("pos")).agg(F.sum("e.val").alias("s"))
    lists = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("sums"))
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    entries = F.transform("sums", lambda e: F.struct(e["pos"].alias("pos"), (e["s"] / F.col("n")).alias("val")))
    out = rows.join(lists, list(by), "left").select(*by, entries.alias("entries"))
    empty = F.array().cast("array<struct<pos:int,val:double>>")
    return out.select(*by, V.densify(F.coalesce("entries", empty), width).alias(name))


def to_long(wide: DataFrame, genes: DataFrame | None = None, vector: str = "expr", value: str = "value") -> DataFrame:
    """One row per (profile, gene)."""
    keep = [c for c in wide.columns if c != vector]
    out = wide.select(*keep, F.posexplode_outer(vector).alias("gene_idx", value))
    return out if genes is None else out.join(genes, "gene_idx")


def to_wide(df: DataFrame, key: Sequence[str], position: str = "gene_idx", value: str = "value", name: str = "expr") -> DataFrame:
    """Arrays ordered by position; the list length is the panel size."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).alias("v"))))
    return df.groupBy(*key).agg(F.transform(packed, lambda e: e["v"]).alias(name))


#: Positions of a vector that are summed and sent together, and sums that a task holds before it sends them.
VECTOR_BLOCK, HELD_SUMS = 4096, 1 << 22


def average_vectors(df: DataFrame, by: Sequence[str], vector: str = "expr", name: str | None = None) -> DataFrame:
    """Element-wise mean per group over the values that are not null, without a row per element: each task adds up the vectors of its groups and sends a sum and a count per block of
    positions, and these are added in the order of group and block. Null vectors are skipped; a group without any has none."""
    by = list(by)
    kinds = dict(df.dtypes)
    source = df.select(*by, F.col(vector).cast("array<double>").alias("_v"))

    def sums(batches):
        held: dict[tuple, list[np.ndarray]] = {}
        types = None

        def out() -> pa.RecordBatch:
            rows = [(key, at, s[at:at + VECTOR_BLOCK], c[at:at + VECTOR_BLOCK]) for key, (s, c) in held.items() for at in range(0, max(1, len(s)), VECTOR_BLOCK)]
            held.clear()
            keys = [pa.array([r[0][i] for r in rows], types[i]) for i in range(len(by))]
            return pa.RecordBatch.from_arrays([*keys, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.float64())),
                                               pa.array([r[3] for r in rows], pa.list_(pa.int64()))], [*by, "_at", "_s", "_c"])

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(by))]
            lists = batch.column(len(by))
            flat = lists.flatten()
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            ends = np.cumsum(size)
            there = ~flat.is_null().to_numpy(zero_copy_only=False)
            values = flat.fill_null(0.0).to_numpy()
            rows_of: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[batch.column(i).to_pylist() for i in range(len(by))])):
                rows_of.setdefault(key, []).append(i)
            for key, rows in rows_of.items():
                n = int(size[rows].max())
                own = held.setdefault(key, [np.zeros(0), np.zeros(0, np.int64)])
                if n > len(own[0]):
                    own[0], own[1] = (np.concatenate([x, np.zeros(n - len(x), x.dtype)]) for x in own)
                for i in rows:
                    a, b = ends[i] - size[i], ends[i]
                    own[0][:b - a] += values[a:b]
                    own[1][:b - a] += there[a:b]
            if sum(len(v[0]) + 1 for v in held.values()) > HELD_SUMS:
                yield out()
        if held:
            yield out()

    def means(batches):
        key, blocks, made = None, {}, []
        types = None

        def close() -> None:
            if key is not None:
                s, c = (np.concatenate([blocks[at][k] for at in sorted(blocks)]) for k in (0, 1))
                with np.errstate(invalid="ignore", divide="ignore"):
                    made.append((key, pa.array(s / c, mask=c == 0) if len(s) else None))

        def out() -> pa.RecordBatch:
            keys = [pa.array([r[0][i] for r in made], types[i]) for i in range(len(by))]
            batch = pa.RecordBatch.from_arrays([*keys, pa.array([None if r[1] is None else r[1].to_pylist() for r in made], pa.list_(pa.float64()))], [*by, "_m"])
            made.clear()
            return batch

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(by))]
            at, s, c = (batch.column(len(by) + k) for k in range(3))
            for i, own in enumerate(zip(*[batch.column(i).to_pylist() for i in range(len(by))])):
                if own != key:
                    close()
                    key, blocks = own, {}
                place, more = at[i].as_py(), (s[i].values.to_numpy(), c[i].values.to_numpy())
                if place in blocks:
                    had, n = blocks[place], max(len(more[0]), len(blocks[place][0]))
                    more = tuple(np.pad(x, (0, n - len(x))) + np.pad(y, (0, n - len(y))) for x, y in zip(had, more))
                blocks[place] = more
            if len(made) > 256:
                yield out()
        close()
        if made:
            yield out()

    keys = "".join(f"`{c}` {kinds[c]}, " for c in by)
    parts = source.mapInArrow(sums, keys + "_at bigint, _s array<double>, _c array<bigint>").repartition(*[F.col(c) for c in by]).sortWithinPartitions(*by, "_at")
    return parts.mapInArrow(means, keys + "_m array<double>").select(*by, F.col("_m").alias(name or vector))


def delta_profiles(control: DataFrame, treated: DataFrame, key: Sequence[str] = CONTROL_KEY, vector: str = "expr") -> DataFrame:
    """Treated minus the mean of the matched controls, for dense profiles; treated rows without a control are dropped."""
    means = average_vectors(control, key, vector, "_control")
    return treated.join(means, list(key)).withColumn(vector, V.minus(F.col(vector), F.col("_control"))).drop("_control")


def delta_of_sparse(profiles: DataFrame, control: str, width: int, key: Sequence[str] = CONTROL_KEY) -> DataFrame:
    """Delta of sparse profiles. The mean is taken on stored entries, treated rows travel to the join as entries and
    become dense only after it."""
    means = mean_of_sparse(profiles.filter(F.col("drug") == control), key, width, "_control")
    joined = profiles.filter(F.col("drug") != control).join(means, list(key))
    return joined.withColumn("expr", V.minus(V.densify(F.col("entries"), width), F.col("_control"))).drop("entries", "_control")


def unmatched_controls(control: DataFrame, treated: DataFrame, key: Sequence[str] = CONTROL_KEY) -> DataFrame:
    return treated.select(*key).distinct().join(control.select(*key).distinct(), list(key), "left_anti")


def panel_positions(panel: DataFrame, wanted: DataFrame, name: str = "gene") -> list[int]:
    """Positions of the wanted genes in the panel; one number per gene of the panel reaches the driver."""
    return sorted(r[0] for r in panel.join(wanted.select(name).distinct(), name, "left_semi").select("gene_idx").collect())


def keep_positions(df: DataFrame, positions: Sequence[int], vector: str = "expr") -> DataFrame:
    """Subset every vector to the given positions, in order."""
    keep = F.array(*[F.lit(i) for i in positions])
    return df.withColumn(vector, F.transform(keep, lambda i: F.get(F.col(vector), i)))
