"""Filters, completeness checks, annotation and quality control of measurement tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL_TYPE, CONTROL_ID, TREATED_TYPE = "ctl_vehicle", "DMSO", "trt_cp"
STRUCTURE_MISSING = ["", "restricted"]


class DataError(ValueError):
    """A table breaks a contract of the pipeline."""


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise DataError(f"missing columns: {missing}")
    return df


def is_control(pert_type: Column, pert_id: Column) -> Column:
    return (pert_type == CONTROL_TYPE) & (pert_id == CONTROL_ID)


def control_or_treated(df: DataFrame) -> DataFrame:
    """Vehicle control wells and compound wells that passed quality control (a text flag)."""
    kind = is_control(F.col("pert_type"), F.col("pert_id")) | (F.col("pert_type") == TREATED_TYPE)
    return df.filter(kind & (F.col("qc_pass") == "1"))


def with_control_on_plate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose (plate, time, cell line) holds at least one control well."""
    ctl = df.filter(is_control(F.col("pert_type"), F.col("pert_id"))).select(*keys).distinct()
    return df.join(ctl, list(keys), "left_semi")


def first_per_group(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Value of the first row by `order`, a plain aggregate."""
    return df.groupBy(*by).agg(F.min_by(value, F.struct(*[F.col(o) for o in order])).alias(value))


def valid_structure(smiles: Column, control: Column) -> Column:
    s = F.coalesce(smiles, F.lit(""))
    return control | ~s.isin(STRUCTURE_MISSING)


def complete_rows(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """No NULL and no empty text in the named columns."""
    out = require_columns(df, names).dropna(subset=list(names))
    for n in names:
        out = out.filter(F.col(n) != "")
    return out


def trim_all(df: DataFrame) -> DataFrame:
    return df.select([F.trim(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name)
                      for f in df.schema.fields])


def restrict(df: DataFrame, allowed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Semi-join to an allow-list; NULL ids never match."""
    return df.join(allowed.select(*on).dropna().distinct(), list(on), "left_semi")


def missing_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.select(*on).distinct().join(right.select(*on).distinct(), list(on), "left_anti")


def keyset_difference(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys with different multiplicity in two tables: counts on both sides, then compared."""
    both = a.select(*on, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(*on, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy(*on).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right")).filter("n_left <> n_right")


def strict_lookup(df: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join that must hit: fails if a key of `df` is absent from `dim`."""
    if not missing_keys(df, dim, on).isEmpty():
        raise DataError(f"keys without an entry on {list(on)}")
    return df.join(dim, list(on))


def duplicate_rows(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    names = [c for c in df.columns if c not in ignore]
    return df.groupBy(*names).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def missing_structures(df: DataFrame, control: str, drug: str = "drug", smiles: str = "smiles") -> DataFrame:
    """Treatments (not the control) with rows that lack a structure, and how many."""
    s = F.coalesce(F.col(smiles), F.lit(""))
    return df.filter((F.col(drug) != control) & s.isin(STRUCTURE_MISSING)).groupBy(drug).agg(F.count(F.lit(1)).alias("n_rows"))


def patch_values(df: DataFrame, patch: DataFrame, on: str, column: str) -> DataFrame:
    """Values of a per-key patch table replace the column where the key is present."""
    p = patch.select(on, F.col(column).alias("_patch"))
    return df.join(p, on, "left").withColumn(column, F.coalesce("_patch", column)).drop("_patch")


def qc_flag(df: DataFrame, min_cells: int = 50, min_umis: float = 35000) -> DataFrame:
    return df.withColumn("qc_pass", (F.col("total_cells") >= min_cells) & (F.col("total_umis") >= min_umis))


def drop_failing_lines(df: DataFrame, max_failure: float = 0.9) -> DataFrame:
    """Remove cell lines whose share of failed profiles is above the limit."""
    bad = df.groupBy("cell_line").agg(F.avg((~F.col("qc_pass")).cast("double")).alias("fail")).filter(F.col("fail") > max_failure)
    return df.join(bad, "cell_line", "left_anti")


def distinct_compounds(df: DataFrame, control: str = CONTROL_ID) -> DataFrame:
    return df.filter(F.col("drug") != control).select(F.trim("drug").alias("drug"), F.trim("smiles").alias("smiles")).distinct()


def choose_dose_time(df: DataFrame, doses: Sequence[str] | None, times: Sequence[str] | None, control: str = CONTROL_ID) -> DataFrame:
    """Inclusion lists; control rows are exempt from the dose list."""
    if times is not None:
        df = df.filter(F.col("time").isin(list(times)))
    if doses is not None:
        df = df.filter((F.col("drug") == control) | F.col("dose").isin(list(doses)))
    return df


def set_signature(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Order-free fingerprint of a row set: count, xor and sum (as text) of 32-bit digests; nothing is collected."""
    from platewise.functions.hashing import md5_int
    h = md5_int(F.md5(F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("NA")) for n in names])))
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor("h").alias("xor_hash"), F.sum(F.col("h").cast("decimal(20,0)")).cast("string").alias("sum_hash"))


def validated_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """Join after a uniqueness check of the side(s) that must be unique."""
    sides = {"one_to_one": [left, right], "many_to_one": [right], "one_to_many": [left]}[validate]
    for side in sides:
        if not side.groupBy(*on).count().filter("count > 1").isEmpty():
            raise DataError(f"duplicate keys on {list(on)} break a {validate} join")
    return left.join(right, list(on), how)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with different multiplicity in two tables of equal columns; empty means identical."""
    return keyset_difference(a, b.select(*a.columns), a.columns)
