"""Text parsing and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number inside a unit text, first (name, amount, unit) tuple, run folder time stamp.
NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
DOSE_TUPLE = r"\('([^']+)',\s*([\d\.eE+-]+),\s*'([^']+)'\)"
RUN_STAMP = r"_(\d{4}-\d{2}-\d{2}_\d{6})$"


def parse_number(c: Column) -> Column:
    """First number in the text, NULL when there is none."""
    return F.regexp_extract(c, f"({NUMBER})", 1).try_cast("double")


def dose_from_tuples(c: Column) -> Column:
    """'<amount> <unit>' of the first tuple, NULL without one."""
    hit = F.concat_ws(" ", F.regexp_extract(c, DOSE_TUPLE, 2), F.regexp_extract(c, DOSE_TUPLE, 3))
    return F.when(c.rlike(DOSE_TUPLE), hit)


def dose_value(c: Column, unit: str = " uM") -> Column:
    """Number before the unit suffix, NULL if the suffix is missing."""
    return F.when(c.endswith(unit), F.regexp_replace(c, unit + "$", "").try_cast("double"))


def p_text(p: Column) -> Column:
    """n/a, <1e-300, exponent form below 0.001, else three decimals."""
    return F.when(p.isNull() | F.isnan(p), "n/a").when(p < 1e-300, "<1e-300") \
        .when(p < 1e-3, F.format_string("%.0e", p)).otherwise(F.format_string("%.3f", p))


def stars(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def normalise_symbol(c: Column) -> Column:
    """Trimmed upper-case symbol; blank counts as missing."""
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def layer_sizes(c: Column) -> Column:
    """'[512, 256]' to an array of integers; empty text gives an empty array."""
    return F.from_json(c, "array<bigint>")


def parameter_count(n_in: Column, layers: Column, n_out: Column) -> Column:
    """Weights and biases of a dense network: sum over consecutive sizes of a*b + b."""
    sizes = F.concat(F.array(n_in.cast("bigint")), layers, F.array(n_out.cast("bigint")))
    nxt = F.slice(sizes, 2, F.size(sizes) - 1)
    cur = F.slice(sizes, 1, F.size(sizes) - 1)
    return F.aggregate(F.zip_with(cur, nxt, lambda a, b: a * b + b), F.lit(0).cast("bigint"), lambda s, x: s + x)


def unique_join(c: Column) -> Column:
    """Aggregate: sorted distinct non-blank values joined by ';' (labels of an annotation dimension)."""
    t = F.trim(c)
    return F.array_join(F.array_sort(F.collect_set(F.when(t != "", t))), ";")


def representation_label(c: Column) -> Column:
    """Drop a trailing ' + dose (...)' note."""
    return F.trim(F.regexp_replace(c, r"\s*\+\s*dose\s*\(.*\)\s*$", ""))


def statistic_method(text: Column, p: Column) -> Column:
    """Test name from a free-text analysis label; without a p-value there is no test. The names are fixed values."""
    low = F.lower(text)
    has = lambda *words: F.lit(False) if not words else low.contains(words[0]) | has(*words[1:])
    name = (F.when(has("friedman"), "Friedman test").when(has("wilcoxon", "paired"), "paired Wilcoxon signed-rank test")
            .when(has("spearman"), "Spearman rank correlation").when(has("slope", "curve", "ols"), "regression").otherwise("NA"))
    return F.when(p.isNotNull() & ~F.isnan(p.cast("double")), name)
