"""Column expressions on dense vectors stored as arrays; everything is computed in double.

A lambda evaluates what it captures once per element, so values used inside one are bound with `let` first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

COSINE_EPS = 1.1920929e-7  # fixed value: single-precision machine epsilon


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_all(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def mean(v: Column) -> Column:
    return let(v, lambda a: F.try_divide(total(a), F.size(a).cast("double")))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def norm(v: Column) -> Column:
    return F.sqrt(squares(v))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def mse(a: Column, b: Column) -> Column:
    return F.try_divide(squared_distance(a, b), F.size(a).cast("double"))


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(mse(a, b))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(COSINE_EPS))


def safe_cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, NULL for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - safe_cosine(a, b)


def tanimoto_distance(a: Column, b: Column) -> Column:
    """Distance of two 0/1 vectors; two empty ones are at distance 0."""
    both = total(F.zip_with(a, b, lambda x, y: F.least(x, y)))
    either = total(F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    return F.lit(1.0) - F.when(either == 0, F.lit(1.0)).otherwise(F.try_divide(both, either))


def constant(v: Column) -> Column:
    return F.array_min(v) == F.array_max(v)


def centred(v: Column) -> Column:
    return let(mean(v), lambda m: F.transform(v, lambda x: x.cast("double") - m))


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation, NULL when either side is constant."""
    r = let_all({"a": centred(a), "b": centred(b)}, lambda c: safe_cosine(c["a"], c["b"]))
    return F.when(~constant(a) & ~constant(b), r)


def standardised(v: Column) -> Column:
    """Centred and scaled to unit length, NULL for a constant vector; Pearson is then a dot product."""
    unit = let(centred(v), lambda c: let(norm(c), lambda length: F.transform(c, lambda x: F.try_divide(x, length))))
    return F.when(~constant(v), unit)


def densify(entries: Column, width: int) -> Column:
    """Dense array from `array<struct<pos,val>>` sorted by pos; gaps are zero, linear in `width`."""
    zeros = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))

    def fill(e: Column) -> Column:
        before = lambda i: F.coalesce(F.get(e, i - 1)["pos"], F.lit(-1))
        pieces = F.transform(e, lambda x, i: F.concat(zeros(x["pos"] - before(i) - 1), F.array(x["val"].cast("double"))))
        return F.concat(F.flatten(pieces), zeros(F.lit(width - 1) - F.coalesce(F.get(e, F.size(e) - 1)["pos"], F.lit(-1))))

    return let(entries, fill)
