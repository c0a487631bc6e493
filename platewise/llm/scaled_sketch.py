"""Threshold-scaled sketches of documents, in built-in functions only.

A sketch is the sorted set of a text's shingle hashes below a fixed fraction of the hash range (and always the smallest hash, so that no text with words
has an empty sketch). Which hashes are kept depends on the hash alone, so sketches of any two texts can be compared or merged, however
unequal their lengths: the part of the shorter one's hashes that the other holds estimates how much of it the other contains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import col, staged
from platewise.llm.merkle import slots

SHINGLE = 5
#: Part of the hash range that is kept.
FRACTION = 1 / 8
#: Documents that are put next to each other by one window, and spans of ids with blocks of their own width.
NEIGHBOURS, SPANS = 2048, 64


def sketch(text: Column, shingle: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """Sorted distinct hashes (array<bigint>) of the word shingles of `text`; fewer words than `shingle` are one shingle. Null and word-free texts: empty."""
    limit = -(1 << 63) + int((1 << 64) * fraction)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        at = F.sequence(F.lit(0), n - shingle)
        return F.when(n >= shingle, F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)]))).when(
            n > 0, F.array(F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: F.xxhash64(a, x)))).otherwise(F.array().cast("array<bigint>"))

    # transform over a one-element array computes its element once for all uses in the lambda
    every = F.transform(F.array(hashes), shingles)[0]
    kept = F.transform(F.array(every), lambda s: F.when(F.size(s) > 0, F.array_append(F.filter(s, lambda h: h < limit), F.array_min(s))).otherwise(s))[0]
    return F.array_sort(F.array_distinct(kept))


def merged(a: Column, b: Column) -> Column:
    """Sketch of two texts taken together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated part of the shorter text's shingles that the other one has, 0 to 1: shared hashes over the smaller sketch. Two empty sketches: 1."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0))


def printed(s: Column) -> Column:
    """A sketch as text: 16 hex digits per hash."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def block_of(low: int, bounds: list[int], high: int, rows: int) -> Column:
    """Number of the block of `doc_id`, never falling as the id grows; -1 for null. `bounds` cut the ids into spans of about as many rows each, and each span is cut evenly into blocks of
    about NEIGHBOURS rows, so that ids far from the others widen the blocks of their own span only."""
    whole = "DECIMAL(38,0)"
    starts = sorted({low, *bounds})
    ends = [*(x - 1 for x in starts[1:]), high]
    widths = [max(1, -(-(e - s + 1) * NEIGHBOURS * len(starts) // max(1, rows))) for s, e in zip(starts, ends)]
    exact = lambda v: F.lit(str(v)).cast(whole)
    span = F.size(F.filter(F.array(*[F.lit(x) for x in starts[1:]]).cast("array<bigint>"), lambda x: x <= F.col("doc_id"))) if len(starts) > 1 else F.lit(0)
    pick = lambda values: F.get(F.array(*map(exact, values)), span)
    inside = F.call_function("div", F.col("doc_id").cast(whole) - pick(starts), pick(widths))
    return F.when(F.col("doc_id").isNull(), F.lit(-1).cast("bigint")).otherwise(span.cast("bigint") * (1 << 40) + inside)


def with_next(docs: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """`docs` (doc_id, _text) with the `derived` columns, and `_next`: text and derived columns of the row that follows in descending order of doc_id (null ids
    last, ties by text in descending order); the last row is followed by the first.

    Ids are cut into blocks (`block_of`); a window within a block finds all followers but the last row's, which is the top row of the next block that has any. Rows move once, by
    block; of the others only the blocks' top rows are read again. The rows of one id, or without one, share a block."""
    low, high, rows, bounds = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*"), F.percentile_approx("doc_id", [i / SPANS for i in range(1, SPANS)], 10 * SPANS)).first()
    block = block_of(low or 0, bounds or [], high or 0, rows)
    tops = docs.groupBy(block.alias("k")).agg(F.max("doc_id").alias("top"))
    placed = staged(slots(tops.select(F.lit("").alias("g"), "k", "top"), ["k"]), "blocks")
    lowest = placed.agg(F.min("k")).first()[0]
    # The last row of the block above is followed by this block's top row; above the top of all stands the lowest block.
    above = placed.select(F.col("k").alias("_edge"), (F.col("slot") - 1).alias("slot"))
    edges = placed.select("top", "slot").join(above, "slot", "left").select("top", F.coalesce("_edge", F.lit(lowest).cast("bigint")).alias("_edge"))
    heads = docs.join(edges, F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("_edge").agg(F.max("_text").alias("_text")).withColumns(derived)
    row = F.struct("_text", *derived)
    down = Window.partitionBy("_block").orderBy(F.col("doc_id").desc_nulls_last(), F.col("_text").desc())
    led = docs.withColumn("_block", block).repartition(F.col("_block")).withColumns(derived).withColumn("_next", F.lead(row).over(down))
    led = led.join(heads.select("_edge", row.alias("_head")), F.col("_block") == F.col("_edge"), "left")
    return led.select("doc_id", "_text", *derived, F.coalesce("_next", "_head").alias("_next"))


def half_edited(text: Column, n: Column, following: Column) -> Column:
    """`text` with its last floor(n / 2) code points replaced by as many (or all) first ones of `following`."""
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - half).cast("int")), F.substring(following, F.lit(1), half))


def compare_edited(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Per row: `id_col`, `n_chars` (code points), `edited` (see `half_edited`), `sketch`, `edited_sketch`, `near_edited` and `near_next` (likeness to the edited text
    and to the next document in descending id order).

    Null counts as empty. Repeated rows follow each other; null ids come last. A single row is its own next. Other columns are left out."""
    own = docs.select(col(id_col).cast("bigint").alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("_text"))
    both = with_next(own, {"_sketch": sketch(F.col("_text"), shingle, fraction)}).withColumn("n_chars", F.length("_text").cast("bigint"))
    edited = both.withColumn("edited", half_edited(F.col("_text"), F.col("n_chars"), F.col("_next._text")))
    edited = edited.withColumn("edited_sketch", sketch(F.col("edited"), shingle, fraction))
    return edited.select(F.col("doc_id").alias(id_col), "n_chars", "edited", F.col("_sketch").alias("sketch"), "edited_sketch",
                         likeness(F.col("_sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("_sketch"), F.col("_next._sketch")).alias("near_next"))
