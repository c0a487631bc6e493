"""Merkle manifest of a dataset: a hash tree for each group of rows, a tree over the groups' roots, and a proof for every row.

Rows get a slot within their group by a range sort, so no group has to fit one task. Each level is then a window over runs of `fan` neighbouring slots: lag and
lead columns at the fixed offsets 1 to fan - 1, masked by a row's place in its run and the run's length, are its siblings; the first child's row hashes them
into the parent, and parents are the next level's rows. Proofs come down the same levels, each by one join of children with their parent.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import col, fresh, staged

FAN = 16
#: Fields of a document that its leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column | str) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes of the parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A value with its length before it, so that neighbouring fields cannot run into each other: `-` for null, else UTF-8 byte count, `:`, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ascii_lower(value: Column) -> Column:
    return F.translate(value, string.ascii_uppercase, string.ascii_lowercase)


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", copies: dict[str, Column] | None = None,
           copied: Column | None = None) -> DataFrame:
    """(key, g, leaf, copy) per row: the value of `order`, the group with null told apart, the hash of the framed fields, and, where `copied` holds, the hash with the
    values of `copies` in place of the fields (of a copy that is to be checked), else null."""
    original = [col(f) for f in fields]
    leaf = digest(*map(framed, original))
    other = digest(*(framed((copies or {}).get(f, c)) for f, c in zip(fields, original)))
    copy = F.when(copied, other) if copied is not None else F.lit(None).cast("string")
    name = col(group).cast("string")
    return docs.select(col(order).alias("key"), F.coalesce(F.concat(F.lit("="), name), F.lit("-")).alias("g"), leaf.alias("leaf"), copy.alias("copy"))


def slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `slot`, the place of a row within its group `g` by `order` from 0, and `total`, the group's rows. Rows are sorted over ranges of (g, order, a number that
    tells repeated rows apart); only the counts of (partition, group), at most partitions plus groups, meet in windows."""
    tie, at, part = (fresh(rows, n) for n in ("_tie", "_at", "_part"))
    keys = ["g", *order, tie]
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = staged(ranged.drop(tie).withColumn(at, F.monotonically_increasing_id()), "sorted").withColumn(part, F.shiftright(at, 33))
    spans = held.groupBy(part, "g").agg(F.min(at).alias("_low"), F.count("*").alias("_n"))
    whole = Window.partitionBy("g")
    before = F.coalesce(F.sum("_n").over(whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(part, "g", (before - F.col("_low")).alias("_base"), F.sum("_n").over(whole).alias("total"))
    return held.join(spans, [part, "g"]).withColumn("slot", F.col(at) + F.col("_base")).drop(part, at, "_base")


def related(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """Nodes (g, slot, total, hash, ...) with their parent's slot `run`, and `left` and `right`, the hashes of the siblings before and after them."""
    place, run = F.col("slot") % fan, F.floor(F.col("slot") / fan).cast("bigint")
    size = F.least(F.lit(fan), F.col("total") - F.col("slot") + place)
    beside = Window.partitionBy("g", "run").orderBy("slot")
    before = [F.when(place >= k, F.lag("hash", k).over(beside)) for k in range(fan - 1, 0, -1)]
    after = [F.when(place + k < size, F.lead("hash", k).over(beside)) for k in range(1, fan)]
    joined = lambda parts: F.concat(*(F.coalesce(p, F.lit("")) for p in parts))
    return nodes.withColumn("run", run).withColumns({"left": joined(before), "right": joined(after)})


def parents(kin: DataFrame, fan: int = FAN) -> DataFrame:
    """The next level: the hash of each run, made by the row of its first child. A group of one node keeps it."""
    up = F.when(F.col("total") == 1, F.col("hash")).otherwise(digest("hash", "right"))
    return kin.filter(F.col("slot") % fan == 0).select("g", F.col("run").alias("slot"), F.ceil(F.col("total") / fan).cast("bigint").alias("total"), up.alias("hash"))


@dataclass
class Tree:
    """Levels of all groups from the leaves' parents up; in the last every group has one node."""

    levels: list[DataFrame]
    tops: DataFrame
    fan: int

    def paths(self, ends: DataFrame) -> DataFrame:
        """(g, slot, path, subroot, root) of the lowest level here: `path` lists, from there up, what stands left and right of the node and its ancestors. `ends` has the same
        columns for the groups' tops, without slot."""
        known = ends.withColumn("slot", F.lit(0).cast("bigint"))
        for nodes in reversed(self.levels[:-1]):
            known = down(related(nodes, self.fan), known).select("g", "slot", "path", "subroot", "root")
        return known


def down(kin: DataFrame, known: DataFrame) -> DataFrame:
    """Children with the paths of their parents and their own siblings put before."""
    above = known.select("g", F.col("slot").alias("run"), F.col("path").alias("_above"), "subroot", "root")
    own = F.when(F.col("total") == 1, F.array().cast("array<struct<left:string,right:string>>")).otherwise(F.array(F.struct("left", "right")))
    return kin.join(above, ["g", "run"]).withColumn("path", F.concat(own, "_above")).drop("_above")


def grown(nodes: DataFrame, fan: int = FAN) -> Tree:
    """All levels above `nodes` (g, slot, total, hash), each written before the next is made from it."""
    most = nodes.agg(F.max("total")).first()[0] or 1
    levels = [staged(parents(related(nodes, fan), fan), "level")]
    most = -(-most // fan)
    while most > 1:
        levels.append(staged(parents(related(levels[-1], fan), fan), "level"))
        most = -(-most // fan)
    return Tree(levels, levels[-1].select("g", F.col("hash").alias("subroot")), fan)


def manifest(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """Per row of `leaves`: `key`, `leaf`, `subroot` of its group, `root` over all groups (in bytewise order of their names, null first), `path` (siblings left and right of the
    row and of each ancestor, from the leaf to the root) and `copy`.

    Rows of equal key stand in the order of their hashes, repeated rows beside each other, each with a leaf of its own; null keys come first. A group of one row has its leaf as
    subroot, a single group its subroot as root. An empty table gives an empty result. Columns that are no fields are left out."""
    rows = staged(rows, "leaves")
    placed = staged(slots(rows, ["key", "leaf"]).withColumnRenamed("leaf", "hash"), "slots")
    tree = grown(placed.select("g", "slot", "total", "hash"), fan)
    tops = slots(tree.tops.select(F.lit("").alias("g"), F.col("g").alias("member"), "subroot"), ["member"]).withColumnRenamed("subroot", "hash")
    tops = staged(tops, "tops")
    above = grown(tops.select("g", "slot", "total", "hash"), fan)
    none = F.array().cast("array<struct<left:string,right:string>>")
    ends = above.tops.select("g", none.alias("path"), F.lit("").alias("subroot"), F.col("subroot").alias("root"))
    known = down(related(tops, fan), above.paths(ends)).select(F.col("member").alias("g"), "path", F.col("hash").alias("subroot"), "root")
    paths = staged(tree.paths(known), "paths")
    found = down(related(placed, fan), paths)
    return found.select("key", F.col("hash").alias("leaf"), "copy", "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, leaf, lambda below, step: digest(step["left"], below, step["right"]))


def proof(path: Column) -> Column:
    """All siblings in order, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")
