import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from platewise.llm import merkle, queries
from tests.llm.helpers import prose


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(hashes, fan):
    """(root, for each hash the siblings left and right on every level)."""
    steps, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, a in enumerate(at):
            lo = a // fan * fan
            steps[i].append(("".join(hashes[lo:a]), "".join(hashes[a + 1:lo + fan])))
        hashes = [H(*hashes[k:k + fan]) for k in range(0, len(hashes), fan)]
        at = [a // fan for a in at]
    return hashes[0], steps


def brute(rows, fan):
    """Rows (doc_id, source, lang, n_chars, text) -> sorted (doc_id, leaf, subroot, root, proof, folded, verified)."""
    def leaf(r, text):
        return H(*map(framed, (*r[:4], text)))

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    first = lambda i: (i is not None, i or 0)
    built = []
    for s in order:
        own = sorted(groups[s], key=lambda r: (first(r[0]), leaf(r, r[4])))
        built.append((own, *climb([leaf(r, r[4]) for r in own], fan)))
    root, above = climb([b[1] for b in built], fan)
    out = []
    for (own, sub, steps), up in zip(built, above):
        for r, path in zip(own, steps):
            path = path + up
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(r, text)
            for left, right in path:
                folded = H(left, folded, right)
            out.append((r[0], leaf(r, r[4]), sub, root, H("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def rows_of(n, seed):
    rng = random.Random(seed)
    sources = ["hot"] * 6 + ["é", "Z", "a", "", None, "src1", "src10"]
    return [(i * 7 - 50, rng.choice(sources), rng.choice(["en", None, "dé"]), rng.choice([None, i]), rng.choice([None, "", "Ab CÉ", prose(9, i), "plain"])) for i in range(n)]


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize("fan, rows", [
    (16, rows_of(700, 1)), (2, rows_of(90, 2)), (3, rows_of(1, 3)), (16, [(5, "one", "en", 3, "Abc")] * 40 + [(6, "two", None, None, None)]),
    (16, rows_of(40, 4) + [(None, "hot", "en", 1, "X"), (None, None, None, None, None), (2**63 - 1, "hot", "en", 1, "Y"), (-2**63, "hot", "en", 1, "Y"), (6, "hot", "en", 1, "same id")]),
    (16, [(i, "s%02d" % (i % 40), "en", i, "T") for i in range(300)])])
def test_against_brute_force(spark, fan, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in ("g", "key", "hash", "leaf", "slot", "total", "left", "path", "copy", "_tie"):
        df = df.withColumn(c, F.lit("clash"))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = merkle.manifest(merkle.leaves(df, copies={"text": merkle.ascii_lower(F.col("text"))}, copied=tampered), fan)
    got = found.withColumn("f", merkle.folded(F.coalesce("copy", "leaf"), F.col("path"))).select("key", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256), "f", F.expr("f = root"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, fan)


def test_empty(spark):
    assert merkle.manifest(merkle.leaves(spark.createDataFrame([], SCHEMA))).collect() == []


def test_slots_spread_a_hot_group(spark):
    rows = merkle.leaves(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text")))
    placed = merkle.slots(rows, ["key", "leaf"]).collect()
    assert sorted((r["key"], r["slot"]) for r in placed) == [(i, i) for i in range(4000)]
    plan = merkle.related(merkle.slots(rows, ["key", "leaf"]).withColumnRenamed("leaf", "hash"))._jdf.queryExecution().toString()
    assert "windowspecdefinition(g" in plan and "run" in plan


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op13_merkle_manifest"](spark, path).collect()), key=str) == brute(rows, 16)
