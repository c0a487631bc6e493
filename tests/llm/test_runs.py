import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.llm import periodic_runs, queries
from tests.llm.helpers import awkward, empty, frame, prose


def brute(w, least=6, times=4):
    """Runs by trying every period at every place."""
    n, out = len(w), []
    for p in range(1, n // times + 1):
        i = p
        while i < n:
            if w[i] != w[i - p]:
                i += 1
                continue
            a, j = i - p, i
            while j < n and w[j] == w[j - p]:
                j += 1
            if j - a >= max(least, times * p) and not any(all(w[k] == w[k - q] for k in range(a + q, j)) for q in range(1, p)):
                out.append((a, j - a, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng):
    n, k = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 4])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(3) if n > 8 else 0):
        a, p = rng.randrange(n), rng.randrange(1, max(2, n // 4))
        for i in range(max(a, p), min(n, a + rng.randrange(n))):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize("pace", [None, 1, 7])
def test_catchers_find_every_run_at_any_pace(pace):
    rng = random.Random(pace or 0)
    for _ in range(400):
        w = made(rng)
        c = periodic_runs.Catchers()
        for i in range(0, len(w), pace or max(1, len(w))):
            c.append(np.array(w[i:i + (pace or len(w))], np.int64))
        assert [tuple(r) for r in c.runs().tolist()] == brute(w), w


def test_several_texts_keep_apart():
    rng = random.Random(9)
    texts = [made(rng) for _ in range(200)] + [[1] * 40, [1] * 40, [], [1]]
    owner, found = periodic_runs.runs_of(np.array([x for t in texts for x in t]), np.cumsum([0, *map(len, texts)]))
    got = {}
    for o, r in zip(owner.tolist(), found.tolist()):
        got.setdefault(o, []).append(tuple(r))
    assert got == {i: brute(t) for i, t in enumerate(texts) if brute(t)}


def test_small_slices(monkeypatch):
    monkeypatch.setattr(periodic_runs, "APPENDED", 13)
    test_several_texts_keep_apart()


def digests(doc_id, text, planted=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for a, m, p in runs for i in range(a + p, a + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{m},{p}\n" for a, m, p in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len((r["text"] or "").split()) < 700]
    assert len(short) > 100 and any(zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in short)
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, path).collect()}
    assert len(got) == len(rows)
    for r in short:
        assert got[r["doc_id"]] == digests(r["doc_id"], r["text"])


def test_awkward_rows(spark):
    rows = [(i, t) for i, t in awkward() if len((t or "").split()) < 1000] + [(20, "a " * 50 + "b"), (21, "x y " * 30), (22, " \x0b\x0c\r\n a\u00a0b a\u00a0b \x1c \x85" + " a" * 7)]
    got = periodic_runs.collapsed(frame(spark, rows)).select("doc_id", "n_words", "runs", "collapsed").collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[3])
    expect = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute(words)
        gone = {k for a, m, p in runs for k in range(a + p, a + m)}
        expect.append((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert sorted(((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in got), key=key) == sorted(expect, key=key)
    assert periodic_runs.collapsed(empty(spark)).collect() == []


def test_long_text(spark):
    long = prose(200000, 5) + " " + " ".join(["tick", "tack", "tock"] * 20000)
    row = periodic_runs.collapsed(spark.createDataFrame([(1, long)], "doc_id bigint, text string")).withColumn("best", periodic_runs.longest(F.col("runs"))).first()
    assert (row["best"]["start"], row["best"]["length"], row["best"]["period"]) == (200000, 60000, 3) and row["collapsed"].endswith(" tick tack tock")


def test_name_clash(spark):
    with pytest.raises(ValueError):
        periodic_runs.collapsed(spark.createDataFrame([(1, "a")], "runs bigint, text string"), keep=("runs",))
