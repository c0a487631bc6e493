import hashlib
import re

import duckdb
import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry_points
from platewise.llm import chunk_recipes, simhash_golay
from tests.llm.helpers import awkward, empty, frame

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """{fp: smallest reachable id} from {fp: smallest id} by comparing all."""
    names = list(fps)
    parent = {f: f for f in names}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[top(a)] = top(b)
    best = {}
    for f in names:
        if fps[f] is not None:
            best[top(f)] = min(best.get(top(f), fps[f]), fps[f])
    return {f: best.get(top(f)) for f in names}


def expected(rows):
    marked = [(i, brute_fingerprint(t)) for i, t in rows]
    first = {}
    for i, f in marked:
        first[f] = min((x for x in (first.get(f), i) if x is not None), default=None)
    comp = brute_components(first)
    return sorted(((i, f"{f:016x}", comp[f]) for i, f in marked), key=str)


def found(df):
    return sorted((tuple(r) for r in simhash_golay.near_duplicates(df).select("doc_id", simhash_golay.hex_of().alias("f"), "component_id").collect()), key=str)


def test_simhash_awkward_rows_and_empty_table(spark):
    assert found(frame(spark, awkward())) == expected(awkward())
    assert found(empty(spark)) == []


def test_simhash_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in entry_points.queries()["op7_simhash_golay"](spark, SF).collect()), key=str)
    assert got == expected(rows)


def test_golay_table_is_perfect_and_keys_meet():
    table = golay = simhash_golay.golay_table()
    assert (np.bincount(golay, minlength=4096) == 2048).all()
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**64, 400, dtype=np.uint64)
    for flips in range(5):
        for _ in range(5):
            mask = sum(1 << int(b) for b in rng.choice(64, flips, replace=False))
            a, ra = simhash_golay.pair_keys(table, x)
            b, rb = simhash_golay.pair_keys(table, x ^ np.uint64(mask))
            left, right = set(zip(ra.tolist(), a.tolist())), set(zip(rb.tolist(), b.tolist()))
            assert {r for r, _ in left & right} == set(range(400))


@pytest.mark.parametrize("block", [4, 50, 4096])
def test_links_of_crowded_buckets(spark, block):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**62))
    fps = {base}
    for _ in range(300):
        fps.add(base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 9)), replace=False)))
    fps |= {int(v) for v in rng.integers(0, 2**62, 200)}
    rows = [(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps]
    edges = simhash_golay.links(spark.createDataFrame(rows, "fp bigint"), block=block)
    root = {r["node"]: r["root"] for r in simhash_golay.components(edges).collect()}
    want = brute_components({f: f for f in fps})
    groups, mine = {}, {}
    for f in fps:
        s = f - (1 << 64) if f >= 1 << 63 else f
        groups.setdefault(want[f], set()).add(f)
        mine.setdefault(root.get(s, s), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def brute_exact(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    by = {}
    for i, t in norm:
        by.setdefault(t, []).append(i)
    out = [(i, min((x for x in by[t] if x is not None), default=None), len(by[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm]
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_duplicates(spark, bits):
    df = chunk_recipes.exact_duplicates(frame(spark, awkward()), hash_bits=bits, chunk=64 if bits == 3 else 2048)
    rows = [r.asDict() for r in df.collect()]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str) == brute_exact(awkward())
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in rows}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert chunk_recipes.exact_duplicates(empty(spark)).collect() == []


def test_cuts_are_bounded_and_local():
    gear = chunk_recipes.gear_values()
    rng = np.random.default_rng(2)
    data = rng.integers(97, 123, 200_000, dtype=np.uint8).tobytes()
    ends = chunk_recipes.cut_points(data, gear)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= 8 * 2048 and (sizes[:-1] >= 512).all()
    moved = {data[a:b] for a, b in zip([0, *ends], ends)} & {d for e in [chunk_recipes.cut_points(b"xyz" + data, gear)] for d in [(b"xyz" + data)[a:b] for a, b in zip([0, *e], e)]}
    assert len(moved) > len(ends) // 2
    assert chunk_recipes.cut_points(b"", gear) == [0] and sum(np.diff([0, *chunk_recipes.cut_points(b"a" * 100_000, gear)])) == 100_000


def test_exact_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(entry_points.oracle_sql()["op10_chunk_recipes"]).fetchall()
    got = entry_points.queries()["op10_chunk_recipes"](spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
