import pytest

import corpus_pipeline
from platewise.llm import near_jaccard
from tests.llm.helpers import awkward, empty, frame, prose

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def kept(rows):
    """Ids that stay when all pairs of texts at Jaccard 0.8 or more are linked."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                parent[top(i)] = top(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[top(i)] = min(best.get(top(i), (True, 0)), (d is None, d or 0))
    return sorted(best.values())


def found(df, **settings):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in near_jaccard.one_of_each(df, **settings).collect())


def edited(words, places):
    return " ".join(w + "x" if i in places else w for i, w in enumerate(words))


def test_near_stage_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted((False, r["doc_id"]) for r in got) == kept(rows)


def test_near_awkward_rows_and_empty_table(spark):
    assert found(frame(spark, awkward())) == kept(awkward())
    assert found(empty(spark)) == []


@pytest.mark.parametrize("block", [6, 4096])
def test_near_crowded_buckets_and_pairs_just_below(spark, block):
    rows = []
    for g in range(6):
        words = [f"{w}{i * 7 + g}" for i, w in enumerate(prose(204, g + 1).split())]
        # Four edits far apart change 20 of 200 shingles: 180 / 220 shared; five change 25: 175 / 225, below.
        rows += [(100 * g + k, edited(words, set(range(5 + k, 200, 50)))) for k in range(30)] + [(100 * g + 90, " ".join(words)), (100 * g + 95, edited(words, set(range(4, 200, 35))))]
    assert found(frame(spark, rows), block=block) == kept(rows)


def test_near_stage_links_fingerprints_through_golay_codewords(spark, monkeypatch):
    """The stage's fingerprint step alone finds close copies, and only pairs whose whole sets reach the similarity come out of it."""
    close = prose(600, 3).split()
    rows = [(1, " ".join(close)), (2, edited(close, {300})), (3, prose(500, 8)), (4, "two words"), (5, None)]
    seen = []
    real = near_jaccard.fingerprint_links
    monkeypatch.setattr(near_jaccard, "fingerprint_links", lambda *a: seen.append((out := real(*a)).collect()) or out)
    got = corpus_pipeline.near_dedup(spark, frame(spark, rows), SF).collect()
    assert sorted((False, r["doc_id"]) for r in got) == kept(rows) and len(seen[0]) == 1
