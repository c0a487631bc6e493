import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from platewise.llm import passage_attention, toxic_grammar
from tests.llm.helpers import awkward, empty, frame, prose

SF = "/root/testdata/sf0.01"


def labelled(spark, name, column):
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = entry_points.queries()[name](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    return [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]


def test_toxicity_query(spark):
    rows = labelled(spark, "op4_toxic_grammar", "toxic")
    assert all(p == (s >= 0.5) for s, p, _ in rows) and np.mean([p == y for _, p, y in rows]) > 0.93


def test_quality_query(spark):
    rows = labelled(spark, "op9_passage_attention", "quality")
    assert all(p == (s >= 0.3) for s, p, _ in rows) and np.mean([p == y for _, p, y in rows]) > 0.95


def grammar():
    return toxic_grammar.Grammar([("idiot", False, 4.0, "I"), ("lowei", True, 4.0, "I"), ("kill", False, 3.0, "H")])


def total(text):
    return np.expm1(grammar().features(text)[toxic_grammar.FEATURES.index("total")])


def test_grammar_weighs_clauses():
    assert total("an idiot") == pytest.approx(4.0)
    assert total("you are an idiot") == pytest.approx(6.0) and total("an idiot, you") == pytest.approx(6.0)
    assert total("not an idiot") == pytest.approx(1.2)
    assert total("somebody said idiot") == pytest.approx(2.0)
    assert total("not so. an idiot") == pytest.approx(4.0)
    assert total("she said you are not an idiot") == pytest.approx(4 * 1.5 * 0.3 * 0.5)
    assert total("loweischaft") == pytest.approx(4.0) and total("xlowei idiots videos") == 0 and total("I kill you") == pytest.approx(4.5)


def test_composed_machine_equals_its_parts():
    machines = (toxic_grammar.INSULT, toxic_grammar.THREAT, toxic_grammar.NEGATION, toxic_grammar.REPORTED, toxic_grammar.TARGETED)
    composed = toxic_grammar.compose(*machines)
    rng = np.random.default_rng(0)
    for _ in range(200):
        symbols = rng.integers(0, len(toxic_grammar.SYMBOLS), 12).tolist()
        parts = [0] * len(machines)
        for k, marks in zip(symbols, toxic_grammar.read(composed, symbols)):
            assert marks == {m.mark for m, s in zip(machines, parts) if m.marking[s][k]}
            parts = [m.table[s][k] for m, s in zip(machines, parts)]


def plain_score(model, text):
    """A text's probability again, clause by clause from the rules in words: no automaton, no machines."""
    text, best, total, clauses, counts = text.lower(), 0.0, 0.0, 0, dict.fromkeys(("threat", "targeted", "negated", "reported"), 0)
    matched = False
    by_start = {}
    for entry, stem, weight, symbol in model.lexicon:
        for m in re.finditer(re.escape(entry), text):
            i, j = m.start(), m.end()
            word = i == 0 or not (text[i - 1].isalnum() or text[i - 1] == "_")
            if word and (stem or j == len(text) or not text[j].isalnum()) and weight > by_start.get(i, (-1e9,))[0]:
                by_start[i] = (weight, symbol)
    begin = 0
    for stop in [*(m.start() for m in re.finditer(r"[.!?;\n\r]", text)), len(text)]:
        tokens = [(m.start(), m.group()) for m in re.finditer(r"[\w']+|[\"“”«»„]", text[begin:stop])]
        tokens = [(begin + i, t, by_start.get(begin + i)) for i, t in tokens]
        aimed = any(not h and t in toxic_grammar.TARGETS for _, t, h in tokens)
        score, found = 0.0, False
        for k, (_, _, hit) in enumerate(tokens):
            if not hit:
                continue
            found = True
            before = [(t, h) for _, t, h in tokens[:k]]
            negated = any(not h and t in toxic_grammar.NEGATIONS for t, h in before[-3:])
            reported = False
            for t, h in before:
                reported = True if not h and t in toxic_grammar.REPORTS else not reported if not h and t in toxic_grammar.QUOTES else reported
            weight = hit[0]
            for name, on, factor in (("targeted", aimed, 1.5), ("negated", negated, 0.3), ("reported", reported, 0.5)):
                counts[name] += on
                weight *= factor if on else 1
            counts["threat"] += hit[1] == "H"
            score += weight
        total, best, clauses, matched = total + score, max(best, score), clauses + found, matched or found
        begin = stop + 1
    x = [1.0] + [0.0] * 8
    if by_start:
        x = [1.0, np.log1p(total), best / 4, np.log1p(clauses), *(np.log1p(counts[c]) for c in ("threat", "targeted", "negated", "reported")), np.log1p(1000 * total / (len(text) + 200))]
    return 1 / (1 + np.exp(-np.clip(np.array(x) @ model.weights, -30, 30)))


def test_every_document_scored_like_a_plain_scorer(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxic_grammar.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = toxic_grammar.score(docs, model).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["score"] == pytest.approx(plain_score(model, texts[r["doc_id"]]), abs=1e-9), r["doc_id"]


def test_model_does_not_depend_on_partitions(spark):
    """Copies of one text under both labels, dealt otherwise each time."""
    docs = [(i, prose(40, i % 40 + 1) + (" grumbald" if i % 3 == 0 else "") + (f" tail{i}" if i % 2 else "")) for i in range(600)]
    labels = [(i, int(i % 3 == 0 or i % 7 == 0)) for i in range(600)]
    d, t = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    models = [toxic_grammar.fit(d.repartition(n), t.repartition(n)) for n in (1, 5, 13)]
    assert all(m.lexicon == models[0].lexicon and (m.weights == models[0].weights).all() for m in models)


def toy(spark):
    docs = [(i, prose(20 + i % 30, i + 1) + (" zorgling fool" if i % 4 == 0 else "") + " " + prose(20, i + 900)) for i in range(400)]
    labels = [(i, 1 - (i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_lexicon_is_learnt_from_the_training_fold_only(spark):
    docs, labels = toy(spark)
    model = toxic_grammar.fit(docs, labels)
    assert {"zorgling", "fool"} <= {e for e, *_ in model.lexicon}
    flipped = labels.withColumn("toxic", toxic_grammar.F.when(toxic_grammar.held_out(), 1 - labels.toxic).otherwise(labels.toxic))
    other = toxic_grammar.fit(docs, flipped)
    assert other.lexicon == model.lexicon and np.allclose(other.weights, model.weights)


@pytest.mark.parametrize("module", [toxic_grammar, passage_attention])
def test_awkward_rows_and_tables(spark, module):
    docs, labels = toy(spark)
    model = module.fit(docs, labels)
    rows = awkward()
    got = module.score(frame(spark, rows), model).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows) and all(0 <= r["score"] <= 1 for r in got)
    blank = {r["score"] for r in module.score(frame(spark, [(1, None), (2, ""), (3, "")]), model).collect()}
    assert len(blank) == 1
    assert module.score(empty(spark), model).collect() == []
    for nothing in (labels.limit(0), labels.withColumn("toxic", toxic_grammar.F.lit(None).cast("int")).withColumn("quality", toxic_grammar.F.lit(None).cast("int")),
                    labels.withColumn("toxic", toxic_grammar.F.lit(1)).withColumn("quality", toxic_grammar.F.lit(1))):
        assert all(0 <= r["score"] <= 1 for r in module.score(docs, module.fit(docs, nothing)).collect())
    odd = labels.union(labels).union(spark.createDataFrame([(None, 1, 1)], labels.schema))
    assert module.score(docs, module.fit(docs.union(docs), odd)).count() == 400


def test_attention_gradients():
    rng = np.random.default_rng(1)
    counts = np.array([3, 1, 4])
    x = rng.normal(size=(8, passage_attention.WIDTH))
    truth = np.array([1.0, 0.0, 1.0])
    net = passage_attention.train(x, counts, np.array([1.0, 1.0, 1.0]))
    net.weights = {k: rng.normal(0, 0.2, v.shape) for k, v in net.weights.items()}
    loss = lambda: -np.mean(np.log(np.where(truth == 1, net.forward(x, counts)[0], 1 - net.forward(x, counts)[0])))
    y, state = net.forward(x, counts)
    grads = net.gradients(y, truth, counts, state)
    for k, w in net.weights.items():
        at = tuple(rng.integers(0, n) for n in w.shape)
        kept = w[at]
        ends = []
        for e in (1e-5, -1e-5):
            if w.shape:
                w[at] = kept + e
            else:
                net.weights[k] = np.array(kept + e)
            ends.append(loss())
        if w.shape:
            w[at] = kept
        else:
            net.weights[k] = np.array(kept)
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(float(grads[k][at]), abs=1e-6)


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf)
        assert out.columns == columns, name
        out = corpus_pipeline.staged(out, "test")
        was, now = {r["doc_id"] for r in seen.select("doc_id").collect()}, {r["doc_id"] for r in out.select("doc_id").collect()}
        assert now <= was
        if name == "exact dedup":
            best = {}
            for r in seen.collect():
                key = " ".join(__import__("re").split(r"[\x20\x09-\x0D]+", r["text"]))
                best[key] = min(best.get(key, r["doc_id"]), r["doc_id"])
            assert now == set(best.values())
        if name == "near dedup":
            from tests.llm.test_near import kept

            assert now == {i for _, i in kept([(r["doc_id"], r["text"]) for r in seen.collect()])}
        if name == "pii":
            assert now == was
        if name == "toxicity":
            model = toxic_grammar.fit(seen, spark.read.parquet(f"{sf}/labels.parquet"))
            assert now == {r["doc_id"] for r in toxic_grammar.score(seen, model).filter("score < 0.5").collect()}
        seen = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen, sf).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in seen.collect()}


@pytest.mark.parametrize("number", range(5))
def test_pipeline_stages_take_awkward_tables(spark, number):
    name, stage = corpus_pipeline.STAGES[number]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in awkward()], columns)
    for c in ("a.b", "_text", "score", "c0", "_done", "node", "key", "fp", "ids", "low", "h"):
        df = df.withColumn(c, toxic_grammar.F.lit("clash"))
    found = stage(spark, corpus_pipeline.staged(df, "awkward"), SF)
    assert number == 4 or found.columns == df.columns
    out = found.collect()
    assert len(out) >= 1
    assert stage(spark, corpus_pipeline.staged(df.limit(0), "none"), SF).collect() == []


def test_long_documents_do_not_crowd_the_sample(spark):
    docs, labels = toy(spark)
    long = spark.createDataFrame([(1000 + i, prose(20000, i)) for i in range(3)], docs.schema)
    more = labels.union(spark.createDataFrame([(1000 + i, 1, 0) for i in range(3)], labels.schema))
    few = passage_attention.fit(docs.union(long), more, most=600)
    assert all(np.array_equal(few.weights[k], v) for k, v in passage_attention.fit(docs, labels, most=600).weights.items())
