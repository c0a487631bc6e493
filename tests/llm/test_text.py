"""Pseudonyms, chat parts, sketches, training order."""

import datetime
import hashlib
import json
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry_points
from platewise.llm import chat_parts, pseudonyms, scaled_sketch, training_order
from tests.llm.helpers import awkward, empty, frame, prose

SF = "/root/testdata/sf0.001"


def luhn(text):
    d = [int(c) for c in text if c.isdigit()]
    return sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d))) % 10 == 0


def iban_ok(text):
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def digest_add(text, digest, hexadecimal):
    out = []
    for i, c in enumerate(text):
        by = int(digest[2 * i:2 * i + 2], 16)
        base, n = (48, 10) if c.isdigit() else (65 if c.isupper() else 97, 6 if hexadecimal else 26)
        out.append(chr(base + (ord(c) - base + by) % n))
    return "".join(out)


def brute_feistel(core, key, kind, hexadecimal=False):
    left, right = core[:len(core) // 2], core[len(core) // 2:]
    for turn in range(1, 9):
        digest = hashlib.sha512(f"{key}|{kind}|{turn}|{right}".encode()).hexdigest()
        left, right = right, digest_add(left, digest, hexadecimal)
    return left + right


CASES = [("a card 4111 1111 1111 1111.", r"\d[\d ]{17}\d", luhn), ("account DE89 3704 0044 0532 0130 00 here", r"DE\d\d[\d ]+\d", iban_ok),
         ("from 193.195.198.107.", r"\d+\.\d+\.\d+\.\d+", lambda v: all(int(o) < 256 for o in v.split("."))),
         ("on 1984-02-29", r"\d{4}-\d\d-\d\d", lambda v: bool(datetime.date.fromisoformat(v))),
         ("on 29.02.1984", r"\d\d\.\d\d\.\d{4}", lambda v: bool(datetime.datetime.strptime(v, "%d.%m.%Y"))),
         ("call +1 (743) 555-3824 now", r"\+1 \(\d{3}\) \d{3}-\d{4}", lambda v: True), ("und.34@mail7.example.com", r"[a-z]{3}\.\d\d@mail7\.example\.com", lambda v: True),
         ('token = "11acdfb36bb72224148e6160f674b4be45601bff"', r"[0-9a-f]{40}", lambda v: True), ("id 123-45-6789", r"\d{3}-\d\d-\d{4}", lambda v: True)]
UNTOUCHED = ["4111111111111112", "999.1.1.1", "31.02.1999", "2001-13-01", "DE88370400440532013000", "version 3.4.5, 1,000.50 = x at 12:30", "no personal data", ""]


def test_pseudonyms_keep_format_and_validity(spark):
    rows = [(i, t) for i, (t, _, _) in enumerate(CASES)] + [(100 + i, t) for i, t in enumerate(UNTOUCHED)]
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymise(frame(spark, rows, extra=False), "k").collect()}
    for i, (t, pattern, valid) in enumerate(CASES):
        was, now = re.search(pattern, t).group(), re.search(pattern, got[i]["text"]).group()
        assert was != now and valid(now) and got[i]["n_pseudonyms"] == 1
        assert t.replace(was, "") == got[i]["text"].replace(now, "")
    for i, t in enumerate(UNTOUCHED):
        assert (got[100 + i]["text"], got[100 + i]["n_pseudonyms"]) == (t, 0)


def test_pseudonyms_equal_brute_force_and_link(spark):
    rows = [(1, "4111111111111111"), (2, "x 4111-1111-1111-1111 y 4111 1111 1111 1111"), (3, "+49 30 1234567"), (4, "Ann.Lee9@x.org"), (5, "key: " + "Ab12" * 8)]
    got = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(frame(spark, rows, extra=False), "k").collect()}
    payload = brute_feistel("411111111111111", "k", "card")
    number = next(payload + str(c) for c in range(10) if luhn(payload + str(c)))
    groups = [number[i:i + 4] for i in range(0, 16, 4)]
    assert got[1] == number and got[2] == f"x {'-'.join(groups)} y {' '.join(groups)}"
    assert re.sub(r"\D", "", got[3][3:]) == brute_feistel("301234567", "k", "phone")
    mail = brute_feistel("AnnLee9", "k", "email")
    assert got[4] == f"{mail[:3]}.{mail[3:]}@x.org"
    assert got[5] == "key: " + brute_feistel("Ab12" * 8, "k", "secret", True)


def test_pseudonyms_are_a_permutation_of_dates(spark):
    days = [(i, str(datetime.date(1999, 1, 1) + datetime.timedelta(i))) for i in range(800)] + [(9000, "9999-12-31"), (9001, "0001-01-01")]
    got = [r["text"] for r in pseudonyms.pseudonymise(frame(spark, days, extra=False), "k").collect()]
    assert len(set(got)) == len(days) and all(datetime.date.fromisoformat(g) for g in got)


def test_pseudonyms_awkward_rows(spark):
    rows = awkward() + [(200, "a" * 100000 + "@"), (201, "1" * 100000), (202, "1.1." * 30000), (203, "4111111111111111 " * 2000)]
    df = frame(spark, rows)
    got = pseudonyms.pseudonymise(df.withColumnRenamed("score", "n_pseudonyms"), "k")
    assert "n_pseudonyms_1" in got.columns and set(df.columns) - {"score"} < set(got.columns)
    assert sorted(str((r["doc_id"], r["text"])) for r in got.collect() if r["doc_id"] != 203) == sorted(str(r) for r in rows if r[0] != 203)
    assert got.filter("doc_id = 203").first()["n_pseudonyms_1"] == 2000
    assert pseudonyms.pseudonymise(empty(spark), "k").collect() == []


def test_pseudonyms_plan_is_native_and_query_covers_all(spark):
    df = entry_points.queries()["op1_feistel_pseudonyms"](spark, SF)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
    was = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = df.collect()
    assert len(got) == len(was)
    for r in got:
        for m in re.findall(r"(?<!\d)\d{16}(?!\d)", was[r["doc_id"]]):
            assert (m in r["text"]) != luhn(m)
        for m in re.findall(r"[\w.]+@\S+\.com|\+1 \(\d{3}\) \d{3}-\d{4}", was[r["doc_id"]]):
            assert m not in r["text"]


TOLD = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>", "<\\|end|>", "<\\\\/s> [\\INST]", "<<SYS>> a <</SYS>>", "a\\b < s>", "", None, "[[INST]]<<s>", "<|x|><|y|>\n<|end|>\n"]


def test_escape_is_reversible_and_leaves_no_control_string():
    for t in filter(None, TOLD):
        e = chat_parts.escape(t)
        assert chat_parts.unescape(e) == t
        assert not re.search(r"<\|\w+\|>|</?s>|\[/?INST\]|<</?SYS>>", e)


def brute_chat(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        told = "".join((t or "") for _, _, role, t in turns if role == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns).encode()).hexdigest(), len(told), hashlib.sha256(told.encode()).hexdigest())
    return out


def test_chat_read_back(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(TOLD)] + [(2, 0, None, "x"), (None, 3, "assistant", "y"), (3, None, "assistant", "z"), (3, 1, "us</s>er", "w" * 90000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for c in ("formatted", "_role", "attachments", "n_turns"):
        df = df.withColumn(c, df.role)
    formatted = chat_parts.format_turns(df)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_parts.read_back(formatted).collect()}
    assert got == brute_chat(rows)
    assert chat_parts.read_back(chat_parts.format_turns(df.limit(0))).collect() == []
    for r in formatted.collect():
        assert len(re.findall(r"<\|turn\|>", r["formatted"])) == 1


def test_chat_repeated_turns(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "same")] * 3, "conv_id bigint, turn bigint, role string, text string")
    r = chat_parts.read_back(chat_parts.format_turns(df)).first()
    assert (r["n_turns"], r["loss_chars"]) == (3, 12)


def test_chat_typed_parts(spark):
    part = chat_parts.PART
    rows = [(1, 0, "user", [("text", "look <|image|> ", None, None, None, None, None), ("image", None, "s3://a.png", 60, 28, None, None), ("audio", None, "b.wav", None, None, 1.0, None),
                            ("document", None, "c.pdf", None, None, None, 3), ("image", None, None, None, None, None, None), None, ("other", "t", None, None, None, None, None)]), (1, 1, "assistant", None)]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, text array<{part}>")
    first, second = chat_parts.format_turns(df).orderBy("turn").collect()
    content = first["formatted"][first["loss_start"]:-len(chat_parts.END) - 1]
    assert content == "look <\\|image|> <|image|><|audio|><|document|><|image|>t"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in first["attachments"]] == [("image", "s3://a.png", 3), ("audio", "b.wav", 13), ("document", "c.pdf", 1536), ("image", None, 256)]
    assert all(content[a["position"]:].startswith(f"<|{a['kind']}|>") for a in first["attachments"])
    assert first["expanded_tokens"] == 3 + 13 + 1536 + 256 and second["attachments"] == [] and second["loss_length"] == 0


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", TOLD[0]), (-7, 1, "assistant", TOLD[0])]
    assert {r["conv_id"]: tuple(r)[1:5] for r in entry_points.queries()["op3_chat_parts"](spark, SF).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()} == brute_chat(rows)


def brute_next(rows):
    """Text that follows each row, in descending order of id (null last) and text."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    return [(i, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)]


def check_edits(rows, got):
    want = sorted((str(i), len(t), hashlib.sha256((t[:len(t) - len(t) // 2] + n[:len(t) // 2]).encode()).hexdigest()) for i, t, n in brute_next(rows))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == want


def edits(spark, df):
    from pyspark.sql import functions as F

    return scaled_sketch.compare_edited(df).select("*", F.sha2("edited", 256).alias("edited_sha256")).collect()


@pytest.mark.parametrize("neighbours,spans", [(2048, 64), (2, 4), (3, 64)])
def test_edited_texts(spark, monkeypatch, neighbours, spans):
    monkeypatch.setattr(scaled_sketch, "NEIGHBOURS", neighbours)
    monkeypatch.setattr(scaled_sketch, "SPANS", spans)
    ends = [(i * 3, prose(6, i + 1)) for i in range(30)] + [(2**63 - 1, "top"), (-2**63, "bottom"), (10**15, "far off")] + [(7, f"same id {i}") for i in range(9)] + [(None, f"none {i}") for i in range(9)]
    check_edits(ends, edits(spark, frame(spark, ends)))
    check_edits(awkward(), edits(spark, frame(spark, awkward())))
    sparse = [(i * i * 37 % 100003, prose(5 + i % 40, i)) for i in range(120)]
    check_edits(sparse, edits(spark, frame(spark, sparse)))
    check_edits([(5, "only one row here")], edits(spark, frame(spark, [(5, "only one row here")])))
    assert edits(spark, empty(spark)) == []


def test_sketch_estimates_containment(spark):
    long, part = prose(20000, 5), " ".join(prose(20000, 5).split()[4000:9000])
    words = [f"w{i * 7919 % 5003}x{i % 97}" for i in range(20000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[3000:8000])), (3, " ".join(words[:2500] + [f"q{i}" for i in range(2500)])), (4, long), (5, part), (6, "a b"), (7, None)]
    s = {r[0]: set(r[1]) for r in spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", scaled_sketch.sketch(scaled_sketch.F.col("text"))).collect()}
    inside = lambda a, b: len(s[a] & s[b]) / min(len(s[a]), len(s[b]))
    assert inside(1, 2) > 0.99 and abs(inside(1, 3) - 0.5) < 0.06 and inside(4, 5) > 0.99
    assert len(s[6]) == 1 and s[7] == set() and abs(len(s[1]) / 19996 - 1 / 8) < 0.02


def test_sketch_query(spark):
    df = entry_points.queries()["op6_scaled_sketch"](spark, SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = df.collect()
    check_edits(rows, got)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
    texts, seen = dict(rows), {}
    for r in got:
        assert seen.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert np.mean([r["near_edited"] for r in got]) > np.mean([r["near_next"] for r in got]) + 0.3


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    p = training_order.Permutation(n, 11)
    x = np.arange(n)
    y = p(x)
    assert sorted(y.tolist()) == list(range(n)) and (p(y, back=True) == x).all()
    assert n < 17 or (training_order.Permutation(n, 12)(x) != y).any()


def test_shards_hold_every_sequence_in_slot_order(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = awkward()
    df = frame(spark, rows)
    got = training_order.materialise(df, str(tmp_path), key=3, length=128, shard_rows=32).orderBy("slot").collect()
    order = json.loads((tmp_path / "order.json").read_text())
    records = list(training_order.read_slots(str(tmp_path)))
    assert [r["slot"] for r in got] == list(range(len(got))) and len(records) == len(got) == order["sequences"]
    for r, ids in zip(got, records):
        assert zlib.crc32(ids[:r["n_tokens"]].tobytes()) == r["ids_crc32"] and (ids[r["n_tokens"]:] == training_order.PAD_ID).all()
        assert r["shard"] == r["slot"] // 32 and r["byte_offset"] == r["slot"] % 32 * 256
    assert [i.tolist() for i in training_order.read_slots(str(tmp_path), 45)] == [i.tolist() for i in records[45:]]
    encode = training_order.encoder(None, None)
    assert sum(r["n_tokens"] for r in got) == sum(len(encode(t)) + 1 if t else 1 for _, t in rows)
    assert {i for r in got for i in r["doc_ids"]} == {i for i, _ in rows}
    again = training_order.materialise(df, str(tmp_path / "again"), key=3, length=128, shard_rows=32)
    assert again.agg(F.bit_xor(F.xxhash64("slot", "ids_crc32"))).first()[0] is not None
    assert (tmp_path / "again/shard-00000000.bin").read_bytes() == (tmp_path / "shard-00000000.bin").read_bytes()
    assert training_order.materialise(empty(spark)).collect() == []


def test_order_query(spark):
    got = entry_points.queries()["op2_training_order"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r["slot"] for r in got) == list(range(len(got))) and {i for r in got for i in r["doc_ids"]} == {r["doc_id"] for r in docs.select("doc_id").collect()}
