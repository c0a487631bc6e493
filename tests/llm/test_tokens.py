import struct
import zlib

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
from platewise.llm import byte_bpe, packing
from tests.llm.helpers import awkward, empty, frame

SF = "/root/testdata/sf0.001"


def library():
    ranks = byte_bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark):
    rows = awkward() + [(100, " " * 3000), (101, "abcdefghij" * 500), (102, "".join(chr(33 + i * 7919 % 40000) for i in range(2000)))]
    got = byte_bpe.decode(byte_bpe.encode(frame(spark, rows))).collect()
    enc = library()
    assert sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got), key=str) == sorted(
        ((i, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)
    assert byte_bpe.decode(byte_bpe.encode(empty(spark))).collect() == []


def test_bpe_decode_nulls_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in byte_bpe.decode(df).collect()} == {1: None, 2: bytearray()}
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, [10**8])], "doc_id bigint, ids array<int>")).collect()


def test_long_pieces_merge_like_matrices():
    v = byte_bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    pieces = [b"abcabcabdabcabe" * 8, bytes(range(1, 200)), b"thethethere" * 9]
    for p, ids in zip(pieces, v.merge_matrix(pieces)):
        assert v.merge_long(p).tolist() == ids.tolist()


def test_bpe_query(spark):
    import hashlib

    enc = library()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry_points.queries()["op8_byte_bpe"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = enc.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def check_packing(rows, pieces, length):
    """Every id once, sequences gapless and full but for powers of two."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.setdefault(i, []).append(ids)
    seqs = {}
    for p in pieces:
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        assert any(zlib.crc32(struct.pack(f"<{p['length']}I", *ids[p["start"]:p["start"] + p["length"]])) == zlib.crc32(bytes(p["ids"])) and p["doc_tokens"] == len(ids)
                   for ids in want[p["doc_id"]])
    for i, copies in want.items():
        cover = sorted((p["doc_tokens"], p["start"], p["length"]) for p in pieces if p["doc_id"] == i)
        assert sum(n for _, _, n in cover) == sum(map(len, copies))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == length or at & (at - 1) == 0


@pytest.mark.parametrize("length,windows,group", [(2048, 32, 64), (64, 2, 1), (256, 4, 2)])
def test_packing(spark, length, windows, group):
    rows = awkward()
    df = packing.pack(frame(spark, rows), length=length, open_windows=windows, group=group)
    check_packing(rows, df.collect(), length)


def test_packing_empty_and_query(spark):
    assert packing.pack(empty(spark)).collect() == []
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_packing(rows, packing.pack(spark.read.parquet(f"{SF}/documents.parquet")).collect(), 2048)
    got = entry_points.queries()["op5_pack_bounded"](spark, SF)
    assert set(got.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} and got.count() >= len(rows)


@pytest.mark.parametrize("text", ["<|endoftext|> hi", "a<|endoftext|>b <|endoftext|>", "<|endoftext|>", "<|endoftext|", "plain", "", "naïve 漢字 <|endoftext|> 😀"])
def test_added_tokens_are_their_own_ids(text):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encoder(None, None)(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_packing_with_added_tokens(spark):
    rows = [(1, "<|endoftext|> hi"), (2, "x <|endoftext|>" * 300), (3, None)]
    check_packing(rows, packing.pack(frame(spark, rows), length=64).collect(), 64)
