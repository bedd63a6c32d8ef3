"""Chunked byte-level BPE against the library for rank files."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rowmend.llm import pretokens
from rowmend.llm.chunked_bpe import decode_ids, encode_texts, load_ranks
from rowmend.llm.queries import op13_chunked_bpe

ODD = "abS's're'll'vtdm  \n\t　 12½éß漢\U0001f600!?<|endoftext|>▁\u0085 ́"


@pytest.fixture(scope="module")
def bpe():
    return load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def encoded(bpe, texts):
    ids, ends = bpe.encode(texts)
    return [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]


def test_pattern_is_the_published_one():
    assert pretokens.WORDS == public_tokenizers.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(ODD, max_size=30)), max_size=6))
def test_like_the_library(bpe, library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encoded(bpe, texts) == [library.encode_ordinary(t) for t in texts]


def test_both_ways_to_merge_agree(bpe):
    draw = random.Random(5)
    for _ in range(300):
        word = bytes(draw.choice(b"aaabetionsx ") for _ in range(draw.randint(2, 150)))
        assert bpe.merged_by_scan(word) == bpe.merged_by_queue(word)


def test_chunks_of_any_size_give_the_whole_encoding(spark, bpe, library):
    draw = random.Random(2)
    texts = ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 400))) for _ in range(60)]
    texts += ["a" * 500, " " * 300 + "x", "ab " * 200, "word " * 90 + "z" * 200 + " end" * 50, "\n" * 200]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {n: library.encode_ordinary(t) for n, t in enumerate(texts)}
    for chunk, overlap in ((16, 8), (40, 12), (64, 30)):
        found = encode_texts(rows, bpe, chunk=chunk, overlap=overlap).collect()
        assert len(found) == len(texts)
        assert {r.doc_id: r.token_ids for r in found} == want


def test_very_long_text(spark, bpe, library):
    draw = random.Random(3)
    words = ["Straße", "don't", "42", "x" * 40, "\n\n", "...", "漢字", "alpha"]
    text = " ".join(draw.choice(words) for _ in range(150_000)) + "b" * 100_000
    rows = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    out = {r.doc_id: r for r in encode_texts(rows, bpe, bytes_col="decoded").collect()}
    assert out[1].token_ids == library.encode_ordinary(text)
    assert bytes(out[1].decoded) == text.encode()
    assert out[2].token_ids == library.encode_ordinary("short")


def test_odd_rows(spark, bpe):
    rows = spark.createDataFrame(
        [(1, None, "k"), (2, "", "k"), (None, "same", None), (None, "same", None), (3, "x" * 50, "k")],
        "doc_id long, text string, token_ids string").selectExpr("*", "1 AS row", "2 AS k", "3 AS `a.b`", "4 AS __chunk")
    out = decode_ids(encode_texts(rows, bpe, chunk=20, overlap=10), bpe)
    assert set(out.columns) == {"doc_id", "text", "row", "k", "a.b", "__chunk", "token_ids", "decoded"}
    found = sorted((r.doc_id or 0, r.text, len(r.token_ids), bytes(r.decoded).decode()) for r in out.collect() if r.text)
    assert [(a, b, d) for a, b, _, d in found] == [(0, "same", "same"), (0, "same", "same"), (3, "x" * 50, "x" * 50)]
    assert [(r.token_ids, bytes(r.decoded)) for r in out.collect() if not r.text] == [([], b"")] * 2
    assert encode_texts(rows.limit(0), bpe).count() == 0


def test_decoding_gives_raw_bytes(spark, bpe):
    high, low = bpe.ranks["é".encode()[:1]], bpe.ranks["é".encode()[1:]]
    rows = spark.createDataFrame([([high],), ([high, low],), (None,), ([],), ([low, -5, 10**6, None],)], "token_ids array<int>")
    found = [r.decoded if r.decoded is None else bytes(r.decoded) for r in decode_ids(rows, bpe).collect()]
    assert found == [b"\xc3", b"\xc3\xa9", None, b"", b"\xa9"]


TABLES = "/root/testdata/sf0.01"


def test_query_on_the_given_table(spark, library):
    out = {r.doc_id: r for r in op13_chunked_bpe(spark, TABLES).collect()}
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").collect()
    assert len(out) == len(docs)
    for doc in docs:
        text = doc.text or ""
        ids = library.encode_ordinary(text)
        row = out[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
