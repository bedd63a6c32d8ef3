"""Encoding and decoding against the tokenizer library."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rowmend.llm.bpe import Bpe, decode_column, encode_column, load_bpe, round_trip
from rowmend.llm.queries import tokenizer_path

PATH = tokenizer_path()
BPE = load_bpe(PATH)
LIBRARY = Tokenizer.from_file(PATH)
SPECIAL = "<|endoftext|>"
AWKWARD = ["", " ", "  a", "a  b", "a \n b\t\tc ", "it's we'll 'S", "x" * 3000, " " * 500 + "end", "né à ß 中文字 🎉 ½²",
           f"{SPECIAL}a{SPECIAL}{SPECIAL} b", "a b  c d", "\x00\x1c\x85", "࢏\U0001df1f new letters",
           "1234567 12 a1b2", "!!! ... ---===", "\r\n\r\n x", "ab" * 2000]


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", AWKWARD)
def test_awkward_texts(text):
    ids = BPE.encode([text])[0]
    assert ids.tolist() == library(text)
    assert BPE.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=5))
def test_any_texts(texts):
    assert [x.tolist() for x in BPE.encode(texts)] == [library(t) for t in texts]


def test_words_merged_together():
    r = random.Random(11)
    given = {bytes(r.randrange(256) for _ in range(r.randint(1, 60))) for _ in range(3000)}
    given |= {w * n for w in (b"a", b"ab", b" the", "é漢".encode()) for n in range(1, 40)}
    given |= {t[:n] for t in BPE.reachable for n in (len(t), 3)}
    listed = r.sample(sorted(given), len(given))
    flat, ends = BPE.merged_words(listed)
    assert dict(zip(listed, (x.tolist() for x in np.split(flat, ends[:-1])))) == dict(BPE.walk(sorted(given)))
    assert [len(x) for x in BPE.merged_words([])] == [0, 0]
    texts = [t.replace(SPECIAL, "") for t in AWKWARD]
    flat, ends = BPE.merged_texts(texts)
    assert [x.tolist() for x in np.split(flat, ends[:-1])] == [library(t) for t in texts]


def test_pairs_stay_apart_as_merging_says():
    r, tokens = random.Random(5), list(BPE.reachable.values())
    for _ in range(4000):
        a, b = r.choice(tokens[:900]), r.choice(tokens)
        assert BPE.apart(a, b) == (BPE.merged(BPE.pieces[a] + BPE.pieces[b]) == [a, b])
        assert BPE.apart(a, a) == (BPE.merged(BPE.pieces[a] * 2) == [a, a])


def test_decoding_any_ids():
    r = random.Random(6)
    for _ in range(500):
        ids = [r.randrange(50_257) for _ in range(r.randrange(12))]
        assert BPE.decode(np.array(ids, np.int64)) == LIBRARY.decode(ids, skip_special_tokens=False)
    assert BPE.decode(np.array([-1, 10**6, 64])) == LIBRARY.decode([64])


def test_forgetting_changes_nothing(monkeypatch):
    from rowmend.llm import bpe as module
    for name in ("REMEMBERED_WORDS", "REMEMBERED_PAIRS"):
        monkeypatch.setattr(module, name, 3)
    small = load_bpe(PATH)
    for text in AWKWARD * 2:
        assert small.encode([text])[0].tolist() == library(text)


def test_columns(spark, docs, no_rows):
    table = docs([(1, "Hello there, hello!"), (2, None), (3, ""), (3, ""), (None, "né  à")]).withColumnRenamed("id", "token_ids")
    got = {(r["doc_id"], tuple(r["token_ids"]), r["decoded"]) for r in round_trip(table, PATH).collect()}
    assert got == {(1, tuple(library("Hello there, hello!")), "Hello there, hello!"), (2, (), ""), (3, (), ""),
                   (None, tuple(library("né  à")), "né  à")}
    assert round_trip(table, PATH).count() == 5 and round_trip(no_rows(table), PATH).count() == 0
    apart = decode_column(encode_column(table, BPE), BPE)
    assert sorted(apart.select("doc_id", "decoded").collect(), key=str) == sorted(
        round_trip(table, PATH).select("doc_id", "decoded").collect(), key=str)
    odd = spark.createDataFrame([(None,), ([],), ([64, None, -5],)], "token_ids array<int>")
    assert [r["decoded"] for r in decode_column(odd, BPE).collect()] == [None, "", LIBRARY.decode([64])]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        Bpe(open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read(), "").encode(["a"])
