"""Alignment of two tokenizers against whole-text encodings and plain definitions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rowmend.llm.alignment import aligned_texts, load_aligner
from rowmend.llm.queries import op11_token_alignment, tokenizer_path

ODD = "abcs' \n\t　12.,!éß漢\U0001f600<|endoftext|>\x00▁ ́"
TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def aligner():
    return load_aligner(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def both():
    one = Tokenizer.from_file(tokenizer_path())
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def tokens(aligner, both, text):
    """(ids, [(start, end)]) of both whole-text encodings, or None if the text has no tokens."""
    if not text:
        return None
    found = []
    for ids, pieces in ((both[0].encode(" " + text, add_special_tokens=False).ids, aligner.a_bytes),
                        (both[1].encode(text), aligner.b_bytes)):
        if b"".join(pieces[x] for x in ids) != (" " + text).encode():
            return None
        places, at = [], 0
        for x in ids:
            places.append((at, at + len(pieces[x])))
            at += len(pieces[x])
        found.append((ids, places))
    return found


def expected(aligner, both, texts):
    """By the definition: every overlapping pair, and groups between common ends."""
    known, counts, links = [tokens(aligner, both, t) for t in texts], Counter(), []
    for k in known:
        pairs = []
        if k:
            (a, pa), (b, pb) = k
            first = 0
            for x, (s, e) in zip(a, pa):
                while pb[first][1] <= s:
                    first += 1
                n = first
                while n < len(b) and pb[n][0] < e:
                    pairs.append((x, b[n]))
                    n += 1
        counts.update(pairs)
        links.append(pairs)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for k, pairs in zip(known, links):
        if not k:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        (a, pa), (b, pb) = k
        groups, i, j = [], 0, 0
        a_places, b_places = ({e: n for n, (_, e) in enumerate(p, 1)} for p in (pa, pb))
        for end in sorted(set(a_places) & set(b_places)):
            m, n = a_places[end], b_places[end]
            groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            i, j = m, n
        out.append((len(a), len(b), len(groups), len(pairs), sum(counts[p] == most[p[1]] for p in pairs),
                    sum(counts[p] for p in pairs), ";".join(groups)))
    return out


def aligned(spark, aligner, texts, **options):
    rows = spark.createDataFrame([(n, t, 1, 2, "k") for n, t in enumerate(texts)],
                                 "doc_id long, text string, n_a int, block int, keys string")
    out = {r.doc_id: tuple(r)[1:] for r in aligned_texts(rows, aligner, **options).collect()}
    assert len(out) == len(texts)
    return [out[n] for n in range(len(texts))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(ODD, max_size=30)), min_size=1, max_size=5))
def test_spans_give_whole_text_encodings(aligner, both, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    tokens, pairs, counts = aligner.encoded(texts)
    columns = aligner.measured(tokens, np.unique(pairs), np.zeros(len(np.unique(pairs)), np.int64))
    got = list(zip(*(c.to_pylist() for c in columns)))
    for text, row, want in zip(texts, got, expected(aligner, both, texts)):
        assert (*row[:4], row[6]) == (*want[:4], want[6]), repr(text)


def test_spans_of_short_words_are_merged_together(aligner, both, monkeypatch):
    draw, walked, walk = random.Random(3), [], aligner.a.walk
    monkeypatch.setattr(aligner.a, "walk", lambda words: walk([walked.append(w) or w for w in words]))
    text = " ".join("".join(draw.choice("aeknrstz") for _ in range(draw.randint(3, 14))) for _ in range(5000)) + " " + "xyz" * 90
    tokens, _, _ = aligner.encoded([text])
    assert tokens.a.tolist() == both[0].encode(" " + text, add_special_tokens=False).ids
    # One by one, only the word that is too long for a matrix.
    assert walked == [b" " + b"xyz" * 90]


def test_counts_over_many_blocks(spark, aligner, both):
    draw = random.Random(4)
    words = ["alpha", "don't", "Straße", "4211", "漢字", "x.y", "\n", "naïve", "  ", "▁", "<|endoftext|>", "<s>", "😀!"]
    texts = [" ".join(draw.choice(words[:9] + words[10:]) for _ in range(draw.randint(1, 30))) for _ in range(80)]
    texts += ["with ▁ mark", "", None, "x", "x", " ", "\x00", "a" * 300] + ["the same text again"] * 40
    want = expected(aligner, both, texts)
    assert aligned(spark, aligner, texts) == want
    assert aligned(spark, aligner, texts, block_chars=60) == want


def test_very_long_text(spark, aligner, both):
    draw = random.Random(6)
    text = " ".join(draw.choice(["one", "zwölf", "3,5", "…", "y" * 30]) for _ in range(260_000))
    got = aligned(spark, aligner, [text, "one", text[:50] + "▁" + text])
    ids = both[0].encode(" " + text, add_special_tokens=False).ids
    assert got[0][:2] == (len(ids), len(both[1].encode(text)))
    assert got[2] == (0, 0, 0, 0, 0, 0, "")
    flat = [int(x) for g in got[0][6].split(";") for x in g.split("|")[0].split(",")]
    assert flat == ids
    assert got[1][3] == 1 and got[1][5] > 10_000


def test_odd_tables(spark, aligner):
    assert aligned(spark, aligner, []) == []
    assert aligned(spark, aligner, [None, ""]) == [(0, 0, 0, 0, 0, 0, "")] * 2
    twice = spark.createDataFrame([(None, "b c"), (None, "b c")], "doc_id string, text string")
    assert [r.count_sum for r in aligned_texts(twice, aligner).collect()] == [4, 4]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        load_aligner(tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model"))


def test_query_on_the_given_table(spark, aligner, both):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in op11_token_alignment(spark, TABLES).collect()}
    assert len(got) == len(docs)
    for doc, want in zip(docs, expected(aligner, both, [d.text for d in docs])):
        digest = hashlib.sha256(want[6].encode()).hexdigest() if want[6] else ""
        assert got[doc.doc_id] == (*want[:6], digest)
