"""Latent retrieval against brute force over all passages."""

import random

import numpy as np
import pytest

from rowmend.llm import decontaminate
from rowmend.llm.decontaminate import (
    HALF, NO_TERM, Index, Terms, half_sums, halves, lcs, with_leaks, with_no_term)


def words(r, n, syllables=("an", "er", "in", "to", "li", "ve", "sa", "ko", "mu", "pe")):
    return ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]


def corpus(seed=0, documents=240, items=30):
    r = random.Random(seed)
    bench = [words(r, r.randint(8, 60)) for _ in range(items)]
    data, truth = [], set()
    for i in range(documents):
        text = words(r, r.randint(0, 300))
        if i % 4 == 0:
            item = r.randrange(items)
            own, turn = list(bench[item]), i // 4 % 3
            if turn == 1:
                for _ in range(len(own) // 10):
                    own[r.randrange(len(own))] = "changed"
            if turn == 2:
                own = [w for k, w in enumerate(own) if k % 9 != 4]
            at = r.randint(0, len(text))
            text[at:at] = own
            truth.add((i, item))
        data.append((i, " ".join(text).capitalize()))
    return data, [(j, " ".join(b)) for j, b in enumerate(bench)], truth


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def brute(data, bench):
    """Every half passage with its surroundings against every item."""
    found = set()
    for i, text in data:
        own = (text or "").lower().split()
        for j, item in bench:
            want = item.lower().split()
            for at in range(0, len(own), HALF):
                around = own[max(0, at - len(want)):at + 2 * HALF + len(want)]
                if len(set(want) & set(around)) >= 0.8 * len(set(want)) and plain_lcs(want, around) >= 0.8 * len(want):
                    found.add((i, j))
                    break
    return found


def found_in(table, bench):
    return {(r["doc_id"], leak["item_id"]) for r in with_leaks(table, bench).collect() for leak in r["leaks"]}


@pytest.fixture(scope="module")
def searched(spark):
    data, bench, truth = corpus()
    table = spark.createDataFrame(data, "doc_id long, text string")
    return data, bench, truth, found_in(table, spark.createDataFrame(bench, "item_id long, text string"))


def test_recall_and_precision(searched):
    data, bench, truth, got = searched
    want = brute(data, bench)
    assert truth <= want
    assert len(got & want) >= 0.9 * len(want) and len(got & truth) >= 0.95 * len(truth)
    assert got <= want


def test_items_over_several_passes(spark, searched, monkeypatch):
    data, bench, _, got = searched
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 11)
    table = spark.createDataFrame(data, "doc_id long, text string")
    assert found_in(table, spark.createDataFrame(bench, "item_id long, text string")) == got


def test_odd_rows(spark, docs, no_rows):
    item = "the quick brown fox jumps over the lazy dog near a river bank today"
    data = [(1, item), (1, item), (2, None), (3, ""), (None, "x " + item.upper() + " y"), (5, "quick brown"), (6, "word " * 3000)]
    r = random.Random(8)
    others = [(100 + i, " ".join(words(r, 150))) for i in range(60)]
    table = docs(data + others).withColumnRenamed("fingerprint", "leaks")
    bench = spark.createDataFrame(
        [(7, item, "k"), (7, item, "k"), (None, item, "k"), (8, None, "k"), (9, "too short", "k"), (10, "", "k")],
        "item_id long, text string, doc_id string")
    got = with_leaks(table, bench)
    assert got.count() == len(data) + 60 and set(got.columns) == set(table.columns)
    found = sorted(((r["doc_id"], [x["item_id"] for x in r["leaks"]]) for r in got.collect()), key=str)
    assert found == sorted([(1, [7]), (1, [7]), (2, []), (3, []), (None, [7]), (5, []), (6, []), *((i, []) for i, _ in others)], key=str)
    assert with_leaks(no_rows(table), bench).count() == 0
    assert with_leaks(table, no_rows(bench)).where("size(leaks) > 0").count() == 0


def test_longest_common_subsequence():
    r = random.Random(3)
    for _ in range(300):
        a = [bytes([r.randrange(97, 102)]) for _ in range(r.randint(1, 70))]
        b = [bytes([r.randrange(97, 104)]) for _ in range(r.randint(0, 90))]
        masks = {}
        for at, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << at
        assert lcs(masks, len(a), b) == plain_lcs(a, b)


def test_halves():
    split = [[b"%d" % (100 * d + k) for k in range(n)] for d, n in enumerate([0, 40, 16, 1])]
    terms = Terms()
    matrix, owner = halves(split, terms)
    assert owner.tolist() == [1, 1, 1, 2, 3]
    for doc, words in enumerate(split):
        flat = matrix[owner == doc].ravel()
        assert flat[:len(words)].tolist() == [terms[w] for w in words] and (flat[len(words):] == NO_TERM).all()
    table = with_no_term(np.random.default_rng(0).normal(0, 1, (NO_TERM, 3)))
    sums = half_sums(matrix, table)
    assert np.allclose(sums[2], sum(table[terms[w]] for w in split[1][32:]), atol=1e-5)


def test_answers():
    weight = np.zeros(decontaminate.TERMS, np.float32)
    index = Index([(1, "What is the capital of it? Paris town"), (2, "a b c d e f")], np.zeros((decontaminate.TERMS, 2), np.float32), weight)
    assert index.answers[0] == {b"paris", b"town"} and len(index.answers[1]) == 2


def test_latent_space_is_fitted_on_all_documents(spark, monkeypatch):
    r = random.Random(5)
    data = [" ".join([f"n{i}", *words(r, 6)]) for i in range(6000)]
    fitted, fit = [], decontaminate.latent_space
    monkeypatch.setattr(decontaminate, "latent_space", lambda rows, weight: fitted.append(rows.count()) or fit(rows, weight))
    table = spark.createDataFrame([(t,) for t in data + data[:50]], "text string")
    bench = spark.createDataFrame([(1, data[17])], "item_id long, text string")
    assert with_leaks(table, bench).where("size(leaks) > 0").count() == 2
    assert fitted == [6000]


def test_items_without_a_latent_vector_are_found_by_words():
    item = " ".join(words(random.Random(4), 20))
    weight = np.ones(decontaminate.TERMS, np.float32)
    index = Index([(3, item)], np.zeros((NO_TERM + 1, 4), np.float32), weight)
    texts = ["some other words " * 9 + item + " and more" * 20, "some other words " * 30, ""]
    assert [[leak[0] for leak in leaks] for leaks in index.leaks(texts)] == [[3], [], []]


def test_sums_by_term():
    r = np.random.default_rng(2)
    matrix = np.minimum(r.geometric(0.02, (300, HALF)), NO_TERM).astype(np.uint16)
    matrix[-1, 3:] = NO_TERM
    product, total = r.normal(0, 1, (300, 5)).astype(np.float32), np.zeros((NO_TERM + 1, 5), np.float32)
    want = np.zeros_like(total)
    np.add.at(want, matrix.ravel(), np.repeat(product, HALF, axis=0))
    decontaminate.add_to_terms(total, matrix, product)
    assert np.allclose(total, want, atol=1e-3)
