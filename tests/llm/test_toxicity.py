"""Toxicity: held-out accuracy, the models' arithmetic and odd input."""

import math
import random
import zlib

import numpy as np
import pytest

from rowmend.llm import toxicity
from rowmend.llm.toxicity import expression_counts, expressions, fit, kneser_ney, logistic, scored, tokens, with_scores

STEMS = ["zork", "blarg", "quimz"]


def corpus(size, seed=0):
    r = random.Random(seed)
    words = ["".join(r.choice(["an", "er", "in", "to", "li", "ve", "sa"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    data, labels = [], []
    for i in range(size):
        text = [r.choice(words) for _ in range(r.randint(5, 60))]
        toxic = int(r.random() < 0.2)
        for _ in range(toxic * r.randint(1, 3)):
            text.insert(r.randrange(len(text)), r.choice(STEMS) + r.choice(["", "an", "er", "in,"]))
        data.append((i, " ".join(text)))
        labels.append((i, toxic))
    return data, labels


@pytest.fixture(scope="module")
def learned(spark):
    data, labels = corpus(1500)
    table = spark.createDataFrame(data, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(0, 1 - labels[0][1]), (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    return table, dict(labels), fit(table, marks)


def test_held_out_documents_are_told_apart(learned):
    table, labels, judge = learned
    got = scored(table, judge).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in held)
    assert len(held) > 200 and right / len(held) > 0.97


def test_odd_documents(learned, docs, no_rows):
    _, _, judge = learned
    table = docs([(1, None), (2, ""), (2, ""), (None, "zorker"), (4, " \n"), (5, "an " * 50_000)])
    got = sorted(((r["doc_id"], r["predicted"]) for r in scored(table, judge).collect()), key=str)
    assert got == [(1, 0), (2, 0), (2, 0), (4, 0), (5, 0), (None, 1)]
    assert scored(no_rows(table), judge).count() == 0
    kept = with_scores(table, judge, score_col="id")
    assert set(kept.columns) == set(table.columns) and kept.where("id >= 0.5").count() == 1


def test_without_both_classes_the_share_is_the_score(spark, docs):
    table = docs([(i, "some words") for i in range(20)])
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in scored(table, fit(table, empty)).collect()} == {0.0}
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    assert {r["score"] for r in scored(table, fit(table, ones)).collect()} == {1.0}
    elsewhere = spark.createDataFrame([(i, i % 2) for i in range(100, 140)], "doc_id long, toxic int")
    assert 0 <= scored(table, fit(table, elsewhere)).first()["score"] <= 1


def test_models_follow_the_definition(spark):
    texts = [("aab abc", 0)] * 6 + [("aac abx", 1)] * 5 + [("bab", 1)]
    counts = expression_counts(spark.createDataFrame(texts, "text string, toxic int"))
    model = kneser_ney(counts)
    grams = {}
    for text, toxic in texts:
        for word in tokens(text):
            for key in expressions([word])[0]:
                grams.setdefault(int(key), [0, 0])[toxic] += 1
    assert {r["key"]: [r["n0"], r["n1"]] for r in counts.collect()} == grams

    def shared(key):
        p = 1 / 256
        for size in range(1, toxicity.ORDER):
            kinds, level = {}, set(grams)
            for smaller in range(toxicity.ORDER - 1, size - 1, -1):
                kinds, longer = {}, level
                for k in longer:
                    short = k & ((1 << 8 * smaller) - 1)
                    kinds[short] = kinds.get(short, 0) + 1
                level = set(kinds)
            here = key & ((1 << 8 * size) - 1)
            same = [k for k in kinds if k >> 8 == here >> 8]
            total = sum(kinds[k] for k in same)
            p = max(kinds[here] - 0.75, 0) / total + 0.75 * len(same) / total * p
        return p

    want = {}
    for key, n in grams.items():
        if sum(n) >= toxicity.RARE:
            logs = []
            for c in (0, 1):
                same = [m[c] for k, m in grams.items() if k >> 8 == key >> 8]
                total, kinds = sum(same), sum(x > 0 for x in same)
                p = max(n[c] - 0.75, 0) / total + 0.75 * kinds / total * shared(key) if total else shared(key)
                logs.append(math.log(p))
            want[key] = logs[1] - logs[0]
    assert dict(zip(model.key.tolist(), model.ratio.tolist())) == pytest.approx(want)


def test_logistic_weights():
    r = np.random.default_rng(0)
    x = r.normal(0, 1, (4000, 2))
    y = (r.random(4000) < 1 / (1 + np.exp(-(x @ [2.0, -1.0] + 0.5)))).astype(float)
    assert logistic(x, y, np.ones(4000)) == pytest.approx([0.5, 2, -1], abs=0.25)
    assert np.isfinite(logistic(x, (x[:, 0] > 0).astype(float), np.ones(4000))).all()
