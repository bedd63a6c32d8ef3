"""Hard negatives against a plain definition."""

import math
import random

import numpy as np
import oracle
from pyspark.sql import functions as F

from rowmend.llm.negatives import hard_negatives, inner_products, whole_numbers
from rowmend.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<double>, label string, anchor boolean, id long, score long, row long, block string"


def brute(rows, positives=5, negatives=10):
    """By the definition, over (vec_id, vector, label, anchor) rows."""
    kept = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None
            and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [[math.floor(x * 256) if abs(x) < 1e15 else int(x) * 256 for x in r[1]] for r in kept]
    found = []
    for i, a in enumerate(kept):
        if not a[3]:
            continue
        scored = sorted((-sum(x * y for x, y in zip(whole[i], whole[j])), b[0], b[2]) for j, b in enumerate(kept)
                        if i != j and len(whole[i]) == len(whole[j]))
        for p_score, p_id, _ in [s for s in scored if s[2] == a[2]][:positives]:
            window = [s for s in scored if s[2] != a[2] and 30 * -p_score <= 100 * -s[0] <= 90 * -p_score][:negatives]
            found += [(a[0], p_id, n, s[1], -p_score, -s[0]) for n, s in enumerate(window, 1)]
    return sorted(found)


def mined(spark, rows, **options):
    full = [(n, v and [x if x is None else float(x) for x in v], label, anchor, 1, 2, 3, "b") for n, v, label, anchor in rows]
    table = spark.createDataFrame(full, SCHEMA)
    return sorted(map(tuple, hard_negatives(table, F.col("anchor"), **options).collect()))


def drawn(seed, count, dims=4, spread=2.0):
    draw = random.Random(seed)
    return [(n, [draw.uniform(-1, spread) for _ in range(dims)], draw.choice("abc"), draw.random() < 0.3) for n in range(count)]


def test_like_the_definition_with_many_tiles(spark):
    rows = drawn(1, 150)
    assert mined(spark, rows, tile_rows=40, block_anchors=10) == brute(rows)
    assert mined(spark, rows) == brute(rows)


def test_ties_copies_and_zero_scores(spark):
    rows = [(n % 40, [float(n % 3), 0.0, 1.0 if n % 2 else 0.0], "ab"[n % 5 == 0], n % 4 == 0) for n in range(120)]
    rows += [(n, [0.0, 0.0, 0.0], "ab"[n % 2], n % 3 == 0) for n in range(200, 240)]
    assert mined(spark, rows, tile_rows=16, block_anchors=8) == brute(rows)


def test_one_vector_held_by_most_rows(spark):
    rows = [(n, [0.5, 0.5], "a" if n % 3 else "b", n % 50 == 0) for n in range(300)]
    rows += [(n, [0.2 + n % 7 / 50, 0.3], "c", n % 50 == 0) for n in range(300, 400)]
    assert mined(spark, rows, tile_rows=64, block_anchors=4) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [*drawn(3, 30), (None, [1.0, 1, 1, 1], "a", True), (31, None, "a", True), (32, [1.0, 1, 1, 1], None, True),
            (33, [1.0, None, 1, 1], "a", True), (34, [nan, 1.0, 1, 1], "a", True), (35, [inf, 1.0, 1, 1], "a", True),
            (36, [1.0, 1.0], "a", True), (37, [1.0, 2.0], "a", True), (38, [0.7, 0.8], "b", None), (39, [], "a", True), (40, [], "b", True)]
    assert mined(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert mined(spark, []) == []


def test_large_components_are_exact(spark):
    rows = drawn(4, 25, dims=3, spread=3e5) + [(99, [4e6, 3e6, 2e6], "a", True), (98, [5e6, 3e6, 2e6], "a", True), (97, [3e6, 1e6, 1e6], "b", False)]
    assert mined(spark, rows) == brute(rows)
    assert inner_products(whole_numbers(np.array([[1e300]])), whole_numbers(np.array([[-1e300]])))[0, 0] == -(1 << 63)


def test_query_like_sql(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        got = QUERIES["op12_hard_negatives"](spark, folder)
        assert got.count()
        assert oracle.differences(got, oracle.connect(folder), ORACLES["op12_hard_negatives"]) == []
