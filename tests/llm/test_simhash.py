"""SimHash groups against a plain definition."""

import random

import numpy as np
import pytest
import xxhash

from rowmend.llm import simhash
from rowmend.llm.components import connected
from rowmend.llm.simhash import ball_links, fingerprints, local_roots, masks, simhash_groups


def plain_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def plain_groups(values, radius):
    """Smallest position reachable, over all pairs."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if bin((a ^ values[j]) & (1 << 64) - 1).count("1") <= radius:
                a_, b_ = sorted((find(i), find(j)))
                root[b_] = a_
    return [find(i) for i in range(len(values))]


def near_values(seed, groups=40, size=12):
    """Random centres with members a few bits off, in chains beyond the radius."""
    r = random.Random(seed)
    values = []
    for _ in range(groups):
        value = r.getrandbits(64)
        for _ in range(r.randint(1, size)):
            values.append(value)
            for _ in range(r.randint(0, 4)):
                value ^= 1 << r.randrange(64)
    return [v - (1 << 64) if v >> 63 else v for v in values]


def test_fingerprints_follow_the_definition(docs):
    texts = ["", None, " \t\n", "One", "one two three", "A b c d", "ÀÉ b C d e", "w " * 70_000 + "x", "a\x0bb\x0cc d\x1ce f"]
    got = dict(fingerprints(docs(list(enumerate(texts)))).collect())
    for number, text in enumerate(texts):
        if text is None or len(text) < 1000:
            assert got[number] == plain_fingerprint(text)
    assert got[7] == simhash.simhash(texts[7], 4) != 0


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_links_connect_what_is_near_and_nothing_else(spark, radius):
    values = sorted(set(near_values(radius)))
    table = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    links = ball_links(table, radius).collect()
    want = plain_groups(values, radius)
    root = list(range(len(values)))
    place = {v: i for i, v in enumerate(values)}
    for _ in values:
        for link in links:
            a, b = place[link["a"]], place[link["b"]]
            root[a] = root[b] = min(root[a], root[b])
    assert len(set(want)) == len(set(root))
    assert [want[i] for i in root] == want


def test_crowded_buckets_give_the_same_groups(spark, docs, monkeypatch):
    values = near_values(9, groups=20)
    table = spark.createDataFrame([(v,) for v in sorted(set(values))], "fingerprint long")
    plain = {tuple(sorted(r)) for r in connected(ball_links(table, 4)).collect()}
    monkeypatch.setattr(simhash, "MOST_ROWS", 30)
    monkeypatch.setattr(simhash, "MEAN_ROWS", 64)
    assert {tuple(sorted(r)) for r in connected(ball_links(table, 4)).collect()} == plain
    monkeypatch.setattr(simhash, "HELD_VARIANTS", 5000)
    assert {tuple(sorted(r)) for r in connected(ball_links(table, 4)).collect()} == plain


def test_groups_of_documents(docs, no_rows):
    long = " ".join(f"w{i}" for i in range(400))
    data = [(5, long), (3, long), (9, long.upper()), (4, "other words here now"), (7, ""), (2, None), (None, long),
            (4, "other words here now"), (8, long + " tail")]
    table = docs(data)
    got = {(r["id"], r["component_id"]) for r in simhash_groups(table).collect()}
    assert {(5, 3), (3, 3), (9, 3), (4, 4), (7, 2), (2, 2), (None, 3)} <= got
    assert simhash_groups(table).count() == len(data)
    assert simhash_groups(no_rows(table)).count() == 0
    with pytest.raises(ValueError):
        simhash_groups(table, radius=3)


def test_masks_and_local_roots():
    assert len(masks(64, 2)) == 1 + 64 + 64 * 63 // 2
    assert masks(3, 3) and len(set(masks(3, 3))) == 8
    variant, index = np.array([0, 0, 1, 1, 2, 2]), np.array([4, 3, 3, 1, 0, 2])
    assert local_roots(variant, index, 6).tolist() == [0, 1, 0, 1, 1, 5]


def test_components(rows):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (7, 7), (None, 3), (300, 200), (500, 400)]
    got = dict(connected(rows(chain, "a long, b long")).collect())
    want = {i: 0 for i in range(1, 61)} | {200: 100, 300: 100, 500: 400}
    assert got == want
    assert connected(rows([], "a long, b long")).count() == 0
    star = [(0, i) for i in range(1, 300)]
    assert dict(connected(rows(star, "a long, b long")).collect()) == {i: 0 for i in range(1, 300)}


@pytest.mark.parametrize("rows_a_task", [64, 1])
def test_only_verified_copies_go(spark, monkeypatch, rows_a_task):
    monkeypatch.setattr(simhash, "GROUP_ROWS", rows_a_task)
    r = random.Random(6)
    base = [f"w{r.randrange(10 ** 6)}" for _ in range(200)]
    near = [*base[:100], "changed", *base[101:]]
    far = [*base[:100], *(f"v{i}" for i in range(100))]
    other = [f"u{i}" for i in range(200)]
    data = [("c", 2, base), ("c", 5, near), ("c", 1, far), ("c", 7, far[:199]), ("c", 3, other), ("d", 1, []), ("d", None, [])]
    table = spark.createDataFrame([(c, (i is None, i), f"k{n}", " ".join(t)) for n, (c, i, t) in enumerate(data)],
                                  "component string, rank struct<none: boolean, id: long>, key string, text string")
    assert sorted(r["key"] for r in simhash.verified_copies(table).collect()) == ["k1", "k3", "k6"]


def test_a_large_group_takes_rounds_by_parts_not_by_members(spark, monkeypatch):
    """Variations of one text, about 0.8 alike, so that many stay; some are empty, some ids are missing."""
    r = random.Random(12)
    base, rows = [f"w{i}" for i in range(60)], []
    for n in range(120):
        words = [f"v{r.randrange(9)}" if r.random() < 0.02 else w for w in base] if n % 20 else []
        rows.append(("c", (n % 7 == 0, None if n % 7 == 0 else r.randrange(1000)), f"k{n:03}", " ".join(words) + " " * n))
    rows += [("d", (False, 1), "x", "alone"), *[("e", (False, n), f"e{n}", f"unlike {n} " * 9) for n in range(3)]]
    kept, want = {}, []
    for component, rank, key, text in sorted(rows, key=lambda row: (row[0], row[1][0], row[1][1] or 0, row[2])):
        own = simhash.shingle_set(text)
        copy = any(len(np.intersect1d(own, k)) >= 0.8 * len(np.union1d(own, k)) for k in kept.setdefault(component, []))
        want.append(key) if copy else kept[component].append(own)
    assert len(want) > 20 and len(kept["c"]) > 40 and len(kept["e"]) == 3
    monkeypatch.setattr(simhash, "GROUP_ROWS", 30)
    monkeypatch.setattr(simhash, "GROUP_CHARS", 30 << 10)
    tables = []
    monkeypatch.setattr(simhash, "written", lambda df, label, f=simhash.written: tables.append(label) or f(df, label))
    table = spark.createDataFrame(rows, "component string, rank struct<none: boolean, id: long>, key string, text string")
    assert sorted(row["key"] for row in simhash.verified_copies(table).collect()) == sorted(want)
    assert 2 <= tables.count("settled") <= 8 and len(tables) < 45
