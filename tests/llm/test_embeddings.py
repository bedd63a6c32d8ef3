"""Vector links against all pairs in double precision."""

import math

import numpy as np
import pytest

from rowmend.llm import embeddings
from rowmend.llm.embeddings import code_product, near_vectors, quantised, tile_links, unit

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, tile string"


def plain(data, threshold=0.93):
    def good(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, root = [0] * len(data), list(range(len(data)))
    for i, (a, v, k) in enumerate(data):
        for j, (b, w, m) in enumerate(data):
            if i < j and a is not None and b is not None and good(v, k) and good(w, m) and k == m and len(v) == len(w):
                x, y = np.array(v, np.float64), np.array(w, np.float64)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    n[i], n[j] = n[i] + 1, n[j] + 1
                    old, new = root[j], root[i]
                    root = [new if r == old else r for r in root]
    least = {r: min((data[i][0] for i in range(len(data)) if root[i] == r and data[i][0] is not None), default=None) for r in root}
    return sorted((d[0], n[i], least[root[i]]) for i, d in enumerate(data) if d[0] is not None)


def fixture(seed=0, size=140):
    r = np.random.default_rng(seed)
    data = []
    for i in range(size):
        if i % 3 and data:
            v = np.array(data[r.integers(len(data))][1], np.float32)
            v = v + r.normal(0, r.choice([0, 0.02, 0.08, 0.1]), len(v))
        else:
            v = r.normal(0, 1, 16)
        data.append((int(1000 - i), [float(x) for x in np.float32(v)], int(i % 2)))
    return data


@pytest.mark.parametrize("tile", [8, 1024])
def test_links_are_all_pairs(rows, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE_ROWS", tile)
    data = fixture()
    got = near_vectors(rows([(*d, 1, "t") for d in data], SCHEMA)).collect()
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in got) == plain(data)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)


def test_odd_vectors_link_with_nothing(rows, no_rows):
    v = [1.0, 2.0, 3.0]
    data = [(9, v, 1), (4, v, 1), (6, v, 2), (5, v, None), (7, None, 1), (8, [0.0, 0.0, 0.0], 1), (10, [1.0, None, 3.0], 1),
            (11, [1.0, float("nan"), 3.0], 1), (12, [1.0, float("inf"), 3.0], 1), (13, [], 1), (14, [1.0, 2.0], 1),
            (15, [2.0, 4.0, 6.0], 1), (16, [1e-30, 2e-30, 3e-30], 1), (17, [1e30, 2e30, 3e30], 1), (18, [-0.0, 0.0, 1.0], 3),
            (19, [0.0, -0.0, 1.0], 3)]
    table = rows([(*d, 1, "t") for d in data], SCHEMA)
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(table).collect()}
    assert got == {r[0]: (r[1], r[2], r[0] == r[2]) for r in plain(data)}
    assert got[4] == (4, 4, True) and got[9] == (4, 4, False) and got[19] == (1, 18, False)
    assert near_vectors(no_rows(table)).count() == 0
    nameless = near_vectors(rows([(None, v, 1, 1, "t"), (1, v, 1, 1, "t")], SCHEMA)).collect()
    assert {(r["id"], r["n_links"], r["kept"]) for r in nameless} == {(None, 0, True), (1, 0, True)}
    with pytest.raises(ValueError):
        near_vectors(table, 0.0)


def test_bounds_hold():
    r = np.random.default_rng(1)
    a, b = unit(r.normal(0, 1, (200, 64)) * r.lognormal(0, 2, (200, 64))), unit(r.normal(0, 1, (150, 64)))
    (qa, sa, ea), (qb, sb, eb) = quantised(a), quantised(b)
    assert np.abs(qa).max() == 127
    error = np.abs(a @ b.T - code_product(qa, qb) * sa[:, None] * sb)
    assert (error <= ea[:, None] * (1 + eb) + eb + 1e-9).all()
    wide = r.integers(-127, 128, (3, 5000)).astype(np.int8)
    assert (code_product(wide, wide) == wide.astype(np.int64) @ wide.astype(np.int64).T).all()
    assert (tile_links(a, a, 0.5) == (a @ a.T >= 0.5)).all()
