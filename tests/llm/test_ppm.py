"""Code lengths against a plain context trie with exclusion."""

import collections
import math
import zlib

import pytest

from rowmend.llm.ppm import ORDER, ppm_scores

TEXTS = ["the cat sat on the mat", "the cat ate the rat", "", None, "ÀÉß the", "mat the", "a", "the the the the", "zq\x00\x01 9",
         "The Cat\tsat\x0bon\x1cit", "the cat sat on the mat", "x" * 3000]


def plain(data, folds=7, fold=2):
    held = [i is not None and zlib.crc32(str(i).encode()) % folds == fold for i, _ in data]
    words = [[*(t or "").encode().lower().split(), None] for _, t in data]
    count = collections.Counter(w for own, h in zip(words, held) if not h for w in own)
    total, kinds = sum(count.values()), len(count)
    after = collections.defaultdict(collections.Counter)
    raw = [b"\xff" * ORDER + (t or "").encode() + b"\xfe" for _, t in data]
    for s, h in zip(raw, held):
        for at in range(ORDER, len(s) * (not h)):
            for size in range(ORDER + 1):
                after[s[at - size:at]][s[at]] += 1

    def log10(context, symbol):
        out, excluded = 0.0, set()
        for size in range(ORDER, -1, -1):
            met = {k: v for k, v in after.get(context[ORDER - size:], {}).items() if k not in excluded}
            if not met:
                continue
            whole = 2 * sum(met.values())
            if symbol in met:
                return out + math.log10((2 * met[symbol] - 1) / whole)
            out += math.log10(len(met) / whole)
            excluded |= set(met)
        return out - math.log10(256 - len(excluded))

    for (i, _), own, s, h in zip(data, words, raw, held):
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in own)
        score = sum(log10(s[at - ORDER:at], s[at]) for at in range(ORDER, len(s)))
        yield i, h, len(own), sum(count[w] > 0 for w in own), total, base, score


def scored(rows, data, **options):
    table = rows([(i, t, "k", 1, 2) for i, t in data], "doc_id long, text string, key string, n long, block int")
    return ppm_scores(table, **options).collect()


def ordered(found):
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[6]))


@pytest.mark.parametrize("block_bytes", [64, 1 << 20])
def test_scores_are_those_of_the_trie(rows, block_bytes):
    data = [(n * 3, t) for n, t in enumerate(TEXTS * 3)] + [(None, "the cat"), (6, TEXTS[2]), (6, TEXTS[2])]
    got, want = ordered(scored(rows, data, block_bytes=block_bytes)), ordered(plain(data))
    assert any(r[1] for r in want) and len(got) == len(want)
    for a, b in zip(got, want):
        assert tuple(a)[:5] == b[:5]
        assert tuple(a)[5:] == pytest.approx(b[5:])


def test_nothing_learnt_and_nothing_to_score(rows, no_rows):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    data = [(i, "abc") for i in held]
    for row, want in zip(ordered(scored(rows, data)), ordered(plain(data))):
        assert tuple(row) == pytest.approx(want)
    table = rows([(1, "a")], "doc_id long, text string")
    assert ppm_scores(no_rows(table)).count() == 0


def test_probabilities_add_up(rows):
    """Every next symbol after a context, each in a held-out text, together with the end."""
    held = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 7 == 2]
    symbols = [bytes([b]).decode("latin-1") for b in range(128)]
    base = [(i, t) for i, t in enumerate(["abab", "abba", "ab"]) if i not in held]
    data = base + list(zip(held, ["ab" + s for s in symbols])) + [(held[200], "ab")]
    score = {r["doc_id"]: r for r in scored(rows, data)}
    want = {r[0]: r[6] for r in plain(data)}
    assert all(r["score"] == pytest.approx(want[i]) for i, r in score.items())
