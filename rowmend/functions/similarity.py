"""Name similarity: Jaro-Winkler over Arrow batches, and a simplified Soundex.

Spark has no Jaro-Winkler, so it is the one Python boundary here. The function works on
whole batches with numpy: one loop over character positions, never one over rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Fixed values of the Jaro-Winkler definition.
PREFIX_LENGTH, PREFIX_WEIGHT, PREFIX_THRESHOLD = 4, 0.1, 0.7
CELLS_PER_BLOCK = 4_000_000


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded matrix of code points and the length of each text."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    width = max(int(lengths.max(initial=0)), 1)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(texts), width), np.uint32)
    out[np.arange(width) < lengths[:, None]] = flat
    return out, lengths


def _in_order(chars: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Matched characters moved to the front of each row, order kept."""
    order = np.argsort(~taken, axis=1, kind="stable")
    return np.take_along_axis(np.where(taken, chars, 0), order, axis=1)


def _jaro_winkler_block(left: list[str], right: list[str]) -> np.ndarray:
    a, len_a = _code_points(left)
    b, len_b = _code_points(right)
    window = np.maximum(np.maximum(len_a, len_b) // 2 - 1, 0)
    positions = np.arange(b.shape[1])
    inside = positions < len_b[:, None]
    free = inside.copy()
    taken_a = np.zeros(a.shape, bool)
    rows = np.arange(len(left))
    for i in range(a.shape[1]):
        near = np.abs(positions - i) <= window[:, None]
        open_hits = free & near & (b == a[:, i, None]) & (i < len_a)[:, None]
        where = open_hits.argmax(axis=1)
        hit = open_hits[rows, where]
        taken_a[:, i] = hit
        free[rows[hit], where[hit]] = False
    matches = taken_a.sum(axis=1)
    shared = min(a.shape[1], b.shape[1])
    seen_a, seen_b = _in_order(a, taken_a), _in_order(b, inside & ~free)
    swaps = (seen_a[:, :shared] != seen_b[:, :shared]).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (matches / len_a + matches / len_b + (matches - swaps) / matches) / 3.0
    jaro = np.where(matches > 0, jaro, 0.0)
    head = min(PREFIX_LENGTH, shared)
    valid = (np.arange(head) < np.minimum(len_a, len_b)[:, None]) & (a[:, :head] == b[:, :head])
    prefix = np.logical_and.accumulate(valid, axis=1).sum(axis=1)
    return np.where(jaro > PREFIX_THRESHOLD, jaro + prefix * PREFIX_WEIGHT * (1.0 - jaro), jaro)


def jaro_winkler_batch(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Similarity in [0, 1] per pair; blocks of similar length bound the working memory."""
    pairs = pd.MultiIndex.from_arrays([left, right])
    codes, distinct = pd.factorize(pairs)
    firsts, seconds = distinct.get_level_values(0).tolist(), distinct.get_level_values(1).tolist()
    longest = np.array([max(len(x), len(y)) for x, y in zip(firsts, seconds)], np.int64)
    order = np.argsort(longest, kind="stable")
    scores = np.zeros(len(firsts))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop - start + 1) * max(longest[order[stop]], 1) <= CELLS_PER_BLOCK:
            stop += 1
        block = order[start:stop]
        scores[block] = _jaro_winkler_block([firsts[k] for k in block], [seconds[k] for k in block])
        start = stop
    return scores[codes]


@F.pandas_udf(DoubleType())
def jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity; null when either side is null or empty."""
    ok = (left.fillna("") != "") & (right.fillna("") != "")
    out = pd.Series(np.nan, index=left.index, dtype="float64")
    if ok.any():
        out[ok] = jaro_winkler_batch(left[ok], right[ok])
    return out.astype(object).where(ok, None)


@F.pandas_udf(DoubleType())
def percent_one_decimal(similarity: pd.Series) -> pd.Series:
    """Similarity as a percentage with one decimal, rounded on the exact binary value.

    Only values next to a tie can round otherwise by their tenfold, and are looked at singly.
    """
    percent = similarity.to_numpy(dtype="float64") * 100.0
    tenfold = percent * 10.0
    out = np.rint(tenfold) / 10.0
    for k in np.flatnonzero(np.abs(tenfold - np.floor(tenfold) - 0.5) < 1e-6):
        out[k] = round(percent[k], 1)
    return pd.Series(out, dtype=object).where(~np.isnan(out), None)


# Letters and their Soundex codes; all others break a run and are dropped.
SOUNDEX_LETTERS = "BFPVCGJKQSXZDTLMNRAEIOUYHW"
SOUNDEX_CODES = "11112222222233455600000000"


def simple_soundex(c: Column) -> Column:
    """First letter plus three codes. Unlike the built-in, H and W separate equal codes,
    and the first letter's own code is not compared."""
    letters = F.regexp_replace(F.upper(c), "[^A-Z]", "")
    codes = F.translate(F.substring(letters, 2, 2**31 - 1), SOUNDEX_LETTERS, SOUNDEX_CODES)
    runs = F.translate(F.regexp_replace(codes, r"(\d)\1+", "$1"), "0", "")
    code = F.rpad(F.concat(F.left(letters, F.lit(1)), runs), 4, "0")
    return F.when(letters == "", F.lit("")).otherwise(code)
