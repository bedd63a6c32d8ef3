"""Hard negatives by a secondary sort: one descending stream of scores for each anchor.

Scores are computed in tiles, a block of anchors against a part of the rows. A first pass leaves
the best positives of every anchor. A second one knows from them which scores an anchor can use
at all: of each tile, the first few of each positive's window, for what is not among the first
of its tile is not among the first of all. These scores and the positives are dealt by anchor
and sorted by (anchor, descending score, id). A task then reads its part as one stream: a
positive opens its window, each following score goes to the windows it lies in, and nothing is
kept of an anchor but its open windows. `repartition` with `sortWithinPartitions` is the table
form of repartitionAndSortWithinPartitions: the shuffle sorts, with spilling, and no group is
ever held as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmend.llm.common import pick
from rowmend.sources.workspace import written

TILE_ROWS, BLOCK_ANCHORS = 1 << 14, 1 << 14
# Scores in hand at once within a tile.
STRIPE = 1 << 22
UNITS = 256
EXACT = 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1
FOUND = "anchor long, anchor_id long, row long, id long, score long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class ScoreWindow:
    """Negatives a positive accepts: low * positive <= scale * negative <= high * positive."""

    low: int = 30
    high: int = 90
    scale: int = 100

    def bounds(self, positive: int) -> tuple[int, int]:
        """Smallest and largest whole score within; the first is above the second if there is none."""
        return -((-self.low * positive) // self.scale), self.high * positive // self.scale


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x): doubles where they are exact, else Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(UNITS * vectors)
    if not len(vectors) or np.abs(scaled).max(initial=0) < EXACT:
        return scaled
    # Doubles this large are whole already.
    exact = [math.floor(UNITS * x) if abs(x) < EXACT / UNITS else UNITS * int(x) for x in vectors.ravel().tolist()]
    return np.array(exact, object).reshape(vectors.shape)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; beyond 64 bits they stand at the end of the range."""
    if a.dtype != object and b.dtype != object:
        if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1) < EXACT:
            return (a @ b.T).astype(np.int64)
    left, right = ([[int(x) for x in row] for row in m.tolist()] for m in (a, b))
    return np.array([[min(MOST, max(LEAST, sum(map(int.__mul__, x, y)))) for y in right] for x in left],
                    np.int64).reshape(len(left), len(right))


def vectors_of(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return whole_numbers(flat.reshape(len(column), -1))


Choice = Callable[[np.ndarray, np.ndarray, np.ndarray, tuple[int, ...]], np.ndarray]


def best_positives(count: int) -> Choice:
    """Places of the first `count` scores of the anchor's own label."""
    def choose(score: np.ndarray, same: np.ndarray, other: np.ndarray, _: tuple[int, ...]) -> np.ndarray:
        at = np.flatnonzero(same & other)
        return at[np.argsort(~score[at], kind="stable")[:count]]

    return choose


def usable_negatives(window: ScoreWindow, count: int) -> Choice:
    """Places of the first `count` scores of other labels in any window of the anchor's positives."""
    def choose(score: np.ndarray, same: np.ndarray, _: np.ndarray, positives: tuple[int, ...]) -> np.ndarray:
        bounds = [window.bounds(p) for p in positives]
        low, high = min(b[0] for b in bounds), max(b[1] for b in bounds)
        at = np.flatnonzero(~same & (score >= low) & (score <= high))
        at = at[np.argsort(~score[at], kind="stable")]
        falling = ~score[at]
        taken = np.zeros(len(at), bool)
        for low, high in bounds:
            first, last = np.searchsorted(falling, ~high), np.searchsorted(falling, ~low, "right")
            taken[first:max(first, min(last, first + count))] = True
        return at[taken]

    return choose


def tile_scores(anchors: pa.Table, rows: pa.Table, choose: Choice) -> pa.Table:
    """The chosen scores of some anchors against a part of the rows."""
    names = ["anchor", "anchor_id", "row", "id", "score"]
    if not len(anchors) or not len(rows):
        return pa.table([pa.array([], pa.int64())] * 5, names=names)
    # Stable sorts of scores then leave equal ones in order of id.
    rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
    labels = pa.chunked_array([*anchors["label"].chunks, *rows["label"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
    own_label, label = labels[:len(anchors)], labels[len(anchors):]
    own_row, own_id = anchors["row"].to_numpy(), anchors["id"].to_numpy()
    row, number = rows["row"].to_numpy(), rows["id"].to_numpy()
    positives = anchors["positives"].to_pylist()
    a, b = vectors_of(anchors["vector"]), vectors_of(rows["vector"])
    out: list[tuple[np.ndarray, ...]] = []
    step = max(1, STRIPE // max(1, len(rows)))
    for start in range(0, len(anchors), step):
        scores = inner_products(a[start:start + step], b)
        for n, score in enumerate(scores, start):
            at = choose(score, label == own_label[n], row != own_row[n], positives[n])
            out.append((np.full(len(at), own_row[n]), np.full(len(at), own_id[n]), row[at], number[at], score[at]))
    return pa.table([np.concatenate(x).astype(np.int64) for x in zip(*out)], names=names)


def dealt(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def every(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))


def scored_tiles(anchors: DataFrame, rows: DataFrame, blocks: int, tiles: int, choose: Choice) -> DataFrame:
    """Chosen scores of every anchor against every row of equal length, one task a block and tile."""
    keys = ["dims", "block", "tile"]
    names = [*keys, "row", "id", "label", "vector"]
    left = anchors.withColumn("block", dealt("row", blocks)).withColumn("tile", every(tiles)).select(*names, "positives")
    right = rows.withColumn("tile", dealt("row", tiles)).withColumn("block", every(blocks))
    # New columns, for both sides come from one table.
    right = right.select(*[F.col(c).alias(c) for c in names])
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(lambda a, b: tile_scores(a, b, choose), FOUND)


def first_scores(found: DataFrame, count: int) -> DataFrame:
    """The first scores of every anchor, higher ones first, equal ones by id."""
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).drop("place")


def mined_from_stream(stream: DataFrame, window: ScoreWindow, count: int) -> DataFrame:
    """Rows of MINED from scores sorted by (anchor, descending score, positives first, id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, opened = None, []
        for batch in batches:
            out = []
            for anchor, anchor_id, negative, number, score in zip(*(c.to_pylist() for c in batch.columns)):
                if anchor != current:
                    current, opened = anchor, []
                if not negative:
                    opened.append([number, score, *window.bounds(score), 0])
                    continue
                for open_window in opened:
                    positive_id, positive, low, high, given = open_window
                    if low <= score <= high and given < count:
                        open_window[4] = given + 1
                        out.append((anchor_id, positive_id, given + 1, number, positive, score))
                # A full window, or one the falling scores have left, needs no more.
                opened = [w for w in opened if w[4] < count and score >= w[2]]
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return stream.mapInArrow(run, MINED)


def hard_negatives(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", positives: int = 5, negatives: int = 10,
                   window: ScoreWindow = ScoreWindow(), tile_rows: int = TILE_ROWS,
                   block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), one row per negative.

    Scores are integer inner products of floor(256 x). An anchor's positives are its first
    `positives` other rows of its label, higher scores first and equal ones by smaller id; for
    each of them come the first `negatives` rows of other labels whose score lies in its window.
    Rows with a null id, label or vector, or a null or non-finite component, take no part;
    vectors of unequal length have no score. Rows that repeat are rows of their own, so a copy of
    an anchor is its positive, and anchors too if they are anchors. Scores beyond 64 bits stand at the end of the range.
    `is_anchor` is a condition on the columns of `df`; null is no. Other columns are not read,
    and an empty table gives an empty result.
    """
    chosen = df.withColumn("__anchor", F.coalesce(is_anchor, F.lit(False)))
    picked = pick(chosen, id=id_col, vector=vector_col, label=label_col, is_anchor="__anchor")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = picked.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    # Written, for the number of a row must not change between reads.
    rows = written(usable.withColumns({
        "id": F.col("id").cast("long"), "row": F.monotonically_increasing_id(), "dims": F.size("vector")}), "vectors")
    total, chosen_rows = rows.agg(F.count("*"), F.count_if("is_anchor")).first()
    tiles, blocks = max(1, math.ceil(total / tile_rows)), max(1, math.ceil(chosen_rows / block_anchors))
    anchors = rows.where("is_anchor")
    none = F.array().cast("array<long>")
    near = scored_tiles(anchors.withColumn("positives", none), rows, blocks, tiles, best_positives(positives))
    # Read twice below; a positive below zero has an empty window.
    best = written(first_scores(near, positives).where("score >= 0"), "positives")
    known = best.groupBy("anchor").agg(F.collect_list("score").alias("positives"))
    ready = anchors.join(known, anchors["row"] == known["anchor"]).drop("anchor")
    far = scored_tiles(ready, rows, blocks, tiles, usable_negatives(window, negatives))
    together = best.withColumn("negative", F.lit(False)).unionByName(far.withColumn("negative", F.lit(True)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = together.select("anchor", "anchor_id", "negative", "id", "score")
    stream = keyed.repartition(parts, "anchor").sortWithinPartitions("anchor", F.desc("score"), "negative", "id")
    return mined_from_stream(stream.select("anchor", "anchor_id", "negative", "id", "score"), window, negatives)
