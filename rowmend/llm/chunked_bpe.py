"""Byte-level BPE by overlapping chunks: cut in parallel, stitched, then encoded.

Texts longer than a chunk are dealt over the cluster as overlapping chunks. Every chunk is cut
into words as if it were a text of its own; near its borders the cuts may be wrong. Two
neighbours resynchronise at the first cut of their overlap that both have made, away from the
end of the first and not after white space: from there on the second one is right. Where no such cut is found, the two
stay together. The stretches between the stitches are encoded in parallel and their ids put
together again. A text of one chunk needs no stitch and is encoded where it lies.
"""

from __future__ import annotations

import base64
import heapq
from array import array as pack
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmend.columns import named
from rowmend.llm.common import appended, slices
from rowmend.llm.pretokens import (
    REACH, character_classes, cut_words, gathered, is_white, list_column, rank_file_matches, spread_out, starts_of,
)
from rowmend.sources.workspace import written

CHUNK, OVERLAP = 1 << 15, 1 << 10
SLICE = 3 << 18
# Words whose ids a worker remembers; forgetting costs time only.
REMEMBERED_WORDS = 200_000
# Beyond this many bytes a word is merged with a queue.
SHORT_WORD = 100
IDS = T.ArrayType(T.IntegerType())


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes; the file's size is the vocabulary's, whatever the corpus."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class RankedBpe:
    """A vocabulary of ranked byte sequences: ranks are ids, and lower ranks merge first."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray):
        self.ranks, self.classes = ranks, classes

    @cached_property
    def remembered(self) -> dict[bytes, bytes]:
        return {}

    @cached_property
    def flat_tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all ids, where each starts, its size); a last empty one stands for unknown ids."""
        pieces = [b""] * (max(self.ranks.values(), default=-1) + 2)
        for token, rank in self.ranks.items():
            pieces[rank] = token
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word: the lowest ranked pair merges first, the leftmost of equal ones."""
        if word in self.ranks:
            return [self.ranks[word]]
        return self.merged_by_scan(word) if len(word) <= SHORT_WORD else self.merged_by_queue(word)

    def merged_by_scan(self, word: bytes) -> list[int]:
        """For short words: look through all pairs for each merge."""
        rank, none = self.ranks.get, len(self.ranks)
        starts = list(range(len(word) + 1))
        pairs = [rank(word[i:i + 2], none) for i in starts[:-2]]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            at = pairs.index(best)
            del starts[at + 1], pairs[at]
            if at < len(pairs):
                pairs[at] = rank(word[starts[at]:starts[at + 2]], none)
            if at:
                pairs[at - 1] = rank(word[starts[at - 1]:starts[at + 1]], none)
        return [self.ranks[word[a:b]] for a, b in zip(starts, starts[1:])]

    def merged_by_queue(self, word: bytes) -> list[int]:
        """For words of any length, in not much more than linear time."""
        ranks, count = self.ranks, len(word)
        # Parts are named by where they begin; `end` is 0 for one that was merged away.
        end, before = list(range(1, count + 1)), list(range(-1, count - 1))
        queue = [(ranks[word[i:i + 2]], i, i + 2) for i in range(count - 1) if word[i:i + 2] in ranks]
        heapq.heapify(queue)
        while queue:
            _, at, stop = heapq.heappop(queue)
            middle = end[at]
            if not middle or middle >= count or end[middle] != stop:
                continue
            end[at], end[middle] = stop, 0
            if stop < count:
                before[stop] = at
            for first, last in ((before[at], stop), (at, end[stop] if stop < count else 0)):
                rank = ranks.get(word[first:last]) if first >= 0 and last else None
                if rank is not None:
                    heapq.heappush(queue, (rank, first, last))
        ids, at = [], 0
        while at < count:
            ids.append(ranks[word[at:end[at]]])
            at = end[at]
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text in them)."""
        words = cut_words(texts, self.classes)
        known = self.remembered
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        for word in words.distinct:
            if word not in known:
                known[word] = pack("i", self.merged(word)).tobytes()
        return gathered([*map(known.__getitem__, words.distinct)], words.index, words.ends)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, end of each text in them); ids outside the vocabulary give nothing."""
        flat, start, size = self.flat_tokens
        known = np.where((ids < 0) | (ids >= len(size)), len(size) - 1, ids)
        return spread_out(flat, start, size, known, ends)


def load_ranks(path: str) -> RankedBpe:
    return RankedBpe(read_ranks(path), character_classes(rank_file_matches))


def to_workers(spark: SparkSession, bpe: RankedBpe) -> Callable[[], RankedBpe]:
    """One vocabulary for each worker; what it remembers outlives the task."""
    shared = spark.sparkContext.broadcast({"ranks": bpe.ranks, "classes": bpe.classes})

    def own() -> RankedBpe:
        held: dict[str, Any] = shared.value
        if "built" not in held:
            held["built"] = RankedBpe(held["ranks"], held["classes"])
        return held["built"]

    return own


def overlapping(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, k, text): chunks of `chunk` characters that reach `overlap` into the next."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                places = range(0, len(text), chunk)
                for some in (places[i:i + 64] for i in range(0, len(places), 64)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(some), pa.int64()), pa.array([p // chunk for p in some], pa.int64()),
                         pa.array([text[p:p + chunk + overlap] for p in some], pa.string())], ["row", "k", "text"])

    return rows.mapInArrow(run, "row long, k long, text string")


def border_cuts(chunks: DataFrame, built: Callable[[], RankedBpe], chunk: int, overlap: int) -> DataFrame:
    """(row, k, head, tail): word starts in the overlaps of a chunk, from where each overlap begins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices((t.as_py() for t in batch.column(2)), SLICE):
                _, points, ends, start = starts_of(texts, built().classes)
                # White space that a stretch ended with would be cut in another way.
                start[1:] &= ~is_white(points[:-1], built().classes)
                heads, tails = [], []
                for text, end in zip(texts, ends):
                    own = start[end - len(text):end]
                    heads.append(np.flatnonzero(own[:overlap]))
                    tails.append(np.flatnonzero(own[chunk:max(chunk, len(text) - REACH)]))
                part = batch.slice(at, len(texts))
                lists = [list_column(np.concatenate(x), np.cumsum([len(y) for y in x])) for x in (heads, tails)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *lists], ["row", "k", "head", "tail"])
                at += len(texts)

    return chunks.mapInArrow(run, "row long, k long, head array<int>, tail array<int>")


def stitches(borders: DataFrame, chunk: int) -> DataFrame:
    """(row, starts): where the stretches of a text begin, each a word start both neighbours agree on."""
    by_place = Window.partitionBy("row").orderBy("k")
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(by_place)))
    place = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.col("k") * chunk + common)
    return borders.select("row", place.alias("at")).where("at IS NOT NULL").groupBy("row").agg(
        F.sort_array(F.collect_list("at")).alias("starts"))


def stretches(rows: DataFrame) -> DataFrame:
    """(row, k, text) between the stitches of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, starts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text, starts = text.as_py(), starts.as_py()
                edges = [*starts, len(text)]
                for i in range(0, len(starts), 64):
                    some = list(zip(edges[i:i + 64], edges[i + 1:i + 65]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(some), pa.int64()), pa.array(range(i, i + len(some)), pa.int64()),
                         pa.array([text[a:b] for a, b in some], pa.string())], ["row", "k", "text"])

    return rows.mapInArrow(run, "row long, k long, text string")


def bytes_column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
    return column.cast(pa.binary())


def encode_texts(df: DataFrame, bpe: RankedBpe, text_col: str = "text", ids_col: str = "token_ids",
                 bytes_col: str | None = None, keep: list[str] | None = None, chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """Token ids of a text column beside the `keep` columns (all by default), whole texts.

    Special tokens are read as plain text. With `bytes_col` the bytes decoded from the ids are
    appended too. Null and empty texts have no ids. Columns that already have the names of the
    results are replaced; other columns and repeated rows stay as they are, an empty table stays
    empty. Rows come out in no particular order.
    """
    built = to_workers(df.sparkSession, bpe)
    new = {"ids": IDS} | ({"bytes": T.BinaryType()} if bytes_col else {})
    kept = [named(c) for c in (df.columns if keep is None else keep) if c not in (ids_col, bytes_col)]
    # Other columns travel as one, so that their names cannot clash.
    rows = df.select(F.struct(*kept).alias("others"), named(text_col).alias("text"))

    def work(column: pa.Array, decoding: bool) -> Iterator[tuple[int, list[pa.Array]]]:
        for texts in slices((t.as_py() for t in column), SLICE):
            ids, ends = built().encode(texts)
            yield len(texts), [list_column(ids, ends), *([bytes_column(*built().decode(ids, ends))] if decoding else [])]

    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    one = appended(rows.where(~is_long), "text", new, lambda c: work(c, bytes_col is not None))
    # Written, for the number of a row must not change between reads.
    long = written(rows.where(is_long).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    chunks = overlapping(long.select("row", "text"), chunk, overlap).repartition("row", "k")
    starts = stitches(border_cuts(chunks, built, chunk, overlap), chunk)
    parts = stretches(long.join(starts, "row").select("row", "text", "starts")).repartition("row", "k")
    encoded = appended(parts, "text", {"ids": IDS}, lambda c: work(c, False)).select("row", "k", "ids")
    whole = encoded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    several = long.join(whole.select("row", F.flatten("parts.ids").alias("ids")), "row").select("others", "ids")
    if bytes_col:
        several = decode_ids(several, bpe, "ids", "bytes")
    out = one.select("others", *new).unionByName(several)
    result = [F.col("ids").alias(ids_col), *([F.col("bytes").alias(bytes_col)] if bytes_col else [])]
    return out.select("others.*", *result)


def decode_ids(df: DataFrame, bpe: RankedBpe, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """Append the bytes of a column of token ids, as they are, valid UTF-8 or not.

    Null lists give null, empty ones no bytes; ids outside the vocabulary and null ids give
    nothing. A column that already has the name of the result is replaced.
    """
    built = to_workers(df.sparkSession, bpe)

    def work(column: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        size = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(column):
            # Some ids at a time, or one row.
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + SLICE // 4, "right")))
            part = column.slice(at, end - at)
            ids = part.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            values = bytes_column(*built().decode(ids, size[at:end] - before))
            if part.null_count:
                values = pc.if_else(part.is_valid(), values, pa.scalar(None, pa.binary()))
            yield len(part), [values]
            at = end

    rows = df.select(F.struct(*[named(c) for c in df.columns if c != bytes_col]).alias("others"), named(ids_col).alias("ids"))
    return appended(rows, "ids", {"bytes": T.BinaryType()}, work).select("others.*", F.col("bytes").alias(bytes_col))
