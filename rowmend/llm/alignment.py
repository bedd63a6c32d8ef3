"""Alignment of two tokenizers: groups of tokens that end together, links, and corpus-wide counts.

The byte ends of both encodings are looked up in dictionaries from end to index; the sorted keys
that both have cut the id lists into groups, and links are expanded between the ends. Texts of a
slice follow one another, for the end of a text is an end of both. Both encoders begin anew at a
lone space between two other characters, so the distinct spans between such spaces are encoded
once, and their links counted as often as they occur.

How often an id pair is linked is a count over the corpus, and no table of all pairs is held by
a task: a first pass deals the texts into blocks and leaves the ids of each, and each block's
pairs with their counts; the totals come back to the blocks that met the pair, and a second pass
reads the ids of a block beside the totals of its own pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmend.llm.bpe import Bpe
from rowmend.llm.common import pick, slices
from rowmend.llm.pretokens import (
    bounded_pieces, byte_places, character_classes, code_points, distinct_values, gathered, is_white, json_file_matches,
    spread_out,
)
from rowmend.sources.workspace import written

# A task of the second pass holds a block or a few at once, in an Arrow batch and in Spark's sort.
BLOCK_CHARS = 1 << 23
SLICE = 1 << 19
# Spans whose ids a worker remembers; forgetting costs time only.
REMEMBERED_SPANS = 40_000
# In remembered ids: a group ends here.
MARK = 1 << 30
# Pairs in one row of a block's list.
LISTED_PAIRS = 200_000
DEALT = ["block", "ids", "a", "a_sizes", "a_marks", "b", "b_sizes", "b_marks", "keys", "counts"]


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group ends in both id lists: indices of the byte ends that both share, in order."""
    a_index = dict(zip(a_ends.tolist(), range(1, len(a_ends) + 1)))
    b_index = dict(zip(b_ends.tolist(), range(1, len(b_ends) + 1)))
    shared = [*filter(b_index.__contains__, a_index)]
    take = (np.fromiter(map(index.__getitem__, shared), np.int64, len(shared)) for index in (a_index, b_index))
    return tuple(take)


def expanded_links(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed pairs of ids, index of the b token) of all tokens whose bytes overlap.

    Between two neighbouring ends of either list lies part of one token of each, and every pair
    that overlaps has one such stretch.
    """
    ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
    ends = ends[np.diff(ends, prepend=-1) > 0]
    left, right = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return a[left].astype(np.int64) << 32 | b[right], right


class Tokens(NamedTuple):
    """Ids of some texts one after another, the end of each text in them, and whether a group ends at each id."""

    a: np.ndarray
    a_ends: np.ndarray
    a_marks: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray
    b_marks: np.ndarray


def digits_table(size: int, first: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, size) of every id in decimal, after the mark of a first one and then after a comma."""
    texts = [f"{mark}{n}".encode() for mark in (first, ",") for n in range(size)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes


class Aligner:
    """Both vocabularies, with the encodings that are remembered of spans."""

    def __init__(self, definition: str, model: bytes, classes: np.ndarray):
        self.definition, self.model, self.classes = definition, model, classes
        self.a = Bpe(definition, classes)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes = self.a.pieces
        self.b_bytes = [self.piece_bytes(n) for n in range(self.b.vocab_size())]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # Ids of both encodings of a span; nothing where they do not give it back.
        self.remembered: dict[bytes, tuple[bytes, bytes]] = {}

    def prepared(self) -> Aligner:
        """With all tables built that short words need, and the parsed file let go."""
        _ = self.digits, self.flat_bytes, self.a.merging()
        return self

    def forget(self) -> None:
        """Let go of what is remembered of texts."""
        self.remembered.clear()
        self.a.known_pairs.clear()
        pa.default_memory_pool().release_unused()

    def piece_bytes(self, number: int) -> bytes:
        if self.b.is_byte(number):
            return bytes([int(self.b.id_to_piece(number)[3:-1], 16)])
        return self.b.id_to_piece(number).replace("▁", " ").encode()

    def checked(self) -> Aligner:
        """Refuse vocabularies that do not begin anew at a lone space."""
        _ = self.a.spec
        pieces = (self.b.id_to_piece(n) for n in range(self.b.vocab_size()))
        plain = "a  ﬁ Ａ\té "
        if any("▁" in p.lstrip("▁") for p in pieces) or self.b.normalize(plain) != "▁" + plain.replace(" ", "▁"):
            raise ValueError("the piece model must keep texts as they are and pieces within words")
        return self

    @cached_property
    def digits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Decimal ids of a and then b, each after the mark that begins its part of a group and after a comma."""
        parts = [digits_table(len(self.a_bytes), ";"), digits_table(len(self.b_bytes), "|")]
        offset = len(parts[0][0])
        return (np.concatenate([x[0] for x in parts]), np.concatenate([parts[0][1], parts[1][1] + offset]),
                np.concatenate([x[2] for x in parts]))

    @cached_property
    def flat_bytes(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes of all ids, where each starts, its size) of both vocabularies."""
        return [(np.frombuffer(b"".join(x), np.uint8), np.cumsum(n) - n, n)
                for x, n in ((self.a_bytes, self.a_size), (self.b_bytes, self.b_size))]

    def learn(self, spans: list[bytes]) -> None:
        """Encode spans, and mark the ids at whose ends both encodings meet."""
        words, data = [s.decode() for s in spans], b"".join(spans)
        a, a_ends = self.a.merged_texts(words)
        lists = self.b.encode([w[1:] for w in words], num_threads=1)
        b_ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        b = np.fromiter(chain.from_iterable(lists), np.int32, b_ends[-1])
        size = np.fromiter(map(len, spans), np.int64, len(spans))
        sound = np.ones(len(spans), bool)
        for ids, ends, flat in ((a, a_ends, self.flat_bytes[0]), (b, b_ends, self.flat_bytes[1])):
            back, back_ends = spread_out(*flat, ids, ends)
            back = back.tobytes()
            if back != data or (np.diff(back_ends, prepend=0) != size).any():
                places = [0, *back_ends.tolist()]
                sound &= [back[x:y] == s for x, y, s in zip(places, places[1:], spans)]
        parts = []
        for ids, ends in ((a, a_ends), (b, b_ends)):
            count = np.where(sound, np.diff(ends, prepend=0), 0)
            parts.append((ids[np.repeat(sound, np.diff(ends, prepend=0))].astype(np.int32), np.cumsum(count)))
        byte_ends = [np.cumsum(n[ids]) for (ids, _), n in zip(parts, (self.a_size, self.b_size))]
        found = []
        for (ids, ends), groups in zip(parts, common_ends(*byte_ends)):
            ids[groups - 1] |= MARK
            places, ids = [0, *(ends * 4).tolist()], ids.tobytes()
            found.append([ids[x:y] for x, y in zip(places, places[1:])])
        self.remembered.update(zip(spans, zip(*found)))

    def spans(self, texts: list[str]) -> tuple[list[tuple[bytes, bytes]], np.ndarray, np.ndarray]:
        """(both encodings of the distinct spans, the span at each place, where each text's spans end).

        The texts begin with a space, each at the start of a span.
        """
        joined = "".join(texts)
        points = code_points(joined)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size)
        dark = ~is_white(points, self.classes)
        start = points == ord(" ")
        start[1:] &= dark[:-1]
        start[:-1] &= dark[1:]
        start[ends - 1] = False
        start[ends - size] = True
        places = np.flatnonzero(start)
        data = joined.encode()
        edges = np.append(places, len(points))
        if len(data) > len(points):
            edges = byte_places(points)[edges]
        distinct, index = distinct_values(data, edges)
        if len(self.remembered) > REMEMBERED_SPANS:
            self.remembered.clear()
        fresh = [s for s in distinct if s not in self.remembered]
        if fresh:
            self.learn(fresh)
        return [*map(self.remembered.__getitem__, distinct)], index, np.searchsorted(places, ends)

    def encoded(self, texts: list[str]) -> tuple[Tokens, np.ndarray, np.ndarray]:
        """(tokens of the texts, packed pairs they link, how often); pairs may repeat.

        A text that is empty or not given back by both encodings has no tokens.
        """
        owned = [(n, part) for n, text in enumerate(texts) if text for part in bounded_pieces(" " + text, SLICE)]
        found, at, sound = [], 0, np.ones(len(texts), bool)
        for some in slices((part for _, part in owned), SLICE):
            records, index, ends = self.spans(some)
            owner = np.repeat([n for n, _ in owned[at:at + len(some)]], np.diff(ends, prepend=0))
            bad = np.fromiter((not a for a, _ in records), bool, len(records))
            if bad.any():
                sound[owner[bad[index]]] = False
            found.append((records, index, owner))
            at += len(some)
        flat: tuple[list, list] = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        sizes = np.zeros((2, len(texts)), np.int64)
        keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for records, index, owner in found:
            index, owner = index[sound[owner]], owner[sound[owner]]
            if not len(index):
                continue
            parts = []
            for side in (0, 1):
                encodings = [r[side] for r in records]
                ids, ends = gathered(encodings, index, np.arange(1, len(index) + 1))
                flat[side].append(ids)
                np.add.at(sizes[side], owner, np.diff(ends, prepend=0))
                parts.append((np.frombuffer(b"".join(encodings), np.int32), np.fromiter(map(len, encodings), np.int64, len(records)) >> 2))
            (a, _), (b, b_count) = ((ids & ~MARK, count) for ids, count in parts)
            pairs, right = expanded_links(a, b, np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
            times = np.bincount(index, minlength=len(records))
            keys.append(pairs)
            counts.append(np.repeat(times, b_count)[right])
        a, b = map(np.concatenate, flat)
        a_ends, b_ends = np.cumsum(sizes, axis=1)
        tokens = Tokens(a & ~MARK, a_ends, a >= MARK, b & ~MARK, b_ends, b >= MARK)
        return tokens, np.concatenate(keys), np.concatenate(counts)

    def measured(self, tokens: Tokens, keys: np.ndarray, values: np.ndarray) -> list[pa.Array]:
        """Columns of MEASURES for some texts; `values` are twice the counts of `keys`, plus one for the best."""
        a, a_text, a_marks, b, b_text, b_marks = tokens
        a_group, b_group = np.flatnonzero(a_marks) + 1, np.flatnonzero(b_marks) + 1
        pairs, right = expanded_links(a, b, np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
        value = values[np.searchsorted(keys, pairs)]
        link_text = np.searchsorted(right, b_text)

        def summed(column: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(column)])[link_text], prepend=0)

        columns = [np.diff(x, prepend=0) for x in (a_text, b_text, np.searchsorted(b_group, b_text, "right"), link_text)]
        columns += [summed(value & 1), summed(value >> 1)]
        texts, ends = self.group_texts(a, b, a_group, b_group, a_text, b_text)
        data = texts.tobytes()
        # Without the semicolon before the first group.
        written_groups = [data[start + 1:end] for start, end in zip([0, *ends.tolist()], ends.tolist())]
        return [*(pa.array(c.astype(np.int64)) for c in columns), pa.array(written_groups, pa.binary()).cast(pa.string())]

    def group_texts(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray,
                    a_text: np.ndarray, b_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the groups of all texts as bytes, end of each text in them)."""
        flat, start, size = self.digits
        base = 2 * len(self.a_bytes)
        first_a, first_b = np.zeros(len(a) + 1, bool), np.zeros(len(b) + 1, bool)
        first_a[np.concatenate([[0], a_group])] = True
        first_b[np.concatenate([[0], b_group])] = True
        entry = np.concatenate([a + np.where(first_a[:-1], 0, len(self.a_bytes)),
                                b + base + np.where(first_b[:-1], 0, len(self.b_bytes))])
        # Every token's group, a before b.
        group = np.concatenate([2 * np.cumsum(first_a[:-1]), 2 * np.cumsum(first_b[:-1]) + 1])
        return spread_out(flat, start, size, entry[np.argsort(group, kind="stable")], a_text + b_text)


MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def load_aligner(byte_level_path: str, piece_path: str) -> Aligner:
    """Read both files on the driver; their size is the vocabularies', whatever the corpus."""
    with open(byte_level_path, encoding="utf-8") as one, open(piece_path, "rb") as other:
        return Aligner(one.read(), other.read(), character_classes(json_file_matches)).checked()


def to_workers(spark: SparkSession, aligner: Aligner) -> Callable[[], Aligner]:
    """Both vocabularies once for each worker; what it remembers outlives the task."""
    shared = spark.sparkContext.broadcast(
        {"definition": aligner.definition, "model": aligner.model, "classes": aligner.classes})

    def own() -> Aligner:
        held: dict[str, Any] = shared.value
        if "built" not in held:
            held["built"] = Aligner(held["definition"], held["model"], held["classes"]).prepared()
        return held["built"]

    return own


def squeezer() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers that are not negative as compressed bytes: in one, two or eight bytes each, as all of them fit."""
    most = int(numbers.max(initial=0))
    kind = np.dtype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64)
    data = numbers.astype(kind).tobytes()
    return bytes([kind.itemsize]) + len(data).to_bytes(8, "little") + squeezer().compress(data, asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 8: np.int64}[data[0]]
    numbers = np.frombuffer(squeezer().decompress(data[9:], int.from_bytes(data[1:9], "little"), asbytes=True), kind)
    return numbers.astype(np.int64)


def squeezed_tokens(tokens: Tokens) -> list[bytes]:
    """The columns of DEALT for the ids of a slice; marks are single bits."""
    return [x for ids, ends, marks in (tokens[:3], tokens[3:])
            for x in (squeezed(ids), squeezed(np.diff(ends, prepend=0)), squeezed(np.packbits(marks)))]


def unsqueezed_tokens(columns: list[bytes]) -> Tokens:
    found = []
    for ids, sizes, marks in (columns[:3], columns[3:]):
        ids = unsqueezed(ids)
        found += [ids, np.cumsum(unsqueezed(sizes)), np.unpackbits(unsqueezed(marks).astype(np.uint8), count=len(ids)).astype(bool)]
    return Tokens(*found)


class PairTotals:
    """Counts of pairs met in a block, merged now and then."""

    def __init__(self):
        self.keys, self.counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        if sum(map(len, self.keys[1:])) > max(1 << 20, len(self.keys[0])):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, place = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, place, np.concatenate(self.counts))
        met = counts > 0
        self.keys, self.counts = [keys[met]], [counts[met]]
        return self.keys[0], self.counts[0]


def dealt_texts(rows: DataFrame, built: Callable[[], Aligner], block_chars: int) -> DataFrame:
    """Rows of slices, with the ids of their texts, and rows that list the pairs a block has met.

    A block is a stretch of one input partition, so dealing moves nothing and a group of copies
    is spread over as many blocks as the partitions and sizes give.
    """
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, totals = TaskContext.get().partitionId() << 32, 0, PairTotals()
        id_type = None

        def row(ids: pa.Array | None, tokens: list[bytes | None], lists: list[bytes | None]) -> pa.RecordBatch:
            held = pa.nulls(1, pa.list_(id_type)) if ids is None else pa.ListArray.from_arrays(
                pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), held, *(pa.array([x], pa.binary()) for x in (*tokens, *lists))], DEALT)

        def listed() -> Iterator[pa.RecordBatch]:
            keys, counts = totals.merge()
            for at in range(0, len(keys), LISTED_PAIRS):
                part = slice(at, at + LISTED_PAIRS)
                yield row(None, [None] * 6, [keys[part].tobytes(), counts[part].tobytes()])

        for batch in batches:
            id_type, at = batch.column(0).type, 0
            for texts in slices((t.as_py() for t in batch.column(1)), SLICE):
                tokens, keys, counts = built().encoded(texts)
                totals.add(keys, counts)
                yield row(batch.column(0).slice(at, len(texts)), squeezed_tokens(tokens), [None, None])
                at += len(texts)
                size += sum(map(len, texts))
                if size >= block_chars:
                    yield from listed()
                    block, size, totals = block + 1, 0, PairTotals()
        if id_type is not None:
            yield from listed()
            # A worker that waits for its next task should hold little.
            built().forget()

    return rows.mapInArrow(run, f"block long, ids array<{kind}>, {', '.join(f'{c} binary' for c in DEALT[2:])}")


def unpacked(lists: DataFrame) -> DataFrame:
    """(block, pair, n) from rows that list the pairs of a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                pair = np.frombuffer(keys, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pair), block)), pa.array(pair), pa.array(np.frombuffer(counts, np.int64))],
                    ["block", "pair", "n"])

    return lists.select("block", "keys", "counts").mapInArrow(run, "block long, pair long, n long")


def repacked(values: DataFrame) -> DataFrame:
    """(block, keys, counts) from rows (block, pair, value): one for each block met in a while."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            block, key, value = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(block, kind="stable")
            own, first = np.unique(block[order], return_index=True)
            parts = [order[a:b] for a, b in zip(first, [*first[1:], len(order)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (key, value))],
                ["block", "keys", "counts"])

        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            if sum(len(h[0]) for h in held) > 500_000:
                yield from out()
                held = []
        if held:
            yield from out()

    return values.mapInArrow(run, "block long, keys binary, counts binary")


def measured_blocks(together: DataFrame, built: Callable[[], Aligner], kind: str) -> DataFrame:
    """Measures of the texts of every block; a block's pairs sort before its slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, keys, values = None, [], None, None
        for batch in batches:
            for n, block in enumerate(batch.column(0).to_pylist()):
                if block != current:
                    current, parts, keys = block, [], None
                *tokens, listed_keys, listed_values = (column[n].as_py() for column in batch.columns[2:])
                if listed_keys is not None:
                    parts.append((listed_keys, listed_values))
                    continue
                if keys is None:
                    keys, values = (np.concatenate([np.empty(0, np.int64), *(np.frombuffer(p[side], np.int64) for p in parts)])
                                    for side in (0, 1))
                    order = np.argsort(keys)
                    keys, values, parts = keys[order], values[order], []
                ids = batch.column(1).slice(n, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [ids, *built().measured(unsqueezed_tokens(tokens), keys, values)], ["doc_id", *MEASURES])
        pa.default_memory_pool().release_unused()

    return together.select(*DEALT).mapInArrow(
        run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def aligned_texts(df: DataFrame, aligner: Aligner, id_col: str = "doc_id", text_col: str = "text",
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) per row.

    A space and the text are encoded by the byte-level vocabulary (a) and the pieces (b), with
    special tokens read as plain text. `groups` is `a1,a2|b1;a3|b2,b3`, the ids of each group.
    A link is a pair of token places whose bytes overlap; its count is how often its two ids are
    linked in all rows. `count_sum` adds the counts of a row's links, `n_best` counts the links
    whose count is the highest of their b id. A text that is null, empty or not given back by
    both encodings has no tokens, zeros and empty groups, and adds to no count. Repeated rows
    are all counted and returned; an empty table gives an empty result. Other columns are not
    read.
    """
    spark = df.sparkSession
    built = to_workers(spark, aligner)
    rows = pick(df, doc_id=id_col, text=text_col)
    kind = dict(rows.dtypes)["doc_id"]
    dealt = written(dealt_texts(rows, built, block_chars), "dealt")
    lists = dealt.where("keys IS NOT NULL")
    met = unpacked(lists)
    counts = written(met.groupBy("pair").agg(F.sum("n").alias("n")), "pairs").withColumn(
        "b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    # One row for each id of a vocabulary, whatever the corpus.
    best = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("most")))
    value = F.col("n") * 2 + (F.col("n") == F.col("most")).cast("long")
    values = counts.join(best, "b").select("pair", value.alias("value"))
    needed = repacked(met.select("block", "pair").join(values, "pair").select("block", "pair", "value"))
    blocks = lists.select("block").distinct().count()
    # More tasks than blocks, so that few of them get two blocks.
    tasks = max(1, 4 * blocks)
    texts = dealt.where("keys IS NULL")
    together = texts.unionByName(needed, allowMissingColumns=True).repartition(tasks, "block").sortWithinPartitions(
        "block", F.col("keys").isNull())
    return measured_blocks(together, built, kind)
