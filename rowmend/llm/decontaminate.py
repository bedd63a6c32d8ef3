"""Benchmark decontamination by latent semantic retrieval.

Texts are passages of some words, weighted by TF-IDF over hashed terms. A randomised SVD of
passages gives a latent space in which every passage is as long as its terms are telling
(singular values divided out). Parts of benchmark items are looked up there by cosine; what
may match is then checked word by word: the longest common subsequence with the whole item,
and the words that make up its answer.

Document frequencies are those of all documents. The latent space is fitted on the half
passages of all of them, equal texts counted once; every passage of every document is
projected and searched. Parts of items of which next to nothing is left in that space are
looked up by their words instead.
The benchmark is the query set: it is searched some thousand items at a time, in one pass
over the documents each, and nothing but these items and the latent space is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmend.llm.common import appended, ascii_words, pick, slices
from rowmend.sources.workspace import new_path, remove, written

TERMS = 1 << 14
NO_TERM = TERMS
RANK, EXTRA = 256, 10
# Fitted passages per latent dimension: a space of too few would tell every two of them apart.
SUPPORT = 50
# Words of half a passage; passages overlap by one half.
HALF = 16
# Tasks that sum for the latent space, at least and at most, and bytes of halves for one: every task sends a whole sum.
LEAST_TASKS, MOST_TASKS, TASK_BYTES = 8, 256, 32 << 20
# Terms of a sum that travel together; halves taken at once; occurrences among these from which a term is summed by a product.
CHUNK, FIT_ROWS, OFTEN = 256, 256, 4
MIN_COSINE = 0.35
# Length that a part keeps in the latent space, below which its cosines tell nothing.
MIN_LENGTH = 0.1
# Parts counted at once by their words.
COUNTED = 256
# Share of a part's words that must be in a passage before the item is aligned.
MIN_OVERLAP = 0.5
MIN_LCS, MIN_ANSWER = 0.8, 0.5
# Shorter items cannot be told from chance.
MIN_WORDS = 5
ITEMS_PER_PASS = 5000
# Words a task remembers; forgetting costs time only.
REMEMBERED = 300_000
SLICE = 128 << 10
SEED = 7
LEAKS = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()),
    T.StructField("lcs", T.DoubleType()), T.StructField("answer", T.DoubleType())]))


class Terms(dict):
    """Hashed terms by word, remembered for a while."""

    def __missing__(self, word: bytes) -> int:
        term = self[word] = xxhash.xxh64_intdigest(word) % TERMS
        return term

    def of(self, words: Collection[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def halves(split: list[list[bytes]], terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """(terms, document) of every half passage: rows of HALF terms, filled up with NO_TERM.

    Documents without words have none.
    """
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    rows = -(-sizes // HALF)
    matrix = np.full((rows.sum(), HALF), NO_TERM, np.int32)
    shift = (np.cumsum(rows) - rows) * HALF - (np.cumsum(sizes) - sizes)
    ids = terms.of(list(chain.from_iterable(split)))
    matrix.ravel()[np.repeat(shift, sizes) + np.arange(len(ids))] = ids
    return matrix, np.repeat(np.arange(len(split)), rows)


def half_sums(matrix: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the table's rows over the terms of every half; the row of NO_TERM is zero."""
    columns = np.ascontiguousarray(matrix.T)
    total = table[columns[0]]
    rows = np.empty_like(total)
    for column in columns[1:]:
        total += np.take(table, column, axis=0, out=rows, mode="clip")
    return total


def with_no_term(table: np.ndarray) -> np.ndarray:
    return np.concatenate([table, np.zeros((1, table.shape[1]), np.float32)]).astype(np.float32)


def halves_of(docs: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """(half passages of every distinct text, documents holding each term, documents), in one pass over the texts.

    The halves are written as 16-bit terms; the driver gets one number per term.
    """
    schema = "a long, b long, halves binary, found array<long>, number long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, found, number = Terms(), np.zeros(TERMS + 1, np.int64), 0
        for batch in batches:
            at = 0
            for texts in slices((t.as_py() for t in batch.column(2)), SLICE):
                matrix, owner = halves([ascii_words(text) for text in texts], terms)
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                own = [matrix[start:end] for start, end in zip(ends, ends[1:])]
                for rows in own:
                    # An assignment by index counts a term once, however often the text has it.
                    found[rows] += 1
                part, at = batch.slice(at, len(texts)), at + len(texts)
                packed = pa.array([rows.astype(np.uint16).tobytes() for rows in own], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), packed, pa.nulls(len(own), pa.list_(pa.int64())),
                     pa.nulls(len(own), pa.int64())], ["a", "b", "halves", "found", "number"])
                number += len(texts)
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, pa.nulls(1, pa.binary()), pa.array([found[:TERMS].tolist()], pa.list_(pa.int64())),
             pa.array([number], pa.int64())], ["a", "b", "halves", "found", "number"])

    keyed = docs.select(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), "text")
    path = new_path(docs.sparkSession, "terms")
    parts = written(keyed.mapInArrow(run, schema), "terms", path)
    rows = parts.select(F.posexplode("found").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(TERMS)
    for row in rows:
        found[row["term"]] = row["n"]
    number = parts.agg(F.sum("number")).first()[0] or 0
    once = written(parts.where("length(halves) > 0").dropDuplicates(["a", "b"]).select("halves"), "halves")
    remove(docs.sparkSession, path)
    return once, found, number


def add_to_terms(total: np.ndarray, matrix: np.ndarray, product: np.ndarray) -> None:
    """Add the product of every half to the rows of its terms, once for each time a term is in it."""
    ids = matrix.ravel()
    order = np.argsort(ids, kind="stable")
    own, first, count = np.unique(ids[order], return_index=True, return_counts=True)
    place = np.repeat(np.arange(len(own)), count)
    half = order // HALF
    often = np.flatnonzero(count >= OFTEN)
    row = np.full(len(own), -1)
    row[often] = np.arange(len(often))
    dense = row[place] >= 0
    times = np.bincount(row[place[dense]] * len(matrix) + half[dense], minlength=len(often) * len(matrix))
    total[own[often]] += times.reshape(len(often), len(matrix)).astype(np.float32) @ product
    # The others by their first, second, ... occurrence: in each of these rounds a term is there once.
    for turn in range(OFTEN - 1):
        left = np.flatnonzero((count > turn) & (count < OFTEN))
        total[own[left]] += product[half[first[left] + turn]]


def fit_tasks(passages: int) -> int:
    return min(MOST_TASKS, max(LEAST_TASKS, passages * 2 * HALF // TASK_BYTES))


def summed_blocks(packed: DataFrame, block, rows: int, columns: int, most: int) -> np.ndarray:
    """Sum over at most `most` tasks of the matrix that `block` makes of their halves."""
    schema = "chunk int, part binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns), np.float32)
        for batch in batches:
            matrix = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16).reshape(-1, HALF)
            for at in range(0, len(matrix), FIT_ROWS):
                block(total, matrix[at:at + FIT_ROWS])
        starts = range(0, rows, CHUNK)
        yield pa.RecordBatch.from_arrays(
            [pa.array([s // CHUNK for s in starts], pa.int32()),
             pa.array([total[s:s + CHUNK].tobytes() for s in starts], pa.binary())], ["chunk", "part"])

    def add(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p.as_py(), np.float32) for p in group.column("part")]
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "part": pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())})

    whole = np.zeros((rows, columns), np.float32)
    tasks = packed.coalesce(most).mapInArrow(run, schema)
    for row in tasks.groupBy("chunk").applyInArrow(add, schema).collect():
        part = np.frombuffer(row["part"], np.float32).reshape(-1, columns)
        whole[row["chunk"] * CHUNK:row["chunk"] * CHUNK + len(part)] = part
    return whole


def latent_space(packed: DataFrame, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms x at most RANK latent dimensions, singular values) by randomised SVD of all TF-IDF half passages A.

    One pass sums A'(A G) for a random G, whose orthonormal basis Q spans the leading right
    singular vectors; another sums (A Q)'(A Q), whose eigenvectors turn Q into them.
    """
    width = RANK + EXTRA
    passages = (packed.agg(F.sum(F.length("halves"))).first()[0] or 0) // (2 * HALF)
    tasks = fit_tasks(passages)
    random = np.random.default_rng(SEED).standard_normal((TERMS, width)).astype(np.float32)
    weighted = with_no_term(random * weight[:, None])

    def range_block(total: np.ndarray, matrix: np.ndarray) -> None:
        add_to_terms(total, matrix, half_sums(matrix, weighted))

    spread = summed_blocks(packed, range_block, TERMS + 1, width, tasks)[:TERMS] * weight[:, None]
    basis = np.linalg.qr(spread.astype(np.float64))[0].astype(np.float32)

    table = with_no_term(basis * weight[:, None])

    def gram_block(total: np.ndarray, matrix: np.ndarray) -> None:
        product = half_sums(matrix, table)
        total += product.T @ product

    values, vectors = np.linalg.eigh(summed_blocks(packed, gram_block, width, width, tasks).astype(np.float64))
    order = np.argsort(-values)[:min(RANK, 1 + passages // SUPPORT)]
    kept = order[values[order] > 1e-6 * max(values.max(), 1e-12)]
    singular = np.sqrt(values[kept])
    # Dividing singular values out keeps common terms from drowning telling ones.
    return (basis @ (vectors[:, kept] / singular) * weight[:, None]).astype(np.float32), singular


def lcs(masks: dict[bytes, int], size: int, words: list[bytes]) -> int:
    """Longest common subsequence with an item, given the positions of its words as bit masks."""
    full = (1 << size) - 1
    row = full
    for word in words:
        hit = masks.get(word)
        if hit:
            met = row & hit
            row = (row + met) | (row - met)
    return size - (row & full).bit_count()


@dataclass
class Index:
    """The benchmark items of one pass: their words, answers and the latent vectors of their parts.

    `space` has a row for every term and a zero one for NO_TERM; `singular` has the values divided out of it.
    """

    items: list[tuple[int, str]]
    space: np.ndarray
    weight: np.ndarray
    singular: np.ndarray | float = 1.0

    @cached_property
    def terms(self) -> Terms:
        return Terms()

    @cached_property
    def words(self) -> list[list[bytes]]:
        return [ascii_words(text) for _, text in self.items]

    @cached_property
    def masks(self) -> list[dict[bytes, int]]:
        found = []
        for words in self.words:
            mask: dict[bytes, int] = {}
            for at, word in enumerate(words):
                mask[word] = mask.get(word, 0) | 1 << at
            found.append(mask)
        return found

    @cached_property
    def answers(self) -> list[set[bytes]]:
        """What follows the last question mark, or else the third of the words that documents share least."""
        found = []
        for (_, text), words in zip(self.items, self.words):
            after = ascii_words(text.rpartition("?")[2]) if "?" in text else []
            if not after:
                rare = sorted(set(words), key=lambda w: (-self.weight[self.terms.of([w])[0]], w))
                after = rare[:max(1, len(rare) // 3)]
            found.append(set(after))
        return found

    @cached_property
    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, unit vector, padded terms, size) of every part of every item."""
        owner, vectors, padded, sizes = [], [], [], []
        for number, words in enumerate(self.words):
            if len(words) < MIN_WORDS:
                continue
            ids = self.terms.of(words)
            for part in np.array_split(ids, max(1, round(len(ids) / HALF))):
                owner.append(number)
                vectors.append(self.space[part].sum(axis=0))
                padded.append(np.pad(part, (0, 2 * HALF - len(part)), constant_values=-2))
                sizes.append(len(part))
        if not owner:
            empty = np.empty(0, np.int64)
            return empty, np.zeros((0, self.space.shape[1]), np.float32), np.zeros((0, 2 * HALF), np.int32), empty
        vector = np.stack(vectors)
        norm = np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-12)
        return np.array(owner), vector / norm, np.stack(padded), np.array(sizes)

    @cached_property
    def lost(self) -> np.ndarray:
        """The parts of which next to nothing is left in the latent space."""
        found = []
        for part, (_, vector, padded, _) in enumerate(zip(*self.parts)):
            ids, times = np.unique(padded[padded >= 0], return_counts=True)
            whole = np.linalg.norm(times * self.weight[ids])
            left = np.linalg.norm(self.space[padded[padded >= 0]].sum(axis=0) * self.singular)
            if left <= MIN_LENGTH * whole:
                found.append(part)
        return np.array(found, np.int64)

    def by_words(self, matrix: np.ndarray, following: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(halves, parts) of the lost parts that may share MIN_OVERLAP of their words with a passage."""
        _, _, padded, size = self.parts
        for at in range(0, len(self.lost), COUNTED):
            parts = self.lost[at:at + COUNTED]
            table = np.zeros((TERMS + 1, len(parts)), np.uint16)
            for column, part in enumerate(parts):
                np.add.at(table[:, column], padded[part][padded[part] >= 0], 1)
            wanted = table.any(axis=1)
            near = np.flatnonzero(wanted[matrix].any(axis=1) | wanted[following].any(axis=1))
            for cut in range(0, len(near), 4096):
                rows = near[cut:cut + 4096]
                # A word the passage repeats counts again, so this is a bound from above.
                shared = half_sums(matrix[rows], table) + half_sums(following[rows], table)
                r, c = np.nonzero(shared >= MIN_OVERLAP * size[parts])
                yield rows[r], parts[c]

    def candidates(self, matrix: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(half, item, cosine) of passages, a half with the next, that may hold a part of an item."""
        item, vector, padded, size = self.parts
        if not len(matrix) or not len(item):
            return
        sums = half_sums(matrix, self.space)
        passage, following = sums.copy(), np.full_like(matrix, NO_TERM)
        follows = np.flatnonzero(owner[1:] == owner[:-1])
        passage[follows] += sums[follows + 1]
        following[follows] = matrix[follows + 1]
        # The bound on the cosine is put on the product, so no vector need be scaled.
        least = MIN_COSINE * np.maximum(np.sqrt(np.einsum("ij,ij->i", passage, passage)), 1e-12)

        def overlapping(rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[int, int]]:
            for cut in range(0, len(rows), 4096):
                r, c = rows[cut:cut + 4096], columns[cut:cut + 4096]
                window = np.concatenate([matrix[r], following[r]], axis=1)
                shared = (window[:, :, None] == padded[c][:, None, :]).any(axis=1).sum(axis=1)
                for k in np.flatnonzero(shared >= MIN_OVERLAP * size[c]):
                    yield int(r[k]), int(c[k])

        for at in range(0, len(passage), 4096):
            product = passage[at:at + 4096] @ vector.T
            rows, columns = np.nonzero(product >= least[at:at + 4096, None])
            for r, c in overlapping(at + rows, columns):
                cosine = MIN_COSINE * product[r - at, c] / least[r]
                yield r, int(item[c]), float(cosine)
        for rows, columns in self.by_words(matrix, following):
            for r, c in overlapping(rows, columns):
                yield r, int(item[c]), float(MIN_COSINE * (passage[r] @ vector[c]) / least[r])

    def leaks(self, texts: list[str]) -> list[list[tuple[int, float, float, float]]]:
        """(item, cosine, LCS share, answer share) of every item found in each text, best passage first found."""
        split = [ascii_words(text) for text in texts]
        matrix, owner = halves(split, self.terms)
        first = np.searchsorted(owner, np.arange(len(texts)))
        found: list[dict[int, tuple]] = [{} for _ in texts]
        for half, number, cosine in self.candidates(matrix, owner):
            doc, words = int(owner[half]), self.words[number]
            at = int(half - first[doc]) * HALF
            around = split[doc][max(0, at - len(words)):at + 2 * HALF + len(words)]
            share = lcs(self.masks[number], len(words), around) / len(words)
            if share < MIN_LCS:
                continue
            answer = self.answers[number]
            held = len(answer.intersection(around)) / len(answer)
            key = self.items[number][0]
            if held >= MIN_ANSWER and (share, held, cosine) > found[doc].get(key, (0,))[:3]:
                found[doc][key] = (share, held, cosine)
        return [[(key, c, s, a) for key, (s, a, c) in sorted(own.items())] for own in found]


def with_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", benchmark_text_col: str = "text",
               text_col: str = "text", leaks_col: str = "leaks") -> DataFrame:
    """Append the benchmark items that each text holds, with the evidence; every row is kept.

    An item is held when some passage has LCS with at least 0.8 of its words, in order, and half
    of its answer words. Null and empty texts hold none; items that are null, without an id or
    shorter than five words match nothing, and repeated item ids count as one. A column that has
    the name of the result is replaced. An empty table stays empty; an empty benchmark matches
    nothing.
    """
    items = pick(benchmark, item_id=id_col, text=benchmark_text_col).where("item_id IS NOT NULL AND text IS NOT NULL")
    texts = pick(docs, text=text_col)
    number = items.count()
    packed, frequency, total = halves_of(texts)
    weight = np.log((total + 1) / (frequency + 1)).astype(np.float32)
    space, singular = latent_space(packed, weight)
    space = with_no_term(space)
    passes = max(1, math.ceil(number / ITEMS_PER_PASS))
    found, columns = docs, []
    for turn in range(passes):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == turn).orderBy("item_id", "text").collect()
        index = docs.sparkSession.sparkContext.broadcast(([(r["item_id"], r["text"]) for r in own], space, weight, singular))
        columns.append(leaks_col if turn == 0 else f"__{leaks_col}{turn}")
        found = appended(found, text_col, {columns[-1]: LEAKS}, searcher(index))
    if passes == 1:
        return found
    return found.withColumn(leaks_col, F.array_sort(F.flatten(F.array(*columns)))).drop(*columns[1:])


def searcher(index):
    """Search texts some at a time against the items of a broadcast index."""
    held: dict[str, Index] = {}

    def work(column: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        if not held:
            held["index"] = Index(*index.value)
        for texts in slices((t.as_py() for t in column), SLICE):
            rows = [[dict(zip(("item_id", "cosine", "lcs", "answer"), leak)) for leak in leaks]
                    for leaks in held["index"].leaks(texts)]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()),
                                       ("answer", pa.float64())]))
            yield len(texts), [pa.array(rows, kind)]

    return work
