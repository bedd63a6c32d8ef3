"""Language-model scoring by prediction by partial matching.

A byte-context trie of order K: the next byte is predicted from the K bytes before it; a byte
that did not follow them escapes to the context one shorter, where the symbols already ruled
out are excluded. Escapes are estimated by method D: a symbol met n times out of T has
probability (2n - 1) / 2T, and the q distinct symbols leave q / 2T to the escape.

The trie is a table of expressions (a context and its symbol), counted over all learning
texts and never held in one place. Texts are dealt into blocks of bounded size. Every block
names the expressions it meets, a join gives it their probabilities, and the block is then
scored with that part of the trie alone. So no broadcast grows with the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmend.llm.common import ascii_words, held_out_by, pick, slices
from rowmend.sources.workspace import written

ORDER = 5
# Bytes that UTF-8 never uses: what stands before a text, and its end.
START, END = b"\xff", b"\xfe"
SYMBOLS = 256
# The level of an expression or context stands above its symbols.
LEVEL_BITS = 48
BLOCK_BYTES = 32 << 20
# Word keys are negative; expressions are not.
END_WORD = -1
# Keys and texts held at once beside the part of a trie.
HELD, SLICE = 2_500_000, 1 << 20


def symbol_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(expressions, where each text starts) of all symbols of some texts with their ends."""
    raw = [text.encode("utf-8", "surrogatepass") for text in texts]
    symbols = np.frombuffer(b"".join(START * ORDER + text + END for text in raw), np.uint8)
    key = np.zeros(len(symbols) - ORDER, np.int64)
    for at in range(ORDER + 1):
        key <<= 8
        key |= symbols[at:len(symbols) - ORDER + at]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    return key[symbols[ORDER:] != START[0]], np.cumsum(sizes) - sizes


def word_key(word: bytes) -> int:
    """63 bits of XXH64 with the sign set."""
    return xxhash.xxh64_intdigest(word) % (1 << 63) - (1 << 63)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their counts."""
    ordered = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.diff(np.concatenate([first, [len(ordered)]]))


class Met:
    """What the texts of one block met: keys with their counts in learning texts, 0 elsewhere."""

    def __init__(self) -> None:
        self.words = (Counter(), Counter())
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, texts: list[str], held_out: bool) -> None:
        key, count = distinct(symbol_keys(texts)[0])
        self.keys.append(key)
        self.counts.append(count * (not held_out))
        words = self.words[held_out]
        for text in texts:
            words.update(ascii_words(text))
        self.add_key(END_WORD, 0 if held_out else len(texts))
        if sum(map(len, self.keys)) > HELD:
            key, count = summed(self.keys, self.counts)
            self.keys, self.counts = [key], [count]

    def add_key(self, key: int, count: int) -> None:
        self.keys.append(np.array([key], np.int64))
        self.counts.append(np.array([count], np.int64))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        for held_out, words in enumerate(self.words):
            self.keys.append(np.fromiter(map(word_key, words), np.int64, len(words)))
            self.counts.append(np.fromiter(words.values(), np.int64, len(words)) * (not held_out))
        return summed(self.keys, self.counts)


def met_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, key, n) from rows (block, held_out, text) sorted by block."""
    def out(block: int, met: Met) -> Iterator[pa.RecordBatch]:
        key, count = met.table()
        for at in range(0, len(key), 200_000):
            part = slice(at, at + 200_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key[part]), block, np.int32)), pa.array(key[part]), pa.array(count[part])],
                ["block", "key", "n"])

    current, met = None, Met()
    for batch in batches:
        blocks, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        # Runs of equal block and fold.
        change = np.flatnonzero((blocks[1:] != blocks[:-1]) | (held[1:] != held[:-1])) + 1
        for start, end in zip([0, *change], [*change, len(blocks)]):
            if end <= start:
                continue
            if current is not None and blocks[start] != current:
                yield from out(current, met)
                met = Met()
            current = int(blocks[start])
            for texts in slices((t.as_py() for t in batch.column(2).slice(start, end - start)), SLICE):
                met.add(texts, bool(held[start]))
    if current is not None:
        yield from out(current, met)


def mask(size: int) -> int:
    return (1 << 8 * size) - 1


def level(size: int, key: Column) -> Column:
    """Key of an expression or context of `size` symbols among all levels."""
    return key.bitwiseAND(F.lit(mask(size))).bitwiseOR(F.lit(size << LEVEL_BITS))


def trie_tables(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(expressions, contexts) of all levels from (key, n) of the longest, all n > 0.

    Expressions: (at, n). Contexts: (at, total, kinds, outside), where `outside` is how often
    the context one shorter was followed by the symbols that follow this one.
    """
    levels = F.array(*[level(size, F.col("key")) for size in range(1, ORDER + 2)])
    found = written(grams.select(F.explode(levels).alias("at"), "n").groupBy("at").agg(F.sum("n").alias("n")), "trie")
    size = F.shiftright("at", LEVEL_BITS)
    key = F.col("at").bitwiseAND(F.lit(mask(ORDER + 1)))
    context = F.shiftright(key, 8).bitwiseOR(F.shiftleft(size - 1, LEVEL_BITS))
    ending = F.expr(f"at & (shiftleft(1L, CAST(8 * (shiftright(at, {LEVEL_BITS}) - 1) AS INT)) - 1)")
    shorter = F.when(size > 1, ending.bitwiseOR(F.shiftleft(size - 1, LEVEL_BITS)))
    rows = found.select(context.alias("context"), "n", shorter.alias("shorter"))
    parent = found.select(F.col("at").alias("shorter"), F.col("n").alias("parent_n"))
    contexts = rows.join(parent, "shorter", "left").groupBy("context").agg(
        F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("parent_n").alias("outside"))
    return found, written(contexts, "contexts")


def seen_scores(grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """(key, value) of the longest expressions that learning texts hold."""
    rows = grams.withColumn("context", level(ORDER, F.shiftright("key", 8)))
    share = (2 * F.col("n") - 1) / (2 * F.col("total"))
    return rows.join(contexts, "context").select("key", F.log10(share).alias("value"))


def unseen_scores(keys: DataFrame, found: DataFrame, contexts: DataFrame) -> DataFrame:
    """(key, value) of longest expressions that no learning text holds: escapes down the levels."""
    steps = F.array(*[F.struct(
        F.lit(size).alias("size"), level(size, F.shiftright("key", 8)).alias("context"),
        level(size + 1, F.col("key")).alias("at")) for size in range(ORDER + 1)])
    rows = keys.select("key", F.inline(steps)).join(contexts, "context", "left").join(found, "at", "left")
    at = lambda size, name: F.max(F.when(F.col("size") == size, F.col(name))).alias(f"{name}{size}")
    wide = rows.groupBy("key").agg(*[at(s, n) for s in range(ORDER + 1) for n in ("total", "kinds", "outside", "n")])
    rest = wide.withColumn("value", -F.log10(SYMBOLS - F.coalesce("kinds0", F.lit(0)).cast("double")))
    for size in range(ORDER + 1):
        total, kinds = F.col(f"total{size}"), F.col(f"kinds{size}")
        if size < ORDER:
            # Entered by an escape, if the longer context is known: its symbols are excluded.
            longer = F.col(f"kinds{size + 1}").isNotNull()
            total = total - F.when(longer, F.col(f"outside{size + 1}")).otherwise(0)
            kinds = kinds - F.when(longer, F.col(f"kinds{size + 1}")).otherwise(0)
        rest = rest.withColumns({"__total": total.cast("double"), "__kinds": kinds.cast("double")})
        escape = F.when(F.col("__total") > 0, F.log10(F.try_divide(F.col("__kinds"), 2 * F.col("__total")))).otherwise(0.0)
        # A symbol excluded here was found above, where this value is not used.
        symbol = F.log10(F.try_divide(2 * F.col(f"n{size}") - 1, 2 * F.col("__total")))
        rest = rest.withColumn("value", F.when(F.col("__total").isNull(), F.col("value")).when(
            F.col(f"n{size}").isNotNull(), symbol).otherwise(escape + F.col("value")))
    return rest.select("key", "value")


PACKED = "block int, turn int, keys binary, vals binary"


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, key, value) as few rows of arrays, one for each block met in a while."""
    held: list[tuple[np.ndarray, ...]] = []

    def out() -> Iterator[pa.RecordBatch]:
        block, key, value = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(block, kind="stable")
        own, first = np.unique(block[order], return_index=True)
        parts = [order[a:b] for a, b in zip(first, [*first[1:], len(order)])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int32()), pa.array(np.zeros(len(own), np.int32)),
             pa.array([key[p].tobytes() for p in parts], pa.binary()),
             pa.array([value[p].tobytes() for p in parts], pa.binary())], ["block", "turn", "keys", "vals"])

    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
        if sum(len(h[0]) for h in held) > 500_000:
            yield from out()
            held = []
    if held:
        yield from out()


class Scorer:
    """The part of the trie and of the word counts that one block needs."""

    def __init__(self, parts: list[tuple[bytes, bytes]], learned: int, vocabulary: int):
        key = np.concatenate([np.frombuffer(k, np.int64) for k, _ in parts])
        value = np.concatenate([np.frombuffer(v, np.float64) for _, v in parts])
        order = np.argsort(key)
        self.key, self.value = key[order], value[order]
        border = np.searchsorted(self.key, 0)
        self.words, self.counts = self.key[:border], self.value[:border]
        self.key, self.value = self.key[border:], self.value[border:]
        self.unit = math.log10(learned + vocabulary + 1)

    def counted(self, keys: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.words, keys)]

    def scores(self, texts: list[str]) -> list[np.ndarray]:
        """[tokens, known tokens, base score, score] of some texts."""
        key, start = symbol_keys(texts)
        score = np.add.reduceat(self.value[np.searchsorted(self.key, key)], start)
        split = [ascii_words(text) for text in texts]
        words = list({word for text in split for word in text})
        count = self.counted(np.fromiter(map(word_key, words), np.int64, len(words)))
        number = dict(zip(words, range(len(words))))
        logs, end = np.log10(count + 1), self.counted(np.array([END_WORD]))[0]
        tokens, known, base = (np.zeros(len(texts)) for _ in range(3))
        for n, text in enumerate(split):
            index = np.fromiter(map(number.__getitem__, text), np.int64, len(text))
            tokens[n] = len(text) + 1
            known[n] = (count[index] > 0).sum() + (end > 0)
            base[n] = logs[index].sum() + math.log10(end + 1) - tokens[n] * self.unit
        return [tokens, known, base, score]


def ppm_scores(df: DataFrame, folds: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text",
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    Rows of the held-out fold teach nothing; a null id is never held out. Null texts count as
    empty, and an empty text is its end alone. `score` is the log10 probability of the whole
    text with its end, `base_score` that of add-one word counts. Words are told apart by 63
    bits of hash. Without learning rows every symbol has the same probability. Repeated rows
    are all returned and learnt from; an empty table gives an empty result. Other columns are
    not read.
    """
    rows = pick(df, doc_id=id_col, text=text_col)
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(8))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    # More tasks than blocks, so that few of them get two blocks.
    tasks = 4 * blocks
    dealt = rows.withColumns({
        "block": F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"),
        "held_out": held_out_by(F.col("doc_id"), folds, held_out)})
    teaching = dealt.select("block", "held_out", "text").repartition(tasks, "block").sortWithinPartitions("block", "held_out")
    met = written(teaching.mapInArrow(met_in_blocks, "block int, key long, n long"), "met")
    counts = written(met.groupBy("key").agg(F.sum("n").alias("n")), "counts")
    learned, vocabulary = counts.where("key < 0 AND n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    grams = counts.where("key >= 0")
    found, contexts = trie_tables(grams.where("n > 0"))
    values = seen_scores(grams.where("n > 0"), contexts).unionByName(
        unseen_scores(grams.where("n = 0").select("key"), found, contexts)).unionByName(
        counts.where("key < 0").select("key", F.col("n").cast("double").alias("value")))
    needed = met.select("block", "key").join(values, "key").select("block", "key", "value").mapInArrow(packed, PACKED)
    kind = dict(rows.dtypes)["doc_id"]
    lines = needed.withColumns({
        "doc_id": F.lit(None).cast(kind), "held_out": F.lit(None).cast("boolean"), "text": F.lit(None).cast("string")})
    texts = dealt.withColumns({
        "turn": F.lit(1), "keys": F.lit(None).cast("binary"), "vals": F.lit(None).cast("binary")})
    # A block's part of the trie sorts before its texts.
    together = lines.unionByName(texts).repartition(tasks, "block").sortWithinPartitions("block", "turn").select(
        "doc_id", "block", "turn", "keys", "vals", "held_out", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, scorer = None, [], None
        for batch in batches:
            block, turn = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            change = np.flatnonzero((block[1:] != block[:-1]) | (turn[1:] != turn[:-1])) + 1
            for start, end in zip([0, *change], [*change, len(block)]):
                if current != block[start]:
                    current, parts, scorer = block[start], [], None
                part = batch.slice(start, end - start)
                if turn[start] == 0:
                    parts += zip(part.column(3).to_pylist(), part.column(4).to_pylist())
                    continue
                scorer = scorer or Scorer(parts, learned, vocabulary)
                parts, at = [], 0
                for texts in slices((t.as_py() for t in part.column(6)), SLICE):
                    tokens, known, base, score = scorer.scores(texts)
                    rows = part.slice(at, len(texts))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), rows.column(5), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)),
                         pa.array(np.full(len(texts), learned, np.int64)), pa.array(base), pa.array(score)],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                    at += len(texts)

    return together.mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long,"
             " base_score double, score double")
