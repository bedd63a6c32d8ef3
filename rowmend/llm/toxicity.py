"""Toxicity by class-conditional Kneser-Ney models.

Each class has a Kneser-Ney model of the symbols (bytes and word end) of its words, given the
four before; so an insult is known by its stem, whatever its ending. Only this highest order
has counts by class. It backs off to lower orders of continuation counts that both classes
share. An expression that both classes together met fewer than `RARE` times has no counts of
its own: both classes give it the shared probability, so a chance word is no evidence.

A text is judged by the difference of its two log-likelihoods, normalised by length: over the
whole text, and in its most toxic word, which alone also counts unnormalised. A logistic
curve, fitted on rows the models have not seen, turns the three into a score.

The models are fitted on at most `per_class` labelled rows of each class, those with the
smallest hash of their id; that bounds what is broadcast. Every document is scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmend.llm.common import appended, ascii_words, held_out_by, pick, slices
from rowmend.sources.workspace import written

DISCOUNT = 0.75
RARE = 5
# Symbols of an expression: four of context and the one they predict.
ORDER = 5
START, END = b"\x01", b"\x00"
EDGES = b".,;:!?\"'()[]{}<>*_-"
PER_CLASS = 4000
# Of the labelled rows, this fold fits the curve and not the models.
CURVE_FOLDS, CURVE_FOLD = 4, 0
# Words a task remembers; forgetting costs time only.
REMEMBERED = 200_000
FEATURES = ["whole", "densest", "strongest"]


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words without punctuation around them."""
    stripped = (word.strip(EDGES) for word in ascii_words(text))
    return [word for word in stripped if word]


def expressions(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key, word number) of every symbol of the words with its context, 8 bits a symbol."""
    text = b"".join(START * (ORDER - 1) + word + END for word in words)
    symbols = np.frombuffer(text, np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + ORDER
    key = np.zeros(len(symbols), np.int64)
    for back in range(ORDER):
        key[back:] += symbols[:len(symbols) - back] << (8 * back)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = place >= ORDER - 1
    return key[inside], owner[inside]


def expression_counts(rows: DataFrame) -> DataFrame:
    """(key, n0, n1): how often each class met an expression, over whole texts of labelled rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, found = batch.slice(at, 512), (Counter(), Counter())
                for text, toxic in zip(part.column(0), part.column(1).to_pylist()):
                    found[toxic].update(tokens(text.as_py()))
                for toxic, counts in enumerate(found):
                    if counts:
                        key, owner = expressions(list(counts))
                        n = np.fromiter(counts.values(), np.int64, len(counts))[owner]
                        keys, index = np.unique(key, return_inverse=True)
                        total = np.bincount(index, n).astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(keys), toxic), pa.int32()), pa.array(keys), pa.array(total)],
                            ["toxic", "key", "n"])

    met = rows.select("text", "toxic").mapInArrow(run, "toxic int, key long, n long")
    by_class = [F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    return met.groupBy("key").agg(*by_class)


def grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, index = np.unique(keys, return_inverse=True)
    return own, np.bincount(index, values)


def found_in(own: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Values of sorted keys, 0 where there is none."""
    place = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    return np.where(own[place] == keys, values[place], 0)


def shared_probability(keys: np.ndarray) -> np.ndarray:
    """Kneser-Ney probability of the last symbol of every expression without its first one.

    `keys` are all distinct expressions of both classes. A lower order counts how many
    different symbols come before it; the lowest backs off to a uniform byte.
    """
    probability, level = np.full(len(keys), 1 / 256), keys
    orders = []
    for size in range(ORDER - 1, 0, -1):
        level, kinds = grouped(level & ((1 << 8 * size) - 1), np.ones(len(level)))
        orders.append((size, level, kinds))
    for size, own, kinds in reversed(orders):
        context, total = grouped(own >> 8, kinds)
        _, after = grouped(own >> 8, np.ones(len(own)))
        here = keys & ((1 << 8 * size) - 1)
        whole = found_in(context, total, here >> 8)
        share = np.maximum(found_in(own, kinds, here) - DISCOUNT, 0) / whole
        probability = share + DISCOUNT * found_in(context, after, here >> 8) / whole * probability
    return probability


@dataclass
class Model:
    """The log ratio of both classes' probabilities for every expression that is not rare."""

    key: np.ndarray
    ratio: np.ndarray

    def learn(self, words: list[bytes], memory: dict[bytes, float]) -> None:
        """Remember the differences of words not met before."""
        fresh = [word for word in set(words) if word not in memory]
        if fresh:
            key, owner = expressions(fresh)
            steps = found_in(self.key, self.ratio, key) if len(self.key) else np.zeros(len(key))
            memory.update(zip(fresh, np.bincount(owner, steps).tolist()))

    def features(self, texts: list[str], memory: dict[bytes, float]) -> np.ndarray:
        """Whole text, densest and strongest word of every text; zeros for texts without words."""
        split = [tokens(text) for text in texts]
        if len(memory) > REMEMBERED:
            memory.clear()
        self.learn([word for words in split for word in words], memory)
        found = np.zeros((len(texts), len(FEATURES)))
        for n, words in enumerate(split):
            if words:
                difference = np.fromiter(map(memory.__getitem__, words), np.float64, len(words))
                size = np.fromiter(map(len, words), np.int64, len(words)) + 1
                found[n] = difference.sum() / size.sum(), (difference / size).max(), difference.max()
        return found


def kneser_ney(counts: DataFrame) -> Model:
    """Fit both classes from (key, n0, n1), a table bounded by the sample it was counted on."""
    table = counts.orderBy("key").toArrow()
    key = table.column("key").to_numpy()
    if not len(key):
        return Model(key, np.empty(0))
    shared, logs = shared_probability(key), []
    for c in (0, 1):
        n = table.column(f"n{c}").to_numpy().astype(float)
        context, total = grouped(key >> 8, n)
        _, kinds = grouped(key >> 8, (n > 0).astype(float))
        whole, after = (found_in(context, v, key >> 8) for v in (total, kinds))
        known = np.maximum(whole, 1)
        back_off = np.where(whole > 0, DISCOUNT * after / known, 1.0)
        logs.append(np.log(np.maximum(n - DISCOUNT, 0) / known + back_off * shared))
    both = table.column("n0").to_numpy() + table.column("n1").to_numpy() >= RARE
    return Model(key[both], (logs[1] - logs[0])[both])


def logistic(features: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first coefficient is the intercept."""
    x = np.column_stack([np.ones(len(features)), features])
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[1e-3] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge * weights.sum()
        step = np.linalg.solve(hessian, x.T @ (weights * (labels - p)) - ridge @ beta * weights.sum())
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass
class Judge:
    """Scores texts; without both classes to learn from, the share of toxic labels."""

    model: Model | None
    beta: np.ndarray
    share: float

    def scores(self, texts: list[str], memory: dict[bytes, float]) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.share)
        z = self.beta[0] + self.model.features(texts, memory) @ self.beta[1:]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: int = PER_CLASS) -> Judge:
    """Learn from labelled rows outside the held-out fold.

    `docs` holds doc_id and text, `labels` doc_id and toxic; a document labelled both ways,
    a null id and a label other than 0 or 1 teach nothing. Repeated labels count once.
    """
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out_by(F.col("doc_id"), folds, held_out))
    single = written(own.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where(
        F.col("toxic") == F.col("most")).select("doc_id", "toxic"), "labels")
    numbers = {r["toxic"]: r["count"] for r in single.groupBy("toxic").count().collect()}
    share = numbers.get(1, 0) / max(1, sum(numbers.values()))
    if len(numbers) < 2:
        return Judge(None, np.zeros(4), share)
    chosen = [single.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    # At most 2 * per_class ids.
    few = F.broadcast(chosen[0].unionByName(chosen[1]))
    curve = F.pmod(F.xxhash64(F.lit("curve"), F.col("doc_id")), F.lit(CURVE_FOLDS)) == CURVE_FOLD
    rows = written(docs.select("doc_id", "text").join(few, "doc_id").withColumn("curve", curve), "labelled")
    taught = {r["toxic"]: r["count"] for r in rows.where("not curve").groupBy("toxic").count().collect()}
    if len(taught) < 2:
        return Judge(None, np.zeros(4), share)
    model = kneser_ney(expression_counts(rows.where("not curve")))
    fitted = written(features(rows.where("curve"), model), "features").toArrow()
    toxic = fitted.column("toxic").to_numpy().astype(float)
    if len(np.unique(toxic)) < 2:
        return Judge(model, np.array([-4.0, 0.0, 0.0, 1.0]), share)
    # The sample holds both classes alike; weights restore their shares.
    weights = np.where(toxic == 1, share / max(toxic.sum(), 1), (1 - share) / max((1 - toxic).sum(), 1)) * len(toxic)
    x = np.column_stack([fitted.column(c).to_numpy() for c in FEATURES])
    return Judge(model, logistic(x, toxic, weights), share)


def features(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory = Model(**shared.value), {}
        for batch in batches:
            at = 0
            for texts in slices(t.as_py() for t in batch.column(0)):
                columns = own.features(texts, memory).T
                toxic = batch.column(1).slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([toxic, *map(pa.array, columns)], ["toxic", *FEATURES])
                at += len(texts)

    return rows.select("text", "toxic").mapInArrow(run, "toxic int, " + ", ".join(f"{f} double" for f in FEATURES))


def with_scores(df: DataFrame, judge: Judge, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Append the score of every text, from its whole text and nothing else; every row is kept.

    Null and empty texts have no words: their score is the curve's at no difference. A column
    that has the name of the result is replaced; an empty table stays empty.
    """
    model = None if judge.model is None else vars(judge.model)
    shared = df.sparkSession.sparkContext.broadcast((model, judge.beta, judge.share))
    memory: dict[bytes, float] = {}

    def work(column: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        model, beta, share = shared.value
        own = Judge(None if model is None else Model(**model), beta, share)
        for texts in slices(t.as_py() for t in column):
            yield len(texts), [pa.array(own.scores(texts, memory), pa.float64())]

    return appended(df, text_col, {score_col: T.DoubleType()}, work)


def scored(docs: DataFrame, judge: Judge, folds: int = 5, held_out: int = 0, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; a null id is not held out. Other columns are not read."""
    found = with_scores(pick(docs, doc_id=id_col, text=text_col), judge)
    return found.select(
        "doc_id", held_out_by(F.col("doc_id"), folds, held_out).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
