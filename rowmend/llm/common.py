"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmend.columns import named

# What a mapping function may hold at once beside one document.
SLICE_BYTES = 4 << 20


def held_out_by(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a row falls in the fold kept from learning; a null id is never held out."""
    remainder = F.crc32(doc_id.cast("string").cast("binary")) % folds
    return F.coalesce(remainder == fold, F.lit(False))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; others cannot clash."""
    return df.select(*[named(source).alias(own) for own, source in columns.items()])


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; bytes.split() and lower() do just that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def slices(texts: Iterable[str | None], limit: int = SLICE_BYTES) -> Iterator[list[str]]:
    """Consecutive texts of about `limit` characters together, null as ''."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with one output batch for each input batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


def appended(df: DataFrame, source_col: str, new: dict[str, T.DataType],
             work: Callable[[pa.Array], Iterator[tuple[int, list[pa.Array]]]]) -> DataFrame:
    """Append columns made from one other, some rows at a time; columns of these names are replaced."""
    source = df.select(*[named(c) for c in df.columns if c not in new and c != "__text"], named(source_col).alias("__source"))
    kept, schema = source.columns[:-1], source.drop("__source").schema
    for name, kind in new.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for rows, columns in work(batch.column(len(kept))):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*kept, *new])
                at += rows

    return source.mapInArrow(run, schema)
