"""Search for lists of many thousand terms: one automaton reads every cell once.

An Aho-Corasick automaton follows all terms at the same time, so a row costs its own length and
what is found in it, nearly whatever the number of terms. One automaton reads the text of a row,
another the digits of its cells. The list travels to the workers once; more terms than an
automaton should hold are searched in several passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmend.columns import named
from rowmend.functions.text import digits_of
from rowmend.operators.search import RESULT, cell_separator, prepare_terms

# Characters of terms in one pass: a worker holds an automaton of some dozens of bytes for each.
PASS_CHARS = 1_000_000

Terms = list[tuple[str, str]]


def in_passes(terms: Terms, limit: int) -> Iterator[Terms]:
    held, size = [], 0
    for term in terms:
        held.append(term)
        size += sum(map(len, term))
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def automaton(words: Iterable[tuple[str, str]]):
    import ahocorasick

    built = ahocorasick.Automaton()
    for word, term in words:
        built.add_word(word, term)
    built.make_automaton()
    return built


def finder(spark: SparkSession, terms: Terms) -> Callable[[], tuple[Any, Any]]:
    """Both automata, built once in each worker."""
    shared = spark.sparkContext.broadcast({"terms": terms})

    def own() -> tuple[Any, Any]:
        held = shared.value
        if "built" not in held:
            digits = [(d, t) for t, d in held["terms"] if d]
            held["built"] = automaton((t, t) for t, _ in held["terms"]), automaton(digits) if digits else None
        return held["built"]

    return own


def hits(rows: DataFrame, terms: Terms) -> DataFrame:
    """Rows (text, digits, kept) with an array of the terms found, those with any."""
    find = finder(rows.sparkSession, terms)
    schema = T.StructType([*rows.select("kept").schema.fields, T.StructField("terms", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_text, by_digits = find()
        for batch in batches:
            place, found = [], []
            for n, (text, digits) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                terms_here = {term for _, term in by_text.iter(text)}
                if by_digits is not None:
                    terms_here.update(term for _, term in by_digits.iter(digits))
                if terms_here:
                    place.append(n)
                    found.append(sorted(terms_here))
            kept = batch.column(2).take(pa.array(place, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept, pa.array(found, pa.list_(pa.string()))], ["kept", "terms"])

    return rows.mapInArrow(run, schema)


def search_many(df: DataFrame, terms: Iterable[str], row_number: Column, source_file: Column | str = "",
                sheet_name: Column | str = "", columns: Iterable[str] | None = None,
                pass_chars: int = PASS_CHARS) -> DataFrame:
    """The rows of `search` for term lists of any length: one per input row and term found."""
    prepared = prepare_terms(terms)
    columns = list(columns or df.columns)
    if not prepared:
        raise ValueError("no search terms")
    where = [x if isinstance(x, Column) else F.lit(x) for x in (source_file, sheet_name)]
    cells = [named(c).cast("string") for c in columns]
    row_text = F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cells])
    kept = F.struct(where[0].alias(RESULT[1]), where[1].alias(RESULT[2]), row_number.cast("long").alias(RESULT[3]),
                    row_text.alias(RESULT[4]))
    rows = df.select(F.concat_ws(cell_separator(prepared), *cells).alias("text"),
                     F.concat_ws(" ", *[digits_of(c) for c in cells]).alias("digits"), kept.alias("kept"))
    out = None
    for some in in_passes(prepared, pass_chars):
        part = hits(rows, some)
        out = part if out is None else out.unionByName(part)
    return out.select(F.explode("terms").alias(RESULT[0]), "kept.*")
