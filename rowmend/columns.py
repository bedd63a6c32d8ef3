"""Column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """Exact column reference; dots and backticks in headers are literal."""
    return F.col("`" + name.replace("`", "``") + "`")


def unique(names: Iterable[str]) -> list[str]:
    """Drop repeated headers, keeping the first of each."""
    return list(dict.fromkeys(names))


def as_text(df: DataFrame, blank_nulls: bool = True) -> DataFrame:
    """Cast a typed table to the all-string model; nulls become '' unless told otherwise."""
    def cell(name: str) -> Column:
        text = named(name).cast("string")
        return (F.coalesce(text, F.lit("")) if blank_nulls else text).alias(name)

    return df.select([cell(name) for name in df.columns])


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Append costly columns so that later filters read them instead of repeating them.

    A filter on a plain projected column is pushed below the projection together with a
    copy of the whole expression, which for nested rules multiplies both plan and work.
    Nothing is pushed below a generator, and one with a single-element array adds no rows.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [named(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def first_item(items: Column) -> Column:
    """First element of an array, '' when there is none."""
    return F.coalesce(F.get(items, F.lit(0)), F.lit(""))


def sql_list(words: Iterable[str]) -> str:
    """Comma-separated SQL string literals."""
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)


def literal_array(words: Iterable[str]) -> Column:
    """Array literal parsed in one call; building it word by word is slow from Python."""
    return F.expr(f"array({sql_list(words)})")


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether any of the words occurs in the text; the text should be a plain column."""
    return F.exists(literal_array(words), lambda word: F.contains(text, word))
