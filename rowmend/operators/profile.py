"""Column profiling and duplicate counts.

Counts are pre-aggregated in the map tasks, so a value held by a third of all rows costs
one row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmend.columns import named
from rowmend.functions.text import strip

SKIP = "-- Skip Duplicate Check --"
ENTIRE_ROW = "-- Entire Row (All Columns) --"


def profiled(c: Column) -> Column:
    text = strip(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(text == "", F.lit("BLANK")).otherwise(text)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(profiled(named(column)).alias("Value")).agg(F.count("*").alias("Count"))


def value_breakdown(df: DataFrame, column: str) -> DataFrame:
    """Values by falling count with their share of all rows, two decimals and a % sign."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("Count")).scalar()
    share = F.bround(F.col("Count") / total * 100, 2)
    return counts.withColumn("% of Total", F.concat(share.cast("string"), F.lit("%"))).orderBy(
        F.desc("Count"), "Value")


def row_fingerprint(df: DataFrame) -> list[Column]:
    """128 bits over a whole row; nulls count as equal to each other and not to ''.

    Plain values are hashed by type, so both zeros are one value and an instant is itself in
    any time zone. Nested values are hashed as text, which keeps an empty list and one of a
    null apart.
    """
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))}
    marked = [x for c in df.columns
              for x in (named(c).isNull(), named(c).cast("string") if c in nested else named(c))]
    return [F.xxhash64(F.lit(salt), *marked) for salt in ("a", "b")]


def distinct_rows(df: DataFrame, exact: bool = False) -> Column:
    """Number of distinct rows. The fingerprint keeps the shuffle at 16 bytes per row;
    `exact` compares the rows themselves."""
    if exact:
        return F.count_distinct(F.struct(*[named(c) for c in df.columns]))
    return F.count_distinct(F.struct(*row_fingerprint(df)))


def profile(df: DataFrame, column: str, dedupe: str = SKIP, exact: bool = False) -> DataFrame:
    """One row: total, found and not-found counts, unique and duplicate entries.

    An unknown dedupe column counts nothing as unique.
    """
    total = F.count("*")
    if column in df.columns:
        value = F.lower(profiled(named(column)))
        found, missing = F.count_if(value == "found"), F.count_if(value == "not found")
    else:
        found, missing = F.count_if(F.lit(False)), F.count_if(F.lit(False))
    if dedupe == SKIP:
        unique_rows, duplicates = F.lit(0).cast("long"), F.lit(0).cast("long")
    else:
        if dedupe == ENTIRE_ROW:
            unique_rows = distinct_rows(df, exact)
        elif dedupe in df.columns:
            text = F.coalesce(named(dedupe).cast("string"), F.lit(""))
            unique_rows = F.count_distinct(strip(text))
        else:
            unique_rows = F.lit(0).cast("long")
        duplicates = total - unique_rows
    return df.agg(
        total.alias("total_rows"), found.alias("found_rows"), missing.alias("not_found_rows"),
        unique_rows.alias("unique_count"), duplicates.alias("duplicate_count"),
    )


def table_summary(df: DataFrame, exact: bool = False) -> DataFrame:
    """Rows, columns, rows that repeat an earlier one, and null cells."""
    nulls = sum((F.when(named(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    return df.agg(
        F.count("*").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        (F.count("*") - distinct_rows(df, exact)).alias("duplicate_rows"),
        F.coalesce(F.sum(nulls), F.lit(0)).alias("total_nulls"),
    )
