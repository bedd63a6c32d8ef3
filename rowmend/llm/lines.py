"""Line dedup by site-relative frequency.

A line is boilerplate of a host when the pages of the host that contain it are more than a
given share of all its pages. Pages are exploded into line keys only to be counted, with
partial sums in the map tasks, so a hot host or line is never gathered. What comes back is
one short list per host: with share r, at most 1/r lines for each line of an average page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmend.columns import named

EDGES = " \t\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """128 bits that stand for a line without the white space at its ends."""
    bare = F.btrim(line, F.lit(EDGES))
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b"))


def not_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(EDGES)) != ""


def boilerplate_keys(df: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """(__host, __keys): the keys of every host's boilerplate lines."""
    pages = df.select(named(host_col).alias("__host"), named(text_col).alias("__text"))
    keys = F.array_distinct(F.transform(F.filter(lines_of(F.col("__text")), not_blank), line_key))
    counted = pages.select("__host", F.explode(keys).alias("__key")).groupBy("__host", "__key").agg(
        F.count("*").alias("__n"))
    totals = pages.groupBy("__host").agg(F.count("*").alias("__pages"))
    same = F.col("l.__host").eqNullSafe(F.col("t.__host"))
    # Only lines on several pages can exceed the share, which leaves little to join.
    often = counted.where(F.col("__n") >= min_pages).alias("l").join(totals.alias("t"), same)
    found = often.where(F.col("__n") > ratio * F.col("__pages"))
    return found.groupBy(F.col("l.__host").alias("__host")).agg(F.collect_list("__key").alias("__keys"))


def drop_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.05,
                     min_pages: int = 3, dropped_col: str | None = None) -> DataFrame:
    """The table with boilerplate lines cut from its texts; every row and column is kept.

    A line goes when it is on at least `min_pages` pages of the host (so a host of one page
    does not lose all) and on more than `ratio` of them. Lines are compared without white
    space at their ends; blank lines stay. A line repeated on one page counts once; repeated
    rows are pages of their own. Null hosts form one host; null texts stay null and count as
    pages; a text may become empty. `dropped_col` names an optional count of cut lines, and
    replaces a column of that name. An empty table stays empty.
    """
    if not 0 <= ratio <= 1:
        raise ValueError("the ratio must be between 0 and 1")
    keys = boilerplate_keys(df, host_col, text_col, ratio, min_pages)
    joined = df.alias("d").join(keys.alias("k"), named(host_col).eqNullSafe(F.col("k.__host")), "left")
    lines = lines_of(named(text_col))
    kept = F.filter(lines, lambda line: ~F.array_contains(F.col("__keys"), line_key(line)) | ~not_blank(line))
    text = F.when(F.col("__keys").isNull(), named(text_col)).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias(c) if c == text_col else named(c) for c in df.columns if c != dropped_col]
    if dropped_col:
        count = F.when(F.col("__keys").isNull(), F.lit(0)).otherwise(F.coalesce(F.size(lines) - F.size(kept), F.lit(0)))
        columns.append(F.greatest(count, F.lit(0)).cast("long").alias(dropped_col))
    return joined.select(columns)
