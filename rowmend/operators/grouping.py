"""Aggregates over many sets of keys at once, first rows of groups, and tables as bags of rows.

Grouping sets are computed from one aggregation by all keys, whose results are states that merge:
counts and sums add, extremes compare, and distinct counts and quantiles are sketches. The input is
read and shuffled once whatever the number of sets, and only the states are copied for each set.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmend.columns import named
from rowmend.sources.workspace import written

DISTINCT_BITS, QUANTILE_SIZE = 14, 400


@dataclass(frozen=True)
class Measure:
    """A state made of rows, the merging of states, and the result read off a merged one."""

    of_rows: Column
    merged: Callable[[Column], Column]
    result: Callable[[Column], Column] = lambda state: state


def count() -> Measure:
    return Measure(F.count("*"), F.sum)


def total(column: str) -> Measure:
    return Measure(F.sum(named(column)), F.sum)


def least(column: str) -> Measure:
    return Measure(F.min(named(column)), F.min)


def most(column: str) -> Measure:
    return Measure(F.max(named(column)), F.max)


def mean(column: str) -> Measure:
    """Sum and count travel together; no value gives null."""
    def merged(state: Column) -> Column:
        return F.struct(F.sum(state["total"]).alias("total"), F.sum(state["n"]).alias("n"))

    value = named(column)
    return Measure(F.struct(F.sum(value).alias("total"), F.count(value).alias("n")), merged,
                   lambda state: F.try_divide(state["total"], state["n"]))


def distinct(column: str, bits: int = DISTINCT_BITS) -> Measure:
    """Distinct values by sketch: the relative error is about 0.8 / sqrt(2 ** bits), 0.7 % by default."""
    return Measure(F.hll_sketch_agg(named(column), F.lit(bits)), F.hll_union_agg, F.hll_sketch_estimate)


def quantile(column: str, share: float, size: int = QUANTILE_SIZE) -> Measure:
    """A value whose rank is the given share of all, by sketch: about 0.7 % off in rank by default."""
    return Measure(F.kll_sketch_agg_double(named(column).cast("double"), F.lit(size)),
                   lambda state: F.kll_merge_agg_double(state, F.lit(size)),
                   lambda state: F.kll_sketch_get_quantile_double(state, F.lit(share)))


def rollup_sets(keys: Sequence[str]) -> list[tuple[str, ...]]:
    return [tuple(keys[:n]) for n in range(len(keys), -1, -1)]


def cube_sets(keys: Sequence[str]) -> list[tuple[str, ...]]:
    return [kept for n in range(len(keys), -1, -1) for kept in combinations(keys, n)]


def set_keys(sets: Sequence[Sequence[str]]) -> dict[str, str]:
    """All keys of the sets by the names they have within."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    if not keys:
        raise ValueError("no set has a key")
    return {f"__key{n}": k for n, k in enumerate(keys)}


def different_sets(sets: Sequence[Sequence[str]]) -> list[tuple[str, ...]]:
    return list(dict.fromkeys(tuple(sorted(set(s))) for s in sets))


def masked_keys(df: DataFrame, own: Mapping[str, str], kept: Sequence[str]) -> Column:
    """The key of a row in one set: those left out are null, and have their bits in `level`."""
    level = sum(1 << (len(own) - 1 - n) for n, k in enumerate(own.values()) if k not in kept)
    values = [(F.col(c) if k in kept else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c, k in own.items()]
    return F.struct(*values, F.lit(level).alias("level"))


def grouped_by_sets(df: DataFrame, sets: Sequence[Sequence[str]], measures: Mapping[str, Measure],
                    level_col: str = "grouping_level") -> DataFrame:
    """One row for every group of every set: all keys, `level_col` and the measures.

    A key a set leaves out is null, and its bit in `level_col` is one, the first key's the highest;
    so a null that is a key's own value is told apart. Repeated sets count once. The empty set is a
    single row, also over an empty table; other sets are then empty.
    """
    own = set_keys(sets)
    states = {f"__state{n}": m for n, m in enumerate(measures.values())}
    base = written(df.groupBy(*[named(k).alias(c) for c, k in own.items()]).agg(
        *[m.of_rows.alias(c) for c, m in states.items()]), "states")

    wanted = different_sets(sets)
    several = [s for s in wanted if s]
    parts = []
    if several:
        spread = base.withColumn("__set", F.explode(F.array(*[masked_keys(base, own, s) for s in several])))
        parts.append(spread.groupBy("__set").agg(*[m.merged(F.col(c)).alias(c) for c, m in states.items()]))
    if () in wanted:
        # Straight from the rows when there are none, so that sketches of nothing exist too.
        whole = df.agg(*[m.of_rows.alias(c) for c, m in states.items()]) if base.isEmpty() else base.agg(
            *[m.merged(F.col(c)).alias(c) for c, m in states.items()])
        parts.append(whole.withColumn("__set", masked_keys(base, own, ())))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select(
        *[F.col("__set").getField(c).alias(k) for c, k in own.items()], F.col("__set.level").alias(level_col),
        *[m.result(F.col(c)).alias(name) for name, (c, m) in zip(measures, states.items())])


def between_quantiles(df: DataFrame, sets: Sequence[Sequence[str]], groups: DataFrame, value: str, column: str,
                      low: float, high: float, result_col: str, level_col: str = "grouping_level") -> DataFrame:
    """Rows that `grouped_by_sets` made of a table, with whether `value` lies between two exact quantiles of a column.

    Quantiles are those of `percentile`: of the values as doubles without nulls, interpolated
    between the rows next to the rank. How many rows lie below `value` and at most at it, and which
    lie next to it, tells the same as the quantiles would. So each set of a row adds to a few counts
    and extremes in its own task, and no values are gathered or sorted. The groups are broadcast: a
    state was kept of each. Groups without rows are left out; a null `value` gives null, and so do
    groups without values.
    """
    own = set_keys(sets)
    rows = df.select(*[named(k).alias(c) for c, k in own.items()], named(column).cast("double").alias("__x"))
    spread = rows.select("__x", F.explode(F.array(*[masked_keys(rows, own, s) for s in different_sets(sets)])).alias("__set"))
    of = {name: f"__of{n}" for n, name in enumerate(groups.columns)}
    same = F.col("__set.level") == F.col(of[level_col])
    for c, k in own.items():
        same = same & F.col("__set").getField(c).eqNullSafe(F.col(of[k]))
    x, v = F.col("__x"), F.col(of[value]).cast("double")
    told = spread.join(F.broadcast(groups.toDF(*of.values())), same).groupBy(*of.values()).agg(
        F.count(x).alias("__n"), F.count_if(x < v).alias("__less"), F.count_if(x <= v).alias("__most"),
        F.max(F.when(x < v, x)).alias("__before"), F.min(F.when(x >= v, x)).alias("__from"),
        F.max(F.when(x <= v, x)).alias("__to"), F.min(F.when(x > v, x)).alias("__after"))

    def side(share: float, count: str, one: str, two: str) -> tuple[Column, Column, Column]:
        """Both rows next to a rank are among the first `count`, neither is, and else the quantile."""
        place = F.lit(share) * (F.col("__n") - 1)
        first, second = F.floor(place), F.ceil(place)
        between = (second - place) * F.col(one) + (place - first) * F.col(two)
        return second < F.col(count), first >= F.col(count), between

    within, beyond, quantile_low = side(low, "__most", "__to", "__after")
    above = F.when(within, True).when(beyond, False).otherwise(quantile_low <= v)
    within, beyond, quantile_high = side(high, "__less", "__before", "__from")
    below = F.when(beyond, True).when(within, False).otherwise(quantile_high >= v)
    return told.select(*[F.col(c).alias(name) for name, c in of.items() if name != result_col],
                       F.when(v.isNotNull() & (F.col("__n") > 0), above & below).alias(result_col))


def first_of_groups(df: DataFrame, group_by: Sequence[str], order_by: Sequence[Column | str], count: int,
                    place_col: str = "place", ties: bool = False) -> DataFrame:
    """The first `count` rows of every group with their place; with `ties` all rows of the last place too.

    Every map task keeps that many of a group before the shuffle, so a group of any size sends
    no more than `count` rows a task. Nulls sort as the order says; null keys form a group. Give
    a total order for equal results in every run. An existing `place_col` is replaced.
    """
    order = Window.partitionBy(*[named(k) for k in group_by]).orderBy(*[named(c) if isinstance(c, str) else c for c in order_by])
    place = (F.rank() if ties else F.row_number()).over(order)
    kept = df.select(*[named(c) for c in df.columns if c != place_col])
    return kept.withColumn(place_col, place).where(named(place_col) <= count)


def bag_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every distinct row of both tables with how often each has it, `__left` and `__right`.

    Rows are compared by type, as grouping does: nulls equal nulls, both zeros are one value. Only
    counts are added up, so copies of a row meet as one from each task.
    """
    if left.columns != right.columns:
        raise ValueError("both tables must have the same columns in one order")

    def marked(df: DataFrame, own: str, other: str) -> DataFrame:
        return df.groupBy(*[named(c) for c in df.columns]).agg(F.count("*").alias(own)).withColumn(other, F.lit(0).cast("long"))

    both = marked(left, "__left", "__right").unionByName(marked(right, "__right", "__left"))
    return both.groupBy(*[named(c) for c in left.columns]).agg(
        F.sum("__left").alias("__left"), F.sum("__right").alias("__right"))


def repeated(counts: DataFrame, times: Column) -> DataFrame:
    """Rows as often as `times` says; none below one."""
    columns = [named(c) for c in counts.columns if c not in ("__left", "__right")]
    some = counts.withColumn("__times", times).where("__times > 0")
    return some.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))).alias("__n")).drop("__n")


def common_rows(left: DataFrame, right: DataFrame, every: bool = False) -> DataFrame:
    """Rows of both tables: each once, or with `every` as often as both have it."""
    times = F.least("__left", "__right")
    return repeated(bag_counts(left, right), times if every else F.least(times, F.lit(1)))


def rows_without(left: DataFrame, right: DataFrame, every: bool = False) -> DataFrame:
    """Rows of the left table that the right one lacks: each once, or with `every` those it has more often."""
    if every:
        return repeated(bag_counts(left, right), F.col("__left") - F.col("__right"))
    return repeated(bag_counts(left, right), F.when(F.col("__right") == 0, F.least("__left", F.lit(1))))


def row_differences(left: DataFrame, right: DataFrame, count_col: str = "surplus") -> DataFrame:
    """Rows that two tables have unequally often, with how much more often the left one has them."""
    counts = bag_counts(left, right).withColumn(count_col, F.col("__left") - F.col("__right"))
    return counts.where(named(count_col) != 0).drop("__left", "__right")
