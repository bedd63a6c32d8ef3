"""Window functions over groups of any size: running totals, frames by rows, neighbours.

A window over a key is one task per key, so one hot key is one slow task. Here rows are placed in
range partitions by key and order (see `numbering`), which cut a large group anywhere. Frames that
begin at the group's start are computed within each piece, and a prefix scan over one summary a
piece tells what came before it. Frames of a few rows see copies of the rows just beyond the
border. No window is larger than a range partition, whatever the sizes of groups.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmend.columns import named
from rowmend.operators.numbering import GROUP, PART, POS, place_rows

Order = Sequence[Column | str]
PIECE = [PART, GROUP]


def last_known(value: Column) -> Column:
    return F.last(value, ignorenulls=True)


def added(before: Column, own: Column) -> Column:
    """Sum of two, of which either may be missing."""
    return F.coalesce(before + own, before, own)


@dataclass(frozen=True)
class Merge:
    """An aggregate with the rule that joins its values of two stretches, the earlier one first."""

    aggregate: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]
    over: Callable[[Column], Column]


# How a running aggregate is computed in a piece, joined with what came before, and gathered over pieces.
RUNNING = {
    "sum": Merge(F.sum, added, F.sum),
    "count": Merge(F.count, added, F.sum),
    "min": Merge(F.min, F.least, F.min),
    "max": Merge(F.max, F.greatest, F.max),
    "last": Merge(last_known, lambda before, own: F.coalesce(own, before), last_known),
}


@dataclass(frozen=True)
class Running:
    """`function` (sum, count, min, max, last known) of `value` from the group's first row to this one."""

    function: str
    value: str | Column


@dataclass(frozen=True)
class Frame:
    """An aggregate over the rows from `preceding` before this one to `following` after it."""

    aggregate: Column
    preceding: int = 0
    following: int = 0


@dataclass(frozen=True)
class Neighbour:
    """A value some rows away: F.lag or F.lead, with the distance it looks."""

    expression: Column
    reach: int


def as_columns(items: Order) -> list[Column]:
    return [named(c) if isinstance(c, str) else c for c in items]


def placed_values(df: DataFrame, group_by: Sequence[str], order_by: Order, values: Mapping[str, Column]) -> DataFrame:
    return place_rows(df.withColumns(dict(values)), as_columns(order_by), as_columns(group_by))


def piece_summaries(placed: DataFrame, functions: Mapping[str, str]) -> DataFrame:
    """What all earlier pieces of a group add up to: a row for every piece that has any.

    A partition has at most one group that began before it, so these rows are no more than the
    partitions.
    """
    summaries = placed.groupBy(*PIECE).agg(
        F.count("*").alias("__rows"), *[RUNNING[f].aggregate(F.col(c)).alias(c) for c, f in functions.items()])
    earlier = Window.partitionBy(GROUP).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    found = summaries.select(
        *PIECE, F.sum("__rows").over(earlier).alias("__before"),
        *[RUNNING[f].over(F.col(c)).over(earlier).alias(f"{c}_before") for c, f in functions.items()])
    return found.where("__before IS NOT NULL").drop("__before")


def running_columns(df: DataFrame, group_by: Sequence[str], order_by: Order,
                    columns: Mapping[str, Running]) -> DataFrame:
    """Append running aggregates, in the given order within each group.

    Nulls are left out as by the plain aggregates; null keys form a group. The order is rising;
    negate a column for a falling one. Rows of equal order may come in any order among
    themselves, so give a total one. Result columns that exist are replaced. An empty table
    stays empty.
    """
    functions = {f"__run{n}": spec.function for n, spec in enumerate(columns.values())}
    values = {c: as_columns([spec.value])[0] for c, spec in zip(functions, columns.values())}
    placed = placed_values(df, group_by, order_by, values)
    # Bounded by the number of partitions.
    earlier = F.broadcast(piece_summaries(placed, functions))
    within = Window.partitionBy(*PIECE).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumns({c: RUNNING[f].aggregate(F.col(c)).over(within) for c, f in functions.items()})
    keys = [own[c].eqNullSafe(earlier[c]) for c in PIECE]
    joined = own.join(earlier, keys[0] & keys[1], "left")
    done = [RUNNING[f].join(F.col(f"{c}_before"), own[c]).alias(name) for name, (c, f) in zip(columns, functions.items())]
    return joined.select(*[own[f"`{c}`"] for c in df.columns if c not in columns], *done)


def with_border_rows(placed: DataFrame, before: int, after: int) -> DataFrame:
    """Append copies of the rows that lie up to so many rows before or after each partition.

    Copies carry the partition they are for and are marked `__copy`. Only rows close to a border
    can be copied, and how many partitions a row is close to is told by their sizes.
    """
    counts = {r[PART]: r["n"] for r in placed.groupBy(PART).agg((F.max(POS) + 1).alias("n")).collect()}
    parts = sorted(counts)
    starts, total = {}, 0
    for part in parts:
        starts[part], total = total, total + counts[part]
    spark = placed.sparkSession
    known = spark.createDataFrame([(p, starts[p], counts[p]) for p in parts], f"{PART} int, __first long, __size long")
    # One row for every partition.
    rows = placed.join(F.broadcast(known), PART).withColumn("__at", F.col("__first") + F.col(POS))
    close = rows.where((F.col(POS) < after) | (F.col(POS) >= F.col("__size") - before))
    listed = F.expr("array(" + ", ".join(
        f"named_struct('part', {p}, 'low', {starts[p]}L, 'high', {starts[p] + counts[p]}L)" for p in parts) + ")")
    at = F.col("__at")
    wanted = F.filter(listed, lambda p: (p["part"] != F.col(PART)) & (at >= p["low"] - before) & (at < p["high"] + after))
    copies = close.withColumn("__to", F.explode(wanted)).withColumn(PART, F.col("__to.part")).drop("__to")
    return rows.withColumn("__copy", F.lit(False)).unionByName(copies.withColumn("__copy", F.lit(True)))


def framed_columns(df: DataFrame, group_by: Sequence[str], order_by: Order,
                   columns: Mapping[str, Frame | Neighbour]) -> DataFrame:
    """Append aggregates over frames of rows, and values of neighbours, within each group.

    The same rules hold as for running columns. A frame is cut at the ends of its group.
    """
    before = max([0, *(c.reach if isinstance(c, Neighbour) else c.preceding for c in columns.values())])
    after = max([0, *(c.reach if isinstance(c, Neighbour) else c.following for c in columns.values())])
    placed = place_rows(df, as_columns(order_by), as_columns(group_by))
    if placed.isEmpty():
        rows = placed.withColumns({"__at": F.lit(0).cast("long"), "__copy": F.lit(False)})
    else:
        rows = with_border_rows(placed, before, after)
    order = Window.partitionBy(*PIECE).orderBy("__at")

    def over(spec: Frame | Neighbour) -> Column:
        if isinstance(spec, Neighbour):
            return spec.expression.over(order)
        return spec.aggregate.over(order.rowsBetween(-spec.preceding, spec.following))

    done = rows.withColumns({f"__frame{n}": over(spec) for n, spec in enumerate(columns.values())})
    return done.where(~F.col("__copy")).select(
        *[named(c) for c in df.columns if c not in columns],
        *[F.col(f"__frame{n}").alias(name) for n, name in enumerate(columns)])
