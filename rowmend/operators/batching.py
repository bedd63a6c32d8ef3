"""Size-capped batches: fill a batch in order, open the next when the cap would be passed.

Where a batch ends depends on all rows before it, yet no group is gathered in one task.
Rows are placed in range partitions; a group may span many of them. For a partition that
continues a group, every possible fill level on entry is reduced to the level and batch
count on exit. Chaining these small tables gives each partition its true entry level,
and all partitions are then numbered at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Row as FoundRow
from pyspark.sql import functions as F

from rowmend.columns import named
from rowmend.operators.numbering import GROUP, PART, POS, Edge, partition_edges, place_rows
from rowmend.sources.workspace import written

SIZE, LEVEL, BATCHES, ROW = "__size", "__level", "__batches", "__row"
SHORT_TABLE = 200


def fill(sizes: np.ndarray, cap: int, level: int = 0) -> tuple[np.ndarray, int]:
    """Batch index of each row when the open batch already holds `level`, and the final level."""
    total = np.cumsum(sizes)
    index = np.zeros(len(sizes), np.int64)
    base, at = -level, 0
    while True:
        at = int(np.searchsorted(total, base + cap, side="right"))
        if at >= len(sizes):
            return index, int(total[-1] - base) if len(sizes) else level
        index[at:] += 1
        base = int(total[at - 1]) if at else 0


def exits(sizes: np.ndarray, cap: int) -> list[tuple[int, int, int | None]]:
    """Exit state by entry level: (levels above this, batches opened, exit level).

    Sorted by falling threshold, neighbours with equal outcome merged. The exit level is
    None when no batch ends here, so that the entry level carries through.
    """
    n = len(sizes)
    total = np.cumsum(sizes)
    before = np.concatenate(([0], total[:-1]))
    jump = np.append(np.searchsorted(total, before + cap, side="right"), n)
    opened = np.append(np.ones(n, np.int64), 0)
    last = np.arange(n + 1)
    # Pointer doubling from each row to the start of the last batch in this partition.
    while (jump[:n] < n).any():
        live = jump < n
        opened = np.where(live, opened + opened[jump], opened)
        last = np.where(live, last[jump], last)
        jump = np.where(live, jump[jump], jump)
    first_break = int(np.searchsorted(total, cap, side="right"))
    table: list[tuple[int, int, int | None]] = []
    for j in range(min(first_break + 1, n)):
        state = (int(opened[j]), int(total[-1] - before[last[j]]))
        if table and table[-1][1:] == state:
            table.pop()
        table.append((int(cap - total[j]), *state))
    if n and first_break >= n:
        table.append((-1, 0, None))
    return table


def _exit_table(cap: int):
    def table(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows.sort_values(POS)[SIZE].to_numpy(np.int64)
        out = pd.DataFrame(exits(sizes, cap), columns=["above", "opened", "level"])
        out["level"] = out["level"].astype("Int64")
        out["total"] = int(sizes.sum())
        out.insert(0, PART, key[0])
        return out

    return table


def exit_lookup(table: DataFrame, cap: int) -> Callable[[int, int], tuple[int, int]]:
    """Function from (partition, entry level) to (batches opened, exit level).

    Where many batches end in a partition its table merges to a few rows, and those are
    read at once. A table stays long only where batches span partitions; then a batch
    rarely ends in one, and the single row needed is fetched.
    """
    counts = written(table.groupBy(PART).agg(F.count("*").alias("n"), F.max("total").alias("sum")), "exits")
    totals = {r[PART]: r["sum"] for r in counts.collect()}
    # One row per partition: the broadcast is bounded by the partition count.
    short = table.join(F.broadcast(counts.filter(F.col("n") <= SHORT_TABLE).select(PART)), PART)
    known: dict[int, list[FoundRow]] = {}
    for row in short.orderBy(PART, F.desc("above")).toLocalIterator():
        known.setdefault(row[PART], []).append(row)

    def after(part: int, level: int) -> tuple[int, int]:
        if level + totals[part] <= cap:
            return 0, level + totals[part]
        if part in known:
            row = next(r for r in known[part] if level > r["above"])
        else:
            fitting = table.filter((F.col(PART) == part) & (F.col("above") < level))
            row = fitting.orderBy(F.desc("above")).first()
        return row["opened"], row["level"]

    return after


def entry_states(edges: Sequence[Edge], fresh: dict[int, tuple[int, int]],
                 after: Callable[[int, int], tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Partition, batches opened before it and entry level of its first group."""
    states, left, previous = [], (0, 0), None
    for edge in edges:
        continues = previous is not None and previous.last == edge.first
        opened, level = left if continues else (0, 0)
        states.append((edge.part, opened, level))
        if continues and edge.one_group:
            more, level = after(edge.part, level)
            left = (opened + more, level)
        else:
            left = fresh[edge.part]
        previous = edge
    return states


def size_batches(df: DataFrame, size: str, cap: int, order_by: Sequence[Column | str],
                 group_by: Sequence[str] = (), column: str = "batch") -> DataFrame:
    """Append the batch number within the group, from 1; null for a row above the cap.

    Sizes and cap are whole numbers in the same unit; the order should be unique.
    """
    order = [named(c) if isinstance(c, str) else c for c in order_by]
    spark, names = df.sparkSession, [c for c in df.columns if c != column]
    amount = F.coalesce(named(size).cast("long"), F.lit(0))
    too_big = amount > F.lit(cap)
    # Written with a number for every row, so that only keys, sizes and numbers are sorted.
    fitting = written(df.filter(~too_big).withColumns({SIZE: amount, ROW: F.monotonically_increasing_id()}), "fitting")
    keys = {f"__by{n}": c for n, c in enumerate(order)} | {f"__in{n}": named(c) for n, c in enumerate(group_by)}
    thin = fitting.select(*[c.alias(k) for k, c in keys.items()], SIZE, ROW)
    placed = place_rows(thin, [F.col(k) for k in keys if k.startswith("__by")], [F.col(k) for k in keys if k.startswith("__in")])
    edges = partition_edges(placed)
    continuing = [(b.part, b.first_rows) for a, b in zip(edges, edges[1:]) if a.last == b.first]

    slim = placed.select(PART, GROUP, POS, SIZE, ROW)
    tails = spark.createDataFrame([(e.part, e.last_rows) for e in edges], f"{PART} int, n long")
    ends = slim.groupBy(PART).agg(F.max(POS).alias("end"))
    last_segments = slim.join(F.broadcast(tails), PART).join(F.broadcast(ends), PART).filter(
        F.col(POS) > F.col("end") - F.col("n"))

    def fresh_exit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        index, level = fill(rows.sort_values(POS)[SIZE].to_numpy(np.int64), cap)
        return pd.DataFrame({PART: [key[0]], "opened": [int(index[-1])], "level": [level]})

    fresh, after = {e.part: (0, 0) for e in edges}, lambda part, level: (0, level)
    if continuing:
        found = last_segments.groupBy(PART).applyInPandas(fresh_exit, f"{PART} int, opened long, level long")
        fresh |= {r[PART]: (r["opened"], r["level"]) for r in found.collect()}
        heads = spark.createDataFrame(continuing, f"{PART} int, n long")
        entered = slim.join(F.broadcast(heads), PART).filter(F.col(POS) < F.col("n"))
        schema = f"{PART} int, above long, opened long, level long, total long"
        table = entered.groupBy(PART).applyInPandas(_exit_table(cap), schema)
        after = exit_lookup(written(table, "exits"), cap)
    states = spark.createDataFrame(
        entry_states(edges, fresh, after), f"{PART} int, {BATCHES} long, {LEVEL} long")

    def number(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(POS)
        entered = int(rows[POS].iloc[0]) == 0
        level = int(rows[LEVEL].iloc[0]) if entered else 0
        index, _ = fill(rows[SIZE].to_numpy(np.int64), cap, level)
        rows[column] = index + 1 + (int(rows[BATCHES].iloc[0]) if entered else 0)
        return rows[[ROW, column]]

    numbered = (
        slim.join(F.broadcast(states), PART).groupBy(PART, GROUP)
        .applyInPandas(number, f"{ROW} long, `{column}` long")
    )
    batched = fitting.select(*[named(c) for c in names], ROW).join(numbered, ROW)
    skipped = df.filter(too_big).withColumn(column, F.lit(None).cast("long"))
    out = [*[named(c) for c in names], named(column)]
    return batched.select(out).unionByName(skipped.select(out))
