"""Dense row numbers over a whole table or within groups, without a one-task window.

Rows are sorted across range partitions and written with their place, so numbering is a
matter of adding one offset per partition. A group of any size may span partitions: the
number of driver-side offsets depends on partitions, never on rows or groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmend.columns import named
from rowmend.sources.workspace import written

PART, POS, GROUP = "__part", "__pos", "__group"
WITHIN = (1 << 33) - 1


def place_rows(df: DataFrame, order_by: Sequence[Column], group_by: Sequence[Column] = ()) -> DataFrame:
    """Sort by group and order, and write every row with its partition and position.

    The order should be unique: a range partitioner can cut anywhere but inside equal
    keys. Written, because a place computed twice need not come out the same.
    """
    group = F.struct(*[c.alias(f"g{i}") for i, c in enumerate(group_by)]) if group_by else (
        F.struct(F.lit(0).alias("g0")))
    # Sort keys are columns of their own: a sort evaluates an expression at every comparison.
    keys = {f"__order{i}": c for i, c in enumerate(order_by)}
    ordered = df.withColumns({GROUP: group} | keys).orderBy(GROUP, *keys).drop(*keys)
    placed = ordered.withColumns({
        PART: F.spark_partition_id(),
        POS: F.monotonically_increasing_id().bitwiseAND(F.lit(WITHIN)),
    })
    return written(placed, "placed")


@dataclass(frozen=True)
class Edge:
    """First and last group of a partition with their row counts there."""

    part: int
    first: Any
    first_rows: int
    last: Any
    last_rows: int

    @property
    def one_group(self) -> bool:
        return self.first == self.last


def partition_edges(placed: DataFrame) -> list[Edge]:
    """One entry per non-empty partition, in order."""
    segments = placed.groupBy(PART, GROUP).agg(F.count("*").alias("n"), F.min(POS).alias("at"))
    segment = F.struct(F.col(GROUP).alias("key"), F.col("n").alias("rows"))
    edges = segments.groupBy(PART).agg(
        F.min_by(segment, "at").alias("head"), F.max_by(segment, "at").alias("tail"))
    return [
        Edge(e[PART], e["head"]["key"], e["head"]["rows"], e["tail"]["key"], e["tail"]["rows"])
        for e in edges.orderBy(PART).collect()
    ]


def carried_rows(edges: Sequence[Edge]) -> dict[int, int]:
    """Rows of a partition's first group that lie in earlier partitions."""
    carried, before, previous = {}, 0, None
    for edge in edges:
        before = before if previous is not None and previous.last == edge.first else 0
        carried[edge.part] = before
        before = edge.last_rows + (before if edge.one_group else 0)
        previous = edge
    return carried


def per_partition(spark: SparkSession, values: dict[int, int], name: str) -> DataFrame:
    schema = T.StructType([T.StructField(PART, T.IntegerType()), T.StructField(name, T.LongType())])
    return spark.createDataFrame(list(values.items()), schema)


def number_rows(df: DataFrame, order_by: Sequence[Column | str], group_by: Sequence[str] = (),
                column: str = "row_number", start: int = 1) -> DataFrame:
    """Append consecutive numbers in the given order, restarting for every group."""
    order = [named(c) if isinstance(c, str) else c for c in order_by]
    placed = place_rows(df, order, [named(c) for c in group_by])
    carried = per_partition(df.sparkSession, carried_rows(partition_edges(placed)), "__carried")
    if group_by:
        # Segment starts per (partition, group): no segment exceeds one range partition.
        segments = placed.groupBy(PART, GROUP).agg(F.min(POS).alias("__start"))
        rows = placed.join(segments, [PART, GROUP])
    else:
        rows = placed.withColumn("__start", F.lit(0).cast("long"))
    offset = F.when(F.col("__start") == 0, F.col("__carried")).otherwise(F.lit(0))
    number = F.col(POS) - F.col("__start") + offset + F.lit(start)
    # One row per partition: the broadcast is bounded by the partition count.
    return rows.join(F.broadcast(carried), PART).select(
        *[named(c) for c in df.columns if c != column], number.cast("long").alias(column))


def number_file_rows(spark: SparkSession, paths: str | list[str], column: str = "row_number",
                     start: int = 1) -> DataFrame:
    """Parquet scan whose rows are numbered in file order, with no sort or shuffle.

    Positions within a file come from the format; one count per file gives the offsets,
    as many driver-side numbers as the file listing has entries.
    """
    table = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    columns = table.columns
    located = table.withColumns({
        "__file": F.col("_metadata.file_path"), "__index": F.col("_metadata.row_index")})
    sizes = located.groupBy("__file").agg((F.max("__index") + 1).alias("n")).orderBy("__file")
    offsets, total = {}, start
    for row in sizes.toLocalIterator():
        offsets[row["__file"]] = total
        total += row["n"]
    schema = T.StructType([T.StructField("__file", T.StringType()), T.StructField("__offset", T.LongType())])
    listed = spark.createDataFrame(list(offsets.items()), schema)
    # One row per file: bounded by the file listing the driver holds anyway.
    return located.join(F.broadcast(listed), "__file").select(
        *[named(c) for c in columns], (F.col("__index") + F.col("__offset")).alias(column))
