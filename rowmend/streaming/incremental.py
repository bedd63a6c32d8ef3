"""Incremental runs: the batch operators over a file stream, until the input is used up.

Lookup, cleaning and name cleaning look at one row at a time and append; profiling keeps
counters. Progress is in the checkpoint, so a stopped run goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rowmend.columns import named
from rowmend.operators.clean import clean
from rowmend.operators.lookup import match, matched
from rowmend.operators.name_clean import categorise
from rowmend.operators.profile import profiled, value_counts
from rowmend.specs import CleanSpec, LookupSpec


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet",
                files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .options(pathGlobFilter=pattern, maxFilesPerTrigger=files_per_batch)
        .parquet(folder)
    )


def lookup_stream(stream: DataFrame, index: DataFrame, spec: LookupSpec,
                  small_index: bool = False, hot_keys: Sequence[str] = ()) -> DataFrame:
    """Stream-static left join; pass a written index so it is not rebuilt for every batch.

    The index is broadcast if the caller or its measured size says it is small. Otherwise
    blank keys, which match nothing, and the given hot keys are spread over the tasks;
    `frequent_keys` finds those of rows that came before.
    """
    if small_index:
        return match(stream, index, spec, small_index=True)
    return matched(stream, index, spec, hot_keys=hot_keys)


def clean_stream(stream: DataFrame, spec: CleanSpec) -> DataFrame:
    return clean(stream, spec)


def name_stream(stream: DataFrame, mobile: str, name: str, status: str) -> DataFrame:
    return categorise(stream, mobile, name, status)


def profile_stream(stream: DataFrame, column: str) -> DataFrame:
    """Running value counts. State holds one row per distinct value."""
    return value_counts(stream, column)


def status_stream(stream: DataFrame, column: str) -> DataFrame:
    """Running totals of rows, `found` and `not found`. State is a single row."""
    value = F.lower(profiled(named(column)))
    return stream.agg(
        F.count("*").alias("total_rows"), F.count_if(value == "found").alias("found_rows"),
        F.count_if(value == "not found").alias("not_found_rows"),
    )


def progress_folder(output: str) -> str:
    """Where a run keeps its progress unless told otherwise: hidden beside its output, so that
    a second run goes on instead of starting over."""
    return f"{output.rstrip('/')}/_progress"


def append_to(rows: DataFrame, output: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append all available input to a Parquet folder."""
    checkpoint = checkpoint or progress_folder(output)
    return (
        rows.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output)
    )


def keep_counts(counts: DataFrame, output: str, checkpoint: str | None = None) -> StreamingQuery:
    """Write the latest counts after each batch to `output/batch=<n>`."""
    checkpoint = checkpoint or progress_folder(output)

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{output}/batch={batch}")

    return (
        counts.writeStream.outputMode("complete").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_counts(spark: SparkSession, output: str) -> DataFrame:
    """The counts of the last batch."""
    table = spark.read.parquet(output)
    last = table.agg(F.max("batch")).first()[0]
    return table.filter(F.col("batch") == last).drop("batch")
