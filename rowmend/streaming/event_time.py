"""Event-time windows over a stream: tumbling, sliding and session windows, and the rows that come too late.

Spark's watermark after a batch is the latest time seen so far less the allowed delay. A window is
final, and comes out in append mode, once the watermark has reached its end. A row is late when
its windows were final before its batch began: with the watermark that the batches before the
last one have set, by which Spark drops rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowmend.columns import named


def as_instant(clock: Column) -> Column:
    """A time without zone as the instant a UTC clock shows it, whatever the session's zone."""
    parts = F.hour(clock) * 3600 + F.minute(clock) * 60 + F.extract(F.lit("SECOND"), clock)
    micros = F.unix_date(clock.cast("date")).cast("long") * 86_400_000_000 + (parts * 1_000_000).cast("long")
    return F.timestamp_micros(micros)


def as_clock(instant: Column) -> Column:
    """What a UTC clock shows at an instant."""
    seconds = (F.unix_micros(instant) / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def windowed(stream: DataFrame, time_col: str, delay: str, window: Column, keys: Sequence[str],
             aggregates: Mapping[str, Column]) -> DataFrame:
    """(window_start, window_end, keys, aggregates) of every window that is final.

    `window` is F.window or F.session_window over `time_col`, which must be an instant. Rows
    with a null time are in no window; a null key is a key. State holds open windows only.
    """
    grouped = stream.withWatermark(time_col, delay).groupBy(window.alias("__window"), *[named(k) for k in keys])
    return grouped.agg(*[c.alias(name) for name, c in aggregates.items()]).select(
        F.col("__window.start").alias("window_start"), F.col("__window.end").alias("window_end"),
        *[named(k) for k in keys], *[named(name) for name in aggregates])


def mark_path(output: str, batch: int) -> str:
    return f"{output}/marks/mark={batch}"


def latest_time(spark: SparkSession, output: str, batch: int):
    """Latest time of all batches up to this one; null before the first."""
    if batch < 0:
        return None
    return spark.read.schema("high timestamp").parquet(mark_path(output, batch)).first()["high"]


def keep_late_rows(stream: DataFrame, time_col: str, delay: str, last_end: Column, output: str) -> StreamingQuery:
    """Write the rows that event-time windows drop to `output`, by batch; run it with the same trigger.

    `last_end` is the end of the last window a row belongs to. A batch leaves one mark, the
    latest time up to it, so no batch reads more than two marks; a batch that is run again
    overwrites what it left.
    """
    def batch_done(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before, settled = (latest_time(spark, output, number - n) for n in (1, 2))
        high = F.greatest(F.max(named(time_col)), F.lit(before).cast("timestamp"))
        batch.agg(high.alias("high")).coalesce(1).write.mode("overwrite").parquet(mark_path(output, number))
        limit = F.lit(settled).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        batch.where(last_end <= limit).write.mode("overwrite").parquet(f"{output}/late/batch={number}")

    return stream.writeStream.foreachBatch(batch_done).option(
        "checkpointLocation", f"{output}/progress").trigger(availableNow=True).start()


def late_rows(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(f"{output}/late")
