"""Running totals by key of a stream, kept as versions of changed keys and compacted now and then.

In update mode a batch of a streamed aggregation holds the keys it changed, with their totals so
far. These are written as one version named by the batch, so a batch that is run again replaces
what it wrote. Now and then the versions are merged into a base; readers take the last base that
is complete and the versions after it. Distinct counts ride along as sketches, whose size does not
depend on what they count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from rowmend.columns import named
from rowmend.sources.workspace import remove

VERSION, READY = "__version", "_SUCCESS"
SKETCH_BITS = 14


def distinct_sketch(value: Column, bits: int = SKETCH_BITS) -> Column:
    """A sketch of the distinct values; its relative error is about 0.8 / sqrt(2 ** bits)."""
    return F.hll_sketch_agg(value, F.lit(bits))


def distinct_estimate(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def numbers_in(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete `n=…` folders, in order: as many as versions since the last bases."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("n=")]
    ready = [p for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, READY))]
    return sorted(int(p.getName()[2:]) for p in ready)


def read_versions(spark: SparkSession, output: str, schema: StructType) -> DataFrame:
    """All rows of the last base and the versions after it, with the version each is of."""
    base = max(numbers_in(spark, f"{output}/bases"), default=None)
    later = [n for n in numbers_in(spark, f"{output}/versions") if base is None or n > base]
    paths = [f"{output}/bases/n={base}"] * (base is not None) + [f"{output}/versions/n={n}" for n in later]
    full = StructType([*schema.fields, StructField(VERSION, LongType())])
    return spark.read.schema(full).parquet(*paths) if paths else spark.createDataFrame([], full)


def latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key, by one aggregate that merges in the map tasks."""
    own = [c for c in rows.columns if c not in (*keys, VERSION)]
    newest = F.max_by(F.struct(VERSION, *[named(c) for c in own]), VERSION).alias("__row")
    return rows.groupBy(*[named(k) for k in keys]).agg(newest).select(*[named(k) for k in keys], "__row.*")


def keep_totals(totals: DataFrame, keys: Sequence[str], output: str, compact_every: int = 16) -> StreamingQuery:
    """Keep the totals of a streamed aggregation under `output`, until the input is used up.

    A batch writes the keys it changed. After every `compact_every` batches the versions become
    a base; the ones it covers are deleted at the next compaction, when no reader needs them.
    """
    schema, spark = totals.schema, totals.sparkSession

    def batch_done(batch: DataFrame, number: int) -> None:
        batch.withColumn(VERSION, F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{output}/versions/n={number}")
        if (number + 1) % compact_every == 0:
            compact(batch.sparkSession, output, keys, schema, number)

    # Totals of one batch alone decide what is written, so nothing is lost if it is run twice.
    return totals.writeStream.outputMode("update").foreachBatch(batch_done).option(
        "checkpointLocation", f"{output}/progress").trigger(availableNow=True).start()


def compact(spark: SparkSession, output: str, keys: Sequence[str], schema: StructType, number: int) -> None:
    """Merge all versions up to `number` into a base."""
    bases, versions = numbers_in(spark, f"{output}/bases"), numbers_in(spark, f"{output}/versions")
    latest(read_versions(spark, output, schema), keys).write.mode("overwrite").parquet(f"{output}/bases/n={number}")
    # What the base before the last one covers.
    settled = [b for b in bases if b < number]
    for old in settled[:-1]:
        remove(spark, f"{output}/bases/n={old}")
    for old in versions:
        if settled and old <= settled[-1]:
            remove(spark, f"{output}/versions/n={old}")


def latest_totals(spark: SparkSession, output: str, keys: Sequence[str], schema: StructType) -> DataFrame:
    """Totals by key after the last complete batch."""
    return latest(read_versions(spark, output, schema), keys).drop(VERSION)


def lookup_totals(matches: DataFrame) -> DataFrame:
    """Running rows by match status and reason of a streamed lookup, from its consolidated output."""
    return matches.groupBy("match_status", "reason").agg(F.count("*").alias("n_rows"))
