"""Event-time windows, late rows and running totals on small streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rowmend.streaming.event_time import as_clock, as_instant, keep_late_rows, late_rows, windowed
from rowmend.streaming.incremental import append_to, file_stream
from rowmend.streaming.totals import (
    distinct_estimate, distinct_sketch, keep_totals, latest_totals, numbers_in, read_versions,
)

START = datetime(2024, 3, 31, 0, 0)
SCHEMA = "at timestamp, key string, value int"


@pytest.fixture
def feed(spark, tmp_path):
    """Append files of (minute, key, value) rows, and read the folder as a stream of one file a batch."""
    folder = str(tmp_path / "in")

    def add(rows):
        data = [(None if m is None else START + timedelta(minutes=m), k, v) for m, k, v in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    def stream():
        return file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, "*.parquet", 1)

    return add, stream


def drained(spark, rows, path):
    append_to(rows, str(path)).awaitTermination()
    return spark.read.schema(rows.schema).parquet(str(path))


def minute(moment):
    return int((moment - START).total_seconds() // 60)


FILES = [[(1, "a", 1), (4, "b", 2)], [(31, "a", 3), (2, "a", 4)], [(3, "a", 5), (29, "b", 6), (None, "a", 9)], [(75, None, 7)], [(33, "b", 8), (70, "a", 1)]]


def test_tumbling_windows_drop_late_rows_and_name_them(spark, feed, tmp_path):
    add, stream = feed
    for rows in FILES:
        add(rows)
    # Ten minutes a window, ten of delay: the second file sets the watermark to 21, by which the fourth is judged.
    got = drained(spark, windowed(stream(), "at", "10 minutes", F.window("at", "10 minutes"), ["key"],
                                  {"n": F.count("*"), "total": F.sum("value")}), tmp_path / "out")
    rows = sorted((minute(r.window_start), minute(r.window_end), r.key, r.n, r.total) for r in got.collect())
    # The third file's minute 3 and the fifth file's minute 33 still count; 70 to 80 are not final yet.
    assert rows == [(0, 10, "a", 3, 10), (0, 10, "b", 1, 2), (20, 30, "b", 1, 6), (30, 40, "a", 1, 3), (30, 40, "b", 1, 8)]
    output = str(tmp_path / "late")
    keep_late_rows(stream(), "at", "10 minutes", F.window("at", "10 minutes")["end"], output).awaitTermination()
    assert late_rows(spark, output).count() == 0


def test_rows_late_by_two_batches(spark, feed, tmp_path):
    add, stream = feed
    for rows in ([(1, "a", 1)], [(100, "a", 1)], [(105, "a", 1)], [(5, "a", 1), (99, "a", 1)], [(300, "a", 1)]):
        add(rows)
    windows = windowed(stream(), "at", "10 minutes", F.window("at", "10 minutes"), [], {"n": F.count("*")})
    got = sorted((minute(r.window_start), r.n) for r in drained(spark, windows, tmp_path / "out").collect())
    assert got == [(0, 1), (90, 1), (100, 2)]
    output = str(tmp_path / "late")
    keep_late_rows(stream(), "at", "10 minutes", F.window("at", "10 minutes")["end"], output).awaitTermination()
    assert [(minute(r["at"]), r.batch) for r in late_rows(spark, output).collect()] == [(5, 3)]


def test_sessions_over_files(spark, feed, tmp_path):
    add, stream = feed
    for rows in ([(0, "a", 1), (8, "a", 2), (3, "b", 3)], [(16, "a", 4), (30, "a", 5)], [(200, "c", 6)]):
        add(rows)
    sessions = windowed(stream(), "at", "5 minutes", F.session_window("at", "10 minutes"), ["key"], {"n": F.count("*")})
    got = sorted((r.key, minute(r.window_start), minute(r.window_end), r.n) for r in drained(spark, sessions, tmp_path / "out").collect())
    assert got == [("a", 0, 26, 3), ("a", 30, 40, 1), ("b", 3, 13, 1)]


def test_clock_and_instant_in_any_zone(spark):
    times = ["2024-03-31 02:30:00.123456", "1969-12-31 23:59:59.5", "2024-10-27 02:30:00"]
    rows = spark.createDataFrame([(t,) for t in times], "text string").select(F.col("text").cast("timestamp_ntz").alias("t"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        back = rows.select("t", as_clock(as_instant(F.col("t"))).alias("again"), F.unix_micros(as_instant(F.col("t"))).alias("n"))
        found = back.collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert all(r.t == r.again for r in found)
    assert [r.n for r in found] == [1711852200123456, -500000, 1729996200000000]


def totals_of(stream):
    return stream.groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def test_totals_write_changed_keys_only_and_restart_adds_nothing(spark, feed, tmp_path):
    add, stream = feed
    output = str(tmp_path / "totals")
    add([(1, "a", 1), (2, "b", 2), (3, None, 3)])
    add([(4, "a", 10)])

    def run():
        totals = totals_of(stream())
        keep_totals(totals, ["key"], output).awaitTermination()
        return totals.schema, {r.key: (r.n, r.total) for r in latest_totals(spark, output, ["key"], totals.schema).collect()}

    schema, got = run()
    assert got == {"a": (2, 11), "b": (1, 2), None: (1, 3)}
    # The second batch wrote one key.
    versions = {r["__version"]: r["n"] for r in read_versions(spark, output, schema).groupBy("__version").agg(
        F.count("*").alias("n")).collect()}
    assert versions == {0: 3, 1: 1}
    assert run()[1] == got and numbers_in(spark, f"{output}/versions") == [0, 1]
    add([(5, "c", 5)])
    assert run()[1] == got | {"c": (1, 5)}


def test_totals_are_compacted(spark, feed, tmp_path):
    add, stream = feed
    output = str(tmp_path / "totals")
    for n in range(7):
        add([(n, "a", 1), (n, f"k{n}", n)])
    totals = totals_of(stream())
    keep_totals(totals, ["key"], output, compact_every=2).awaitTermination()
    assert numbers_in(spark, f"{output}/bases") == [3, 5]
    assert numbers_in(spark, f"{output}/versions") == [4, 5, 6]
    got = {r.key: (r.n, r.total) for r in latest_totals(spark, output, ["key"], totals.schema).collect()}
    assert got == {"a": (7, 7)} | {f"k{n}": (1, n) for n in range(7)}
    # A version without its success marker was not completed.
    spark.createDataFrame([("x", 9, 9, 9)], [*totals.columns, "__version"]).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{output}/versions/n=9")
    assert latest_totals(spark, output, ["key"], totals.schema).count() == 8


def test_totals_of_nothing(spark, feed, tmp_path):
    add, stream = feed
    add([])
    totals = totals_of(stream())
    keep_totals(totals, ["key"], str(tmp_path / "t")).awaitTermination()
    assert latest_totals(spark, str(tmp_path / "t"), ["key"], totals.schema).count() == 0


def test_distinct_sketches_merge_over_batches(spark, feed, tmp_path):
    add, stream = feed
    add([(n % 60, f"u{n % 3000}", n % 2) for n in range(6000)])
    add([(n % 60, f"u{n % 5000}", n % 2) for n in range(6000)])
    totals = stream().groupBy("value").agg(distinct_sketch(F.col("key")).alias("users"))
    keep_totals(totals, ["value"], str(tmp_path / "t")).awaitTermination()
    got = latest_totals(spark, str(tmp_path / "t"), ["value"], totals.schema)
    estimates = {r.value: r.e for r in got.select("value", distinct_estimate(F.col("users")).alias("e")).collect()}
    assert estimates.keys() == {0, 1} and all(abs(e - 2500) <= 50 for e in estimates.values())
