"""The incremental jobs over the same tables, checked against the batch answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmend.columns import as_text
from rowmend.operators.lookup import build_index
from rowmend.plans.clean_queries import WHOLE_JOB
from rowmend.plans.lookup_queries import ORDERS, SPEC, sources
from rowmend.plans.name_queries import CONTACTS
from rowmend.plans.registry import ORACLES, query, table
from rowmend.plans.table_queries import STATES
from rowmend.sources.workspace import new_path, written
from rowmend.streaming.event_time import as_clock, as_instant, keep_late_rows, late_rows, windowed
from rowmend.streaming.incremental import (
    append_to, clean_stream, file_stream, keep_counts, latest_counts, lookup_stream, name_stream,
    profile_stream, status_stream,
)
from rowmend.streaming.totals import distinct_estimate, distinct_sketch, keep_totals, latest_totals, lookup_totals


def stream_of(spark, sf_dir, name, columns=None):
    schema = table(spark, sf_dir, name).schema
    rows = file_stream(spark, sf_dir, schema, f"{name}.parquet")
    return rows if columns is None else rows.selectExpr(*[f"{t} AS `{a}`" for a, t in columns.items()])


def drained(rows, label):
    spark = rows.sparkSession
    output = new_path(spark, label)
    append_to(rows, output).awaitTermination()
    return spark.read.schema(rows.schema).parquet(output)


def counted(rows, label):
    spark = rows.sparkSession
    output = new_path(spark, label)
    keep_counts(rows, output).awaitTermination()
    return latest_counts(spark, output)


@query("stream_lookup", ORACLES["lookup_consolidated"])
def stream_lookup(spark, sf_dir):
    index = written(build_index(sources(spark, sf_dir), SPEC), "index")
    return drained(lookup_stream(stream_of(spark, sf_dir, "orders", ORDERS), index, SPEC), "lookup")


@query("stream_clean", ORACLES["clean_whole_job"])
def stream_clean(spark, sf_dir):
    return drained(clean_stream(as_text(stream_of(spark, sf_dir, "events")), WHOLE_JOB), "clean")


@query("stream_names", ORACLES["names_consolidate"])
def stream_names(spark, sf_dir):
    contacts = stream_of(spark, sf_dir, "orders", CONTACTS)
    return drained(name_stream(contacts, "phone", "response", "state"), "names")


@query("stream_value_counts", """
    SELECT CAST(user_id AS VARCHAR) AS "Value", count(*) AS "Count" FROM events GROUP BY 1""")
def stream_value_counts(spark, sf_dir):
    return counted(profile_stream(stream_of(spark, sf_dir, "events"), "user_id"), "values")


@query("stream_status_counts", """
    SELECT count(*) AS total_rows, count(*) FILTER (o_orderkey % 5 <= 1) AS found_rows,
           count(*) FILTER (o_orderkey % 5 = 2) AS not_found_rows FROM orders""")
def stream_status_counts(spark, sf_dir):
    return counted(status_stream(stream_of(spark, sf_dir, "orders", STATES), "state"), "states")


def events_in_files(spark, sf_dir):
    """The events as five files in order of time, but that every fiftieth event comes with the last one."""
    folder = new_path(spark, "event-files")
    events = table(spark, sf_dir, "events")
    quarter = F.floor(F.col("event_id") * 4 / (events.agg(F.max("event_id") + 1).first()[0])).cast("int")
    filed = written(events.withColumn("file", F.when(F.col("event_id") % 50 == 0, 4).otherwise(quarter)), "filed")
    for file in range(5):
        # One file each, named and written in order, for the stream to take one a batch.
        filed.where(F.col("file") == file).drop("file").coalesce(1).write.mode("append").parquet(folder)
    instant = as_instant(F.col("ts"))
    return file_stream(spark, folder, events.schema, "*.parquet", 1).withColumn("at", instant)


LATE_SQL = """
    filed AS (
        SELECT *, CASE WHEN event_id % 50 = 0 THEN 4
                       ELSE CAST(floor(event_id * 4 / (SELECT max(event_id) + 1 FROM events)) AS INTEGER) END AS file
        FROM events),
    highs AS (SELECT file, max(max(ts)) OVER (ORDER BY file) AS high FROM filed GROUP BY file),
    judged AS (
        SELECT f.*, {end} AS last_end, h.high - INTERVAL 2 HOUR AS settled
        FROM filed f LEFT JOIN highs h ON h.file = f.file - 2)"""
TUMBLE_END = "time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR"
SLIDE_END = "time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 12 HOUR"


def drained_windows(windows, label):
    return drained(windows, label).withColumns({c: as_clock(F.col(c)) for c in ("window_start", "window_end")})


def measures():
    return {"n": F.count("*"), "hundredths": F.sum(F.round(F.col("value") * 100).cast("long"))}


@query("stream_tumbling_windows", f"""
    WITH {LATE_SQL.format(end=TUMBLE_END)}
    SELECT last_end - INTERVAL 6 HOUR AS window_start, last_end AS window_end, event_type, count(*) AS n,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS hundredths
    FROM judged WHERE settled IS NULL OR last_end > settled
    GROUP BY last_end, event_type HAVING last_end <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def stream_tumbling_windows(spark, sf_dir):
    events = events_in_files(spark, sf_dir)
    return drained_windows(windowed(events, "at", "2 hours", F.window("at", "6 hours"), ["event_type"], measures()), "tumbling")


@query("stream_sliding_windows", f"""
    WITH {LATE_SQL.format(end=SLIDE_END)},
    each AS (SELECT last_end - k * INTERVAL 4 HOUR AS window_end, * FROM judged, range(3) r(k))
    SELECT window_end - INTERVAL 12 HOUR AS window_start, window_end, count(*) AS n,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS hundredths
    FROM each WHERE settled IS NULL OR window_end > settled
    GROUP BY window_end HAVING window_end <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def stream_sliding_windows(spark, sf_dir):
    events = events_in_files(spark, sf_dir)
    return drained_windows(windowed(events, "at", "2 hours", F.window("at", "12 hours", "4 hours"), [], measures()), "sliding")


@query("stream_late_rows", f"""
    WITH {LATE_SQL.format(end=TUMBLE_END)}
    SELECT event_id, ts, user_id, file AS batch FROM judged WHERE last_end <= settled""")
def stream_late_rows(spark, sf_dir):
    """The rows the tumbling windows drop, named."""
    output = new_path(spark, "late")
    events = events_in_files(spark, sf_dir)
    keep_late_rows(events, "at", "2 hours", F.window("at", "6 hours")["end"], output).awaitTermination()
    return late_rows(spark, output).select("event_id", "ts", "user_id", "batch")


@query("stream_session_windows", """
    WITH gaps AS (
        SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS fresh
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM gaps)
    SELECT min(ts) AS window_start, max(ts) + INTERVAL 8 HOUR AS window_end, user_id, count(*) AS n,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS hundredths
    FROM numbered GROUP BY user_id, session
    HAVING max(ts) + INTERVAL 8 HOUR <= (SELECT max(ts) FROM events)""")
def stream_session_windows(spark, sf_dir):
    """Sessions of a user that end after eight quiet hours, over all events in order of time."""
    folder = new_path(spark, "ordered-events")
    events = table(spark, sf_dir, "events")
    middle = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    for part in (F.col("event_id") <= middle, F.col("event_id") > middle):
        events.where(part).coalesce(1).write.mode("append").parquet(folder)
    stream = file_stream(spark, folder, events.schema, "*.parquet", 1).withColumn("at", as_instant(F.col("ts")))
    sessions = windowed(stream, "at", "0 seconds", F.session_window("at", "8 hours"), ["user_id"], measures())
    return drained_windows(sessions, "sessions")


def kept(totals, keys, label, **options):
    spark, output = totals.sparkSession, new_path(totals.sparkSession, label)
    keep_totals(totals, keys, output, **options).awaitTermination()
    return latest_totals(spark, output, keys, totals.schema)


@query("stream_totals_by_user", """
    SELECT user_id, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM events GROUP BY user_id""")
def stream_totals_by_user(spark, sf_dir):
    """Totals of every user after five batches, of which each wrote the users it changed."""
    totals = events_in_files(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
    return kept(totals, ["user_id"], "totals", compact_every=2)


@query("stream_distinct_users", """
    SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, true AS within_two_percent
    FROM events GROUP BY event_type""")
def stream_distinct_users(spark, sf_dir):
    """Distinct users by sketch after five batches, held against the exact count."""
    totals = events_in_files(spark, sf_dir).groupBy("event_type").agg(
        F.count("*").alias("n"), distinct_sketch(F.col("user_id")).alias("users"))
    found = kept(totals, ["event_type"], "distinct", compact_every=2).withColumn("estimate", distinct_estimate(F.col("users")))
    exact = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"))
    close = F.abs(F.col("estimate") - F.col("n_users")) <= 0.02 * F.col("n_users")
    return found.join(exact, "event_type").select("event_type", "n", "n_users", close.alias("within_two_percent"))


@query("stream_lookup_totals", f"""
    SELECT match_status, reason, count(*) AS n_rows FROM ({ORACLES["lookup_consolidated"]}) GROUP BY 1, 2""")
def stream_lookup_totals(spark, sf_dir):
    """Running rows by status and reason while a lookup is streamed."""
    index = written(build_index(sources(spark, sf_dir), SPEC), "index")
    matches = lookup_stream(stream_of(spark, sf_dir, "orders", ORDERS), index, SPEC)
    return kept(lookup_totals(matches), ["match_status", "reason"], "lookup-totals")
