"""Ids, times, dates, file names, manifests, batches and natural order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from rowmend.functions.dates import normal_date
from rowmend.functions.text import safe_file_name, safe_merge_name
from rowmend.operators.batching import size_batches
from rowmend.operators.prepare import (
    assign_unique_id, natural_position, plan_url_manifest, repeated_ids, stagger_timestamps,
)
from rowmend.plans.registry import derived, derived_sql, query, table
from rowmend.sources.files import spread

TICKETS = {
    "o_orderkey": "o_orderkey", "o_custkey": "o_custkey",
    "Unique ID": "CASE o_orderkey % 4 WHEN 0 THEN 'KEPT' || CAST(o_orderkey AS STRING) WHEN 1 THEN ' ' "
                 "WHEN 2 THEN '' ELSE CAST(NULL AS STRING) END",
}


def sql_id(*keys: str) -> str:
    framed = " || ".join(f"CAST(length({k}) AS VARCHAR) || ':' || {k}" for k in keys)
    digest = f"sha256({framed})"
    chunks = [f"to_base(CAST('0x' || substr({digest}, {i * 12 + 1}, 12) AS BIGINT) % 60466176, 36, 5)"
              for i in range(5)]
    return " || ".join(chunks)


TICKETS_SQL = f"""
    SELECT o_orderkey, o_custkey, CASE WHEN trim(coalesce("Unique ID", '')) = ''
        THEN {sql_id('CAST(o_orderkey AS VARCHAR)', 'CAST(o_custkey AS VARCHAR)')}
        ELSE "Unique ID" END AS "Unique ID"
    FROM ({derived_sql('orders', TICKETS)})"""


@query("unique_ids", TICKETS_SQL)
def unique_ids(spark, sf_dir):
    return assign_unique_id(derived(spark, sf_dir, "orders", TICKETS), ["o_orderkey", "o_custkey"])


@query("repeated_ids", f"""
    SELECT "Unique ID", count(*) AS rows FROM (
        SELECT {sql_id('CAST(o_custkey AS VARCHAR)')} AS "Unique ID" FROM orders)
    GROUP BY 1 HAVING count(*) > 1""")
def ids_repeated(spark, sf_dir):
    by_customer = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return repeated_ids(assign_unique_id(by_customer, ["o_custkey"]))


START = datetime(2024, 2, 28, 22, 30)


@query("staggered_timestamps", """
    SELECT o_orderkey, o_totalprice, strftime(TIMESTAMP '2024-02-28 22:30:00' + to_minutes(
        row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1), '%d-%m-%Y %H:%M') AS "Initiation Date"
    FROM orders""")
def staggered_timestamps(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return stagger_timestamps(rows, ["o_totalprice", "o_orderkey"], START)


DAY, MONTH, YEAR = "lpad(CAST(day(d) AS STRING), 2, '0')", "lpad(CAST(month(d) AS STRING), 2, '0')", "CAST(year(d) AS STRING)"
SHORT_DAY, SHORT_MONTH = "CAST(day(d) AS STRING)", "CAST(month(d) AS STRING)"
MONTHS = "January February March April May June July August September October November December".split()
MONTH_NAME = "CASE month(d) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MONTHS, 1)) + " END"
DATE_TEXTS = [
    f"{DAY} || '-' || {MONTH} || '-' || {YEAR}", f"{SHORT_DAY} || '/' || {SHORT_MONTH} || '/' || {YEAR}",
    f"{DAY} || '.' || {MONTH} || '.' || {YEAR}", f"{DAY} || ' ' || {MONTH} || ' ' || {YEAR}",
    f"{SHORT_DAY} || '-' || left({MONTH_NAME}, 3) || '-' || {YEAR}",
    f"{DAY} || ' ' || upper(left({MONTH_NAME}, 3)) || ' ' || {YEAR}",
    f"{DAY} || '-' || {MONTH_NAME} || '-' || {YEAR}", f"' ' || {SHORT_DAY} || ' ' || lower({MONTH_NAME}) || ' ' || {YEAR}",
    f"{YEAR} || '-' || {MONTH} || '-' || {DAY}", f"{YEAR} || '/' || {SHORT_MONTH} || '/' || {DAY}",
    f"{MONTH} || '/' || {DAY} || '/' || {YEAR}", f"{MONTH} || '-' || {SHORT_DAY} || '-' || {YEAR}",
    "'31-02-2024'", "'soon'", "''", f"{DAY} || '/' || {MONTH} || '-' || {YEAR}",
]
CASES = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(DATE_TEXTS))
DATED = {"o_orderkey": "o_orderkey", "text": f"CASE o_orderkey % {len(DATE_TEXTS)} {CASES} END"}
FORMATS = ("'%d-%m-%Y', '%d/%m/%Y', '%d.%m.%Y', '%d %m %Y', '%d-%b-%Y', '%d %b %Y', '%d-%B-%Y', "
           "'%d %B %Y', '%Y-%m-%d', '%Y/%m/%d', '%m/%d/%Y', '%m-%d-%Y'")


def dated(spark, sf_dir):
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("d")))
    return orders.selectExpr(*[f"{t} AS `{a}`" for a, t in DATED.items()])


@query("normal_dates", f"""
    SELECT o_orderkey, text, coalesce(strftime(try_strptime(trim(text), [{FORMATS}]), '%d %b %Y'), text) AS normal
    FROM ({derived_sql('(SELECT *, o_orderdate AS d FROM orders)', DATED)})""")
def normal_dates(spark, sf_dir):
    return dated(spark, sf_dir).withColumn("normal", normal_date(F.col("text")))


UNSAFE = {"p_partkey": "p_partkey",
          "raw": "' ' || p_name || '<>:' || p_brand || '  a/b|c?.' || p_type || '. '"}


@query("safe_file_names", f"""
    SELECT p_partkey, trim(regexp_replace(regexp_replace(trim(raw), '[<>:"/\\\\|?*]+', '_', 'g'), '\\s+', ' ', 'g'), ' .')
               AS download_name,
           regexp_replace(trim(raw), '[\\\\/:*?"<>|]', '_', 'g') AS merge_name
    FROM ({derived_sql('part', UNSAFE)})""")
def safe_file_names(spark, sf_dir):
    raw = F.col("raw")
    return derived(spark, sf_dir, "part", UNSAFE).select(
        "p_partkey", safe_file_name(raw).alias("download_name"), safe_merge_name(raw).alias("merge_name"))


LINKS = {
    "page_id": "page_id",
    "link": """CASE page_id % 8 WHEN 0 THEN '  ' WHEN 1 THEN CAST(NULL AS STRING)
        WHEN 2 THEN 'https://drive.google.com/file/d/F_' || CAST(page_id AS STRING) || '/view'
        WHEN 3 THEN 'https://docs.google.com/open?id=D-' || CAST(page_id AS STRING)
        WHEN 4 THEN 'https://drive.google.com/drive/folders'
        WHEN 5 THEN url || '/report.v2.PDF?x=1.zip#top' ELSE url END""",
    "title": "CASE page_id % 3 WHEN 0 THEN CAST(NULL AS STRING) ELSE ' Page: ' || CAST(page_id AS STRING) || '. ' END",
}


@query("url_manifest", f"""
    WITH links AS (
        SELECT page_id + 2 AS row, trim(coalesce(link, '')) AS url,
               CASE WHEN title IS NULL THEN 'file_' || CAST(page_id + 1 AS VARCHAR) ELSE trim(title) END AS rename_value
        FROM ({derived_sql('pages', LINKS)})),
    drive AS (
        SELECT *, (contains(url, 'drive.google.com') OR contains(url, 'docs.google.com'))
            AND NOT regexp_matches(url, '/file/d/[a-zA-Z0-9_-]+|id=[a-zA-Z0-9_-]+|/d/[a-zA-Z0-9_-]+') AS lost,
            regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#;]*)', 1), '[^/.][^/]*(\\.[^/.]*)$', 1) AS ext
        FROM links),
    judged AS (
        SELECT *, CASE WHEN url = '' THEN 'skipped - empty url'
            WHEN lost THEN 'failed - Could not extract Google Drive file ID' ELSE 'planned' END AS status FROM drive)
    SELECT row, url, rename_value, status, CASE WHEN status <> 'planned' THEN '' ELSE 'out/' ||
        trim(regexp_replace(rename_value, '[<>:"/\\\\|?*]+', '_', 'g'), ' .') ||
        CASE WHEN ext = '' THEN '.bin' ELSE ext END END AS saved_path
    FROM judged""")
def url_manifest(spark, sf_dir):
    return plan_url_manifest(derived(spark, sf_dir, "pages", LINKS), "link", "title", F.col("page_id"), "out")


CAP = 9000


def batches_sql(group: str) -> str:
    return f"""
        WITH RECURSIVE fitting AS (
            SELECT doc_id, {group} AS g, n_chars,
                   row_number() OVER (PARTITION BY {group} ORDER BY doc_id) AS i
            FROM documents WHERE n_chars <= {CAP}),
        filled AS (
            SELECT g, i, doc_id, CAST(1 AS BIGINT) AS batch, n_chars AS level FROM fitting WHERE i = 1
            UNION ALL
            SELECT f.g, f.i, f.doc_id,
                   CASE WHEN p.level + f.n_chars > {CAP} THEN p.batch + 1 ELSE p.batch END,
                   CASE WHEN p.level + f.n_chars > {CAP} THEN f.n_chars ELSE p.level + f.n_chars END
            FROM filled p JOIN fitting f ON f.g = p.g AND f.i = p.i + 1)
        SELECT d.doc_id, d.source, d.n_chars, b.batch FROM documents d LEFT JOIN filled b ON d.doc_id = b.doc_id"""


@query("size_batches_by_source", batches_sql("source"))
def size_batches_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return size_batches(docs, "n_chars", CAP, ["doc_id"], ["source"])


@query("size_batches_whole_table", batches_sql("1"))
def size_batches_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return size_batches(docs, "n_chars", CAP, ["doc_id"])


FILES = {"p_partkey": "p_partkey", "file": "p_name || ' ' || CAST(p_partkey % 1000 AS STRING) || '.v' || CAST(p_size AS STRING)"}


@query("natural_order", f"""
    SELECT p_partkey, file, row_number() OVER (ORDER BY
        lower(regexp_extract(file, '^([^0-9]*)', 1)), CAST(regexp_extract(file, '([0-9]+)', 1) AS BIGINT),
        CAST(regexp_extract(file, '([0-9]+)$', 1) AS BIGINT), p_partkey) AS position
    FROM ({derived_sql('part', FILES)})""")
def natural_order(spark, sf_dir):
    return natural_position(derived(spark, sf_dir, "part", FILES), "file", ["p_partkey"])
