"""Search, profiling, unions and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmend.operators.numbering import number_file_rows
from rowmend.operators.profile import ENTIRE_ROW, SKIP, profile, table_summary, value_breakdown
from rowmend.operators.search import search
from rowmend.operators.union import union_folder, union_tables
from rowmend.plans.registry import derived, derived_sql, query, table
from rowmend.sources.files import (
    csv_scan, list_files, list_lookup_files, preview, smart_read, spread, whole_texts, write_csv, write_report,
)
from rowmend.sources.workspace import new_path

TERMS = [" BUILDING ", "Customer#00000012", "40-21", "4021", "tool", "", "HOUSEHOLD", "77", "MACHINERY "]


def search_sql(terms: list[str], source: str, cells: list[str], row_number: str, file: str) -> str:
    cleaned = [t.strip() for t in terms if t.strip()]
    digits = {"".join(ch for ch in t if ch.isdigit()): t for t in cleaned}
    owned = {t: d for d, t in digits.items() if d}
    listed = ", ".join(f"('{t}', '{owned.get(t, '')}')" for t in sorted(set(cleaned)))
    tests = " OR ".join(
        f"contains({c}, term) OR (digits <> '' AND contains(regexp_replace({c}, '[^0-9]', '', 'g'), digits))"
        for c in cells)
    shown = " || ' | ' || ".join(f"coalesce({c}, '')" for c in cells)
    return f"""
        SELECT term AS "Matched_Term", '{file}' AS "Source_File", '' AS "Sheet_Name",
               {row_number} AS "Excel_Row_Number", {shown} AS "Row_Data"
        FROM {source}, (VALUES {listed}) t(term, digits) WHERE {tests}"""


CUSTOMER_CELLS = ["CAST(c_custkey AS VARCHAR)", "c_name", "CAST(c_nationkey AS VARCHAR)", "CAST(c_acctbal AS VARCHAR)",
                  "c_mktsegment"]


@query("search_customers", search_sql(TERMS, "customer", CUSTOMER_CELLS, "c_custkey + 2", "customer.parquet"))
def search_customers(spark, sf_dir):
    rows = number_file_rows(spark, f"{sf_dir}/customer.parquet", "__row", start=2)
    return search(rows, TERMS, F.col("__row"), "customer.parquet",
                  columns=["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])


TEXT_TERMS = ["data", "2019", "the", "9-9-9", "information", "zzzz", "@"]


@query("search_documents", search_sql(
    TEXT_TERMS, "documents", ["CAST(doc_id AS VARCHAR)", "text", "lang", "source", "CAST(n_chars AS VARCHAR)"],
    "doc_id + 2", "documents"))
def search_documents(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return search(docs, TEXT_TERMS, F.col("doc_id") + 2, "documents",
                  columns=["doc_id", "text", "lang", "source", "n_chars"])


def breakdown_sql(value: str, source: str) -> str:
    return f"""
        WITH counts AS (SELECT {value} AS v, count(*) AS n FROM {source} GROUP BY 1)
        SELECT v AS "Value", n AS "Count",
               CAST(round_even(CAST(n AS DOUBLE) / (SELECT sum(n) FROM counts) * 100, 2) AS VARCHAR) || '%'
                   AS "% of Total"
        FROM counts"""


@query("profile_order_status", breakdown_sql("o_orderstatus", "orders"))
def profile_order_status(spark, sf_dir):
    return value_breakdown(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("profile_event_users", breakdown_sql("CAST(user_id AS VARCHAR)", "events"))
def profile_event_users(spark, sf_dir):
    return value_breakdown(table(spark, sf_dir, "events"), "user_id")


STATES = {
    "id": "o_orderkey",
    "state": """CASE o_orderkey % 5 WHEN 0 THEN 'Found' WHEN 1 THEN ' FOUND' WHEN 2 THEN 'not found '
        WHEN 3 THEN '  ' ELSE CAST(NULL AS STRING) END""",
}


@query("profile_states", breakdown_sql(
    "CASE WHEN trim(coalesce(state, '')) = '' THEN 'BLANK' ELSE trim(state) END",
    f"({derived_sql('orders', STATES)})"))
def profile_states(spark, sf_dir):
    return value_breakdown(derived(spark, sf_dir, "orders", STATES), "state")


def profile_sql(source: str, value: str | None, unique: str) -> str:
    found = f"count(*) FILTER (lower(trim({value})) = 'found')" if value else "0"
    missing = f"count(*) FILTER (lower(trim({value})) = 'not found')" if value else "0"
    duplicates = "0" if unique == "skip" else f"count(*) - {unique}"
    unique = "0" if unique == "skip" else unique
    return f"""
        SELECT count(*) AS total_rows, CAST({found} AS BIGINT) AS found_rows,
               CAST({missing} AS BIGINT) AS not_found_rows, CAST({unique} AS BIGINT) AS unique_count,
               CAST({duplicates} AS BIGINT) AS duplicate_count
        FROM {source}"""


@query("profile_skip_duplicates", profile_sql(f"({derived_sql('orders', STATES)})", "state", "skip"))
def profile_skip_duplicates(spark, sf_dir):
    return profile(derived(spark, sf_dir, "orders", STATES), "state", SKIP)


@query("profile_duplicate_texts", profile_sql("documents", "lang", "count(DISTINCT trim(text))"))
def profile_duplicate_texts(spark, sf_dir):
    return profile(table(spark, sf_dir, "documents"), "lang", "text")


@query("profile_unknown_column", profile_sql("documents", None, "0"))
def profile_unknown_column(spark, sf_dir):
    return profile(table(spark, sf_dir, "documents"), "absent", "absent")


DISTINCT_ROWS = "(SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem))"


@query("profile_duplicate_rows", profile_sql("lineitem", "l_returnflag", DISTINCT_ROWS))
def profile_duplicate_rows(spark, sf_dir):
    return profile(table(spark, sf_dir, "lineitem"), "l_returnflag", ENTIRE_ROW)


@query("profile_duplicate_rows_exact", profile_sql("lineitem", "l_returnflag", DISTINCT_ROWS))
def profile_duplicate_rows_exact(spark, sf_dir):
    return profile(table(spark, sf_dir, "lineitem"), "l_returnflag", ENTIRE_ROW, exact=True)


# Every order twice, once with another sign of zero.
SIGNED = {
    "order_key": "o_orderkey - o_orderkey % 2",
    "zero": "CASE WHEN o_orderkey % 2 = 0 THEN CAST('0' AS DOUBLE) ELSE CAST('-0' AS DOUBLE) END",
    "status": "NULLIF(o_orderstatus, 'P')",
}
DISTINCT_SIGNED = f"(SELECT count(*) FROM (SELECT DISTINCT * FROM ({derived_sql('orders', SIGNED)})))"


@query("profile_duplicate_typed", profile_sql(f"({derived_sql('orders', SIGNED)})", "status", DISTINCT_SIGNED))
def profile_duplicate_typed(spark, sf_dir):
    return profile(derived(spark, sf_dir, "orders", SIGNED), "status", ENTIRE_ROW)


GAPPED = {
    "key": "o_orderkey", "customer": "o_custkey", "price": "o_totalprice", "day": "o_orderdate",
    "status": "NULLIF(o_orderstatus, 'P')",
    "priority": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE NULLIF(o_orderpriority, '5-LOW') END",
}


@query("table_summary", f"""
    WITH gapped AS ({derived_sql('orders', GAPPED)})
    SELECT count(*) AS row_count, 6 AS column_count,
           count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM gapped)) AS duplicate_rows,
           6 * count(*) - count(key) - count(customer) - count(price) - count(day) - count(status) - count(priority)
               AS total_nulls
    FROM gapped""")
def summary_of_table(spark, sf_dir):
    return table_summary(derived(spark, sf_dir, "orders", GAPPED))


CUSTOMERS = {"key": "CAST(c_custkey AS STRING)", "name": "c_name", "segment": "c_mktsegment"}
SUPPLIERS = {"name": "s_name", "nation": "CAST(s_nationkey AS STRING)", "key": "CAST(s_suppkey AS STRING)"}


def union_sql(first: str, second: str) -> str:
    return f"""
        SELECT key, name, segment, '{first}' AS source_file, NULL AS nation
        FROM ({derived_sql('customer', CUSTOMERS)})
        UNION ALL
        SELECT key, name, NULL, '{second}', nation FROM ({derived_sql('supplier', SUPPLIERS)})"""


@query("union_tables", union_sql("customer", "supplier"))
def union_of_tables(spark, sf_dir):
    return union_tables([
        ("customer", derived(spark, sf_dir, "customer", CUSTOMERS)),
        ("supplier", derived(spark, sf_dir, "supplier", SUPPLIERS))])


@query("union_csv_folder", f"""
    SELECT key, name, segment, nation FROM ({union_sql('customer', 'supplier')})""")
def union_csv_folder(spark, sf_dir):
    """Both tables written as CSV files into one folder, then merged by header."""
    folder = new_path(spark, "union")
    for name, columns in (("customer", CUSTOMERS), ("supplier", SUPPLIERS)):
        derived(spark, sf_dir, name, columns).write.mode("append").options(
            header=True, quote='"', escape='"').csv(folder)
    return union_folder(spark, folder, multi_line=False).drop("source_file")


AWKWARD = {
    "doc_id": "CAST(doc_id AS STRING)", "lang": "lang", "text": "text",
    "missing": "CASE doc_id % 3 WHEN 0 THEN 'NA' WHEN 1 THEN '' ELSE 'a \"quoted\", cell' END",
}


@query("csv_round_trip", f"""
    SELECT doc_id, lang, text, CASE WHEN missing = 'NA' THEN '' ELSE missing END AS missing
    FROM ({derived_sql('documents', AWKWARD)})""")
def csv_round_trip(spark, sf_dir):
    """Whole texts with quotes and line breaks written as CSV and scanned back."""
    folder = new_path(spark, "csv")
    write_csv(derived(spark, sf_dir, "documents", AWKWARD), folder)
    return csv_scan(spark, folder, list(AWKWARD))


@query("csv_of_many_splits", """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents""")
def csv_of_many_splits(spark, sf_dir):
    """The documents as one CSV folder whose fields hold line breaks, scanned back split by split."""
    folder = new_path(spark, "breaks")
    docs = table(spark, sf_dir, "documents")
    write_csv(docs.select([F.col(c).cast("string") for c in docs.columns]), folder)
    return csv_scan(spark, folder, docs.columns, missing=())


@query("union_folder_with_breaks", """
    SELECT CAST(doc_id AS VARCHAR) AS id, text, lang, NULL AS benchmark FROM documents
    UNION ALL SELECT CAST(item_id AS VARCHAR), NULL, NULL, text || chr(10) || '"end"' FROM benchmark""")
def union_folder_with_breaks(spark, sf_dir):
    """Two tables with line breaks in their fields as CSV files of one folder, merged by header in one scan."""
    folder = new_path(spark, "merged")
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    for rows in (docs.selectExpr("CAST(doc_id AS STRING) AS id", "text", "lang"),
                 items.selectExpr("CAST(item_id AS STRING) AS id", """concat(text, '\n"end"') AS benchmark""")):
        rows.write.mode("append").options(header=True, quote='"', escape='"').csv(folder)
    return union_folder(spark, folder).drop("source_file")


@query("csv_smart_read", """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer""")
def csv_smart_read(spark, sf_dir):
    folder = new_path(spark, "smart")
    write_csv(table(spark, sf_dir, "customer"), folder, ["c_custkey", "c_name", "c_mktsegment"])
    return smart_read(spark, folder, multi_line=False)


@query("table_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000")
def table_preview(spark, sf_dir):
    return preview(table(spark, sf_dir, "orders"), 1000, ["o_orderkey"])


@query("lookup_files_listed", """
    SELECT place, 'c_mktsegment=' || c_mktsegment AS folder
    FROM (SELECT DISTINCT c_mktsegment,
                 dense_rank() OVER (ORDER BY c_mktsegment DESC) AS place FROM customer)""")
def lookup_files_listed(spark, sf_dir):
    """One file for every segment, listed by folders in falling order."""
    folder = new_path(spark, "segments")
    customers = table(spark, sf_dir, "customer")
    customers.repartition("c_mktsegment").write.partitionBy("c_mktsegment").csv(folder)
    folders = sorted({p.rsplit("/", 1)[0] for p in list_files(spark, folder, recursive=True)}, reverse=True)
    listed = [(n, p.split("/")[-2]) for n, p in enumerate(list_lookup_files(spark, folders), 1)]
    return spark.createDataFrame(listed, "place long, folder string")


@query("texts_of_files", "SELECT CAST(item_id AS VARCHAR) AS item, text || chr(10) AS content FROM benchmark")
def texts_of_files(spark, sf_dir):
    """Every item written as a file of its own, and read back whole."""
    folder = new_path(spark, "texts")
    table(spark, sf_dir, "benchmark").write.partitionBy("item_id").text(folder)
    texts = whole_texts(spark, folder)
    return texts.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).alias("item"), "content")


@query("run_report", """
    SELECT count(*) AS total_rows, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders""")
def run_report(spark, sf_dir):
    """Counters written as a JSON report and read back."""
    folder = new_path(spark, "report")
    orders = table(spark, sf_dir, "orders")
    write_report(orders.agg(F.count("*").alias("total_rows"), F.count_if(F.col("o_orderstatus") == "F").alias("finished")), folder)
    return spark.read.schema("total_rows long, finished long").json(folder)
