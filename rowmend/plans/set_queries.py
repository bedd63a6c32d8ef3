"""Grouping sets, first rows of groups, bags of rows, many terms and JSON fields over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmend.operators import grouping as G
from rowmend.operators.json_fields import json_fields, key_statistics, with_json_columns
from rowmend.operators.term_search import search_many
from rowmend.plans.registry import query, table

KEYS = ["l_returnflag", "l_linestatus", "l_linenumber"]
CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


def lines_in_cents(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("cents", F.expr(CENTS))


def sets_sql(clause: str, extra: str = "") -> str:
    return f"""
        SELECT {', '.join(KEYS)}, CAST(GROUPING({', '.join(KEYS)}) AS INTEGER) AS grouping_level, count(*) AS n,
               CAST(sum({CENTS}) AS BIGINT) AS cents, min(l_shipdate) AS first_day, max(l_quantity) AS most{extra}
        FROM lineitem GROUP BY {clause}"""


def exact_measures():
    return {"n": G.count(), "cents": G.total("cents"), "first_day": G.least("l_shipdate"), "most": G.most("l_quantity")}


@query("grouping_cube", sets_sql(f"CUBE ({', '.join(KEYS)})"))
def grouping_cube(spark, sf_dir):
    return G.grouped_by_sets(lines_in_cents(spark, sf_dir), G.cube_sets(KEYS), exact_measures())


@query("grouping_rollup", sets_sql(f"ROLLUP ({', '.join(KEYS)})"))
def grouping_rollup(spark, sf_dir):
    return G.grouped_by_sets(lines_in_cents(spark, sf_dir), G.rollup_sets(KEYS), exact_measures())


@query("grouping_sketches", """
    SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag, l_linestatus) AS INTEGER) AS grouping_level,
           count(DISTINCT l_partkey) AS parts, true AS parts_within, true AS median_within
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def grouping_sketches(spark, sf_dir):
    """Merged sketches held against exact results: distinct parts within 2 %, the median within 2 % of rank."""
    lines = table(spark, sf_dir, "lineitem")
    keys = ["l_returnflag", "l_linestatus"]
    found = G.grouped_by_sets(lines, G.cube_sets(keys), {
        "estimate": G.distinct("l_partkey"), "median": G.quantile("l_extendedprice", 0.5)})
    held = G.between_quantiles(lines, G.cube_sets(keys), found, "median", "l_extendedprice", 0.48, 0.52, "median_within")
    # Each part of a group once before it is copied for the sets.
    exact = lines.select(*keys, "l_partkey").distinct().cube(*keys).agg(
        F.grouping_id().cast("int").alias("level"), F.count_distinct("l_partkey").alias("parts"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = held.alias("a").join(exact.alias("b"), same[0] & same[1] & (F.col("grouping_level") == F.col("level")))
    return joined.select(
        "a.l_returnflag", "a.l_linestatus", "grouping_level", "parts",
        (F.abs(F.col("estimate") - F.col("parts")) <= 0.02 * F.col("parts") + 1).alias("parts_within"), "median_within")


@query("top_orders_by_status", """
    SELECT *, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place
    FROM orders QUALIFY place <= 20""")
def top_orders_by_status(spark, sf_dir):
    return G.first_of_groups(table(spark, sf_dir, "orders"), ["o_orderstatus"], [F.desc("o_totalprice"), "o_orderkey"], 20)


@query("top_quantities_with_ties", """
    SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity,
           CAST(rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS INTEGER) AS place
    FROM lineitem QUALIFY place <= 3""")
def top_quantities_with_ties(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return G.first_of_groups(lines, ["l_suppkey"], [F.desc("l_quantity")], 3, ties=True)


def two_bags(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    columns = ["l_returnflag", "l_quantity", "l_discount"]
    return [lines.where(F.col("l_linenumber") % 2 == n).selectExpr("NULLIF(l_returnflag, 'A') AS l_returnflag", *columns[1:])
            for n in (1, 0)]


def bags_sql(operation: str) -> str:
    side = "SELECT NULLIF(l_returnflag, 'A') AS l_returnflag, l_quantity, l_discount FROM lineitem WHERE l_linenumber % 2 = {}"
    return f"{side.format(1)} {operation} {side.format(0)}"


@query("bag_intersect", bags_sql("INTERSECT ALL"))
def bag_intersect(spark, sf_dir):
    return G.common_rows(*two_bags(spark, sf_dir), every=True)


@query("bag_except", bags_sql("EXCEPT ALL"))
def bag_except(spark, sf_dir):
    return G.rows_without(*two_bags(spark, sf_dir), every=True)


@query("set_intersect", bags_sql("INTERSECT"))
def set_intersect(spark, sf_dir):
    return G.common_rows(*two_bags(spark, sf_dir))


@query("set_except", "SELECT c_custkey, c_nationkey FROM customer EXCEPT SELECT s_suppkey, s_nationkey FROM supplier")
def set_except(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"))
    return G.rows_without(customers, suppliers)


@query("search_many_terms", r"""
    WITH terms AS (
        SELECT DISTINCT unnest(regexp_extract_all(text, '[^\s0-9]{9,}')) AS term FROM benchmark)
    SELECT term AS "Matched_Term", 'documents' AS "Source_File", '' AS "Sheet_Name", doc_id + 2 AS "Excel_Row_Number",
           coalesce(text, '') || ' | ' || coalesce(source, '') AS "Row_Data"
    FROM documents, terms WHERE contains(text, term) OR contains(source, term)""")
def search_many_terms(spark, sf_dir):
    """All long words of the benchmark, some thousand at larger sizes, in whole documents."""
    words = table(spark, sf_dir, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit(r"[^\s0-9]{9,}"), 0)).alias("word")).distinct()
    return search_many(table(spark, sf_dir, "documents"), [r["word"] for r in words.collect()], F.col("doc_id") + 2,
                       "documents", columns=["text", "source"])


@query("json_key_statistics", """
    WITH each AS (SELECT props, unnest(json_keys(props)) AS key FROM events)
    SELECT key, count(*) AS n_rows, count(TRY_CAST(json_extract_string(props, '$."' || key || '"') AS DECIMAL(38, 6))) AS n_numbers,
           CAST(sum(TRY_CAST(json_extract_string(props, '$."' || key || '"') AS DECIMAL(38, 6))) AS DOUBLE) AS total
    FROM each GROUP BY key""")
def json_key_statistics(spark, sf_dir):
    return key_statistics(table(spark, sf_dir, "events"), "props")


@query("json_typed_columns", "SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_typed_columns(spark, sf_dir):
    """A typed column for every field that any event has."""
    events = table(spark, sf_dir, "events")
    return with_json_columns(events, "props", json_fields(events, "props"))
