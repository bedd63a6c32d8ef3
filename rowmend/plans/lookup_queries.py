"""Lookup enrichment: orders enriched from customers under prioritised sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmend.functions.text import normal_key
from rowmend.operators.lookup import (
    build_index, enrich, main_source, match, matched, measure_index, route, run_statistics, special_source,
    with_partner, without_partner,
)
from rowmend.plans.registry import derived, derived_sql, query
from rowmend.sources.workspace import written
from rowmend.specs import LookupSpec, Mapping

# A third of all orders share one customer reference; others are blank or unknown.
ORDERS = {
    "o_orderkey": "CAST(o_orderkey AS STRING)",
    "customer_ref": """CASE WHEN o_orderkey % 3 = 0 THEN ' CUST-1 '
        WHEN o_orderkey % 11 = 0 THEN '  '
        WHEN o_orderkey % 13 = 0 THEN 'X-' || CAST(o_custkey AS STRING)
        WHEN o_orderkey % 2 = 0 THEN 'Cust-' || CAST(o_custkey AS STRING) || ' '
        ELSE 'cust-' || CAST(o_custkey AS STRING) END""",
    "o_orderstatus": "o_orderstatus",
    "note": "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END",
    "label": "CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'own' END",
    "region": "CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'kept' END",
}
MAIN = {
    "ref": "'Cust-' || CAST(c_custkey AS STRING)", "c_name": "c_name", "c_mktsegment": "c_mktsegment",
    "nation": "CAST(c_nationkey AS STRING)",
}
SECOND = {**MAIN, "c_name": "upper(c_name)"}
SPECIAL = {
    "code": "'CUST-' || CAST(c_custkey AS STRING)",
    "override": "CASE WHEN c_custkey % 14 = 0 THEN ' ' ELSE lower(c_mktsegment) END",
}
SPECIAL_WHERE = "c_custkey % 7 = 0"

SPEC = LookupSpec(
    input_key="customer_ref",
    keep_columns=("o_orderkey", "customer_ref", "o_orderstatus"),
    main_key="ref",
    main_mappings=(
        Mapping("c_name", new_column_name="customer_name"),
        Mapping("c_mktsegment", new_column_name="segment", mandatory=True),
    ),
    special_key="code",
    special_mappings=(Mapping("override", new_column_name="segment", mandatory=True),),
)
MODES = LookupSpec(
    input_key="customer_ref",
    keep_columns=("o_orderkey", "note", "label", "region"),
    main_key="ref",
    main_mappings=(
        Mapping("c_mktsegment", "existing", target_existing_column="note", write_mode="fill_if_blank"),
        Mapping("c_name", "existing", target_existing_column="label", write_mode="overwrite"),
        Mapping("nation", "existing", target_existing_column="region"),
    ),
)
PHONES = LookupSpec(
    input_key="phone", keep_columns=("s_suppkey", "phone"), main_key="mobile",
    main_mappings=(Mapping("c_name", new_column_name="c_name"),), key_type="mobile",
)
CUSTOMER_PHONES = {
    "mobile": "'+91-' || lpad(CAST(c_custkey AS STRING), 10, '9')", "c_name": "c_name",
}
SUPPLIER_PHONES = {
    "s_suppkey": "s_suppkey",
    "phone": """CASE WHEN s_suppkey % 9 = 0 THEN '12-345'
        WHEN s_suppkey % 9 = 1 THEN CAST(NULL AS STRING)
        WHEN s_suppkey % 9 = 2 THEN '(0) 700-' || lpad(CAST(s_suppkey AS STRING), 8, '5')
        ELSE '0091 ' || lpad(CAST(s_suppkey * 3 AS STRING), 10, '9') || ' ' END""",
}


def orders(spark, sf_dir):
    return derived(spark, sf_dir, "orders", ORDERS)


def sources(spark, sf_dir):
    return [
        special_source(derived(spark, sf_dir, "customer", SPECIAL, SPECIAL_WHERE)),
        main_source(derived(spark, sf_dir, "customer", MAIN)),
        main_source(derived(spark, sf_dir, "customer", SECOND)),
    ]


def first_main(spark, sf_dir):
    return [main_source(derived(spark, sf_dir, "customer", MAIN))]


INDEX_CTE = f"""
    special AS ({derived_sql('customer', SPECIAL, SPECIAL_WHERE)}),
    main AS ({derived_sql('customer', MAIN)}),
    second AS ({derived_sql('customer', SECOND)}),
    staged AS (
        SELECT lower(trim(code)) AS norm_key, '' AS customer_name, override AS segment,
               'special_lookup' AS source_type, 1 AS priority, 0 AS ordinal
        FROM special WHERE trim(override) <> ''
        UNION ALL
        SELECT lower(trim(ref)), c_name, c_mktsegment, 'main_lookup', 2, 1 FROM main
        WHERE trim(c_mktsegment) <> ''
        UNION ALL
        SELECT lower(trim(ref)), c_name, c_mktsegment, 'main_lookup', 2, 2 FROM second
        WHERE trim(c_mktsegment) <> ''),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY norm_key ORDER BY priority, ordinal) AS rn
        FROM staged WHERE norm_key <> ''),
    idx AS (SELECT norm_key, customer_name, segment, source_type, priority FROM ranked WHERE rn = 1)"""

CONSOLIDATED_CTE = f"""{INDEX_CTE},
    keyed AS (
        SELECT *, lower(trim(coalesce(customer_ref, ''))) AS norm_key
        FROM ({derived_sql('orders', ORDERS)})),
    consolidated AS (
        SELECT k.o_orderkey, k.customer_ref, k.o_orderstatus,
               coalesce(i.customer_name, '') AS customer_name, coalesce(i.segment, '') AS segment,
               CASE WHEN k.norm_key <> '' AND i.norm_key IS NOT NULL THEN 'MATCHED'
                    ELSE 'UNMATCHED' END AS match_status,
               CASE WHEN k.norm_key = '' THEN 'INVALID_OR_BLANK_KEY'
                    WHEN i.norm_key IS NULL THEN 'NO_MATCH_FOUND' ELSE '' END AS reason
        FROM keyed k LEFT JOIN idx i ON k.norm_key = i.norm_key)"""


@query("lookup_index", f"WITH {INDEX_CTE} SELECT * FROM idx")
def lookup_index(spark, sf_dir):
    return build_index(sources(spark, sf_dir), SPEC)


@query("lookup_keyless_source", f"WITH {INDEX_CTE} SELECT * FROM idx")
def lookup_keyless_source(spark, sf_dir):
    """A source without the key column is passed over."""
    keyless = main_source(derived(spark, sf_dir, "customer", {"name": "c_name", "c_mktsegment": "c_mktsegment"}))
    special, *others = sources(spark, sf_dir)
    return build_index([special, *others, keyless], SPEC)


@query("lookup_consolidated", f"WITH {CONSOLIDATED_CTE} SELECT * FROM consolidated")
def lookup_consolidated(spark, sf_dir):
    return enrich(orders(spark, sf_dir), sources(spark, sf_dir), SPEC)


@query("lookup_matched", f"""WITH {CONSOLIDATED_CTE}
    SELECT o_orderkey, customer_ref, o_orderstatus, customer_name, segment
    FROM consolidated WHERE reason = ''""")
def lookup_matched(spark, sf_dir):
    return route(lookup_consolidated(spark, sf_dir), SPEC)["matched"]


@query("lookup_unmatched", f"""WITH {CONSOLIDATED_CTE}
    SELECT o_orderkey, customer_ref, o_orderstatus, customer_name, segment, reason
    FROM consolidated WHERE reason <> ''""")
def lookup_unmatched(spark, sf_dir):
    return route(lookup_consolidated(spark, sf_dir), SPEC)["unmatched"]


@query("lookup_statistics", f"""WITH {CONSOLIDATED_CTE}
    SELECT count(*) AS processed_rows, count(*) FILTER (reason = '') AS matched_rows,
           count(*) FILTER (reason <> '') AS unmatched_rows,
           (SELECT count(*) FROM idx) AS unique_lookup_keys_indexed
    FROM consolidated""")
def lookup_statistics(spark, sf_dir):
    index = written(build_index(sources(spark, sf_dir), SPEC), "index")
    size = measure_index(index)
    counted = run_statistics(matched(orders(spark, sf_dir), index, SPEC, size))
    return counted.withColumn("unique_lookup_keys_indexed", F.lit(size.keys).cast("long"))


@query("lookup_with_partner", f"""WITH {CONSOLIDATED_CTE}
    SELECT o_orderkey, customer_ref, o_orderstatus, note, label, region
    FROM keyed WHERE norm_key IN (SELECT norm_key FROM idx)""")
def lookup_with_partner(spark, sf_dir):
    return with_partner(orders(spark, sf_dir), lookup_index(spark, sf_dir), SPEC)


@query("lookup_without_partner", f"""WITH {CONSOLIDATED_CTE}
    SELECT o_orderkey, customer_ref, o_orderstatus, note, label, region
    FROM keyed WHERE norm_key NOT IN (SELECT norm_key FROM idx)""")
def lookup_without_partner(spark, sf_dir):
    return without_partner(orders(spark, sf_dir), lookup_index(spark, sf_dir), SPEC)


@query("lookup_write_modes", f"""WITH
    main AS ({derived_sql('customer', MAIN)}),
    keyed AS (SELECT *, lower(trim(customer_ref)) AS norm_key FROM ({derived_sql('orders', ORDERS)}))
    SELECT k.o_orderkey,
           CASE WHEN trim(k.note) = '' THEN coalesce(m.c_mktsegment, '') ELSE k.note END AS note,
           coalesce(m.c_name, k.label) AS label, k.region,
           CASE WHEN k.norm_key <> '' AND m.ref IS NOT NULL THEN 'MATCHED'
                ELSE 'UNMATCHED' END AS match_status,
           CASE WHEN k.norm_key = '' THEN 'INVALID_OR_BLANK_KEY'
                WHEN m.ref IS NULL THEN 'NO_MATCH_FOUND' ELSE '' END AS reason
    FROM keyed k LEFT JOIN main m ON k.norm_key = lower(m.ref)""")
def lookup_write_modes(spark, sf_dir):
    return enrich(orders(spark, sf_dir), first_main(spark, sf_dir), MODES)


@query("lookup_mobile", f"""WITH
    dialled AS (
        SELECT *, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') AS digits
        FROM ({derived_sql('supplier', SUPPLIER_PHONES)})),
    keyed AS (SELECT *, CASE WHEN length(digits) >= 10 THEN right(digits, 10) ELSE '' END AS k
              FROM dialled),
    phones AS (
        SELECT right(regexp_replace(mobile, '[^0-9]', '', 'g'), 10) AS k, min(c_name) AS c_name
        FROM ({derived_sql('customer', CUSTOMER_PHONES)}) GROUP BY 1)
    SELECT CAST(d.s_suppkey AS BIGINT) AS s_suppkey, d.phone, coalesce(p.c_name, '') AS c_name,
           CASE WHEN d.k <> '' AND p.k IS NOT NULL THEN 'MATCHED' ELSE 'UNMATCHED' END AS match_status,
           CASE WHEN d.k = '' THEN 'INVALID_OR_BLANK_KEY'
                WHEN p.k IS NULL THEN 'NO_MATCH_FOUND' ELSE '' END AS reason
    FROM keyed d LEFT JOIN phones p ON d.k = p.k""")
def lookup_mobile(spark, sf_dir):
    phones = main_source(derived(spark, sf_dir, "customer", CUSTOMER_PHONES))
    index = build_index([phones], PHONES)
    return match(derived(spark, sf_dir, "supplier", SUPPLIER_PHONES), index, PHONES)


@query("lookup_keys", f"""
    SELECT o_orderkey, lower(trim(customer_ref)) AS text_key,
           CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10
                THEN right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) ELSE '' END AS mobile_key
    FROM (SELECT *, '+' || repeat('7', CAST(length(customer_ref) AS INT)) || '-' || o_orderkey AS phone
          FROM ({derived_sql('orders', ORDERS)}))""")
def lookup_keys(spark, sf_dir):
    phone = F.concat(F.lit("+"), F.repeat(F.lit("7"), F.length("customer_ref")), F.lit("-"), "o_orderkey")
    return orders(spark, sf_dir).select(
        "o_orderkey", normal_key(F.col("customer_ref")).alias("text_key"),
        normal_key(phone, "mobile").alias("mobile_key"))
