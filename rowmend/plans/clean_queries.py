"""Cleaning jobs over line items and events in the all-string model."""

from __future__ import annotations

from rowmend.columns import as_text
from rowmend.operators.clean import clean, clean_counts, dry_run
from rowmend.plans.registry import query, table
from rowmend.specs import CleanSpec

LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
         "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
TEXT = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in LINES)
LINES_CTE = f"lines AS (SELECT {TEXT} FROM lineitem)"

REPLACING = CleanSpec(
    rename_map={"l_returnflag": "flag", "l_linestatus": "status", "l_tax": " ", "unknown": "x",
                "l_quantity": "l_discount", "l_discount": "l_quantity"},
    replacement_rules=[
        {"column": "flag", "old_value": "R", "new_value": "returned", "match_type": "exact"},
        {"column": "flag", "old_value": "n", "new_value": "never", "match_type": "exact"},
        {"column": "status", "old_value": "f", "new_value": "Finished", "match_type": "contains"},
        {"column": "l_extendedprice", "old_value": "99", "new_value": "nines", "match_type": "contains",
         "case_sensitive": True},
        {"column": "absent", "old_value": "a", "new_value": "b", "match_type": "exact"},
    ],
)
ADDING = CleanSpec(
    add_rules=[
        {"new_column": "batch", "logic_type": "constant", "value": "B1"},
        {"new_column": "order_copy", "logic_type": "from_existing_column", "source_column": "l_orderkey"},
        {"new_column": "line_id", "logic_type": "concat", "separator": "-",
         "source_columns": ["l_orderkey", "absent", "l_linenumber"]},
        {"new_column": "sum", "logic_type": "math", "operation": "add",
         "left_column": "l_discount", "right_column": "l_tax"},
        {"new_column": "difference", "logic_type": "math", "operation": "subtract",
         "left_column": "l_discount", "right_column": "l_tax"},
        {"new_column": "product", "logic_type": "math", "operation": "multiply",
         "left_column": "l_quantity", "right_column": "l_extendedprice"},
        {"new_column": "ratio", "logic_type": "math", "operation": "divide",
         "left_column": "l_extendedprice", "right_column": "l_discount"},
        {"new_column": "text_sum", "logic_type": "math", "operation": "add",
         "left_column": "l_returnflag", "right_column": "l_tax"},
        {"new_column": "", "logic_type": "constant", "value": "ignored"},
        {"new_column": "nothing", "logic_type": "from_existing_column", "source_column": "absent"},
    ],
)


def _test(name: str, source: str, operator: str, value: str) -> dict:
    return {"new_column": name, "logic_type": "conditional_if_else", "source_column": source,
            "operator": operator, "compare_value": value, "true_value": "yes", "false_value": "no"}


DECIDING = CleanSpec(
    add_rules=[
        _test("equal", "l_quantity", "==", "17.0"), _test("unequal", "l_quantity", "!=", "17.0"),
        _test("above", "l_quantity", ">", "9"), _test("below", "l_quantity", "<", "9"),
        _test("at_least", "l_quantity", ">=", "10"), _test("at_most", "l_quantity", "<=", "10"),
        _test("holds", "l_linestatus", "contains", "o"), _test("blank", "l_tax", "is_null", ""),
        _test("filled", "l_tax", "not_null", ""), _test("unknown", "l_tax", "like", "0"),
        _test("no_number", "l_returnflag", ">", "1"), _test("no_limit", "l_quantity", ">", "many"),
    ],
    final_columns=["l_orderkey", "l_linenumber", "equal", "unequal", "above", "below", "at_least",
                   "at_most", "holds", "blank", "filled", "unknown", "no_number", "no_limit"],
)
FILTERING = CleanSpec(
    cols_to_drop=["l_tax", "absent"],
    filter_rules=[
        {"column": "l_quantity", "operator": ">", "value": "10"},
        {"column": "l_discount", "operator": "<=", "value": "0.07"},
        {"column": "l_returnflag", "operator": "!=", "value": "N"},
        {"column": "l_extendedprice", "operator": "contains", "value": "1"},
        {"column": "l_linestatus", "operator": "not_null", "value": ""},
        {"column": "l_linestatus", "operator": "resembles", "value": "F"},
        {"column": "l_tax", "operator": "==", "value": "none"},
    ],
    final_columns=["l_linestatus", "l_orderkey", "absent", "l_linenumber", "l_quantity"],
)
WHOLE_JOB = CleanSpec(
    rename_map={"event_type": "kind", "value": "amount"},
    replacement_rules=[
        {"column": "kind", "old_value": "CLI", "new_value": "pressed", "match_type": "contains"}],
    add_rules=[
        {"new_column": "double_amount", "logic_type": "math", "operation": "add",
         "left_column": "amount", "right_column": "amount"},
        {"new_column": "who", "logic_type": "concat", "separator": ":", "source_columns": ["kind", "user_id"]},
        _test("large", "double_amount", ">=", "20"),
    ],
    cols_to_drop=["props", "ts"],
    filter_rules=[{"column": "large", "operator": "==", "value": "yes"},
                  {"column": "double_amount", "operator": "!=", "value": "20.0"}],
    final_columns=["event_id", "kind", "who", "double_amount"],
)
WHOLE_JOB_CTE = """
    cleaned AS (
        SELECT CAST(event_id AS VARCHAR) AS event_id,
               CASE WHEN contains(lower(event_type), 'cli') THEN 'pressed' ELSE event_type END AS kind,
               CAST(user_id AS VARCHAR) AS user_id, value + value AS double_amount
        FROM events),
    kept AS (SELECT event_id, kind, kind || ':' || user_id AS who, double_amount
             FROM cleaned WHERE double_amount >= 20 AND double_amount <> 20)"""


def lines(spark, sf_dir):
    return as_text(table(spark, sf_dir, "lineitem").select(LINES))


def events(spark, sf_dir):
    return as_text(table(spark, sf_dir, "events"))


@query("clean_rename_replace", f"""WITH {LINES_CTE}
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS l_discount, l_discount AS l_quantity,
           l_tax, l_shipdate,
           CASE WHEN contains(l_extendedprice, '99') THEN 'nines' ELSE l_extendedprice END AS l_extendedprice,
           CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE l_returnflag END AS flag,
           CASE WHEN contains(lower(l_linestatus), 'f') THEN 'Finished' ELSE l_linestatus END AS status
    FROM lines""")
def clean_rename_replace(spark, sf_dir):
    return clean(lines(spark, sf_dir), REPLACING)


@query("clean_add_columns", f"""WITH {LINES_CTE}
    SELECT *, 'B1' AS batch, l_orderkey AS order_copy, l_orderkey || '-' || l_linenumber AS line_id,
           CAST(l_discount AS DOUBLE) + CAST(l_tax AS DOUBLE) AS sum,
           CAST(l_discount AS DOUBLE) - CAST(l_tax AS DOUBLE) AS difference,
           CAST(l_quantity AS DOUBLE) * CAST(l_extendedprice AS DOUBLE) AS product,
           CASE WHEN CAST(l_discount AS DOUBLE) <> 0
                THEN CAST(l_extendedprice AS DOUBLE) / CAST(l_discount AS DOUBLE) END AS ratio,
           CAST(NULL AS DOUBLE) AS text_sum
    FROM lines""")
def clean_add_columns(spark, sf_dir):
    return clean(lines(spark, sf_dir), ADDING)


@query("clean_if_else", f"""WITH {LINES_CTE}, q AS (SELECT *, CAST(l_quantity AS DOUBLE) AS n FROM lines)
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_quantity = '17.0' THEN 'yes' ELSE 'no' END AS equal,
           CASE WHEN l_quantity <> '17.0' THEN 'yes' ELSE 'no' END AS unequal,
           CASE WHEN n > 9 THEN 'yes' ELSE 'no' END AS above,
           CASE WHEN n < 9 THEN 'yes' ELSE 'no' END AS below,
           CASE WHEN n >= 10 THEN 'yes' ELSE 'no' END AS at_least,
           CASE WHEN n <= 10 THEN 'yes' ELSE 'no' END AS at_most,
           CASE WHEN contains(lower(l_linestatus), 'o') THEN 'yes' ELSE 'no' END AS holds,
           CASE WHEN l_tax IS NULL OR l_tax = '' THEN 'yes' ELSE 'no' END AS blank,
           CASE WHEN l_tax IS NOT NULL AND l_tax <> '' THEN 'yes' ELSE 'no' END AS filled,
           'no' AS unknown, 'no' AS no_number, 'no' AS no_limit
    FROM q""")
def clean_if_else(spark, sf_dir):
    return clean(lines(spark, sf_dir), DECIDING)


@query("clean_filter_select", f"""WITH {LINES_CTE}
    SELECT l_linestatus, l_orderkey, l_linenumber, l_quantity FROM lines
    WHERE CAST(l_quantity AS DOUBLE) > 10 AND CAST(l_discount AS DOUBLE) <= 0.07
      AND l_returnflag <> 'N' AND contains(l_extendedprice, '1') AND l_linestatus <> ''""")
def clean_filter_select(spark, sf_dir):
    return as_text(clean(table(spark, sf_dir, "lineitem").select(LINES), FILTERING))


@query("clean_whole_job", f"WITH {WHOLE_JOB_CTE} SELECT * FROM kept")
def clean_whole_job(spark, sf_dir):
    return clean(events(spark, sf_dir), CleanSpec.from_json(WHOLE_JOB.to_json()))


@query("clean_counts", f"""WITH {WHOLE_JOB_CTE}
    SELECT (SELECT count(*) FROM events) AS processed_rows, (SELECT count(*) FROM kept) AS retained_rows""")
def clean_counted(spark, sf_dir):
    return clean_counts(events(spark, sf_dir), WHOLE_JOB)


@query("clean_dry_run", f"""WITH
    {WHOLE_JOB_CTE.replace('FROM events', 'FROM (SELECT * FROM events ORDER BY event_id LIMIT 500)')}
    SELECT * FROM kept""")
def clean_dry(spark, sf_dir):
    return dry_run(events(spark, sf_dir), WHOLE_JOB)
