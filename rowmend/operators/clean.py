"""Rule-driven cleaning: rename, replace, add, drop, filter, select.

Every rule becomes a projection or a filter over built-in functions, so a whole job is
one narrow stage and needs no shuffle. Rules naming absent columns are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rowmend.columns import named, unique
from rowmend.functions.text import NUMERIC, no_nan, to_number
from rowmend.sources.files import preview, write_csv
from rowmend.specs import CleanSpec

Rule = dict[str, Any]


def rename_headers(df: DataFrame, rename_map: dict[str, str]) -> DataFrame:
    """All renames at once, so two headers may swap names."""
    def header(old: str) -> str:
        new = rename_map.get(old, old)
        return new if str(new).strip() else old

    headers = [header(c) for c in df.columns]
    if len(set(headers)) < len(headers):
        raise ValueError("renaming gives two columns the same name")
    return df.select([named(c).alias(h) for c, h in zip(df.columns, headers)])


def replace_values(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Exact rules compare whole cells; contains rules replace the whole cell on a hit."""
    for rule in rules:
        name, kind = rule.get("column"), rule.get("match_type", "exact")
        if name not in df.columns:
            continue
        old, new = rule.get("old_value"), F.lit(rule.get("new_value")).cast("string")
        cell = named(name).cast("string")
        if kind == "exact":
            hit = cell == F.lit(old)
        elif kind == "contains" and rule.get("case_sensitive", False):
            hit = F.contains(cell, F.lit(str(old)))
        elif kind == "contains":
            hit = F.contains(F.lower(cell), F.lit(str(old).lower()))
        else:
            continue
        df = df.withColumn(name, F.when(hit, new).otherwise(cell))
    return df


ORDERINGS = {
    ">": lambda a, b: a > b, "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b,
}


def condition(cell: Column, operator: str | None, value: Any) -> Column | None:
    """The nine comparisons; None for an operator outside them. Never yields null.

    Equality is on text, ordering on numbers with unreadable text false, `contains` is
    literal and ignores case.
    """
    text = cell.cast("string")
    if operator == "==":
        return text.eqNullSafe(F.lit(str(value)))
    if operator == "!=":
        return ~text.eqNullSafe(F.lit(str(value)))
    if operator in ORDERINGS:
        limit = to_number(F.lit(str(value)))
        return F.coalesce(ORDERINGS[operator](to_number(cell), limit), F.lit(False))
    if operator == "contains":
        hit = F.contains(F.lower(text), F.lit(str(value).lower()))
        return F.coalesce(hit, F.lit(False))
    blank = text.isNull() | (text == "")
    return {"is_null": blank, "not_null": ~blank}.get(operator)


def _arithmetic(rule: Rule, have: list[str]) -> Column | None:
    names = rule.get("left_column"), rule.get("right_column")
    if not set(names) <= set(have):
        return None
    left, right = (to_number(named(n)) for n in names)
    results = {
        "add": left + right, "subtract": left - right,
        "multiply": left * right, "divide": F.try_divide(left, right),
    }
    out = results.get(rule.get("operation", "add"))
    return None if out is None else no_nan(out)


def added_column(rule: Rule, have: list[str]) -> Column | None:
    """Expression of one add rule, None when its sources are missing."""
    kind, source = rule.get("logic_type"), rule.get("source_column")
    if kind == "constant":
        return F.lit(rule.get("value")).cast("string")
    if kind == "from_existing_column":
        return named(source) if source in have else None
    if kind == "concat":
        parts = [F.coalesce(named(c).cast("string"), F.lit(""))
                 for c in rule.get("source_columns", []) if c in have]
        return F.concat_ws(rule.get("separator", ""), *parts) if parts else None
    if kind == "math":
        return _arithmetic(rule, have)
    if kind == "conditional_if_else" and source in have:
        test = condition(named(source), rule.get("operator"), rule.get("compare_value"))
        yes, no = (F.lit(rule.get(k)).cast("string") for k in ("true_value", "false_value"))
        return no if test is None else F.when(test, yes).otherwise(no)
    return None


def add_columns(df: DataFrame, rules: list[Rule]) -> DataFrame:
    for rule in rules:
        name = str(rule.get("new_column", "")).strip()
        value = added_column(rule, df.columns) if name else None
        if value is not None:
            df = df.withColumn(name, value)
    return df


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select([named(c) for c in df.columns if c not in set(names)])


WHOLE, FRACTIONS = ("tinyint", "smallint", "int", "bigint"), ("float", "double")


def typed_test(cell: Column, kind: str, operator: str | None, value: Any) -> Column | None:
    """A row filter that means what `condition` does and that a scan can take over.

    Ordering compares numeric columns as they are, equality strings as they are; all else
    goes by text. A null is as good as false in a filter.
    """
    if operator in ORDERINGS and kind in (*WHOLE, *FRACTIONS):
        text = str(value).strip(" \t\n\x0b\x0c\r")
        if not re.search(NUMERIC, text):
            return F.lit(False)
        limit = float(text)
        if kind in WHOLE:
            return ORDERINGS[operator](cell, F.lit(int(limit) if limit.is_integer() and abs(limit) < 2**53 else limit))
        return ORDERINGS[operator](cell, F.lit(limit)) & ~F.isnan(cell)
    if operator == "==" and kind == "string":
        return cell == F.lit(str(value))
    return condition(cell, operator, value)


def filter_rows(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rules are AND-ed; an unknown operator or column keeps every row."""
    kinds = dict(df.dtypes)
    for rule in rules:
        if rule.get("column") in df.columns:
            name = rule["column"]
            test = typed_test(named(name), kinds[name], rule.get("operator"), rule.get("value"))
            df = df if test is None else df.filter(test)
    return df


def select_columns(df: DataFrame, names: list[str]) -> DataFrame:
    chosen = [c for c in unique(names) if c in df.columns]
    return df.select([named(c) for c in chosen]) if chosen else df


def shape(df: DataFrame, spec: CleanSpec) -> DataFrame:
    """The column steps that come before row filtering."""
    return (
        df.transform(rename_headers, spec.rename_map)
        .transform(replace_values, spec.replacement_rules)
        .transform(add_columns, spec.add_rules)
        .transform(drop_columns, spec.cols_to_drop)
    )


def clean(df: DataFrame, spec: CleanSpec) -> DataFrame:
    return (
        shape(df, spec)
        .transform(filter_rows, spec.filter_rules)
        .transform(select_columns, spec.final_columns)
    )


def dry_run(df: DataFrame, spec: CleanSpec, rows: int = 500, order_by: Sequence[str] = ()) -> DataFrame:
    """The job on the first rows only, in the given order or else any, to look at a rule set before running it."""
    return clean(preview(df, rows, order_by), spec)


def clean_counts(df: DataFrame, spec: CleanSpec) -> DataFrame:
    """Rows read and rows kept, in one pass."""
    shaped = shape(df, spec)
    kept = F.lit(True)
    for rule in spec.filter_rules:
        if rule.get("column") in shaped.columns:
            test = condition(named(rule["column"]), rule.get("operator"), rule.get("value"))
            kept = kept if test is None else kept & test
    return shaped.agg(F.count("*").alias("processed_rows"), F.count_if(kept).alias("retained_rows"))


def run_clean(df: DataFrame, spec: CleanSpec, output: str) -> dict[str, int]:
    """Write the cleaned table; the counters ride along on the write."""
    read, kept = Observation("read"), Observation("kept")
    cleaned = clean(df.observe(read, F.count(F.lit(1)).alias("rows")), spec)
    write_csv(cleaned.observe(kept, F.count(F.lit(1)).alias("rows")), output)
    return {"processed_rows": read.get["rows"], "retained_rows": kept.get["rows"]}
