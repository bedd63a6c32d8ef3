import pytest

from rowmend.columns import as_text
from rowmend.operators import clean as C
from rowmend.specs import CleanSpec


def column(df, name):
    return [row[name] for row in df.collect()]


def test_renames_ignore_unknown_and_blank_and_may_swap(frame):
    df = C.rename_headers(frame([("1", "2", "3")], "a b c"), {"a": "b", "b": "a", "c": " ", "x": "y"})
    assert df.columns == ["b", "a", "c"] and tuple(df.first()) == ("1", "2", "3")
    with pytest.raises(ValueError):
        C.rename_headers(df, {"a": "c"})


def test_replacements(frame):
    df = frame([("Foo Bar",), ("foo",), ("bar",)], "v")
    def done(**rule):
        return column(C.replace_values(df, [{"column": "v", "new_value": "N"} | rule]), "v")

    assert done(old_value="foo", match_type="exact") == ["Foo Bar", "N", "bar"]
    assert done(old_value="foo", match_type="contains") == ["N", "N", "bar"]
    assert done(old_value="Foo", match_type="contains", case_sensitive=True) == ["N", "foo", "bar"]
    assert done(old_value=".", match_type="contains") == ["Foo Bar", "foo", "bar"]
    assert done(old_value="foo", match_type="other") == ["Foo Bar", "foo", "bar"]


@pytest.mark.parametrize("operation, left, right, want", [
    ("divide", "6", "0", None), ("divide", "6", "4", 1.5), ("add", "x", "1", None), ("add", "1d", "1", None),
    ("add", " 1 ", "1e2", 101.0), ("subtract", "inf", "inf", None), ("multiply", "-.5", "4.", -2.0),
    ("add", "nan", "1", None), ("add", "0x1A", "1", None), ("add", "1,000", "1", None)])
def test_arithmetic(frame, operation, left, right, want):
    rule = {"new_column": "r", "logic_type": "math", "operation": operation,
            "left_column": "a", "right_column": "b"}
    assert column(C.add_columns(frame([(left, right)], "a b"), [rule]), "r") == [want]


def test_added_columns(frame):
    df = C.add_columns(frame([("x", None)], "a b"), [
        {"new_column": "k", "logic_type": "constant", "value": "v"},
        {"new_column": " c ", "logic_type": "from_existing_column", "source_column": "a"},
        {"new_column": "j", "logic_type": "concat", "source_columns": ["a", "zz", "b", "k"], "separator": "+"},
        {"new_column": "none", "logic_type": "concat", "source_columns": ["zz"]},
        {"new_column": "odd", "logic_type": "unknown"},
        {"new_column": "", "logic_type": "constant", "value": "v"},
    ])
    assert df.columns == ["a", "b", "k", "c", "j"] and tuple(df.first()) == ("x", None, "v", "x", "x++v")


CASES = [
    ("10", ">", "9", True), ("10", "==", "10.0", False), ("10", "!=", "10.0", True), ("abc", ">", "1", False),
    ("5", ">", "abc", False), ("5", "<=", "5.0", True), ("5", ">=", "6", False), ("a.c", "contains", "A.", True),
    ("abc", "contains", "a.", False), ("", "is_null", "", True), (None, "is_null", "", True),
    ("x", "not_null", "", True), (None, "not_null", "", False), (None, "!=", "a", True), (None, "contains", "a", False)]


@pytest.mark.parametrize("cell, operator, value, hit", CASES)
def test_predicates_in_columns_and_filters(frame, cell, operator, value, hit):
    df = frame([(cell,)], "v")
    rule = {"column": "v", "source_column": "v", "operator": operator, "value": value, "compare_value": value,
            "new_column": "r", "logic_type": "conditional_if_else", "true_value": "T", "false_value": "F"}
    assert column(C.add_columns(df, [rule]), "r") == ["T" if hit else "F"]
    assert C.filter_rows(df, [rule]).count() == int(hit)


def test_unknown_operator_is_false_in_a_column_and_keeps_rows_in_a_filter(frame):
    df = frame([("1",)], "v")
    rule = {"new_column": "r", "logic_type": "conditional_if_else", "source_column": "v", "operator": "~",
            "true_value": "T", "false_value": "F"}
    assert column(C.add_columns(df, [rule]), "r") == ["F"]
    assert C.filter_rows(df, [{"column": "v", "operator": "~"}, {"column": "zz", "operator": "=="}]).count() == 1


def test_select_and_drop(frame):
    df = frame([("1", "2", "3")], "a b c")
    assert C.select_columns(df, ["c", "zz", "a"]).columns == ["c", "a"]
    assert C.select_columns(df, ["zz"]).columns == ["a", "b", "c"]
    assert C.drop_columns(df, ["b", "zz"]).columns == ["a", "c"]


def test_empty_rules_change_nothing(frame):
    df = frame([("1", None), ("2", "x")], "a b")
    assert C.clean(df, CleanSpec()).collect() == df.collect()


def test_job_is_one_narrow_stage(spark):
    from rowmend.plans.clean_queries import WHOLE_JOB

    source = spark.range(10).selectExpr("id AS event_id", "'x' AS event_type", "id AS value", "id AS user_id",
                                        "'p' AS props", "'t' AS ts")
    plan = C.clean(as_text(source), WHOLE_JOB)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_run_writes_and_counts(spark, frame, tmp_path):
    spec = CleanSpec(filter_rules=[{"column": "a", "operator": ">", "value": "1"}])
    out = f"{tmp_path}/cleaned"
    assert C.run_clean(frame([("1",), ("2",), ("3",)], "a"), spec, out) == {
        "processed_rows": 3, "retained_rows": 2}
    assert sorted(column(spark.read.csv(out, header=True), "a")) == ["2", "3"]
    counts = C.clean_counts(frame([("1",), ("2",), ("3",)], "a"), spec).first()
    assert (counts.processed_rows, counts.retained_rows) == (3, 2)


def test_spec_json():
    spec = CleanSpec({"a": "b"}, [{"column": "b"}], ["c"], [{"new_column": "d"}], [{"column": "d"}], ["d"])
    assert CleanSpec.from_json(spec.to_json()) == spec


def test_typed_filters_mean_what_text_filters_do(spark):
    values = [0.0, -0.0, 1.5, 10.0, -3.25, 1e20, float("nan"), float("inf"), float("-inf"), None]
    table = spark.createDataFrame([(v, i * 7 - 20, f"{i % 4}" if i % 5 else None) for i, v in enumerate(values)],
                                  "x double, n long, s string")
    for column in "xns":
        for operator in ("==", "!=", ">", "<=", "contains", "is_null", "odd"):
            for value in ("0", " 8 ", "many", "-inf"):
                rules = [{"column": column, "operator": operator, "value": value}]
                spec = CleanSpec(filter_rules=rules)
                got = as_text(C.clean(table, spec)).collect()
                assert sorted(got) == sorted(C.clean(as_text(table), spec).collect()), rules


def test_filters_reach_the_scan(spark):
    from rowmend.plans.clean_queries import clean_filter_select
    plan = clean_filter_select(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThan(l_quantity,10.0)" in pushed and "IsNotNull(l_discount)" in pushed


def test_dry_run_in_order(spark):
    from rowmend.operators.clean import dry_run

    rows = spark.range(50).selectExpr("CAST(99 - id AS STRING) AS a", "CAST(id AS STRING) AS b").repartition(5)
    assert sorted(r["a"] for r in dry_run(rows, CleanSpec(), 3, ["a"]).collect()) == ["50", "51", "52"]
