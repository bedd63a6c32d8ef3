"""Grouping sets, first rows of groups, bags, many-term search and JSON fields against plain definitions."""

import json
import random
import string
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from rowmend.operators import grouping as G
from rowmend.operators.json_fields import (
    JsonField, fields_of_type, json_fields, json_maps, key_statistics, with_json_columns,
)
from rowmend.operators.search import search
from rowmend.operators.term_search import search_many


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def sales(spark, count=400):
    draw = random.Random(3)
    data = [(draw.choice(["hot"] * 5 + ["b", None]), draw.choice([1, 2, None]), draw.choice([None, *range(20)])) for _ in range(count)]
    return data, spark.createDataFrame(data, "key string, level int, value int")


def test_sets_by_definition(spark):
    data, rows = sales(spark)
    got = G.grouped_by_sets(rows, G.cube_sets(["key", "level"]), {
        "n": G.count(), "total": G.total("value"), "low": G.least("value"), "high": G.most("value"), "mean": G.mean("value")})
    want = []
    for kept in ((1, 1), (1, 0), (0, 1), (0, 0)):
        groups = defaultdict(list)
        for k, v, x in data:
            groups[(k if kept[0] else None, v if kept[1] else None)].append(x)
        for (k, v), values in groups.items():
            x = [y for y in values if y is not None]
            want.append((k, v, 3 - 2 * kept[0] - kept[1], len(values), sum(x) if x else None, min(x, default=None),
                         max(x, default=None), sum(x) / len(x) if x else None))
    assert sorted_rows(got) == sorted(want, key=str)


def test_sets_read_the_input_once(spark, tmp_path):
    _, rows = sales(spark)
    rows.write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    got = G.grouped_by_sets(table, G.cube_sets(["key", "level"]), {"n": G.count()})
    assert str(tmp_path) not in got._jdf.queryExecution().toString()


def test_sets_of_an_empty_table(spark):
    _, rows = sales(spark)
    got = G.grouped_by_sets(rows.limit(0), [["key"], []], {"n": G.count(), "d": G.distinct("value"), "s": G.total("value")})
    assert sorted_rows(got) == [(None, 1, 0, 0, None)]
    with pytest.raises(ValueError):
        G.grouped_by_sets(rows, [[]], {"n": G.count()})


def test_sketches_merge_within_their_errors(spark):
    rows = spark.range(60_000).selectExpr("id % 3 AS a", "id % 7 AS b", "id % 20000 AS user", "CAST(id AS DOUBLE) AS x")
    got = {(r.a, r.b): r for r in G.grouped_by_sets(rows, [["a", "b"], ["a"], []], {
        "users": G.distinct("user"), "half": G.quantile("x", 0.5), "tenth": G.quantile("x", 0.1)}).collect()}
    assert len(got) == 21 + 3 + 1
    whole = got[(None, None)]
    assert abs(whole.users - 20_000) <= 400 and abs(whole.half - 30_000) <= 900 and abs(whole.tenth - 6_000) <= 900
    assert all(abs(got[(a, None)].half - 30_000) <= 1200 for a in range(3))


@pytest.mark.parametrize("low, high", [(0.48, 0.52), (0.25, 0.75), (0.0, 1.0), (0.5, 0.5)])
def test_values_between_exact_quantiles(spark, low, high):
    draw = random.Random(5)
    data = [(draw.choice("aabc"), draw.choice([1, 2, None]), draw.choice([None, 0.5, 2.25, float("nan"), *range(12)])) for _ in range(60)]
    rows = spark.createDataFrame([(k, n, None if x is None else float(x)) for k, n, x in [*data, ("none", 3, None)]],
                                 "`a.b` string, n int, x double")
    sets = G.cube_sets(["a.b", "n"])
    exact = [(r["a.b"], r.n, r.level, r.around) for r in rows.cube("`a.b`", "n").agg(
        F.grouping_id().alias("level"), F.percentile("x", F.array(F.lit(low), F.lit(high))).alias("around")).collect()]
    tried = [None, -1.0, 0.5, 3.0, 4.5, 5.0, 6.75, 11.0, float("nan")]
    tried += sorted({y for *_, around in exact if around for y in around if y == y})
    as_spark = lambda y: (y != y, 0 if y != y else y)
    for v in tried:
        groups = spark.createDataFrame([(k, n, level, v) for k, n, level, _ in exact], "`a.b` string, n int, level int, v double")
        got = G.between_quantiles(rows, sets, groups, "v", "x", low, high, "ok", "level")
        want = [(k, n, level, None if None in (around, v) else as_spark(around[0]) <= as_spark(v) <= as_spark(around[1]))
                for k, n, level, around in exact]
        assert sorted_rows(got.drop("v")) == sorted(want, key=str)


def test_sketches_are_held_against_ranks_not_gathered_values(spark):
    plan = entry_points.queries()["grouping_sketches"](spark, entry_points.SMALL)._jdf.queryExecution().toString()
    assert "percentile" not in plan and "__less" in plan


def test_first_rows_with_a_hot_group(spark):
    data, rows = sales(spark)
    numbered = rows.withColumn("id", F.monotonically_increasing_id())
    got = G.first_of_groups(numbered, ["key"], [F.desc_nulls_last("value"), "id"], 4)
    # Once before the shuffle and once after it.
    assert got._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    groups = defaultdict(list)
    for r in numbered.collect():
        groups[r.key].append(r)
    want = []
    for key, members in groups.items():
        order = sorted(members, key=lambda r: (r.value is None, -(r.value or 0), r.id))
        want += [(*r, n) for n, r in enumerate(order[:4], 1)]
    assert sorted_rows(got) == sorted(want, key=str)


def test_first_rows_with_ties(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 5), ("a", 4), ("a", 3), ("b", 1)], "g string, v int")
    got = G.first_of_groups(rows, ["g"], [F.desc("v")], 2, ties=True)
    assert sorted_rows(got) == [("a", 5, 1), ("a", 5, 1), ("b", 1, 1)]
    assert sorted_rows(G.first_of_groups(rows, ["g"], [F.desc("v")], 3, ties=True)) == [
        ("a", 4, 3), ("a", 5, 1), ("a", 5, 1), ("b", 1, 1)]


def test_bags_by_definition(spark):
    draw = random.Random(6)

    def bag():
        return [(draw.choice(["x", "y", None]), draw.choice([0.0, -0.0, 1.5, float("nan"), None])) for _ in range(120)]
    one, two = bag(), [*bag(), ("only", 1.0)]
    a, b = (spark.createDataFrame(x, "k string, v double") for x in (one, two))
    count = [Counter((k, str(abs(v)) if v is not None else None) for k, v in x) for x in (one, two)]

    def found(df):
        return Counter((r.k, str(abs(r.v)) if r.v is not None else None) for r in df.collect())
    assert found(G.common_rows(a, b, every=True)) == count[0] & count[1]
    assert found(G.rows_without(b, a, every=True)) == count[1] - count[0]
    assert found(G.common_rows(a, b)) == Counter(list(count[0].keys() & count[1].keys()))
    assert found(G.rows_without(b, a)) == Counter(list(count[1].keys() - count[0].keys()))
    assert {r.k: r.surplus for r in G.row_differences(a, b).collect() if r.k == "only"} == {"only": -1}
    assert G.rows_without(a, a, every=True).count() == 0 and G.common_rows(a, b.limit(0)).count() == 0
    with pytest.raises(ValueError):
        G.common_rows(a, b.select("v", "k"))


def test_many_terms_like_the_short_search(spark):
    draw = random.Random(7)
    rows = spark.createDataFrame(
        [(n, "".join(draw.choice("ab1 2-") for _ in range(30)), draw.choice([None, "x1", "q"])) for n in range(60)] + [(99, None, None)],
        "id int, text string, other string")
    terms = ["ab", " 1a ", "b", "a", "1-2", "12", "2-1", "", "1", "ba1", "q", "zz"]
    want = sorted_rows(search(rows, terms, F.col("id") + 2, "f"))
    assert want and sorted_rows(search_many(rows, terms, F.col("id") + 2, "f")) == want
    assert sorted_rows(search_many(rows, terms, F.col("id") + 2, "f", pass_chars=4)) == want
    assert sorted_rows(search_many(rows, ["ab"], F.col("id") + 2)) == sorted_rows(search(rows, ["ab"], F.col("id") + 2))
    assert search_many(rows.limit(0), terms, F.col("id")).count() == 0
    with pytest.raises(ValueError):
        search_many(rows, [" "], F.col("id"))


def test_ten_thousand_terms(spark):
    draw = random.Random(8)
    words = ["".join(draw.choice(string.ascii_lowercase) for _ in range(draw.randint(6, 12))) for _ in range(20_000)]
    terms, others = words[:10_000], words[10_000:]
    texts = [" ".join(draw.choice(terms if draw.random() < 0.02 else others) for _ in range(80)) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    small = search_many(rows, terms[:10], F.col("id"), columns=["text"])
    full = search_many(rows, terms, F.col("id"), columns=["text"])
    seconds = []
    for df in (small, small, full):
        start = time.perf_counter()
        found = df.collect()
        seconds.append(time.perf_counter() - start)
    want = sorted((n, t) for n, text in enumerate(texts) for t in set(text.split()) & set(terms))
    inside = [(n, t) for n, text in enumerate(texts) for t in terms[:300] if t in text]
    got = sorted((r["Excel_Row_Number"], r["Matched_Term"]) for r in found)
    assert set(want) <= set(got) and set(inside) <= set(got)
    assert seconds[2] < 20 * seconds[1] + 5


def test_fields_of_a_type():
    kind = "OBJECT<a: BIGINT, `b: <c`: OBJECT<d: DECIMAL(3,1), e: ARRAY<OBJECT<f: STRING>>>, g: VOID, h: VARIANT>"
    assert fields_of_type(kind) == [
        JsonField(("a",), "BIGINT"), JsonField(("b: <c", "d"), "DECIMAL(3,1)"), JsonField(("b: <c", "e"), "VARIANT"),
        JsonField(("g",), "VARIANT"), JsonField(("h",), "VARIANT")]
    assert fields_of_type("BIGINT") == [] and fields_of_type("OBJECT<>") == []


def test_json_fields_found_in_any_row(spark):
    values = [{"a": 1, "o": {"x": "s", "y": [1, {"z": 2}]}}, {"a": 2.5, "o": {"x": None}}, {"b": True, "odd key": "v"}, {}, [1], 7]
    texts = [json.dumps(v) for v in values] + ["not json", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, props string")
    objects = rows.where("id < 4 OR id > 5")
    fields = {f.names: f.kind for f in json_fields(objects, "props")}
    assert set(fields) == {("a",), ("b",), ("o", "x"), ("o", "y"), ("odd key",)}
    assert fields[("b",)] == "BOOLEAN" and fields[("o", "x")] == "STRING" and fields[("a",)].startswith(("DECIMAL", "DOUBLE"))
    got = {r.id: r for r in with_json_columns(rows, "props", json_fields(objects, "props")).collect()}
    assert float(got[0]["a"]) == 1 and float(got[1]["a"]) == 2.5 and got[2]["b"] is True and got[2]["odd key"] == "v"
    assert got[0]["o.x"] == "s" and got[1]["o.x"] is None
    assert all(got[n]["a"] is None and got[n]["b"] is None for n in (3, 4, 5, 6, 7))
    assert json_fields(rows.limit(0), "props") == []


def test_keys_and_maps(spark):
    rows = spark.createDataFrame([('{"k": 1, "t": "x"}',), ('{"k": 2.5}',), ('{"t": null}',), ("[1]",), (None,), ("{}",)], "props string")
    assert sorted_rows(key_statistics(rows, "props")) == [("k", 2, 2, 3.5), ("t", 2, 0, None)]
    assert [r[0] for r in rows.select(F.map_keys(json_maps(F.col("props")))).limit(2).collect()] == [["k", "t"], ["k"]]
