import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from rowmend.functions.text import normal_key
from rowmend.operators import lookup as L
from rowmend.specs import LookupSpec, Mapping, map_all

MAIN = (Mapping("city", new_column_name="town", mandatory=True), Mapping("zip", new_column_name="zip"))
SPEC = LookupSpec(
    input_key="k", keep_columns=("id", "k"), main_key="k", main_mappings=MAIN, special_key="code",
    special_mappings=(Mapping("c", new_column_name="town", mandatory=True),))


def by_id(df):
    return {row["id"]: row.asDict() for row in df.collect()}


@pytest.fixture
def sources(frame):
    special = frame([("A", "special a", "x"), ("b", " ", "x"), ("d", "special d", "x")], "code c other")
    first = frame([("a", "main a", "1"), ("B ", "main b", ""), ("e", "", "5"), ("", "nowhere", "0")], "k city zip")
    second = frame([("b", "second b", "2"), ("e", "second e", "6"), ("f", None, "7")], "k city zip")
    keyless = frame([("z", "z")], "other city")
    return [L.special_source(special), L.main_source(first), L.main_source(keyless), L.main_source(second)]


@pytest.fixture
def rows(frame):
    return frame([("1", " a\t"), ("2", "B"), ("3", "d"), ("4", "E"), ("5", "f"), ("6", "  "), ("7", None)], "id k")


def test_keys(frame):
    got = frame([("  AbC\t",), (None,), ("+91 98765-43210",), ("12345",), ("00919876543210",)], "v").select(
        normal_key(F.col("v")).alias("text"), normal_key(F.col("v"), "mobile").alias("mobile")).collect()
    assert [r["text"] for r in got] == ["abc", "", "+91 98765-43210", "12345", "00919876543210"]
    assert [r["mobile"] for r in got] == ["", "", "9876543210", "", "9876543210"]


def test_whole_row_of_best_source_wins(rows, sources):
    got = by_id(L.enrich(rows, sources, SPEC))
    assert (got["1"]["town"], got["1"]["zip"]) == ("special a", "")
    assert (got["2"]["town"], got["2"]["zip"]) == ("main b", "")
    assert got["3"]["town"] == "special d"
    assert (got["4"]["town"], got["4"]["zip"]) == ("second e", "6")
    assert [got[i]["reason"] for i in "1567"] == [
        "", "NO_MATCH_FOUND", "INVALID_OR_BLANK_KEY", "INVALID_OR_BLANK_KEY"]
    assert got["1"]["match_status"] == "MATCHED" and got["7"]["match_status"] == "UNMATCHED"


def test_unmapped_source_column_with_target_name_is_taken(frame):
    spec = LookupSpec("k", ("id",), "k", (Mapping("city", new_column_name="town"),), "code",
                      (Mapping("c", new_column_name="zip"),))
    special = frame([("a", "9", "own town")], "code c town")
    got = by_id(L.enrich(frame([("1", "a")], "id k"), [L.special_source(special)], spec))
    assert got["1"]["town"] == "own town"


def test_row_order_breaks_ties(spark, frame):
    table = spark.createDataFrame([("a", "zz", 1), ("a", "aa", 2)], "k string, city string, n long")
    spec = LookupSpec("k", ("id",), "k", (Mapping("city", new_column_name="town"),))
    rows = frame([("1", "a")], "id k")
    assert by_id(L.enrich(rows, [L.main_source(table, "n")], spec))["1"]["town"] == "zz"
    assert by_id(L.enrich(rows, [L.main_source(table)], spec))["1"]["town"] == "aa"


def test_routing_and_headers(rows, sources):
    parts = L.route(L.enrich(rows, sources, SPEC), SPEC)
    assert parts["matched"].columns == ["id", "k", "town", "zip"]
    assert parts["unmatched"].columns == ["id", "k", "town", "zip", "reason"]
    assert parts["consolidated"].columns == ["id", "k", "town", "zip", "match_status", "reason"]
    assert parts["matched"].count() == 4 and parts["unmatched"].count() == 3


def test_all_strategies_agree(rows, sources):
    index = L.build_index(sources, SPEC)
    want = sorted(L.match(rows, index, SPEC).collect())
    assert sorted(L.match(rows, index, SPEC, ["a", "e", "none"]).collect()) == want
    assert sorted(L.match(rows, index, SPEC, small_index=True).collect()) == want


def test_semi_and_anti_views(rows, sources):
    index = L.build_index(sources, SPEC)
    assert sorted(r["id"] for r in L.with_partner(rows, index, SPEC).collect()) == list("1234")
    assert sorted(r["id"] for r in L.without_partner(rows, index, SPEC).collect()) == list("567")


@pytest.mark.parametrize("mode, blank, filled", [
    ("keep_input", "", "own"), ("fill_if_blank", "new", "own"), ("overwrite", "new", "new")])
def test_write_modes(frame, mode, blank, filled):
    spec = LookupSpec("k", ("id", "note"), "k", (
        Mapping("v", "existing", target_existing_column="note", write_mode=mode),))
    rows = frame([("1", "a", ""), ("2", "a", "own"), ("3", "x", "own")], "id k note")
    got = by_id(L.enrich(rows, [L.main_source(frame([("a", "new")], "k v"))], spec))
    assert (got["1"]["note"], got["2"]["note"], got["3"]["note"]) == (blank, filled, "own")


def test_validation(frame):
    rows = frame([("1", "a")], "id k")
    bad = [
        LookupSpec("absent", ("id",), "k", ()),
        LookupSpec("k", ("id",), "k", (Mapping("c", new_column_name="x"), Mapping("c", new_column_name="y"))),
        LookupSpec("k", ("id",), "k", (Mapping("c", new_column_name="reason"),)),
        LookupSpec("k", ("id",), "k", (Mapping("c", new_column_name="x", write_mode="append"),)),
        LookupSpec("k", ("id",), "k", (), key_type="date"),
    ]
    for spec in bad:
        with pytest.raises(ValueError):
            spec.validate(rows.columns)


def test_spec_json_and_map_all():
    assert LookupSpec.from_json(SPEC.to_json()) == SPEC
    assert [m.target for m in map_all(["k", "a", "b"], "k")] == ["a", "b"]


def test_frequent_keys_are_found_and_bounded(spark):
    keys = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "")
        .otherwise(F.col("id").cast("string")).alias("norm_key")).repartition(8)
    assert L.frequent_keys(keys) == ["hot"]
    assert len(L.frequent_keys(keys, limit=5)) <= 5
    assert L.frequent_keys(keys.limit(0)) == []


def test_input_and_sources_are_read_once(spark, monkeypatch):
    from rowmend.plans import lookup_queries as Q
    small = "/root/testdata/sf0.001"
    reads = []
    monkeypatch.setattr(Q, "derived", lambda s, d, name, *a: reads.append(name) or derived(s, d, name, *a))
    derived = __import__("rowmend.plans.registry", fromlist=["derived"]).derived
    plan = Q.lookup_consolidated(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert reads.count("orders") == 1 and plan.count("FileScan") == 2 and "BroadcastHashJoin" in plan
    monkeypatch.setattr(L, "BROADCAST_BYTES", 0)
    plan = Q.lookup_consolidated(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2
    assert sorted(map(str, Q.lookup_consolidated(spark, small).collect()))


def test_hot_and_blank_keys_are_spread(spark, frame):
    rows = spark.range(3000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"))
    spec = LookupSpec("k", ("id", "k"), "k", (Mapping("v", new_column_name="v"),))
    index = L.build_index([L.main_source(frame([("hot", "h"), ("k1", "one")], "k v"))], spec)
    assert L.match(rows, index, spec, ["hot"]).columns == spec.headers["consolidated"]
    keyed = rows.withColumn(L.KEY, F.col("k"))
    spread = L.join_keys(keyed, index.select(L.KEY, F.lit(1).alias("hit")), "left", ["hot"])
    assert spread.count() == 3000 and spread.where("hit = 1").count() == 1001
    got = L.run_statistics(L.match(rows, index, spec, ["hot"])).first()
    assert (got.processed_rows, got.matched_rows, got.unmatched_rows) == (3000, 1001, 1999)


def test_observed_counters(rows, sources):
    seen = Observation("lookup")
    L.observed(L.enrich(rows, sources, SPEC), seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"processed_rows": 7, "matched_rows": 4, "unmatched_rows": 3}


def test_whole_run(spark, rows, sources, tmp_path):
    out = f"{tmp_path}/run"
    assert L.run_lookup(rows, sources, SPEC, out) == {
        "processed_rows": 7, "matched_rows": 4, "unmatched_rows": 3, "unique_lookup_keys_indexed": 4}
    back = spark.read.csv(f"{out}/consolidated_output", header=True)
    assert back.columns == SPEC.headers["consolidated"] and back.count() == 7
    assert spark.read.json(f"{out}/summary").first()["matched_rows"] == 4
    assert spark.read.text(f"{out}/summary_text").first().value == "Processed: 7 | Matched: 4"


def test_sources_from_folders(spark, rows, tmp_path):
    for name, text in {"m/a.csv": "k,city,zip\na,A,1\n", "m/b.csv": "k,city,zip\nb,B,\n",
                       "n/c.csv": "city,k\nE,e\n", "special.csv": "code,c\nA,over\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = L.folder_sources(spark, [f"{tmp_path}/{d}" for d in "mxn"], f"{tmp_path}/special.csv")
    assert [s.kind for s in found] == ["special_lookup", "main_lookup", "main_lookup"]
    got = by_id(L.enrich(rows, found, SPEC))
    assert [got[i]["town"] for i in "124"] == ["over", "B", "E"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "A ", "b", "", None, "q", "zz"]), min_size=1, max_size=20))
def test_routing_partitions_the_input(frame, sources, keys):
    rows = frame([(str(i), k) for i, k in enumerate(keys)], "id k")
    parts = L.route(L.enrich(rows, sources, SPEC), SPEC)
    counts = {name: part.count() for name, part in parts.items()}
    assert counts["matched"] + counts["unmatched"] == counts["consolidated"] == len(keys)


def test_file_order_breaks_ties_across_headers(spark, rows, tmp_path):
    texts = {"m/b.csv": "k,city,zip\na,second,1\nb,B,1\nb,B2,1\n", "m/a.csv": "city,k\nfirst,a\n",
             "n/0.csv": "k,city,zip\na,third,1\ne,\"E\nbroken\",2\n", "n/1.csv": "k,city,zip\ne,late,2\n"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = by_id(L.enrich(rows, L.folder_sources(spark, [f"{tmp_path}/{d}" for d in "mn"]), SPEC))
    assert [got[i]["town"] for i in "124"] == ["first", "B", "E\nbroken"]
    turned = by_id(L.enrich(rows, L.folder_sources(spark, [f"{tmp_path}/{d}" for d in "nm"]), SPEC))
    assert [turned[i]["town"] for i in "124"] == ["third", "B", "E\nbroken"]


def test_partner_joins_follow_the_measured_index(spark, rows, sources, monkeypatch):
    index = L.build_index(sources, SPEC)
    small = L.with_partner(rows, index, SPEC)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(L, "BROADCAST_BYTES", -1)
    asked = []
    monkeypatch.setattr(L, "frequent_keys", lambda keys: asked.append(1) or ["a"])
    assert sorted(r["id"] for r in L.with_partner(rows, index, SPEC).collect()) == sorted(r["id"] for r in small.collect())
    assert sorted(r["id"] for r in L.without_partner(rows, index, SPEC).collect()) == list("567")
    assert asked == [1, 1]
