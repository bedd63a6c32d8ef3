import pytest

from rowmend.columns import as_text
from rowmend.operators.clean import clean
from rowmend.operators.lookup import build_index, enrich, main_source
from rowmend.operators.profile import value_counts
from rowmend.sources.workspace import written
from rowmend.specs import CleanSpec, LookupSpec, Mapping
from rowmend.streaming import incremental as I


@pytest.fixture
def folder(spark, tmp_path):
    path = f"{tmp_path}/rows"
    rows = spark.range(500).selectExpr("cast(id AS string) AS id", "concat('K', id % 40) AS k",
                                       "if(id % 3 = 0, 'Found', 'Not Found') AS state")
    rows.repartition(5).write.parquet(path)
    return path


def stream(spark, folder):
    return I.file_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=2)


def test_lookup_in_steps_equals_batch(spark, folder, frame, tmp_path):
    spec = LookupSpec("k", ("id", "k"), "k", (Mapping("v", new_column_name="v"),))
    source = main_source(frame([(f"k{i}", f"v{i}") for i in range(0, 40, 3)], "k v"))
    index = written(build_index([source], spec), "index")
    I.append_to(I.lookup_stream(stream(spark, folder), index, spec), f"{tmp_path}/out").awaitTermination()
    batch = enrich(spark.read.parquet(folder), [source], spec)
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(batch.collect())


def test_clean_resumes_from_its_checkpoint(spark, folder, tmp_path):
    spec = CleanSpec(add_rules=[{"new_column": "n", "logic_type": "math", "operation": "add",
                                 "left_column": "id", "right_column": "id"}],
                     filter_rules=[{"column": "n", "operator": ">", "value": "20"}])
    out, progress = f"{tmp_path}/out", f"{tmp_path}/progress"
    for _ in range(2):
        I.append_to(I.clean_stream(stream(spark, folder), spec), out, progress).awaitTermination()
        spark.read.parquet(folder).limit(7).coalesce(1).write.mode("append").parquet(folder)
    I.append_to(I.clean_stream(stream(spark, folder), spec), out, progress).awaitTermination()
    want = clean(as_text(spark.read.parquet(folder)), spec)
    assert sorted(spark.read.parquet(out).collect()) == sorted(want.collect())


def test_running_counts_equal_batch(spark, folder, tmp_path):
    I.keep_counts(I.profile_stream(stream(spark, folder), "k"), f"{tmp_path}/counts").awaitTermination()
    batch = value_counts(spark.read.parquet(folder), "k")
    assert sorted(I.latest_counts(spark, f"{tmp_path}/counts").collect()) == sorted(batch.collect())
    I.keep_counts(I.status_stream(stream(spark, folder), "state"), f"{tmp_path}/state").awaitTermination()
    assert tuple(I.latest_counts(spark, f"{tmp_path}/state").first()) == (500, 167, 333)


def test_a_second_run_without_new_input_adds_nothing(spark, folder, tmp_path):
    out = str(tmp_path / "again")
    for _ in range(2):
        I.append_to(stream(spark, folder), out).awaitTermination()
    assert spark.read.parquet(out).count() == spark.read.parquet(folder).count()


def test_streamed_lookup_spreads_given_hot_keys(spark, tmp_path, monkeypatch):
    from rowmend.operators import lookup as L
    from rowmend.specs import LookupSpec, Mapping

    spec = LookupSpec(input_key="k", keep_columns=("id", "k"), key_type="text", main_key="k",
                      main_mappings=(Mapping("city", new_column_name="city"),))
    spark.createDataFrame([(n, "hot" if n % 4 else f"k{n}") for n in range(40)], "id int, k string").write.parquet(str(tmp_path / "in"))
    index = written(L.build_index([L.main_source(spark.createDataFrame([("hot", "H"), ("k4", "F")], "k string, city string"))], spec), "index")
    monkeypatch.setattr(L, "BROADCAST_BYTES", -1)
    stream = I.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    matches = I.lookup_stream(stream, index, spec, hot_keys=["hot"])
    I.append_to(matches, str(tmp_path / "out")).awaitTermination()
    got = spark.read.schema(matches.schema).parquet(str(tmp_path / "out"))
    assert got.count() == 40 and got.where("city = 'H'").count() == 30 and got.where("city = 'F'").count() == 1
