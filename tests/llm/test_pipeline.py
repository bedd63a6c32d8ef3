"""The registered corpus queries, and every stage of the pipeline on its own input."""

import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from rowmend.llm import queries

SMALL = entry_points.SMALL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert oracle.differences(queries.QUERIES[name](spark, SMALL), oracle.connect(SMALL), queries.ORACLES[name]) == []


def test_every_operator_is_registered():
    names = set(entry_points.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {n.split("_")[0] + "_" for n in names if n.startswith("op")}
    assert "pipeline" in names and "pipeline" not in entry_points.oracle_sql()


PLANTED = "one two three four five six seven eight nine ten"


@pytest.fixture
def folder(spark, tmp_path):
    """Documents with an insult, a repeated line, near copies and a benchmark item."""
    words = ["".join(p) for p in zip("abcdefghijklmnopqrst" * 4, "aeiou" * 16, "tnrsl" * 16)]
    plain = lambda i, n=120: " ".join(f"{words[(i * 7 + k * k) % 80]}{(i * 31 + k) % 97}" for k in range(n))
    data, labels = [], []
    for i in range(200):
        text = plain(i)
        if i % 5 == 3:
            text += " you stinker and stinkers"
            labels.append((i, 1, 1))
        else:
            labels.append((i, 1, 0))
        if i % 2 == 0:
            text = "Menu | Home\n" + text
        if i == 44:
            text += " " + PLANTED
        data.append((i, text, "en", f"s{i % 3}", len(text)))
    data += [(500, plain(0), "en", "s9", len(plain(0))), (501, data[2][1], "en", "s2", data[2][4])]
    data += [(None, "no id here", "en", None, 10), (502, None, None, "s1", None), (503, "", "en", "s1", 0)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, PLANTED)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.columns[:5] == columns and (name == "bpe") == (len(docs.columns) > 5)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.count() == len(seen[name])
    toxic = {i for i in range(200) if i % 5 == 3}
    assert set(seen["toxicity"]) == {*range(200), 500, 501, 502, 503, None} - toxic
    cut = seen["line_dedup"]
    assert set(cut) == set(seen["toxicity"]) and not any("Menu" in (r["text"] or "") for r in cut.values())
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cut.values())
    single = seen["simhash"]
    assert set(single) == set(cut) - {500, 501, 503}
    assert set(seen["decontamination"]) == set(single) - {44}
    assert set(seen["bpe"]) == set(seen["decontamination"])
    assert all(r["decoded"] == (r["text"] or "") for r in seen["bpe"].values())
    assert corpus_pipeline.run(spark, folder).count() == len(seen["bpe"])


def test_repeated_rows_stay_once(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 4")
    got = corpus_pipeline.drop_near_copies(spark, docs.unionByName(docs), folder)
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 1, 2, 3]


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_unlike_documents_of_a_group_stay(spark, monkeypatch):
    plain = lambda i: " ".join(f"w{(i * 31 + k * k) % 997}x{i}" for k in range(100))
    # Ids 2 and 3 are copies, 1 and 4 are like nothing; null ids are copies of each other and of 2.
    data = [(1, plain(1)), (2, plain(2)), (3, plain(2) + " tail"), (4, plain(4)), (None, plain(2)), (None, plain(5)), (None, plain(5))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    linked = lambda df, id_col="doc_id", width=4: df.select(F.col(id_col).alias("id"), F.lit(1).alias("component_id"))
    monkeypatch.setattr(corpus_pipeline, "simhash_groups", linked)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([data[0], data[1], data[3], data[5]], key=str)
