import random
import re
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowmend.functions.dates import normal_date
from rowmend.functions.text import safe_file_name, safe_merge_name
from rowmend.operators import batching
from rowmend.operators import numbering as N
from rowmend.operators import prepare as P
from rowmend.operators.batching import exits, fill, size_batches


def values(df, name):
    return [row[name] for row in df.collect()]


# --- ids, times, dates


def test_unique_ids(frame):
    df = frame([("1", "ab", "c", "KEEP"), ("2", "a", "bc", " "), ("3", "a", "bc", None)], "n x y id")
    got = values(P.assign_unique_id(df, ["n", "x", "y"], "id"), "id")
    assert got[0] == "KEEP" and all(re.fullmatch("[0-9A-Z]{25}", v) for v in got[1:]) and got[1] != got[2]
    assert values(P.assign_unique_id(df, ["n", "x", "y"], "id"), "id") == got
    by_text = P.assign_unique_id(df.drop("id"), ["x", "y"])
    assert len(set(values(by_text, "Unique ID"))) == 2
    assert [tuple(r)[1] for r in P.repeated_ids(by_text).collect()] == [2]


def test_staggered_times_and_records(frame):
    df = frame([("b", "05-03-2024"), ("a", "soon")], "k dob").withColumnRenamed("dob", " Date of Birth")
    got = {r["k"]: r for r in P.prepare_records(df, ["k"], ["k"], datetime(2024, 2, 29, 23, 59)).collect()}
    assert got["a"]["Initiation Date"] == "29-02-2024 23:59" and got["b"]["Initiation Date"] == "01-03-2024 00:00"
    assert got["b"][" Date of Birth"] == "05 Mar 2024" and got["a"][" Date of Birth"] == "soon"
    assert len(got["a"]["Unique ID"]) == 25


@pytest.mark.parametrize("text, want", [
    *[(t, "05 Mar 2024") for t in (
        "05-03-2024", "5/3/2024", "05.03.2024", "05 03 2024", "5-Mar-2024", "05 mar 2024", "05-MARCH-2024",
        "05 March 2024", "2024-3-05", "2024/03/05", "  5   March  2024 ")],
    ("12/31/2024", "31 Dec 2024"), ("12-31-2024", "31 Dec 2024"), ("31-02-2024", "31-02-2024"),
    ("12.31.2024", "12.31.2024"), ("5/3-2024", "5/3-2024"), ("05-03-24", "05-03-24"), ("", ""), (None, None),
    ("2024-03-05 10:00", "2024-03-05 10:00"), ("05-03-12024", "05-03-12024")])
def test_dates(frame, text, want):
    assert frame([(text,)], "d").select(normal_date(F.col("d")).alias("d")).first().d == want


# --- file names and manifests


def test_file_names(frame):
    row = frame([('. a<>b:"c"  d/e. ',)], "n").select(
        safe_file_name(F.col("n")).alias("one"), safe_merge_name(F.col("n")).alias("two")).first()
    assert (row.one, row.two) == ("a_b_c_ d_e", ". a__b__c_  d_e.")


MANIFEST = [
    ("", "x", "skipped - empty url", ""), (None, "x", "skipped - empty url", ""),
    ("http://h/a/b.tar.gz?q=1.zip", None, "planned", "out/file_3.gz"), ("http://h.org", "n", "planned", "out/n.bin"),
    ("http://h/.hidden", "n", "planned", "out/n.bin"), ("http://h/a.PDF;v=1#x.y", "n ", "planned", "out/n.PDF"),
    ("https://drive.google.com/file/d/A_b-1/view", "n", "planned", "out/n.bin"),
    ("https://docs.google.com/none", "n", "failed - Could not extract Google Drive file ID", "")]


def test_manifest(spark):
    rows = [(i, u, n) for i, (u, n, _, _) in enumerate(MANIFEST)]
    df = spark.createDataFrame(rows, "i long, u string, n string")
    got = P.plan_url_manifest(df, "u", "n", F.col("i"), "out").orderBy("row").collect()
    assert [(r.status, r.saved_path) for r in got] == [(s, p) for *_, s, p in MANIFEST]
    assert [r.row for r in got] == list(range(2, 2 + len(MANIFEST)))
    direct = P.plan_url_manifest(df, "u", "n", F.col("i"), source_type="Direct").filter("row = 9").first()
    assert direct.status == "planned"


@pytest.mark.parametrize("url, file_id", [
    ("https://x/file/d/AB-1/view", "AB-1"), ("https://x/open?id=Z_9&x", "Z_9"), ("https://x/d/Q", "Q"),
    ("https://x/?id=%2Fa", "/a"), ("https://x/", "")])
def test_drive_ids(frame, url, file_id):
    assert frame([(url,)], "u").select(P.drive_file_id(F.col("u")).alias("v")).first().v == file_id


# --- numbering


def test_numbers_are_dense_over_many_partitions(many_partitions):
    df = many_partitions.range(5000).select(((F.col("id") * 7919) % 5000).alias("v"), (F.col("id") % 3).alias("g"))
    placed = N.place_rows(df, [F.col("v")])
    assert placed.select(N.PART).distinct().count() > 4
    got = N.number_rows(df, ["v"], start=0).collect()
    assert all(r["v"] == r["row_number"] for r in got) and len(got) == 5000


def test_group_numbers_with_one_group_over_many_partitions(many_partitions):
    df = many_partitions.range(6000).select(
        "id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 100)).alias("g"))
    got = N.number_rows(df, ["id"], ["g"]).collect()
    seen = {}
    for row in sorted(got, key=lambda r: r["id"]):
        seen[row["g"]] = seen.get(row["g"], 0) + 1
        assert row["row_number"] == seen[row["g"]]
    assert len(got) == 6000 and seen["hot"] == 4000


def test_null_groups_are_numbered(many_partitions):
    df = many_partitions.range(20).select("id", F.when(F.col("id") > 4, "x").alias("g"))
    got = N.number_rows(df, ["id"], ["g"]).collect()
    assert sorted(r["row_number"] for r in got if r["g"] is None) == [1, 2, 3, 4, 5]


def test_file_rows(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t/part{i}")
    paths = [f"{tmp_path}/t/part{i}" for i in range(3)]
    got = N.number_file_rows(spark, paths, start=2).collect()
    assert sorted((r["id"], r["row_number"]) for r in got) == [(i, i + 2) for i in range(30)]


# --- batches


def slow_batches(sizes, cap):
    batch, level, out = 1, 0, []
    for size in sizes:
        if size > cap:
            out.append(None)
            continue
        if level + size > cap:
            batch, level = batch + 1, 0
        level += size
        out.append(batch)
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(0, 40), min_size=1, max_size=30), st.integers(0, 40))
def test_exit_table_gives_the_state_for_any_entry_level(cap, sizes, level):
    sizes = np.array([min(s, cap) for s in sizes])
    level = min(level, cap)
    index, final = fill(sizes, cap, level)
    above, opened, left = next(row for row in exits(sizes, cap) if level > row[0])
    assert (opened, level + int(sizes.sum()) if left is None else left) == (int(index[-1]), final)
    # The open batch behaves like a first row of that size.
    assert [i + 1 for i in index] == slow_batches([level, *sizes], cap)[1:]


def test_batches_fixture(spark):
    df = spark.createDataFrame([(1, 10), (2, 25), (3, 40), (4, 5)], "id int, size int")
    got = {r.id: r.batch for r in size_batches(df, "size", 30, ["id"]).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: 2}


@pytest.mark.parametrize("short", [200, 0])
@pytest.mark.parametrize("cap", [15, 200, 5000, 10**6])
def test_batches_over_many_partitions(many_partitions, monkeypatch, cap, short):
    monkeypatch.setattr(batching, "SHORT_TABLE", short)
    rng = random.Random(cap)
    rows = [(i, rng.choice(["hot", "hot", f"g{i % 40}"]), rng.randint(0, 18)) for i in range(3000)]
    df = many_partitions.createDataFrame(rows, "id int, g string, size int")
    got = {r["id"]: r["batch"] for r in size_batches(df, "size", cap, ["id"], ["g"]).collect()}
    for group in {g for _, g, _ in rows}:
        members = [(i, s) for i, g, s in rows if g == group]
        assert [got[i] for i, _ in members] == slow_batches([s for _, s in members], cap)
    whole = {r["id"]: r["batch"] for r in size_batches(df, "size", cap, ["id"]).collect()}
    assert [whole[i] for i, _, _ in rows] == slow_batches([s for *_, s in rows], cap)


def test_natural_position(frame):
    df = frame([("f10",), ("f2",), ("F1",)], "n")
    assert {r.n: r.position for r in P.natural_position(df, "n").collect()} == {"F1": 1, "f2": 2, "f10": 3}
    assert values(P.natural_sort(df, "n"), "n") == ["F1", "f2", "f10"]
