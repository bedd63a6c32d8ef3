import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rowmend.operators.profile import ENTIRE_ROW, SKIP, profile, table_summary, value_breakdown
from rowmend.operators.search import RESULT, prepare_terms, search
from rowmend.operators.union import union_folder, union_tables
from rowmend.sources import files
from rowmend.sources.workspace import ensure_workspace, new_path, remove, run_folder, shared_folder, written


def save(folder, name, text, encoding="utf-8"):
    folder.mkdir(exist_ok=True, parents=True)
    path = folder / name
    path.write_bytes(text.encode(encoding) if isinstance(text, str) else text)
    return str(path)


def cells(df):
    return [tuple(row) for row in df.collect()]


# --- files


def test_csv_rows_short_long_quoted_and_missing(spark, tmp_path):
    path = save(tmp_path, "a.csv", 'a,b\n1,2\n3,4,5\n6\n7,8,\n\n"x\ny",NA\n"q""r","c,d"\nnull, n \n"p,q",1,2\n')
    got = cells(files.csv_scan(spark, path))
    assert got == [("1", "2"), ("6", ""), ("x\ny", ""), ('q"r', "c,d"), ("", " n ")]
    raw = cells(files.csv_scan(spark, path, blank_nulls=False, missing=("",)))
    assert raw[1] == ("6", None) and raw[2] == ("x\ny", "NA") and raw[4][0] == "null"


def test_csv_single_line_mode_agrees(spark, tmp_path):
    path = save(tmp_path, "a.csv", 'a,b\n1,2\n3,4,5\n6\n7,8,\n"q""r","c,d"\n')
    assert cells(files.csv_scan(spark, path, multi_line=False)) == cells(files.csv_scan(spark, path))


def test_headers(spark, tmp_path):
    path = save(tmp_path, "a.csv", "﻿a,b,a,,a.b\r\n1,2,3,4,5\r\n")
    assert files.header_of(spark, path) == ["a", "b", "a.1", "Unnamed: 3", "a.b"]
    assert cells(files.csv_scan(spark, path)) == [("1", "2", "3", "4", "5")]
    broken = save(tmp_path, "d.csv", '"k\nx",v,"a ""q"" b"\n1,2,3\n')
    assert files.header_of(spark, broken) == ["k\nx", "v", 'a "q" b']
    assert cells(files.csv_scan(spark, broken)) == [("1", "2", "3")]
    assert cells(files.smart_read(spark, save(tmp_path, "b.txt", "x,y\n1,\n"))) == [("1", None)]
    with pytest.raises(ValueError):
        files.smart_read(spark, save(tmp_path, "c.csv", ""))


def test_file_listing(spark, tmp_path):
    for name in ("b.csv", "a.csv", "n.txt"):
        save(tmp_path / "one", name, "k\n1\n")
    save(tmp_path / "two", "0.csv", "k\n1\n")
    save(tmp_path / "one" / "deep", "z.csv", "k\n1\n")
    listed = files.list_lookup_files(spark, [str(tmp_path / d) for d in ("two", "missing", "one")])
    assert [p.rsplit("/", 2)[1:] for p in listed] == [["two", "0.csv"], ["one", "a.csv"], ["one", "b.csv"]]
    save(tmp_path / "one", "B.CSV", "k\n1\n")
    deep = files.list_files(spark, str(tmp_path / "one"), recursive=True)
    assert [p.rsplit("/", 1)[1] for p in deep] == ["B.CSV", "a.csv", "b.csv", "z.csv"]
    for name in ("_c.csv", ".d.csv"):
        save(tmp_path / name, name, "k\n1\n")
        with pytest.raises(ValueError, match=name):
            files.list_files(spark, str(tmp_path / name))


def test_conforming_writer(spark, frame, tmp_path):
    df = frame([('say "hi"', None), ("two\nlines", " x ")], "a b")
    out = f"{tmp_path}/out"
    files.write_csv(df, out, ["b", "c", "a", "b"])
    back = files.csv_scan(spark, files.list_files(spark, out))
    assert back.columns == ["b", "c", "a"]
    assert sorted(cells(back)) == [("", "", 'say "hi"'), (" x ", "", "two\nlines")]
    files.write_csv(df.limit(0), f"{tmp_path}/none", ["a"])
    assert files.header_of(spark, files.list_files(spark, f"{tmp_path}/none")[0]) == ["a"]


def test_whole_texts_drop_bad_bytes(spark, tmp_path):
    save(tmp_path / "x" / "y", "a.txt", b"ab\xff\xfec\n")
    save(tmp_path / "x", "b.bin", b"no")
    assert [r.content for r in files.whole_texts(spark, str(tmp_path / "x")).collect()] == ["abc\n"]


def test_preview_and_spread(spark):
    assert files.preview(spark.range(5), 3).count() == 3
    assert files.spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 8
    wide = spark.range(0, 100, 1, 20)
    assert files.spread(wide) is wide


class Settings:
    """A session that only has settings."""

    def __init__(self, **values):
        self.conf = {k.replace("_", "."): v for k, v in values.items()}


def test_working_folder_is_the_sessions(spark):
    assert shared_folder(Settings(spark_checkpoint_dir="/shared/", spark_master="yarn")) == "/shared"
    for master in ("yarn", "local[2]", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_folder(Settings(spark_master=master))
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            ensure_workspace(Settings(spark_master=master))
    kept = written(spark.range(3), "t")
    assert kept.count() == 3 and f"{run_folder(spark)}/t-" in kept.inputFiles()[0]
    assert new_path(spark, "t") != new_path(spark, "t")
    with pytest.raises(AnalysisException):
        written(spark.range(3), "t", kept.inputFiles()[0].rsplit("/", 1)[0])


def test_intermediates_can_be_removed(spark, tmp_path):
    gone = written(spark.range(3), "t", str(tmp_path / "t"))
    assert gone.count() == 3
    remove(spark, str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()


# --- search


def slow_search(rows, terms):
    cleaned = [t.strip() for t in terms if t.strip()]
    by_digits = {re.sub(r"\D", "", t): t for t in cleaned}
    by_digits.pop("", None)
    out = []
    for n, row in enumerate(rows, start=2):
        hits = set()
        for cell in row:
            text = (cell or "").strip()
            digits = re.sub(r"\D", "", text)
            hits |= {t for t in cleaned if text and t in text}
            hits |= {t for d, t in by_digits.items() if d in digits}
        out += [(t, "f", "s", n, " | ".join(c or "" for c in row)) for t in sorted(hits)]
    return out


def test_search_against_definition(spark):
    rows = [("x4021y", "b", None), ("40-21", "B", " pad "), ("4", "021", ""), (None, None, None), ("a | b", "4,0", "21"),
            ("ab", "a", "b40 21c")]
    terms = ["INV-4021", "40-21", "4021", " b ", "", "a | b", "b40", "pad", "021"]
    df = spark.createDataFrame([(i + 2, *r) for i, r in enumerate(rows)], "n int, a string, b string, c string")
    got = search(df, terms, F.col("n"), "f", "s", ["a", "b", "c"])
    assert got.columns == RESULT
    assert sorted(cells(got)) == sorted(slow_search(rows, terms))


def test_later_term_owns_shared_digits():
    assert prepare_terms(["40-21", " 4021 ", "x"]) == [("40-21", ""), ("4021", "4021"), ("x", "")]


def test_search_needs_no_join_and_no_shuffle(spark, frame):
    plan = search(frame([("a", "b")], "a b"), ["a"], F.lit(2))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    with pytest.raises(ValueError):
        search(frame([("a", "b")], "a b"), [" "], F.lit(2))


# --- profiling


@pytest.fixture
def states(frame):
    return frame([("Found", "1"), (" found", "1 "), ("not FOUND", "2"), ("", None), (None, "")], "s k")


def test_profile(states):
    assert tuple(profile(states, "s", "k").first()) == (5, 2, 1, 3, 2)
    assert tuple(profile(states, "s", SKIP).first()) == (5, 2, 1, 0, 0)
    assert tuple(profile(states, "zz", "zz").first()) == (5, 0, 0, 0, 5)
    assert tuple(profile(states, "s", ENTIRE_ROW).first())[3:] == (5, 0)


def test_breakdown(states):
    assert cells(value_breakdown(states, "s")) == [
        ("BLANK", 2, "40.0%"), ("Found", 1, "20.0%"), ("found", 1, "20.0%"), ("not FOUND", 1, "20.0%")]


@pytest.mark.parametrize("exact", [False, True])
def test_summary_counts_nulls_as_equal_but_not_blank(frame, exact):
    df = frame([("a", None), (None, "a"), ("a", None), ("a", ""), (None, None)], "x y")
    assert tuple(table_summary(df, exact).first()) == (5, 2, 1, 5)


# --- unions


def test_union_order_and_gaps(frame):
    got = union_tables([("one", frame([("1", "2")], "a b")), ("two", frame([("3", "4")], "b c"))])
    assert got.columns == ["a", "b", "source_file", "c"]
    assert sorted(cells(got), key=str) == [("1", "2", "one", None), (None, "3", "two", "4")]
    with pytest.raises(ValueError):
        union_tables([("one", frame([("1",)], "a"))])


def test_union_folder(spark, tmp_path):
    folder = tmp_path / "u"
    save(folder, "b.csv", "b,c\n3,4\n")
    save(folder, "a.csv", "a,b\n1,2\n")
    save(folder, "d.csv", "a,b\n5,NA\n")
    save(folder, "empty.csv", "")
    got = union_folder(spark, str(folder))
    assert got.columns == ["a", "b", "source_file", "c"]
    assert sorted(cells(got), key=str) == [
        ("1", "2", "a.csv", None), ("5", None, "d.csv", None), (None, "3", "b.csv", "4")]
    with pytest.raises(ValueError):
        union_folder(spark, str(tmp_path / "none"))


def test_typed_rows_count_alike_by_fingerprint(spark):
    from datetime import datetime, timezone

    from rowmend.operators.profile import ENTIRE_ROW, profile, table_summary
    data = [(0.0, 1, "a"), (-0.0, 1, "a"), (float("nan"), 2, ""), (float("nan"), 2, ""), (None, 3, None), (None, 3, ""),
            (1.0, None, None), (1.0, None, None)]
    table = spark.createDataFrame(data, "x double, n int, s string")
    # The hour that repeats in New York at the end of summer time.
    hours = [(datetime(2023, 11, 5, h, 30, tzinfo=timezone.utc),) for h in (5, 6, 6)]
    times = spark.createDataFrame(hours, "t timestamp")
    nested = spark.createDataFrame([([],), ([None],), ([1],), ([1],)], "a array<int>")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for df, unique in ((table, 5), (times, 2), (nested, 3)):
            for exact in (False, True):
                assert profile(df, "absent", ENTIRE_ROW, exact).first()["unique_count"] == unique
                assert table_summary(df, exact).first()["duplicate_rows"] == df.count() - unique
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_minutes_go_beyond_an_integer(spark, monkeypatch):
    from datetime import datetime

    from rowmend.operators import prepare
    row = spark.sql("SELECT 3000000000L AS __minute, 'x' AS k")
    monkeypatch.setattr(prepare, "number_rows", lambda df, order, column, start: row)
    done = prepare.stagger_timestamps(row, ["k"], datetime(2024, 1, 1)).first()
    assert done["Initiation Date"] == "22-12-7727 08:00"


def test_whole_texts_keep_replacement_characters_and_name_hidden_files(spark, tmp_path):
    save(tmp_path / "x", "a.txt", "own �  mark".encode() + b"\xff\xc3 end")
    save(tmp_path / "x", "b.txt", "plain � ".encode())
    assert sorted(r.content for r in files.whole_texts(spark, str(tmp_path / "x")).collect()) == [
        "own �  mark end", "plain � "]
    save(tmp_path / "x", "_c.txt", b"lost")
    with pytest.raises(ValueError, match="_c.txt"):
        files.whole_texts(spark, str(tmp_path / "x"))


def test_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("1", "ä")], "a string, b string")
    files.write_csv(df.coalesce(1), str(tmp_path / "out"), ["a", "b", "c"], byte_order_mark=True)
    path = files.list_files(spark, str(tmp_path / "out"))[-1]
    with open(path.removeprefix("file:"), "rb") as file:
        assert file.read() == b'\xef\xbb\xbfa,b,c\n1,\xc3\xa4,\n'
    assert cells(files.csv_scan(spark, path)) == [("1", "ä", "")]
    assert files.csv_scan(spark, path).columns == ["a", "b", "c"]
