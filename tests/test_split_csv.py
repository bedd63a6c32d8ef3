"""CSV cut into records over many splits, against Python's reader of whole files."""

import csv
import io
import random
import uuid

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowmend.operators.union import union_folder
from rowmend.sources import files
from rowmend.sources.split_csv import csv_index, csv_records, ends_open


@pytest.fixture
def small_splits(spark):
    """Splits of some dozens of bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def written_as_csv(rows, path, end="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    path.write_bytes(out.getvalue().encode())


def drawn(seed, count, letters='ab,"\n', width=3):
    draw = random.Random(seed)
    return [[str(n), *("".join(draw.choice(letters) for _ in range(draw.randint(0, 10))) for _ in range(width - 1))]
            for n in range(count)]


def opens(text):
    """By single characters: whether a line that begins a record ends within quotes."""
    state = "start"
    for c in text:
        if state == "quoted":
            state = "maybe" if c == '"' else "quoted"
        elif state == "maybe":
            state = "quoted" if c == '"' else "start" if c == "," else "rest"
        elif c == ",":
            state = "start"
        else:
            state = "quoted" if state == "start" and c == '"' else "rest"
    return state == "quoted"


@given(st.text('a,"', max_size=14))
def test_state_of_a_line(line):
    assert ends_open(line, False) == opens(line)
    assert ends_open(line, True) == opens('"' + line)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_many_splits(small_splits, tmp_path, end):
    rows = [["key", "some\ntext", "more"], *drawn(1, 120, 'ab,"\n\r')]
    written_as_csv(rows, tmp_path / "a.csv", end)
    index = csv_index(small_splits, str(tmp_path))
    assert index.breaks and index.lines.rdd.getNumPartitions() > 20
    got = csv_records(index).orderBy("block", "pos").collect()
    assert [next(csv.reader(io.StringIO(r.record, newline=""))) for r in got] == rows
    assert [r.first for r in got] == [True] + [False] * 120


def test_scan_equals_the_one_task_scan(small_splits, tmp_path):
    rows = [["id", "a", "b"], *drawn(2, 100)]
    written_as_csv(rows, tmp_path / "a.csv")
    got = files.csv_scan(small_splits, str(tmp_path / "a.csv"), missing=())
    whole = small_splits.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "a.csv")).fillna("")
    assert got.columns == whole.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows[1:]))
    assert got.rdd.getNumPartitions() > 10


def test_a_field_over_many_splits_and_stray_quotes(small_splits, tmp_path):
    long = "\n".join(f'line {n}, "quoted"' for n in range(60))
    rows = [["id", "text"], ["1", "5\" pipe"], ["2", long], ["3", ""], ["4", "x\ny"], ["5", long]]
    written_as_csv(rows, tmp_path / "a.csv")
    with open(tmp_path / "a.csv", "a") as file:
        file.write('6,7" x 8" y\n7,"open to the end\nof the file')
    got = {r.id: r.text for r in files.csv_scan(small_splits, str(tmp_path / "a.csv")).collect()}
    assert got == {"1": '5" pipe', "2": long, "3": "", "4": "x\ny", "5": long, "6": '7" x 8" y',
                   "7": "open to the end\nof the file"}


def test_files_without_breaks_are_left_to_spark(small_splits, tmp_path):
    written_as_csv([["id", "a"], ["1", 'say "x", y'], ["2", "z"]], tmp_path / "a.csv")
    assert not csv_index(small_splits, str(tmp_path)).breaks
    got = files.csv_scan(small_splits, str(tmp_path / "a.csv"))
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == [("1", 'say "x", y'), ("2", "z")]


def test_short_long_blank_and_missing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,2\n3,4,5\n6\n\n"x\ny",NA\n7,8,\n"q""r","c,d"\n"p,q",1,2\n')
    got = sorted(map(tuple, files.csv_scan(spark, str(tmp_path / "a.csv")).collect()))
    assert got == [("1", "2"), ("6", ""), ('q"r', "c,d"), ("x\ny", "")]


def jobs_of(spark, action):
    """Number of jobs an action starts."""
    group = f"counted {uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_folder_of_files_with_breaks(small_splits, tmp_path):
    written_as_csv([["a", "b\nc"], ["1", "x\ny"], ["2", "z"]], tmp_path / "one file+.csv")
    written_as_csv([["d", "a"], ["p\nq", "3"]], tmp_path / "two.csv")
    written_as_csv([["a", "b\nc"], ["5", "NA"]], tmp_path / "zwei.csv")
    (tmp_path / "zz.csv").write_text("")
    got = union_folder(small_splits, str(tmp_path))
    assert got.columns == ["a", "b\nc", "source_file", "d"]
    assert sorted(map(tuple, got.collect())) == [
        ("1", "x\ny", "one file+.csv", None), ("2", "z", "one file+.csv", None), ("3", None, "two.csv", "p\nq"),
        ("5", None, "zwei.csv", None)]


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    counts = []
    for number in (3, 30):
        folder = tmp_path / str(number)
        folder.mkdir()
        for n in range(number):
            written_as_csv([["a", "b"] if n % 2 else ["b", "c"], [str(n), "x"]], folder / f"{n}.csv")
        counts.append(jobs_of(spark, lambda: files.files_by_header(spark, files.list_files(spark, str(folder)))))
    assert counts[0] == counts[1]


def test_headers_in_file_order(spark, tmp_path):
    for name, header in (("b", "x,y"), ("a", 'k,"l\nm",k'), ("c", "x,y")):
        (tmp_path / f"{name}.csv").write_text(f"{header}\n1,2,3\n")
    paths = files.list_files(spark, str(tmp_path))
    groups = files.files_by_header(spark, paths)
    assert list(groups) == [("k", "l\nm", "k.1"), ("x", "y")]
    assert [len(v) for v in groups.values()] == [1, 2]
    assert files.csv_scan(spark, groups[("x", "y")], ["x", "y"]).where(F.col("x") == "1").count() == 0
