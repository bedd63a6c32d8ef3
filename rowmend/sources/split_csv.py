"""CSV whose quoted fields may hold line breaks, read in as many tasks as the files have splits.

A split begins at some line, and whether that line begins a record is not known there. But what
a line does to the state is known for both states it may begin in, so each split is reduced to
a pair: how it ends if it began between records, how it ends if it began within quotes. A prefix
scan over the pairs of a file tells the state every split begins in. Then all splits cut their
lines into records at once; what crosses a border is a few fragments, joined afterwards. Only
lines with quotes take part in the first step, and when no quoted break is found anywhere, lines
are records and Spark's own scan does the rest.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowmend.sources.workspace import written

# States of splits up to this size are broadcast; more of them are joined by a shuffle.
BROADCAST_SPLITS = 1 << 18
SPLIT = ["file", "block"]


def ends_open(line: str, is_open: bool) -> bool:
    """Whether a line ends within quotes, if it begins within them or at the start of a record.

    A quote opens a field only as its first character; two within it stand for one.
    """
    at = 0
    while True:
        if is_open:
            at = line.find('"', at)
            while at >= 0 and line.startswith('"', at + 1):
                at = line.find('"', at + 2)
            if at < 0:
                return True
            at = line.find(",", at + 1)
            if at < 0:
                return False
            at += 1
        if line.startswith('"', at):
            at += 1
        else:
            at = line.find(',"', at)
            if at < 0:
                return False
            at += 2
        is_open = True


def header_names(record: str) -> list[str]:
    """Column names of a header record. Blank names are numbered, repeats get a suffix."""
    cells = next(csv.reader(io.StringIO(record.lstrip("﻿").rstrip("\r"), newline="")))
    names, seen = [], {}
    for i, cell in enumerate(cells):
        name = cell if cell else f"Unnamed: {i}"
        if name in seen:
            seen[name] += 1
            name = f"{name}.{seen[name]}"
        else:
            seen[name] = 0
        names.append(name)
    return names


def located_lines(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """(file, block, pos, line): physical lines with their split and their order within it."""
    text = spark.read.options(**options).text(paths, lineSep="\n")
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def reduced_splits(lines: DataFrame) -> DataFrame:
    """(file, block, from_closed, from_open, breaks) of the splits that hold quotes.

    `breaks` tells whether any line ends within quotes if the split begins between records.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, closed, opened, breaks = None, False, True, False

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (*place, closed, opened, breaks)],
                [*SPLIT, "from_closed", "from_open", "breaks"])

        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns)):
                if place != (file, block):
                    if place is not None:
                        yield out()
                    place, closed, opened, breaks = (file, block), False, True, False
                same = closed == opened
                closed = ends_open(line, closed)
                opened = closed if same else ends_open(line, opened)
                breaks = breaks or closed
        if place is not None:
            yield out()

    quoted = lines.where(F.contains("line", F.lit('"'))).select("file", "block", "line")
    return quoted.mapInArrow(run, "file string, block long, from_closed boolean, from_open boolean, breaks boolean")


def split_states(splits: DataFrame) -> DataFrame:
    """Append `starts_open`: a prefix scan over the splits of every file.

    A split that ends alike from both states sets the state; one that swaps them flips it; the
    rest leave it. So the state is the one set last, flipped as often as splits have since.
    """
    order = Window.partitionBy("file").orderBy("block")
    since = Window.partitionBy("file", "__set").orderBy("block")
    sets = F.col("from_closed") == F.col("from_open")
    flips = F.col("from_closed") & ~F.col("from_open")
    flipped = F.sum(flips.cast("long")).over(since) % 2
    base = F.first(F.when(sets, F.col("from_closed"))).over(since)
    after = F.coalesce(base, F.lit(False)) != (flipped == 1)
    return splits.withColumn("__set", F.count(F.when(sets, 1)).over(order)).withColumn("__after", after).withColumn(
        "starts_open", F.coalesce(F.lag("__after").over(order), F.lit(False))).drop("__set", "__after")


@dataclass(frozen=True)
class CsvIndex:
    """What one look at the files tells: a row per split, written, and whether any quoted break exists."""

    lines: DataFrame
    splits: DataFrame
    breaks: bool

    def headers(self) -> DataFrame:
        """(file, header): the first record of every file that has one, with quoted breaks whole."""
        first = self.splits.where("first_line IS NOT NULL AND block = 0").select("file", F.col("first_line").alias("header"))
        if not self.breaks:
            return first
        # Only headers that a quoted break cuts need more than the first line.
        cut = first.where(F.contains("header", F.lit('"')))
        whole = csv_records(self, self.lines.join(cut.select("file"), "file", "left_semi")).where("first")
        return first.join(cut, "file", "left_anti").unionByName(whole.select("file", F.col("record").alias("header")))


def csv_index(spark: SparkSession, paths: str | list[str], **options) -> CsvIndex:
    """Index CSV files by split: two scans whatever the number of files, and one row a split."""
    lines = located_lines(spark, paths, **options)
    filled = F.when(~F.col("line").isin("", "\r"), F.struct("pos", "line"))
    # A carriage return within a line is a quoted break that Spark's own scan would cut at.
    inner = F.instr("line", "\r").between(F.lit(1), F.length("line") - 1)
    all_splits = lines.groupBy(*SPLIT).agg(
        F.count("*").alias("n_lines"), F.min(filled)["line"].alias("first_line"), F.bool_or(inner).alias("returns"))
    known = all_splits.join(reduced_splits(lines), SPLIT, "left").withColumns({
        "from_closed": F.coalesce("from_closed", F.lit(False)), "from_open": F.coalesce("from_open", F.lit(True)),
        "breaks": F.coalesce("breaks", F.lit(False)) | F.col("returns")})
    splits = written(split_states(known), "csv-splits")
    return CsvIndex(lines, splits, bool(splits.where("breaks").take(1)))


RECORDS = "file string, block long, pos long, kind int, first boolean, record string"
WHOLE, CONTINUED, BEGUN = range(3)


def cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and border fragments of lines that come in order, split by split."""
    names = ["file", "block", "pos", "kind", "first", "record"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    place, is_open, kind, held, start, first = None, False, WHOLE, [], 0, False
    out: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def flush(as_kind: int) -> None:
        nonlocal held, first
        record = "\n".join(held)
        if as_kind != BEGUN and record.endswith("\r"):
            record = record[:-1]
        if record or as_kind != WHOLE:
            out.append((*place, start, as_kind, first, record.removeprefix("﻿") if first else record))
            first = False
        held = []

    for batch in batches:
        for file, block, pos, line, starts_open in zip(*(c.to_pylist() for c in batch.columns)):
            if place != (file, block):
                if held:
                    flush(CONTINUED if kind == CONTINUED else BEGUN)
                place, is_open, first = (file, block), starts_open, block == 0
                kind = CONTINUED if starts_open else WHOLE
            if not held:
                start = pos
            held.append(line)
            is_open = ends_open(line, is_open) if '"' in line else is_open
            if not is_open:
                flush(kind)
                kind = WHOLE
        if len(out) >= 1024:
            yield batch_of(out)
            out = []
    if held:
        flush(CONTINUED if kind == CONTINUED else BEGUN)
    if out:
        yield batch_of(out)


def csv_records(index: CsvIndex, lines: DataFrame | None = None) -> DataFrame:
    """(file, block, pos, first, record): records with their breaks, `first` for the header of a file.

    Blank lines between records are left out. A record is placed where it begins.
    """
    lines = index.lines if lines is None else lines
    states = index.splits.where("starts_open").select(*SPLIT, F.lit(True).alias("starts_open"))
    small = states.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    known = lines.join(F.broadcast(states) if small else states, SPLIT, "left").select(
        *SPLIT, "pos", "line", F.coalesce("starts_open", F.lit(False)).alias("starts_open"))
    # A shuffled join loses the order of lines; a broadcast one keeps it.
    ordered = known if small else known.sortWithinPartitions(*SPLIT, "pos")
    pieces = ordered.mapInArrow(cut_records, RECORDS)
    if not index.breaks:
        return pieces.drop("kind")
    # Fragments are at most two a split; each record that crosses a border begins a group.
    order = Window.partitionBy("file").orderBy("block", "kind", "pos")
    groups = pieces.where(F.col("kind") != WHOLE).withColumn(
        "group", F.count(F.when(F.col("kind") == BEGUN, 1)).over(order))
    part = F.array_sort(F.collect_list(F.struct("block", "kind", "record")))
    text = F.array_join(part["record"], "\n")
    joined = groups.groupBy("file", "group").agg(
        F.min(F.struct("block", "pos")).alias("at"), F.bool_or("first").alias("first"),
        F.regexp_replace(text, "\r$", "").alias("record"))
    return pieces.where(F.col("kind") == WHOLE).drop("kind").unionByName(
        joined.select("file", "at.block", "at.pos", "first", "record"))


def record_width(record: Column) -> Column:
    """Number of fields of a record; commas inside quotes do not count."""
    plain = F.regexp_replace(record, r'(^|,)"[^"]*+(?:""[^"]*+)*+"', "$1")
    return F.regexp_count(F.when(F.contains(record, F.lit('"')), plain).otherwise(record), F.lit(",")) + 1


def record_cells(record: Column, width: int) -> Column:
    """The first `width` fields of a record as an array, absent and empty ones null."""
    fields = ", ".join(f"c{i} string" for i in range(width))
    options = {"mode": "PERMISSIVE", "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    parsed = F.from_csv(record, F.lit(fields), options)
    return F.array(*[parsed[f"c{i}"] for i in range(width)])


def distinct_headers(index: CsvIndex) -> list[tuple[str, list[str]]]:
    """(header record, column names) in order of the first file with it: as many as headers differ."""
    found = index.headers().groupBy("header").agg(F.min("file").alias("file")).orderBy("file")
    return [(row["header"], header_names(row["header"])) for row in found.collect()]


def by_header(index: CsvIndex, shapes: list[tuple[str, list[str]]], columns: list[str]) -> DataFrame:
    """(file, cells): records of files of several headers, their cells in the order of `columns`.

    One scan for all headers: each file's header tells where in its records a column stands.
    """
    spark = index.lines.sparkSession
    places = [(header, len(names), [names.index(c) if c in names else None for c in columns]) for header, names in shapes]
    listed = spark.createDataFrame(places, "header string, width int, places array<int>")
    shaped = written(index.headers().join(F.broadcast(listed), "header").drop("header"), "csv-shapes")
    rows = csv_records(index).where(~F.col("first")).join(shaped, "file")
    fields = record_cells(F.col("record"), max(len(names) for _, names in shapes))
    kept = rows.where(record_width(F.col("record")) <= F.col("width")).select("file", "places", fields.alias("fields"))
    return kept.select("file", F.transform("places", lambda place: F.get("fields", place)).alias("cells"))


def absent_as(cell: Column, missing: Iterable[str], filler: Column) -> Column:
    return F.when(cell.isNull() | cell.isin(list(missing)), filler).otherwise(cell)
