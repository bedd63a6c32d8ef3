"""File scans and sinks: CSV in the all-string model, folders, whole texts, reports."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmend.columns import named, unique
from rowmend.sources.split_csv import (
    CsvIndex, absent_as, csv_index, csv_records, header_names, record_cells, record_width,
)

# Texts a CSV reader takes for a missing cell by default.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TABLE_ENDINGS = ("csv",)
CORRUPT = "__malformed_record"


def list_files(spark: SparkSession, folder: str, endings: Iterable[str] = TABLE_ENDINGS,
               recursive: bool = False) -> list[str]:
    """Paths in a folder by ending in either case, sorted by name. Only names are read.

    A folder that does not exist yields nothing. Spark's file sources pass over names that
    begin with `_` or `.`; such a table is named in an error, not left out in silence.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    wanted = tuple("." + e.lower() for e in endings)
    found, listing = [], files.listFiles(path, recursive)
    while listing.hasNext():
        name = listing.next().getPath()
        if name.getName().lower().endswith(wanted):
            found.append((name.toString(), name.getName()))
    hidden = sorted(n for _, n in found if n.startswith(("_", ".")))
    if hidden:
        raise ValueError(f"Spark cannot scan files whose names begin with '_' or '.': {hidden[:5]}")
    return sorted(p for p, _ in found)


def list_lookup_files(spark: SparkSession, folders: Iterable[str]) -> list[str]:
    """Lookup tables of several folders: folder order first, then file name."""
    return [path for folder in folders for path in list_files(spark, folder)]


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file. Blank names are numbered, repeats get a suffix.

    The header is the first record, which may hold quoted line breaks.
    """
    lines, wanted = spark.read.text(path, lineSep="\n"), 1
    while True:
        head = [row.value for row in lines.take(wanted)]
        text = "\n".join(head)
        if text.count('"') % 2 == 0 or len(head) < wanted:
            break
        wanted *= 8
    if not head:
        raise ValueError(f"no header in {path}")
    return header_names(text)


def plain_path(path: str) -> str:
    """A path without scheme and host, as both listings and file metadata name it."""
    return re.sub(r"^[^/:]+:(//[^/]*)?", "", path)


def files_by_header(spark: SparkSession, paths: list[str],
                    index: CsvIndex | None = None) -> dict[tuple[str, ...], list[str]]:
    """Group files by header in order of first appearance; files without one are left out.

    All headers come from one index, so the number of jobs does not grow with the files.
    """
    if not paths:
        return {}
    index = index or csv_index(spark, paths)
    found = {plain_path(unquote(row["file"])): row["header"] for row in index.headers().collect()}
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        header = found.get(plain_path(path))
        if header is not None:
            groups.setdefault(tuple(header_names(header)), []).append(path)
    return groups


def decoded_path(file: Column) -> Column:
    """A path of the metadata, where a plus sign stands for itself."""
    return F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))


def file_name(file: Column) -> Column:
    return decoded_path(F.regexp_extract(file, "[^/]*$", 0))


def place_of(file: Column, block: Column, pos: Column) -> Column:
    """Where a row stands: the file's path without scheme and host, its split, and its place there."""
    path = decoded_path(F.regexp_replace(file, r"^[^/:]+:(//[^/]*)?", ""))
    return F.struct(path.alias("path"), block.alias("block"), pos.alias("pos"))


def field_count(record: Column) -> Column:
    """Number of fields in a raw CSV record; commas inside quotes do not count."""
    return F.regexp_count(F.regexp_replace(record, r'"[^"]*+(?:""[^"]*+)*+"', ""), F.lit(",")) + 1


def csv_scan(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None,
             blank_nulls: bool = True, missing: Iterable[str] = MISSING_TEXTS,
             multi_line: bool = True, file_column: str | None = None,
             place_column: str | None = None) -> DataFrame:
    """All-string CSV scan: short rows are padded, over-long rows skipped.

    Records end in a line feed, with or without a carriage return. `multi_line` keeps quoted
    line breaks whole: the files are indexed by split first, and if there is such a break, all
    splits are cut into records in parallel. Without any, and with `multi_line` off, Spark's own
    scan reads the splits, and only records it flags as malformed have their fields counted.
    `place_column` tells where a row stands: file path, split and place within it.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    columns = columns or header_of(spark, paths[0])
    index = csv_index(spark, paths) if multi_line else None
    filler = F.lit("") if blank_nulls else F.lit(None).cast("string")
    if index is not None and index.breaks:
        rows = csv_records(index).where(~F.col("first"))
        kept = rows.where(record_width(F.col("record")) <= len(columns)).select(
            "file", "block", "pos", record_cells(F.col("record"), len(columns)).alias("cells"))
        out = [absent_as(F.col("cells")[i], missing, filler).alias(c) for i, c in enumerate(columns)]
        if file_column:
            out.append(file_name(F.col("file")).alias(file_column))
        if place_column:
            out.append(place_of(F.col("file"), F.col("block"), F.col("pos")).alias(place_column))
        return kept.select(out)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])
    raw = (
        spark.read.schema(schema)
        .options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, quote='"',
                 escape='"', encoding="UTF-8", enforceSchema=True, maxCharsPerColumn=-1, columnPruning=False)
        .csv(paths)
    )
    kept = raw.filter(named(CORRUPT).isNull() | (field_count(named(CORRUPT)) <= len(columns)))
    out = [absent_as(named(c), missing, filler).alias(c) for c in columns]
    if file_column:
        out.append(F.col("_metadata.file_name").alias(file_column))
    if place_column:
        out.append(place_of(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                            F.monotonically_increasing_id()).alias(place_column))
    return kept.select(out)


def smart_read(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV by ending; any other text ending is tried as CSV too."""
    try:
        return csv_scan(spark, path, blank_nulls=False, **options)
    except Exception as error:
        raise ValueError("Unsupported or corrupted file") from error


def spread(df: DataFrame) -> DataFrame:
    """One piece per core for costly row-wise work on an input that scans as fewer pieces.

    A small file of one row group is a single task otherwise. Inputs that already have as
    many scan tasks as the session has cores are returned unchanged, so large tables are
    never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def preview(df: DataFrame, rows: int = 1000, order_by: Iterable[str] = ()) -> DataFrame:
    """The first rows, in the given order or else any."""
    order = [named(c) for c in order_by]
    return (df.orderBy(order) if order else df).limit(rows)


def without_broken_bytes(text: Column) -> Column:
    """A text without the bytes that are no UTF-8; replacement characters of its own stay."""
    mark, own, broken = "\ue000", "\ue000\ue001", "\ufffd"
    kept = F.replace(F.replace(text, F.lit(mark), F.lit(own)), F.lit(broken), F.lit("\ue000\ue002"))
    valid = F.replace(F.make_valid_utf8(kept), F.lit(broken), F.lit(""))
    back = F.replace(F.replace(valid, F.lit("\ue000\ue002"), F.lit(broken)), F.lit(own), F.lit(mark))
    return F.when(F.is_valid_utf8(text), text).otherwise(back)


def whole_texts(spark: SparkSession, folder: str, ending: str = "txt") -> DataFrame:
    """One row per file, found recursively, undecodable bytes dropped: `path`, `content`.

    Names that Spark would pass over are an error, as for tables.
    """
    list_files(spark, folder, [ending], recursive=True)
    files = (
        spark.read.format("binaryFile")
        .options(pathGlobFilter=f"*.{ending}", recursiveFileLookup="true")
        .load(folder)
    )
    return files.select("path", without_broken_bytes(F.col("content").cast("string")).alias("content"))


def conform(df: DataFrame, headers: Iterable[str]) -> DataFrame:
    """Fixed column list: absent columns become '', others are dropped."""
    have = set(df.columns)
    return df.select([named(h) if h in have else F.lit("").alias(h) for h in unique(headers)])


def write_csv(df: DataFrame, path: str, headers: Iterable[str] | None = None, byte_order_mark: bool = False) -> None:
    """Write CSV files with headers; a byte-order mark, if wanted, begins each of them."""
    out = conform(df, headers) if headers is not None else df
    if byte_order_mark and out.columns:
        out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0])
    out.write.mode("errorifexists").options(
        header=True, quote='"', escape='"', emptyValue="", nullValue="", encoding="UTF-8",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_report(summary: DataFrame, path: str) -> None:
    """One-row (or few-row) summary as JSON."""
    summary.coalesce(1).write.mode("errorifexists").json(path)
