"""Union of tables and folders by column name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmend.columns import named, unique
from rowmend.sources.files import MISSING_TEXTS, csv_scan, file_name, files_by_header, list_files
from rowmend.sources.split_csv import absent_as, by_header, csv_index, distinct_headers

SOURCE = "source_file"


def union_tables(tables: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Stack named tables; columns in order of first appearance, gaps null.

    `source_file` follows the first table's columns.
    """
    if len(tables) < 2:
        raise ValueError("need at least two tables to merge")
    tagged = [df.withColumn(SOURCE, F.lit(name)) for name, df in tables]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    order = unique(c for df in tagged for c in df.columns)
    return out.select([named(c) for c in order])


def union_folder(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame:
    """All CSV files of a folder under one header.

    The files are indexed first. If a field holds a line break, all of them are cut into records
    by one scan, and each file's header tells where its columns stand; else files that share a
    header are one scan. The plan grows with the number of distinct headers, not of files. Files
    without a header are left out.
    """
    paths = list_files(spark, folder)
    if len(paths) < 2:
        raise ValueError("need at least two files to merge")
    index = csv_index(spark, paths) if multi_line else None
    if index is not None and index.breaks:
        shapes = distinct_headers(index)
        columns = unique(c for _, names in shapes for c in names)
        rows = by_header(index, shapes, columns)
        cells = [absent_as(F.col("cells")[i], MISSING_TEXTS, F.lit(None)).alias(c) for i, c in enumerate(columns)]
        # The file follows the first header's columns.
        order = unique([*shapes[0][1], SOURCE, *columns])
        return rows.select(*cells, file_name(F.col("file")).alias(SOURCE)).select([named(c) for c in order])
    groups = files_by_header(spark, paths, index)
    if not groups:
        raise ValueError("no valid files could be loaded")
    order = unique(c for header in groups for c in (*header, SOURCE))
    out = None
    for header, members in groups.items():
        part = csv_scan(spark, members, list(header), blank_nulls=False, multi_line=False, file_column=SOURCE)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select([named(c) for c in order])
