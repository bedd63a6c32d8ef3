"""Record preparation: ids, sequence times, dates, URL manifests and natural order."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmend.columns import contains_any, named
from rowmend.functions.dates import normal_date
from rowmend.functions.text import natural_key, safe_file_name, strip
from rowmend.operators.numbering import number_rows

# Length of an id and of the alphabet it is written in (0-9, A-Z).
ID_LENGTH, ID_RADIX = 25, 36
ID_CHUNKS = 5
# Headers that hold a date of birth, compared in upper case.
BIRTH_HEADERS = ("DOB", "DATE OF BIRTH")


def keyed_id(keys: Sequence[Column], salt: str = "") -> Column:
    """25 characters from a SHA-256 of the keys: equal keys give equal ids on every run.

    Each key is prefixed with its length, so `ab, c` and `a, bc` differ.
    """
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    framed = [x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]
    digest = F.sha2(F.concat(F.lit(salt), *framed), 256)
    width = ID_LENGTH // ID_CHUNKS

    def chunk(i: int) -> Column:
        number = F.conv(F.substring(digest, i * 12 + 1, 12), 16, 10).cast("long")
        return F.lpad(F.conv((number % ID_RADIX**width).cast("string"), 10, ID_RADIX), width, "0")

    return F.concat(*[chunk(i) for i in range(ID_CHUNKS)])


def assign_unique_id(df: DataFrame, keys: Sequence[str], column: str = "Unique ID",
                     salt: str = "") -> DataFrame:
    """Fill blank ids; ids already there are kept. `keys` must identify a row."""
    new = keyed_id([named(k) for k in keys], salt)
    if column not in df.columns:
        return df.withColumn(column, new)
    have = F.coalesce(named(column).cast("string"), F.lit(""))
    return df.withColumn(column, F.when(strip(have) == "", new).otherwise(have))


def repeated_ids(df: DataFrame, column: str = "Unique ID") -> DataFrame:
    """Ids borne by more than one row."""
    return df.groupBy(named(column).alias(column)).agg(F.count("*").alias("rows")).filter("rows > 1")


def stagger_timestamps(df: DataFrame, order_by: Sequence[Column | str], start: datetime,
                       column: str = "Initiation Date") -> DataFrame:
    """Start time plus one minute per row, in the given order, as `dd-MM-yyyy HH:mm`."""
    numbered = number_rows(df, order_by, column="__minute", start=0)
    first = F.lit(start).cast("timestamp_ntz")
    moment = F.timestamp_add("MINUTE", F.col("__minute"), first)
    return numbered.withColumn(column, F.date_format(moment, "dd-MM-yyyy HH:mm")).drop("__minute")


def normalise_birth_dates(df: DataFrame) -> DataFrame:
    """Rewrite the first date-of-birth column; text that is no date stays."""
    names = [c for c in df.columns if c.strip().upper() in BIRTH_HEADERS]
    return df.withColumn(names[0], normal_date(named(names[0]))) if names else df


def prepare_records(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str],
                    start: datetime) -> DataFrame:
    """Ids, sequence times and birth dates in one go."""
    return (
        df.transform(assign_unique_id, keys)
        .transform(normalise_birth_dates)
        .transform(stagger_timestamps, order_by, start)
    )


# Hosts of shared drives and the places a file id is found, in order.
DRIVE_HOSTS = ("drive.google.com", "docs.google.com")
DRIVE_ID_PATTERNS = (r"/file/d/([a-zA-Z0-9_-]+)", r"id=([a-zA-Z0-9_-]+)", r"/d/([a-zA-Z0-9_-]+)")
DEFAULT_EXTENSION = ".bin"


def drive_file_id(url: Column) -> Column:
    """File id of a shared-drive URL, '' when it has none; the `id` query key comes last."""
    ids = [F.regexp_extract(url, p, 1) for p in DRIVE_ID_PATTERNS]
    ids.append(F.try_url_decode(F.regexp_extract(url, r"[?&]id=([^&#]+)", 1)))
    return F.coalesce(*[F.nullif(i, F.lit("")) for i in ids], F.lit(""))


def url_extension(url: Column) -> Column:
    """Extension of the URL's path with its dot, `.bin` when there is none."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)
    extension = F.regexp_extract(path, r"[^/.][^/]*?(\.[^/.]*)$", 1)
    return F.when(extension == "", F.lit(DEFAULT_EXTENSION)).otherwise(extension)


def plan_url_manifest(df: DataFrame, url: str, name: str, row_index: Column, folder: str = "",
                      source_type: str = "Auto-Detect") -> DataFrame:
    """What a download run would fetch: row, url, name, status, path. Nothing is fetched.

    `row_index` counts data rows from 0; reported rows count the header too.
    """
    address = strip(F.coalesce(named(url).cast("string"), F.lit("")))
    given = named(name).cast("string")
    numbered = F.concat(F.lit("file_"), (row_index + 1).cast("string"))
    wanted = F.when(given.isNull(), numbered).otherwise(strip(given))
    rows = df.select(
        (row_index + 2).cast("long").alias("row"), address.alias("url"), wanted.alias("rename_value"))
    drive = {
        "Google Drive": F.lit(True), "Auto-Detect": contains_any(F.col("url"), DRIVE_HOSTS),
    }.get(source_type, F.lit(False))
    lost = drive & (drive_file_id(F.col("url")) == "")
    rows = rows.withColumn("status", F.when(F.col("url") == "", F.lit("skipped - empty url"))
                           .when(lost, F.lit("failed - Could not extract Google Drive file ID"))
                           .otherwise(F.lit("planned")))
    base = F.lit(folder.rstrip("/") + "/" if folder else "")
    path = F.concat(base, safe_file_name(F.col("rename_value")), url_extension(F.col("url")))
    return rows.withColumn("saved_path", F.when(F.col("status") == "planned", path).otherwise(F.lit("")))


def natural_sort(df: DataFrame, column: str, then_by: Sequence[str] = ()) -> DataFrame:
    """Total order in which `f2` comes before `f10`."""
    keyed = df.withColumn("__natural", natural_key(named(column)))
    return keyed.orderBy("__natural", *[named(c) for c in then_by]).drop("__natural")


def natural_position(df: DataFrame, column: str, then_by: Sequence[str] = (),
                     position: str = "position") -> DataFrame:
    """Rank of each row in natural order, from 1."""
    order = [natural_key(named(column)), *[named(c) for c in then_by]]
    return number_rows(df, order, column=position)
