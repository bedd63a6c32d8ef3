"""Base64 payloads in text to typed binary content. One narrow pass plus the naming step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmend.columns import computed_once, named
from rowmend.operators.lookup import BROADCAST_BYTES
from rowmend.operators.numbering import number_rows
from rowmend.sources.workspace import written

# Wrappers taken out of the text before decoding.
WRAPPERS = (
    '<img src="', "data:image/jpeg;base64,", "data:image/png;base64,", "data:application/pdf;base64,",
)
# First characters of an encoded file and the extension they stand for.
SIGNATURES = (("JVBERi0", ".pdf"), ("/9j/", ".jpg"), ("iVBORw0KGgo", ".png"))
OTHER = ".bin"


def bare_payload(content: Column) -> Column:
    """Text without wrappers and without anything outside the base64 alphabet.

    The slash of a closing tag belongs to the alphabet and stays.
    """
    text = reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), WRAPPERS, content)
    return F.regexp_replace(text, r"[^\p{Alnum}+/=]+", "")


def payload_extension(payload: Column) -> Column:
    kind = F.lit(OTHER)
    for start, extension in reversed(SIGNATURES):
        kind = F.when(F.startswith(payload, F.lit(start)), F.lit(extension)).otherwise(kind)
    return kind


def padded(payload: Column) -> Column:
    short = F.length(payload) % 4
    return F.when(short == 0, payload).otherwise(F.concat(payload, F.repeat(F.lit("="), 4 - short)))


def decode_payloads(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """`path`, `folder`, `ext`, decoded `content` and `error`; rows without payload are left out."""
    where = named(path)
    parent = F.regexp_extract(where, r"([^/]*)/[^/]*$", 1)
    texts = df.select(where.alias("path"), parent.alias("folder"), named(content).alias("__text"))
    payload = F.col("__payload")
    payloads = computed_once(texts, {"__payload": bare_payload(F.col("__text"))}).filter(payload != "")
    decoded = computed_once(payloads, {
        "ext": payload_extension(payload),
        "content": F.try_to_binary(padded(payload), F.lit("base64")),
    })
    failed = F.when(F.col("content").isNull(), F.lit("invalid base64")).otherwise(F.lit(""))
    return decoded.select("path", "folder", "ext", "content", failed.alias("error"))


ROW = ["__file", "__index"]


def unique_names(numbered: DataFrame) -> DataFrame:
    """Rows with `name`; where folders make the same name, the first path keeps it.

    The others count on past the numbers of their folder until their names are free.
    """
    suffix = F.when(F.col("__nth") == 0, F.lit("")).otherwise(
        F.concat(F.lit("_"), F.col("__nth").cast("string")))
    while True:
        named_rows = written(numbered.withColumn("name", F.concat("folder", suffix, "ext")), "names")
        first = F.min(F.struct("path", *ROW)).alias("first")
        taken = named_rows.groupBy("name").agg(first, F.count("*").alias("n")).where("n > 1")
        if taken.isEmpty():
            return named_rows
        last = named_rows.groupBy("folder", "ext").agg(F.max("__nth").alias("last"))
        moved = named_rows.join(taken, "name").where(F.struct("path", *ROW) != F.col("first"))
        moved = number_rows(moved.select("path", "folder", "ext", *ROW), ["path", *ROW], ["folder", "ext"],
                            column="__more", start=1)
        again = moved.join(last, ["folder", "ext"]).withColumn("__nth", F.col("last") + F.col("__more"))
        numbered = named_rows.drop("name").join(again.select(*ROW), ROW, "left_anti").unionByName(
            again.select("path", "folder", "ext", *ROW, "__nth"))


def name_payloads(decoded: DataFrame) -> DataFrame:
    """File names for decoded rows: the folder, then `_1`, `_2` ... in path order; no name twice.

    Numbers come from the distributed row numbering, so one folder may hold any share of
    the files. Payloads are decoded and written once; only paths are numbered, and the
    content joins back by its place in the written table, so a path may repeat.
    """
    good = written(decoded.filter(F.col("error") == ""), "payloads")
    placed = good.withColumns({ROW[0]: F.col("_metadata.file_path"), ROW[1]: F.col("_metadata.row_index")})
    numbered = number_rows(placed.select("path", "folder", "ext", *ROW), ["path", *ROW], ["folder", "ext"],
                           column="__nth", start=0)
    names = written(unique_names(numbered).select(*ROW, "name"), "names")
    size = names.agg(F.coalesce(F.sum(F.octet_length(ROW[0]) + F.octet_length("name") + 16), F.lit(0))).first()[0]
    # Names come to the contents, not contents to the names, as long as they fit a broadcast.
    near = F.broadcast(names) if size <= BROADCAST_BYTES else names
    return placed.join(near, ROW).select("path", "name", "ext", "content")
