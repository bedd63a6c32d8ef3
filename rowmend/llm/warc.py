"""WARC archives: segmented records written, and reassembled when read back.

A record whose block is longer than a segment is written as a first record and continuations,
so no file need hold a long record whole. Reading groups the segments by the identifier of the
first, orders them by number, checks them for gaps and the total length, and decodes the
chunked transfer framing. Equal payloads are stored once; the others revisit that record.

Archives are plain WARC/1.1 files, gzip-compressed, written and read by Spark's own sources.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmend.llm.common import pick
from rowmend.sources.workspace import written

FILE_BYTES = 32 << 20
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
BREAK = b"\r\n"
RECORD_SCHEMA = ("record_id string, record_type string, page_id long, refers_to_record string, digest string,"
                 " origin string, segment int, total_length long, block binary")
PAGE_SCHEMA = ("record_id string, record_type string, page_id long, refers_to_record string, payload_bytes long,"
               " payload_digest string, payload binary, problem string")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at:at + size]
        parts += [b"%x" % len(piece), BREAK, piece, BREAK]
    return b"".join([*parts, b"0", BREAK, BREAK])


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; extensions and trailers are ignored, broken framing raises."""
    parts, at = [], 0
    while True:
        end = body.index(BREAK, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if at + size + 2 > len(body) or body[at + size:at + size + 2] != BREAK:
            raise ValueError("a chunk is cut short")
        parts.append(body[at:at + size])
        at += size + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without the two line breaks after it; fields without a value are left out."""
    lines = [f"{name}: {' '.join(str(value).split())}" for name, value in fields if value is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + BREAK + BREAK + block


def record_parts(row: dict, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a response, cut into segments where it is long, or a revisit."""
    payload = (row["html"] or "").encode()
    target = "urn:uuid:" + row["record_id"] if row["url"] is None else row["url"]
    fields = [("WARC-Type", "revisit" if row["refers_to"] else "response"), ("WARC-Record-ID", uri(row["record_id"])),
              ("WARC-Date", DATE), ("WARC-Target-URI", target), ("Page-ID", row["page_id"]),
              ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)), ("Content-Type", "application/http; msgtype=response")]
    if row["refers_to"]:
        block = HTTP_HEAD + b"Content-Length: %d" % len(payload) + BREAK + BREAK
        yield record([*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", uri(row["refers_to"]))], block)
        return
    block = HTTP_HEAD + b"Transfer-Encoding: chunked" + BREAK + BREAK + chunked(payload)
    if len(block) <= segment_bytes:
        yield record(fields, block)
        return
    yield record([*fields, ("WARC-Segment-Number", 1)], block[:segment_bytes])
    for number, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        last = len(block) if at + segment_bytes >= len(block) else None
        own = hashlib.md5(f"{row['record_id']} {number}".encode()).hexdigest()
        yield record(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", uri(own)), ("WARC-Date", DATE),
             ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", uri(row["record_id"])),
             ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", last)], block[at:at + segment_bytes])


def uri(digits: str) -> str:
    return f"<urn:uuid:{digits[:8]}-{digits[8:12]}-{digits[12:16]}-{digits[16:20]}-{digits[20:]}>"


def with_references(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Append record_id and refers_to: the record of the smallest id among equal payloads, if another."""
    row = F.monotonically_increasing_id()
    payload = F.coalesce("html", F.lit("")).cast("binary")
    marked = pages.withColumns({
        "row": row, "size": F.octet_length(payload).cast("long"), "sha": F.sha2(payload, 256)})
    marked = marked.withColumn("record_id", F.md5(F.concat_ws(" ", "row", "page_id", "sha").cast("binary")))
    # Rows without an id come last, and the record id settles ties.
    order = F.struct(F.col("page_id").isNull(), "page_id", "record_id")
    # Only payloads met more than once are looked up; written, for their number decides how they are joined.
    first = marked.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(
        F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = marked.join(written(first, "repeated"), ["sha", "size"], "left")
    other = F.col("first.record_id") != F.col("record_id")
    return joined.select("record_id", "page_id", "url", "html", "size", F.when(other, F.col("first.record_id")).alias("refers_to"))


def write_warc(df: DataFrame, path: str, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
               file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> None:
    """Archive the pages of a table under a folder, in files of about `file_bytes` before compression.

    Of equal payloads of at least `least_bytes` the row with the smallest id is a response and
    the others revisit it; of repeated rows one is the response. A null html is an empty
    payload. A null id is left out and never preferred; a null url is replaced by the record
    id. Other columns are not read; an empty table writes no record. The table must give the
    same rows whenever it is read.
    """
    pages = pick(df, page_id=id_col, url=url_col, html=html_col)
    whole = pages.agg(F.sum(F.octet_length("html") + F.lit(1000)), F.count("*")).first()
    files = max(1, math.ceil((whole[0] or 0) / file_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                parts = [p for row in batch.slice(at, 128).to_pylist() for p in record_parts(row, segment_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["record"])

    records = with_references(pages, least_bytes).mapInArrow(run, "record binary")
    # A record is written as the bytes it is: the text writer only adds what separates records.
    records.repartition(files, F.xxhash64("record")).select(F.col("record").cast("string").alias("value")).write.option(
        "lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def inflated(content: bytes) -> bytes:
    """Contents of a file of one or more gzip members, or of a plain one."""
    parts = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content))
        content = member.unused_data
    return b"".join(parts) if parts else content


FIELD = re.compile(rb"(?m)^([^:\r\n]+):[ \t]*(.*?)[ \t]*\r?$")


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of every record of a file."""
    at = 0
    while True:
        at = content.find(b"WARC/", at)
        if at < 0:
            return
        end = content.index(b"\r\n\r\n", at)
        fields = {k.decode().lower(): v.decode() for k, v in FIELD.findall(content[at:end])}
        size = int(fields["content-length"])
        if end + 4 + size > len(content):
            raise ValueError("a record is cut short")
        yield fields, content[end + 4:end + 4 + size]
        at = end + 4 + size


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record under a folder, segments apart."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()),
                            ("refers_to_record", pa.string()), ("digest", pa.string()), ("origin", pa.string()),
                            ("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary())])
        number = lambda text: None if text is None else int(text)
        for batch in batches:
            for file in batch.column(0):
                rows, held = [], 0
                for f, block in parsed(inflated(file.as_py())):
                    rows.append({
                        "record_id": f.get("warc-record-id"), "record_type": f.get("warc-type"),
                        "page_id": number(f.get("page-id")), "refers_to_record": f.get("warc-refers-to"),
                        "digest": f.get("warc-payload-digest"), "origin": f.get("warc-segment-origin-id"),
                        "segment": number(f.get("warc-segment-number")),
                        "total_length": number(f.get("warc-segment-total-length")), "block": block})
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, RECORD_SCHEMA)


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records: (record_id, record_type, page_id, refers_to_record, digest, blocks, problem).

    Only segments are shuffled. A group holds the segments of one record, whose parts are
    sorted by number; a gap, a repeated number, a missing first or last segment or another
    total length than announced is named in `problem`.
    """
    whole = records.where("segment IS NULL").select(
        "record_id", "record_type", "page_id", "refers_to_record", "digest", F.array("block").alias("blocks"),
        F.lit(None).cast("string").alias("problem"))
    first = F.col("segment") == 1
    key = F.when(first, F.col("record_id")).otherwise(F.col("origin"))
    only = lambda name: F.max(F.when(first, F.col(name))).alias(name)
    parts = F.sort_array(F.collect_list(F.struct("segment", "block")))
    grouped = records.where("segment IS NOT NULL").groupBy(key.alias("record_key")).agg(
        *[only(c) for c in ("record_type", "page_id", "refers_to_record", "digest")], parts.alias("parts"),
        F.max("total_length").alias("total"))
    numbers = F.transform("parts", lambda p: p["segment"])
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    problem = F.when(numbers != F.sequence(F.lit(1), F.size("parts")), "segments are missing or repeated").when(
        F.col("total").isNull(), "the last segment is missing").when(length != F.col("total"), "the total length differs")
    return whole.unionByName(grouped.select(
        F.col("record_key").alias("record_id"), "record_type", "page_id", "refers_to_record", "digest",
        F.transform("parts", lambda p: p["block"]).alias("blocks"), problem.alias("problem")))


def payload_of(block: bytes) -> tuple[int | None, bytes]:
    """(announced length, payload) of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.decode().lower(): v.decode().lower() for k, v in FIELD.findall(head)}
    if "chunked" in fields.get("transfer-encoding", ""):
        body = dechunked(body)
    return (int(fields["content-length"]) if "content-length" in fields else None), body


def decoded(records: DataFrame) -> DataFrame:
    """Payloads of whole records, checked against their digests; what fails names its problem."""
    names = [f.split()[0] for f in PAGE_SCHEMA.split(", ")]

    def page(row: dict) -> dict:
        found = {k: row[k] for k in names if k in row}
        if row["record_type"] == "revisit":
            announced, _ = payload_of(b"".join(row["blocks"]))
            return found | {"payload_bytes": announced, "payload_digest": (row["digest"] or "").removeprefix("sha1:") or None}
        if row["problem"] is None:
            try:
                _, payload = payload_of(b"".join(row["blocks"]))
            except ValueError:
                return found | {"problem": "broken chunks"}
            digest = sha1_base32(payload)
            found |= {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload}
            if row["digest"] is not None and row["digest"].removeprefix("sha1:") != digest:
                found["problem"] = "the digest differs"
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = [page(row) for row in batch.slice(at, 128).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.get(name) for row in rows], kind) for name, kind in zip(names, kinds)], names)

    pages = records.where(F.col("record_type").isin("response", "revisit", "resource") | F.col("record_type").isNull())
    return pages.mapInArrow(run, PAGE_SCHEMA)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the archives under a folder, with whole payloads and a `problem` where one was found.

    `refers_to` is the page id of the record that a revisit refers to. Revisits have the size
    and digest their record announces, and no payload. An empty folder gives no rows.
    """
    pages = written(decoded(reassembled(read_records(spark, path))), "pages")
    targets = pages.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    return pages.join(targets, "refers_to_record", "left").drop("refers_to_record")
