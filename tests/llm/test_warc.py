"""WARC round trips and broken archives."""

import base64
import gzip
import hashlib

import pytest

from rowmend.llm.warc import (
    chunked, dechunked, decoded, inflated, parsed, read_records, read_warc, reassembled, record, write_warc)

SCHEMA = "page_id long, url string, html string, record_id string, size long, row string"


def pages(rows, data):
    return rows([(*d, "r", 1, "x") for d in data], SCHEMA)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("segment", [64, 1 << 14])
def test_round_trip(rows, tmp_path, spark, segment):
    awkward = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n0\r\n\r\n é\x00\n"
    html = ["", None, "x", "same" * 300, awkward, "y" * 9000, "same" * 300, "x", "", "same" * 300]
    data = [(90 - i, None if i == 4 else f"http://h/{i}\nq", h) for i, h in enumerate(html)]
    write_warc(pages(rows, data), str(tmp_path / "w"), segment_bytes=segment, file_bytes=4000)
    got = {r["page_id"]: r for r in read_warc(spark, str(tmp_path / "w")).collect()}
    first = {}
    for i, _, h in sorted(data):
        first.setdefault(h or "", i)
    assert len(got) == len(data) and all(r["problem"] is None for r in got.values())
    for i, _, h in data:
        row, own = got[i], first[h or ""]
        assert (row["payload_bytes"], row["payload_digest"]) == (len((h or "").encode()), digest(h))
        assert row["record_type"] == ("response" if own == i else "revisit")
        assert row["refers_to"] == (None if own == i else own)
        assert own != i or bytes(row["payload"]) == (h or "").encode()


def test_small_payloads_repeated_rows_and_no_ids(rows, tmp_path, spark, no_rows):
    data = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (3, "u", "abcdef"), (None, "u", "abcdef"), (None, "u", "only")]
    write_warc(pages(rows, data), str(tmp_path / "w"), least_bytes=3)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"])
                  for r in read_warc(spark, str(tmp_path / "w")).collect()), key=str)
    assert got == sorted([(1, "response", None, 2), (2, "response", None, 2), (3, "response", None, 6), (3, "revisit", 3, 6),
                          (None, "revisit", 3, 6), (None, "response", None, 4)], key=str)
    write_warc(no_rows(pages(rows, data)), str(tmp_path / "none"))
    assert read_warc(spark, str(tmp_path / "none")).count() == 0


def test_files_are_plain_warc(rows, tmp_path):
    write_warc(pages(rows, [(i, "http://h/", f"page {i} " * 400) for i in range(9)]), str(tmp_path / "w"), segment_bytes=700, file_bytes=9000)
    files = list((tmp_path / "w").glob("*.gz"))
    found = [r for f in files for r in parsed(gzip.decompress(f.read_bytes()))]
    assert len(files) > 1
    kinds = [f["warc-type"] for f, _ in found]
    assert kinds.count("response") == 9 and kinds.count("continuation") > 9
    for fields, block in found:
        assert len(block) == int(fields["content-length"]) <= 700
        assert fields["warc-record-id"].startswith("<urn:uuid:") and fields["warc-date"]


def segments(parts, total, numbers=None, first_id="<a>"):
    for at, part in enumerate(parts):
        number = numbers[at] if numbers else at + 1
        yield (first_id if number == 1 else f"<{first_id}{number}>", "response" if number == 1 else "continuation", 7, None, None,
               None if number == 1 else first_id, number, total if at == len(parts) - 1 else None, part)


def test_broken_segments_are_named(rows):
    head = b"HTTP/1.1 200 OK\r\n\r\n"
    whole = head + b"hello world"
    n = len(whole)
    data = [*segments([whole[20:], whole[:20]], n, [2, 1], "ok"), *segments([whole[:20]], n, [1], "short"),
            *segments([whole[20:]], n, [2], "headless"), *segments([whole[:20], whole[20:]], n, [1, 3], "gap"),
            *segments([whole[:20], whole[20:]], None, first_id="open"), *segments([whole[:20], whole[20:], b"x"], n, first_id="long")]
    schema = ("record_id string, record_type string, page_id long, refers_to_record string, digest string, origin string,"
              " segment int, total_length long, block binary")
    got = {r["record_id"]: r for r in decoded(reassembled(rows(data, schema))).collect()}
    assert bytes(got["ok"]["payload"]) == b"hello world" and got["ok"]["problem"] is None
    assert {k: r["problem"] for k, r in got.items() if k != "ok"} == {
        "short": "the total length differs", "headless": "segments are missing or repeated",
        "gap": "segments are missing or repeated", "open": "the last segment is missing", "long": "the total length differs"}
    bad = [("r", "response", 1, None, "sha1:AAAA", None, None, None, head + b"x"),
           ("c", "response", 2, None, None, None, None, None, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab")]
    assert {r["record_id"]: r["problem"] for r in decoded(reassembled(rows(bad, schema))).collect()} == {
        "r": "the digest differs", "c": "broken chunks"}


def test_framing():
    for payload in (b"", b"a", b"\r\n0\r\n\r\n" * 900):
        assert dechunked(chunked(payload, 100)) == payload
    assert dechunked(b"2;x=y\r\nab\r\n0\r\nTrailer: t\r\n\r\n") == b"ab"
    for broken in (b"2\r\nab", b"zz\r\n", b"5\r\nab\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            dechunked(broken)
    assert inflated(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab" and inflated(b"plain") == b"plain"
    assert b"X: a b\r\n" in record([("X", "a\r\nb"), ("Y", None)], b"") and b"Y:" not in record([("Y", None)], b"")


def test_foreign_archives(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(
        [("WARC-Type", kind), ("WARC-Record-ID", f"<{kind}>")], block) + b"\r\n\r\n") for kind, block in (
            ("warcinfo", b"software: x"), ("response", b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"), ("request", b"GET /"))))
    assert read_records(spark, str(tmp_path)).count() == 3
    got = read_warc(spark, str(tmp_path)).collect()
    assert [(r["record_type"], bytes(r["payload"]), r["page_id"]) for r in got] == [("response", b"hi", None)]
