import base64

import pytest
from pyspark.sql import functions as F

from rowmend.functions import document_rules as rules
from rowmend.operators import extract as X
from rowmend.operators.payload import decode_payloads, name_payloads

# --- payloads

JPG = b"\xff\xd8\xffpicture"
PDF = b"%PDF-1.4 text"
PNG = b"\x89PNG\r\n\x1a\n...."


def coded(data):
    return base64.b64encode(data).decode()


PAYLOADS = [
    ("/in/a/1.txt", '<img src="data:image/jpeg;base64,' + coded(JPG), ".jpg", JPG),
    ("/in/a/2.txt", "data:application/pdf;base64," + coded(PDF).rstrip("="), ".pdf", PDF),
    ("/in/a/3.txt", f" {coded(PDF)[:9]}\n\t{coded(PDF)[9:]} ", ".pdf", PDF),
    ("/in/b/4.txt", "data:image/png;base64," + coded(PNG), ".png", PNG),
    ("/in/b/5.txt", coded(b"plain"), ".bin", b"plain"),
    ("/in/b/6.txt", "abc=def", ".bin", None),
    ("/in/b/7.txt", "a", ".bin", None),
    ("/in/b/8.txt", " -- \n", None, None),
    ("/in/b/9.txt", '<img src="data:image/png;base64,' + coded(b"abc") + '" />', ".bin", b"abc" + b"\xff"),
]


def test_payloads(frame):
    got = {r.path: r for r in decode_payloads(frame([p[:2] for p in PAYLOADS], "path content")).collect()}
    for path, text, ext, content in PAYLOADS:
        if ext is None:
            assert path not in got
        elif path == "/in/b/9.txt":
            # The slash of the closing tag stays and makes a fifth character.
            assert got[path].content is None or got[path].content != b"abc"
        else:
            assert got[path].ext == ext
            assert got[path].content == content if content is None else bytes(got[path].content) == content
            assert (got[path].error == "") == (content is not None)


def test_payload_names(frame):
    done = name_payloads(decode_payloads(frame([p[:2] for p in PAYLOADS[:6]], "path content")))
    assert {r.path[-5]: r["name"] for r in done.collect()} == {
        "1": "a.jpg", "2": "a.pdf", "3": "a_1.pdf", "4": "b.png", "5": "b.bin"}


def test_encoding_and_decoding_cancel(spark):
    df = spark.range(300).select(
        F.concat(F.lit("/d/"), (F.col("id") % 7).cast("string"), F.lit("/"), "id", F.lit(".txt")).alias("path"),
        F.base64(F.encode(F.repeat(F.col("id").cast("string"), (F.col("id") % 9 + 1).cast("int")), "UTF-8")).alias("content"))
    rows = decode_payloads(df).collect()
    for r in rows:
        n = int(r.path.rsplit("/", 1)[1][:-4])
        assert bytes(r.content).decode() == str(n) * (n % 9 + 1)
    assert len(rows) == 300


# --- fields

EMPTY = dict.fromkeys(X.FIELDS, "") | {"Passing Status": "Unknown"}
GATE = "Marksheet of the semester\n"
PAGES = [
    ("Roll No: AB1234", {"Roll No": "AB1234"}),
    ("seat number - x 12/ 3", {"Roll No": "x 12/ 3"}),
    ("SEAT NO.\nA-77x", {"Roll No": "A-77x"}),
    ("Roll\nname\nroll no\nZ991", {"Roll No": "Z991"}),
    ("Roll: ab", {}),
    ("Candidate's Name: Ann Lee", {"Candidate Name": "Ann Lee"}),
    ("Mother name: Eva Paul\nName : Bo  Ray.", {"Candidate Name": "Bo Ray"}),
    ("Name: Tom\nTOM O HARA", {"Candidate Name": "TOM O HARA"}),
    ("UNIVERSITY EXAM\nRAVI KUMAR DAS DEV RAO\nRAVI K2\nRavi Das", {"University Name": "UNIVERSITY EXAM", "Candidate Name": ""}),
    ("University of Mysore\nState Board\nBoard of All Mysore", {"University Name": "University of Mysore"}),
    ("board ab\nBoard aa", {"University Name": "Board aa"}),
    ("University\nadmitted by the university of x\nVice chancellor, University", {}),
    ("Statement of marks for B.A. Examination held\nTrade: none", {"Course Name": "B.A"}),
    ("Trade: result\ndiscipline\nArt", {"Course Name": "Art"}),
    ("course\nxy\nProgramme\nFine Arts", {"Course Name": "Fine Arts"}),
    ("Year of Passing 2018\nsince 1956", {"Passing Year": "2018"}),
    ("since 1956\nYear of Passing 2018", {"Passing Year": "2018"}),
    ("since 1956, 12018 or 2199x", {"Passing Year": "1956"}),
    ("Study Centre: City College", {"Institute Name": "City College"}),
    ("centre: practical\n12\n34 Hill Academy", {"Institute Name": "Hill Academy"}),
    ("exam center\nnone\n9 North campus", {"Institute Name": "North campus"}),
    ("Result: Pass", {"Passing Status": "Pass"}), ("he qualified, fail", {"Passing Status": "Pass"}),
    ("passed or failed", {}), ("FAIL", {"Passing Status": "Fail"}), ("promoted", {"Passing Status": "Promoted"}),
    ("appeared", {"Passing Status": "Appeared"}), ("completed", {"Passing Status": "Completed"}),
    ("needs improvement, pass", {"Passing Status": "Needs Improvement"}),
]


@pytest.fixture(scope="module")
def page_report(spark):
    rows = [(str(i), GATE + text, 0.9) for i, (text, _) in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "name string, text string, confidence double")
    return {r["File Name"]: r for r in X.extract_fields(df, "name", "text", "confidence").collect()}


@pytest.mark.parametrize("i", range(len(PAGES)), ids=lambda i: PAGES[i][0][:25].replace("\n", "|"))
def test_fields(page_report, i):
    text, want = PAGES[i]
    row = page_report[str(i)].asDict()
    for field, value in want.items():
        assert row[field] == value
    if not want:
        assert {k: row[k] for k in EMPTY} == EMPTY


def test_text_and_lines(frame):
    df = frame([("a \t b\x00c\n\n\n\nd  ",), ("one | x\r\n--- Page 1\n\n  two\x0bthree | four |",)], "t")
    texts = [r.t for r in df.select(X.clean_text(F.col("t")).alias("t")).collect()]
    assert texts[0] == "a b c\n\nd"
    lines = [r.t for r in df.select(X.clean_lines(F.col("t")).alias("t")).collect()]
    assert lines[1] == ["one   x", "two", "three", "four"]


def test_gate(frame):
    df = frame([("only a SCHOOL",), ("school of Trade",), ("nothing",)], "t")
    assert [r.g for r in df.select(X.is_relevant(F.lower("t")).alias("g")).collect()] == [False, True, False]


def test_report_states(spark):
    rows = [("a", "  \n", 0.5), ("b", "some text", 0.5), ("c", "Marksheet result\nName: Ann Lee\n2001", 0.9),
            ("d", "Marksheet result\nName: Ann Lee\n2001", 0.7), ("e", None, None)]
    df = spark.createDataFrame(rows, "n string, t string, c double")
    report = X.extract_fields(df, "n", "t", "c")
    got = {r["File Name"]: r for r in report.collect()}
    assert report.columns == X.REPORT
    assert [got[k]["Extraction Mode"] for k in "abcde"] == ["none", "skipped", "smart_rules", "smart_rules", "none"]
    assert got["a"]["Status"] == "No text extracted" and got["b"]["Status"] == X.SKIPPED
    assert got["c"]["Confidence"] == 0.729 and not got["c"]["Review Required"]
    assert got["d"]["Confidence"] == 0.589 and got["d"]["Review Required"]
    assert tuple(X.review_count(report).first()) == (5, 4) and X.for_review(report).count() == 4


def test_payload_names_are_unique_and_keep_their_content(frame):
    import base64
    coded = lambda text: base64.b64encode(text.encode()).decode()
    rows = [("/in/a/x.txt", coded("one")), ("/in/a/x.txt", coded("two")), ("/in/a/y.txt", coded("six")),
            ("/in/a_1/z.txt", coded("ten")), ("/in/a_1/z.txt", coded("ten")), ("/in/a_3/q.txt", coded("odd"))]
    done = name_payloads(decode_payloads(frame(rows, "path content"))).collect()
    assert sorted((r["path"], bytes(r["content"]).decode()) for r in done) == sorted(
        (p, base64.b64decode(c).decode()) for p, c in rows)
    names = [r["name"] for r in done]
    assert len(set(names)) == len(rows) and {"a.bin", "a_1.bin", "a_2.bin"} <= {
        r["name"] for r in done if "/a/" in r["path"]}


def test_whole_text_is_read(frame):
    long = GATE + "x " * 10_000 + "\nYear of Passing 2018"
    df = frame([("a", long, "0.9")], "n t c")
    assert X.extract_fields(df, "n", "t", "c").first()["Passing Year"] == "2018"


def test_row_normalisation(frame):
    header = [*X.FIELDS, "Passing Status"]
    rows = [("in 2015.", "PASSED"), ("15", "he failed"), ("", "promotion"), ("", "so-so"), ("", "Fail"), ("", None)]
    df = frame([(y, s) for y, s in rows], "y s").select(
        *[F.lit(" :a  b. ").alias(f) if f != "Passing Year" else F.col("y").alias(f) for f in X.FIELDS],
        F.col("s").alias("Passing Status"))
    got = X.normalise_fields(df).select(header).collect()
    assert [r["Passing Status"] for r in got] == ["Pass", "Fail", "Promoted", "Unknown", "Fail", "Unknown"]
    assert [r["Passing Year"] for r in got] == ["2015", "", "", "", "", ""] and got[0]["Roll No"] == "a b"


def test_combined_confidence_is_clamped(spark):
    row = spark.range(1).select(
        X.combined_confidence(F.lit(0.9), F.lit(0.5)).alias("a"), X.combined_confidence(F.lit(2.0), F.lit(0.5)).alias("b"),
        X.combined_confidence(F.lit(-1.0), F.lit(None).cast("double")).alias("c")).first()
    assert tuple(row) == (0.78, 1.0, 0.0)


def test_every_pattern_starts_with_the_text_it_is_tested_for():
    patterns = [*rules.ROLL_PATTERNS, *rules.NAME_PATTERNS, *rules.COURSE_PATTERNS, *rules.INSTITUTE_PATTERNS]
    assert all(X.lead(p) for p in patterns)
    assert X.lead(rules.ROLL_PATTERNS[-1]) == "s.i.d." and X.lead(rules.NAME_PATTERNS[-1]) == "name"


def test_extraction_needs_no_shuffle_and_no_python(frame):
    df = X.for_review(X.extract_fields(frame([("a", "t", "1")], "n t c"), "n", "t", "c"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
