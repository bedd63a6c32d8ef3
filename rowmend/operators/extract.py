"""Rule-based fields from document text.

Input is a table of texts with a reading confidence. Each document is handled in its own
row with array and pattern functions, so there is no shuffle; lines are split once, and
only for documents that pass the relevance test.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmend.columns import computed_once, contains_any, first_item, literal_array, named
from rowmend.functions import document_rules as rules
from rowmend.functions.text import BLANK, LINE_BREAK, NON_BLANK, WIDE, strip

REPORT = [
    "File Name", "Roll No", "University Name", "Course Name", "Passing Year", "Candidate Name",
    "Passing Status", "Institute Name", "Confidence", "OCR Confidence", "Status",
    "Extraction Mode", "Review Required",
]
FIELDS = ["Roll No", "University Name", "Course Name", "Passing Year", "Candidate Name", "Institute Name"]
SKIPPED = "Skipped: not an education document"


def clean_text(c: Column) -> Column:
    """NUL to blank, runs of blanks and tabs to one blank, at most one empty line in a row."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x00 \\t]+", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def is_relevant(text: Column) -> Column:
    """Whether enough of the telling words occur; `text` is in lower case already."""
    hits = F.filter(literal_array(rules.RELEVANT_WORDS), lambda word: F.contains(text, word))
    return F.size(hits) >= rules.RELEVANT_MINIMUM


@dataclass(frozen=True)
class Lines:
    """Parallel arrays over a document's lines, computed once for all detectors."""

    line: Column
    low: Column
    folded: Column
    value: Column


def clean_lines(text: Column) -> Column:
    """Lines without bars and blank ones, page marks left out."""
    bare = F.regexp_replace(F.regexp_replace(text, "[\\x00 \\t]+", " "), r"[|]+", " ")
    lines = F.transform(F.split(bare, LINE_BREAK), strip)
    return F.filter(lines, lambda line: (line != "") & ~F.startswith(line, F.lit(rules.PAGE_MARK)))


def clean_value(c: Column) -> Column:
    text = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), f"{WIDE}{BLANK}{{2,}}", " ")
    return F.btrim(text, F.lit(rules.VALUE_EDGES))


def line_arrays(lines: Column) -> dict[str, Column]:
    return {
        "__low": F.transform(lines, F.lower),
        # Folding both ways also brings together letters a caseless pattern equates.
        "__folded": F.transform(lines, lambda line: F.lower(F.upper(line))),
        "__value": F.transform(lines, clean_value),
    }


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"{WIDE}{NON_BLANK}+"))


def lead(pattern: str) -> str:
    """Literal text a pattern starts with; a line without it cannot match."""
    return re.match(r"\^?((?:[a-z ]|\\\.)+)", pattern).group(1).replace("\\.", ".").strip()


def first_match(lines: Lines, patterns: Iterable[str], excluded: Iterable[str] = ()) -> Column:
    """First non-empty cleaned group: lines in order, within a line patterns in order.

    A plain substring test comes before each pattern, so most lines run none.
    """
    patterns, excluded = tuple(patterns), tuple(excluded)

    def in_line(line: Column, i: Column) -> Column:
        folded, low = F.get(lines.folded, i), F.get(lines.low, i)
        groups = [
            F.when(F.contains(folded, F.lit(lead(p))),
                   F.nullif(clean_value(F.regexp_extract(line, f"(?iU){p}", 1)), F.lit("")))
            for p in patterns
        ]
        found = F.coalesce(*groups)
        return F.when(~contains_any(low, excluded), found) if excluded else found

    return first_item(F.array_compact(F.transform(lines.line, in_line)))


def like_name(value: Column) -> Column:
    return (
        (word_count(value) >= 2) & ~value.rlike(r"\p{Nd}")
        & ~F.lower(value).rlike(any_word(rules.NAME_REJECTS))
    )


def like_roll(value: Column) -> Column:
    return (F.length(value) >= 4) & value.rlike("[A-Za-z0-9]") & ~F.lower(value).isin(*rules.ROLL_REJECTS)


def like_institute(value: Column) -> Column:
    return F.lower(value).rlike(any_word(rules.INSTITUTE_WORDS))


def any_word(words: Iterable[str]) -> str:
    """Pattern for any of the texts; tests an inner value without evaluating it per word."""
    return "|".join(re.escape(w) for w in words)


def next_line(lines: Lines, headings: Iterable[str], accept) -> Column:
    """Cleaned line below the first heading line whose follower is accepted."""
    followers = F.transform(
        lines.low, lambda low, i: F.when(low.isin(*headings), F.get(lines.value, i + 1)))
    return first_item(F.filter(F.array_compact(followers), lambda v: (v != "") & accept(v)))


def labelled_values(lines: Lines) -> dict[str, Column]:
    """What stands behind a label, before it is judged."""
    return {
        "__roll": first_match(lines, rules.ROLL_PATTERNS),
        "__name": first_match(lines, rules.NAME_PATTERNS, rules.NAME_LINE_EXCLUDES),
        "__course": first_match(lines, rules.COURSE_PATTERNS),
        "__institute": first_match(lines, rules.INSTITUTE_PATTERNS),
    }


def roll_number(labelled: Column, lines: Lines) -> Column:
    return F.when(like_roll(labelled), labelled).otherwise(next_line(lines, rules.ROLL_HEADINGS, like_roll))


def candidate_name(labelled: Column, lines: Lines) -> Column:
    """Labelled name, else the first short line in capitals that reads like a name."""
    short = f"{WIDE}^{NON_BLANK}+(?:{BLANK}+{NON_BLANK}+){{1,3}}{BLANK}*$"

    def in_capitals(value: Column) -> Column:
        letters = F.greatest(F.regexp_count(value, F.lit(r"\p{L}")), F.lit(1))
        capitals = F.regexp_count(value, F.lit(r"\p{Lu}"))
        return (
            value.rlike(short) & like_name(value) & (capitals / letters > 0.8)
            & ~F.lower(value).rlike(any_word(rules.NAME_LINE_REJECTS))
        )

    return F.when(like_name(labelled), labelled).otherwise(
        first_item(F.filter(lines.value, in_capitals)))


def university_name(lines: Lines) -> Column:
    """Longest suitable line, the alphabetically first among equals."""
    def ranked(low: Column, i: Column) -> Column:
        value = F.get(lines.value, i)
        suitable = (
            contains_any(low, rules.UNIVERSITY_WORDS) & ~contains_any(low, rules.UNIVERSITY_REJECTS)
            & word_count(value).between(2, 10)
        )
        return F.when(suitable, F.struct((-F.length(value)).alias("rank"), value.alias("name")))

    return F.coalesce(F.array_min(F.transform(lines.low, ranked))["name"], F.lit(""))


def course_name(labelled: Column, lines: Lines) -> Column:
    usable = (labelled != "") & ~F.lower(labelled).isin(*rules.COURSE_REJECTS)
    return F.when(usable, labelled).otherwise(
        next_line(lines, rules.COURSE_HEADINGS, lambda v: F.length(v) > 2))


def institute_name(labelled: Column, lines: Lines) -> Column:
    """Labelled institute, else one of the two lines below a heading, numbering removed."""
    usable = like_institute(labelled) & ~F.lower(labelled).isin(*rules.INSTITUTE_REJECTS)

    def below(low: Column, i: Column) -> Column:
        found = [F.regexp_replace(F.get(lines.value, i + k), r"(?U)^\d+\s*", "") for k in (1, 2)]
        return F.when(contains_any(low, rules.INSTITUTE_HEADINGS), F.array_compact(F.array(*found)))

    candidates = F.flatten(F.array_compact(F.transform(lines.low, below)))
    return F.when(usable, labelled).otherwise(first_item(F.filter(candidates, like_institute)))


def passing_status(blob: Column) -> Column:
    """Status by the first rule that fits; `blob` is all lines in lower case as one text."""
    out = F.lit("Unknown")
    for status, pattern in reversed(rules.STATUS_RULES):
        out = F.when(blob.rlike(f"(?U){pattern}"), F.lit(status)).otherwise(out)
    return out


def year_in(c: Column) -> Column:
    return F.regexp_extract(c, f"(?U){rules.YEAR_PATTERN}", 1)


def passing_year(lines: Lines) -> Column:
    """First year in a line that speaks of results, else the first year anywhere."""
    preferred = F.filter(
        lines.line, lambda line, i: contains_any(F.get(lines.low, i), rules.YEAR_LINE_WORDS))
    first = F.nullif(year_in(F.array_join(preferred, "\n")), F.lit(""))
    return F.coalesce(first, year_in(F.array_join(lines.line, "\n")))


def normal_status(c: Column) -> Column:
    low = F.lower(c)
    out = F.lit("Unknown")
    for status, stems in reversed(rules.STATUS_STEMS):
        out = F.when(contains_any(low, stems), F.lit(status)).otherwise(out)
    return F.when(c.isin(*rules.STATUSES), c).otherwise(out)


def normalise_fields(df: DataFrame) -> DataFrame:
    """Final form of a row's fields: bare year, known status, trimmed values."""
    cleaned = {c: clean_value(named(c)) for c in FIELDS if c != "Passing Year"}
    return df.withColumns(cleaned | {
        "Passing Year": year_in(F.coalesce(named("Passing Year"), F.lit(""))),
        "Passing Status": normal_status(strip(F.coalesce(named("Passing Status"), F.lit("Unknown")))),
    })


def field_confidence(fields: Iterable[str] = FIELDS) -> Column:
    filled = sum((F.when(named(f) != "", 1).otherwise(0) for f in fields), F.lit(0))
    return F.bround(filled / F.lit(float(len(FIELDS))), 2)


def combined_confidence(text: Column, fields: Column) -> Column:
    mixed = text * rules.TEXT_WEIGHT + F.coalesce(fields, F.lit(0.0)) * rules.FIELD_WEIGHT
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed)), 4)


def needs_review() -> Column:
    return (
        (named("Candidate Name") == "") | (named("Passing Year") == "")
        | (named("Confidence") < rules.REVIEW_BELOW)
        | F.contains("Status", F.lit("Skipped")) | F.contains("Extraction Mode", F.lit("error"))
    )


def extract_fields(df: DataFrame, name: str, text: str, confidence: str) -> DataFrame:
    """The report, one row per document. Whole texts are read."""
    body, relevant = clean_text(named(text).cast("string")), F.col("__relevant")
    read = df.select(
        named(name).cast("string").alias("File Name"),
        F.bround(F.coalesce(named(confidence).cast("double"), F.lit(0.0)), 4).alias("OCR Confidence"),
        body.alias("__text"),
    ).withColumn("__lower", F.lower("__text")).withColumn("__relevant", is_relevant(F.col("__lower")))
    # Later steps see null arrays, and so do nothing, where the document is not relevant.
    split = computed_once(read, {"__lines": F.when(relevant, clean_lines(F.col("__text")))})
    arrays = computed_once(split, line_arrays(F.col("__lines")))
    lines = Lines(*[F.col(c) for c in ("__lines", "__low", "__folded", "__value")])
    labelled = computed_once(arrays, labelled_values(lines) | {
        "__blob": F.array_join(lines.low, " ")})
    detected = {
        "Roll No": roll_number(F.col("__roll"), lines),
        "University Name": university_name(lines),
        "Course Name": course_name(F.col("__course"), lines),
        "Passing Year": passing_year(lines),
        "Candidate Name": candidate_name(F.col("__name"), lines),
        "Passing Status": passing_status(F.col("__blob")),
        "Institute Name": institute_name(F.col("__institute"), lines),
    }
    blank = {"Passing Status": "Unknown"}
    found = computed_once(labelled, {
        field: F.when(relevant, value).otherwise(F.lit(blank.get(field, "")))
        for field, value in detected.items()
    })
    scored = normalise_fields(found.withColumn("__fields", field_confidence()))
    empty = F.col("__text") == ""
    combined = combined_confidence(F.col("OCR Confidence"), F.col("__fields"))
    return scored.withColumns({
        "Confidence": F.when(relevant, combined).otherwise(F.lit(0.0)),
        "Status": F.when(empty, F.lit("No text extracted")).when(~relevant, F.lit(SKIPPED))
        .otherwise(F.lit("Success")),
        "Extraction Mode": F.when(empty, F.lit("none")).when(~relevant, F.lit("skipped"))
        .otherwise(F.lit("smart_rules")),
    }).withColumn("Review Required", needs_review()).select([named(c) for c in REPORT])


def for_review(report: DataFrame) -> DataFrame:
    return report.filter(named("Review Required"))


def review_count(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("documents"), F.count_if(named("Review Required")).alias("review_count"))
