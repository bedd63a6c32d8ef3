"""Multi-term search over every cell of a table.

The terms are a short list typed by a user, so they travel as a literal inside the
expression: each row is tested where it lies, with no join, no pairing of cells with
terms and no shuffle. Only hits are exploded.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmend.columns import named
from rowmend.functions.text import digits_of

RESULT = ["Matched_Term", "Source_File", "Sheet_Name", "Excel_Row_Number", "Row_Data"]


def prepare_terms(terms: Iterable[str]) -> list[tuple[str, str]]:
    """Distinct trimmed terms in sorted order, each with the digits it stands for.

    When two terms share their digits the later one owns them, the other keeps ''.
    """
    cleaned = [t.strip() for t in map(str, terms) if t.strip()]
    owner = {}
    for term in cleaned:
        owner[re.sub(r"\D", "", term)] = term
    owned = {term: digits for digits, term in owner.items() if digits}
    return [(term, owned.get(term, "")) for term in sorted(set(cleaned))]


def cell_separator(terms: Iterable[tuple[str, str]]) -> str:
    """A character that occurs in no term, so no term can match across two cells."""
    used = {ch for term, _ in terms for ch in term}
    return next(chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in used)


def terms_found(columns: Iterable[str], terms: list[tuple[str, str]]) -> Column:
    """Terms that occur in a cell literally, or by digits alone, in sorted order."""
    cells = [named(c).cast("string") for c in columns]
    text = F.concat_ws(cell_separator(terms), *cells)
    digits = F.concat_ws(" ", *[digits_of(c) for c in cells])
    listed = F.array([F.struct(F.lit(t).alias("term"), F.lit(d).alias("digits")) for t, d in terms])

    def pick(found_text: Column, found_digits: Column) -> Column:
        hits = F.filter(listed, lambda x: F.contains(found_text, x["term"])
                        | ((x["digits"] != "") & F.contains(found_digits, x["digits"])))
        return F.transform(hits, lambda x: x["term"])

    # A one-element array binds both texts once, so they are not rebuilt for every term.
    bound = F.array(F.struct(text.alias("text"), digits.alias("digits")))
    return F.get(F.transform(bound, lambda b: pick(b["text"], b["digits"])), F.lit(0))


def search(df: DataFrame, terms: Iterable[str], row_number: Column, source_file: Column | str = "",
           sheet_name: Column | str = "", columns: Iterable[str] | None = None) -> DataFrame:
    """One row per input row and term found: term, file, sheet, row number, row text.

    `row_number` is one-based with the header as row 1.
    """
    prepared = prepare_terms(terms)
    columns = list(columns or df.columns)
    if not prepared:
        raise ValueError("no search terms")
    where = [x if isinstance(x, Column) else F.lit(x) for x in (source_file, sheet_name)]
    row_text = F.concat_ws(" | ", *[F.coalesce(named(c).cast("string"), F.lit("")) for c in columns])
    # Exploding the expression itself: rows without a hit vanish, and it is evaluated once.
    return df.select(
        F.explode(terms_found(columns, prepared)).alias("Matched_Term"),
        where[0].alias("Source_File"), where[1].alias("Sheet_Name"),
        row_number.cast("long").alias("Excel_Row_Number"), row_text.alias("Row_Data"),
    ).select(RESULT)
