"""Date text in a dozen spellings, read in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowmend.functions.text import squash

# Families of accepted spellings in order of preference. Separators are
# rewritten to '-' before parsing; a text outside every outline costs no parse at all.
DATE_FAMILIES = (
    (r"^\d{1,2}([-/. ])\d{1,2}\1\d{4}$", ("d-M-yyyy",)),
    (r"^\d{1,2}([- ])\p{L}+\1\d{4}$", ("d-MMM-yyyy", "d-MMMM-yyyy")),
    (r"^\d{4}([-/])\d{1,2}\1\d{1,2}$", ("yyyy-M-d",)),
    (r"^\d{1,2}([-/])\d{1,2}\1\d{4}$", ("M-d-yyyy",)),
)


def parse_date(c: Column) -> Column:
    """Date in the first spelling that fits, else null."""
    text = squash(c.cast("string"))
    dashed = F.translate(text, "/. ", "---")
    return F.coalesce(*[
        F.when(text.rlike(outline), F.coalesce(*[F.try_to_date(dashed, f) for f in formats]))
        for outline, formats in DATE_FAMILIES
    ])


def normal_date(c: Column) -> Column:
    """`05 Mar 2024` for any readable date; other text unchanged."""
    return F.coalesce(F.date_format(parse_date(c), "dd MMM yyyy"), c.cast("string"))
