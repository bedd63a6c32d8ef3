"""Pairwise scoring of two name columns with a written note per row. No shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmend.columns import named
from rowmend.functions.similarity import jaro_winkler, percent_one_decimal, simple_soundex
from rowmend.functions.text import squash
from rowmend.functions.word_lists import NAME_PREFIXES, NAME_STOP_WORDS

PUNCTUATION = ".,:;/\\-_\t"


def scrub_name(c: Column, prefixes: Iterable[str] = NAME_PREFIXES,
               stop_words: Iterable[str] = NAME_STOP_WORDS) -> Column:
    """Upper-case name without punctuation, leading prefixes and trailing stop words.

    A prefix is taken off wherever the text starts with it, word boundary or not; end it
    with a blank to ask for one.
    """
    name = F.upper(squash(F.translate(c.cast("string"), PUNCTUATION, " " * len(PUNCTUATION))))
    heads = [re.escape(p.upper()) for p in prefixes]
    if heads:
        name = F.regexp_replace(name, rf"^(?:(?:{'|'.join(heads)})\s*)+", "")
    tails = [re.escape(w.upper()) for w in stop_words]
    if tails:
        name = F.regexp_replace(name, rf"(?:(?:^| )(?:{'|'.join(tails)}))+$", "")
    return name


def match_note(left: Column, right: Column, score: Column) -> Column:
    """Band, agreement of first and last token, middle-name and phonetic remarks."""
    tokens = [F.split(side, " ") for side in (left, right)]
    first = [F.get(t, F.lit(0)) for t in tokens]
    last = [F.element_at(t, -1) for t in tokens]
    same_first, same_last = first[0] == first[1], last[0] == last[1]
    band = (
        F.when(score >= 98, F.lit("Exact match"))
        .when((score >= 90) & same_first & same_last,
              F.lit("Very strong match (minor spelling differences)"))
        .when(score >= 90, F.lit("Very strong match"))
        .when((score >= 75) & same_first & ~same_last,
              F.lit("Strong match (first name identical, surname differs)"))
        .when((score >= 75) & same_first, F.lit("Strong match (first name matched)"))
        .when(score >= 75, F.lit("Strong partial match"))
        .when((score >= 50) & same_first, F.lit("Partial match (first name same)"))
        .when(score >= 50, F.lit("Partial / phonetic match"))
        .otherwise(F.lit("Low similarity"))
    )
    uneven = (F.size(tokens[0]) != F.size(tokens[1])) & (same_first | same_last)
    middle = F.when(uneven, F.lit(" (possible extra or missing middle name)")).otherwise(F.lit(""))
    sounds = (
        F.when(score >= 90, F.lit(""))
        .when(simple_soundex(first[0]) == simple_soundex(first[1]), F.lit(" (first name sounds similar)"))
        .when(simple_soundex(last[0]) == simple_soundex(last[1]), F.lit(" (surname sounds similar)"))
        .otherwise(F.lit(""))
    )
    return (
        F.when((left == "") & (right == ""), F.lit("Both blank"))
        .when((left == "") | (right == ""), F.lit("One name missing"))
        .otherwise(F.concat(band, middle, sounds))
    )


def match_names(df: DataFrame, left: str, right: str, score_column: str = "Similarity_Score",
                prefixes: Iterable[str] = NAME_PREFIXES,
                stop_words: Iterable[str] = NAME_STOP_WORDS) -> DataFrame:
    """Append the score in percent (null when a name is blank) and `Notes`."""
    absent = [c for c in (left, right) if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    prefixes, stop_words = tuple(prefixes), tuple(stop_words)
    a, b, score = F.col("__left"), F.col("__right"), F.col("__score")
    scored = (
        df.withColumn("__left", scrub_name(named(left), prefixes, stop_words))
        .withColumn("__right", scrub_name(named(right), prefixes, stop_words))
        .withColumn("__score", percent_one_decimal(jaro_winkler(a, b)))
    )
    kept = [named(c) for c in df.columns if c not in (score_column, "Notes")]
    return scored.select(*kept, score.alias(score_column), match_note(a, b, score).alias("Notes"))
