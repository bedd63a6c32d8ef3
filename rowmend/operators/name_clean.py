"""Name cleaning: a verdict per name, routing by verdict and status, and a summary.

All rules are string and array functions inside the JVM; there is no shuffle up to the
summary counts. Intermediate values are named columns, so each is computed once per row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmend.columns import computed_once, named, sql_list
from rowmend.functions.text import digit_count, squash, to_ascii
from rowmend.functions.word_lists import ADDRESS_WORDS, BUSINESS_WORDS, GENERIC_WORDS, HONORIFICS
from rowmend.sources.files import write_csv, write_report
from rowmend.sources.workspace import written

# Column lists of the four outputs.
OUTPUTS = {
    "consolidate": ["mobile", "lookup_response", "cleaned_name", "status", "status_bucket",
                    "is_clean", "removed_reason"],
    "clean_with_not_found": ["mobile", "name", "lookup_response", "status", "status_bucket"],
    "only_clean": ["mobile", "name", "lookup_response", "status"],
    "not_found_data": ["mobile", "lookup_response", "cleaned_name", "status", "is_clean",
                       "removed_reason"],
}
MAX_TOKENS = 6


def normal_name_text(c: Column) -> Column:
    """Byte-order marks and runs of white space to single blanks, trimmed; null to ''."""
    return squash(F.translate(c.cast("string"), "\ufeff", " "))


def letters_only(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"[^A-Za-z]+", " "))


def latin_words(c: Column) -> Column:
    return F.split(F.lower(c), "[^a-z]+")


def word_hits(words: str, listed: Iterable[str]) -> Column:
    """How many words of an array column are in the list, repeats counted."""
    return F.expr(f"size(filter({words}, w -> w IN ({sql_list(listed)})))")


def has_email_or_url(c: Column) -> Column:
    return F.lower(c).rlike("@|https?://|www\\.")


def halve_repeat(words: Column) -> Column:
    """A phrase written twice in a row (four words or more, even count) once."""
    half = F.floor(F.size(words) / 2).cast("int")
    front, back = F.slice(words, F.lit(1), half), F.slice(words, half + 1, half)
    twice = (F.size(words) >= 4) & (F.size(words) % 2 == 0) & (front == back)
    return F.when(twice, front).otherwise(words)


def drop_leading_generic(words: Column) -> Column:
    lead = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    return F.when(lead.isin(*GENERIC_WORDS), F.slice(words, F.lit(2), F.size(words))).otherwise(words)


def business_or_address(original: Column, token_count: Column, address: Column, business: Column,
                        digits: Column) -> Column:
    """Reason for a name that reads like a business or an address, else ''."""
    comma = F.contains(original, F.lit(","))
    located = (
        (address >= 2)
        | ((address >= 1) & ((digits >= 1) | comma))
        | ((digits >= 4) & (business >= 1))
    )
    hinted = comma | (address >= 1) | (business >= 1)
    return (
        F.when(business >= 2, F.lit("business_name"))
        .when(located, F.lit("looks_like_address"))
        .when((token_count > MAX_TOKENS) & hinted, F.lit("too_long_non_name"))
        .otherwise(F.lit(""))
    )


def clean_names(df: DataFrame, column: str, cleaned: str = "cleaned_name",
                reason: str = "removed_reason", spellings: dict[str, str] | None = None) -> DataFrame:
    """Append the cleaned name ('' when rejected) and the reason ('' when kept)."""
    words, size = F.col("__words"), F.size(F.col("__words"))
    staged = (
        df.withColumn("__original", normal_name_text(named(column)))
        .withColumn("__letters", F.lower(letters_only(to_ascii(F.col("__original"), spellings))))
        .withColumn("__untitled", untitled(F.col("__letters")))
        .withColumn("__named", drop_leading_generic(F.col("__untitled")))
        .withColumn("__words", F.array_distinct(halve_repeat(F.col("__named"))))
        .withColumn("__name", F.initcap(F.array_join(words, " ")))
    )
    original, name = F.col("__original"), F.col("__name")
    counted = computed_once(staged.withColumn("__latin", latin_words(original)), {
        "__address": word_hits("__latin", ADDRESS_WORDS),
        "__business": word_hits("__latin", BUSINESS_WORDS),
        "__digits": digit_count(original),
    })
    address, business, digits = (F.col(c) for c in ("__address", "__business", "__digits"))
    verdict = (
        F.when(original == "", F.lit("empty_original"))
        .when(has_email_or_url(original), F.lit("contains_email_or_url"))
        .when(F.col("__letters") == "", F.lit("empty_after_cleaning"))
        .when(F.size(F.col("__untitled")) == 0, F.lit("only_honorific"))
        .when(F.size(F.col("__named")) == 0, F.lit("generic_non_name"))
        .when(digits >= 6, F.lit("contains_many_digits"))
        .when(F.length(name) <= 1, F.lit("too_short"))
        .when((size == 1) & F.lower(name).isin(*GENERIC_WORDS), F.lit("generic_non_name"))
        # n one-letter words joined by blanks are exactly 2n - 1 characters long
        .when(F.length(name) == 2 * size - 1, F.lit("initials_only"))
        .when(size > MAX_TOKENS, F.lit("too_long"))
        .otherwise(business_or_address(original, size, address, business, digits))
    )
    judged = computed_once(counted, {"__verdict": verdict, "__name": name})
    return judged.select(
        *[named(c) for c in df.columns if c not in (cleaned, reason)],
        F.when(F.col("__verdict") == "", name).otherwise(F.lit("")).alias(cleaned),
        F.col("__verdict").alias(reason),
    )


def untitled(letters: Column) -> Column:
    """Words of the text without honorifics."""
    return F.filter(F.split(letters, " "), lambda w: (w != "") & ~w.isin(*HONORIFICS))


def categorise(df: DataFrame, mobile: str, name: str, status: str,
               spellings: dict[str, str] | None = None) -> DataFrame:
    """The consolidate output: one row per input row with bucket, verdict and flag."""
    absent = [c for c in (mobile, name, status) if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    base = df.select(
        normal_name_text(named(mobile)).alias("mobile"),
        normal_name_text(named(name)).alias("lookup_response"),
        normal_name_text(named(status)).alias("status"),
    )
    found = F.lower(F.col("status")) == "found"
    return clean_names(base, "lookup_response", spellings=spellings).select(
        "mobile", "lookup_response", "cleaned_name", "status",
        F.when(found, F.lit("Found")).otherwise(F.lit("Not Found")).alias("status_bucket"),
        F.when(F.col("cleaned_name") != "", F.lit("Yes")).otherwise(F.lit("No")).alias("is_clean"),
        "removed_reason",
    )


def route_names(consolidate: DataFrame) -> dict[str, DataFrame]:
    clean = F.col("is_clean") == "Yes"
    found = F.col("status_bucket") == "Found"
    rows = consolidate.withColumn("name", F.col("cleaned_name"))
    kept = {
        "consolidate": rows, "clean_with_not_found": rows.filter(clean),
        "only_clean": rows.filter(clean & found), "not_found_data": rows.filter(~found),
    }
    return {output: kept[output].select(columns) for output, columns in OUTPUTS.items()}


def name_summary(consolidate: DataFrame) -> DataFrame:
    """Totals, status counts and rows per output, one row."""
    clean = F.col("is_clean") == "Yes"
    found = F.col("status_bucket") == "Found"
    return consolidate.agg(
        F.count("*").alias("total_rows"),
        F.count_if(found).alias("found_rows"),
        F.count_if(~found).alias("not_found_rows"),
        F.count_if(clean).alias("clean_names_total"),
        F.count_if(~clean).alias("non_clean_names_total"),
        F.count("*").alias("consolidate_rows"),
        F.count_if(clean).alias("clean_with_not_found_rows"),
        F.count_if(clean & found).alias("only_clean_rows"),
        F.count_if(~found).alias("not_found_data_rows"),
    )


def reason_breakdown(consolidate: DataFrame) -> DataFrame:
    """How often each removal reason occurred."""
    removed = consolidate.filter(F.col("is_clean") == "No")
    return removed.groupBy("removed_reason").agg(F.count("*").alias("rows"))


def run_names(df: DataFrame, mobile: str, name: str, status: str, output: str) -> dict:
    """Write the four outputs and the JSON summary; the verdicts are computed once."""
    done = written(categorise(df, mobile, name, status), "consolidate", f"{output}/verdicts")
    for part, rows in route_names(done).items():
        write_csv(rows, f"{output}/{part}")
    reasons = reason_breakdown(done).agg(
        F.map_from_entries(F.collect_list(F.struct("removed_reason", "rows"))).alias("reasons"))
    summary = name_summary(done).withColumn(
        "non_clean_reason_breakdown", reasons.scalar())
    write_report(summary, f"{output}/summary")
    return summary.first().asDict()
