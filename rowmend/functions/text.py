"""Text normalisers built from JVM-side string functions.

Trimming follows Unicode white space, not the plain space `trim` knows, so the set of
characters is spelled out once and used both by `btrim` and inside patterns.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character for which Unicode text handling reports white space.
BLANKS = "".join(
    [chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680)]
    + [chr(c) for c in (*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
)
# The same set inside a pattern. The property class is several times faster than a list.
WIDE = "(?U)"
BLANK = r"[\s\x1c-\x1f]"
NON_BLANK = r"[^\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def squash(c: Column) -> Column:
    """Collapse white space to single spaces and trim; null becomes ''."""
    # Single plain blanks match nothing, so ordinary text is returned as it is.
    text = F.regexp_replace(
        F.coalesce(c, F.lit("")), f"{WIDE}{BLANK}{{2,}}|[{BLANK}&&[^ ]]", " ")
    return F.btrim(text)


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def digit_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\d"))


def text_key(c: Column) -> Column:
    """Join key for free text: null to '', trimmed, lower case."""
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def mobile_key(c: Column) -> Column:
    """Join key for phone numbers: the last ten digits, '' when there are fewer."""
    digits = digits_of(F.coalesce(c, F.lit("")))
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10))).otherwise(F.lit(""))


def normal_key(c: Column, key_type: str = "text") -> Column:
    c = c.cast("string")
    return mobile_key(c) if key_type == "mobile" else text_key(c)


NUMERIC = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)$"


def to_number(c: Column) -> Column:
    """Lenient number parse: null where the text is not a plain decimal number.

    The pattern keeps out spellings the SQL cast takes but a CSV tool does not
    (`1d`, `NaN`).
    """
    text = F.btrim(c.cast("string"), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(text.rlike(NUMERIC), text.try_cast("double"))


def no_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


# Letters that have no Unicode decomposition and their usual ASCII spelling.
ASCII_SPELLINGS = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE",
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th",
    "ħ": "h", "Ħ": "H", "ı": "i", "ł": "l", "Ł": "L", "ŋ": "ng", "Ŋ": "NG",
    "ŧ": "t", "Ŧ": "T", "ſ": "s", "ƒ": "f",
}


@cache
def latin_tables() -> tuple[str, str, dict[str, str]]:
    """Decompose the Latin blocks once: one-to-one pairs for `translate`, the rest as a map."""
    single, many = {}, {}
    blocks = (range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F))
    for point in (p for block in blocks for p in block):
        letter = chr(point)
        plain = "".join(x for x in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(x))
        plain = ASCII_SPELLINGS.get(letter, plain)
        if plain.isascii() and plain != letter:
            (single if len(plain) == 1 else many)[letter] = plain
    return "".join(single), "".join(single.values()), many


def spell_out(c: Column, spellings: dict[str, str]) -> Column:
    """Replace single characters by strings, all in one pass over the text."""
    table = F.create_map([F.lit(x) for pair in spellings.items() for x in pair])
    return F.array_join(
        F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), ""
    )


def to_ascii(c: Column, spellings: dict[str, str] | None = None) -> Column:
    """Transliterate Latin scripts to ASCII without leaving the JVM.

    `spellings` adds characters of other scripts. Plain ASCII rows pay one pattern test.
    """
    source, target, many = latin_tables()
    many = {**many, **(spellings or {})}
    foreign = r"[^\x00-\x7f]"
    plain = F.regexp_replace(F.translate(c, source, target), r"\p{M}+", "")
    spelled = F.when(plain.rlike(foreign), spell_out(plain, many)).otherwise(plain)
    return strip(F.when(c.rlike(foreign), spelled).otherwise(c))


def natural_key(c: Column) -> Column:
    """Sort key in which digit runs compare as integers and text compares without case.

    Digit runs become `<length><digits>` so string order equals numeric order at any
    length; a leading digit run gets an empty text part before it.
    """
    parts = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))

    def encode(part: Column) -> Column:
        digits = F.regexp_replace(part, r"^0+(?=\d)", "")
        number = F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
        return F.when(part.rlike(r"^\d"), number).otherwise(F.lower(part))

    lead = F.when(c.rlike(r"^\d"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(lead, F.transform(parts, encode))


def safe_file_name(c: Column) -> Column:
    """Replace runs of characters a file system rejects, collapse blanks, trim dots."""
    name = F.regexp_replace(strip(c), r'[<>:"/\\|?*]+', "_")
    return F.btrim(F.regexp_replace(name, f"{WIDE}{BLANK}+", " "), F.lit(" ."))


def safe_merge_name(c: Column) -> Column:
    """Variant used for merged documents: each rejected character becomes one underscore."""
    return F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r'[\\/:*?"<>|]', "_")
