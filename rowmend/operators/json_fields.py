"""JSON texts: their fields discovered over all rows, typed columns for them, and maps of their keys.

The type of a column of JSON texts is an aggregate of variants that merges like any other, so it
takes one pass and a short text to the driver, whatever the rows. Fields of unlike types in
different rows come out as variants.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmend.columns import named


@dataclass(frozen=True)
class JsonField:
    """A field by its names from the outside in, with the SQL type of its values."""

    names: tuple[str, ...]
    kind: str

    @property
    def path(self) -> str:
        return "$" + "".join("[" + repr_name(n) + "]" for n in self.names)


def repr_name(name: str) -> str:
    """A field name in a path; a quote that it holds must not end it."""
    mark = "'" if "'" not in name else '"'
    return f"{mark}{name}{mark}"


def variants(texts: Column) -> Column:
    """Parsed values; null for texts that are not JSON."""
    return F.try_parse_json(texts)


def type_of_texts(df: DataFrame, column: str) -> str:
    """The merged type of all values, in SQL notation."""
    return df.agg(F.schema_of_variant_agg(variants(named(column)))).first()[0]


def split_fields(inner: str) -> Iterator[tuple[str, str]]:
    """(name, type) pairs of an object type's text; names may be quoted, types nest."""
    at = 0
    while at < len(inner):
        if inner[at] == "`":
            end = at + 1
            while inner[end] != "`" or inner.startswith("``", end):
                end += 2 if inner.startswith("``", end) else 1
            name, at = inner[at + 1:end].replace("``", "`"), end + 1
        else:
            end = inner.index(":", at)
            name, at = inner[at:end], end
        start, depth, quoted = at + 1, 0, False
        at = start
        while at < len(inner) and (quoted or depth or inner[at] != ","):
            quoted ^= inner[at] == "`"
            depth += 0 if quoted else (inner[at] in "<(") - (inner[at] in ">)")
            at += 1
        yield name, inner[start:at].strip()
        at += 1
        while at < len(inner) and inner[at] == " ":
            at += 1


def fields_of_type(kind: str, outer: tuple[str, ...] = ()) -> list[JsonField]:
    """Fields that are no objects; an array, and an object without fields, is a field of its own."""
    if kind.startswith("OBJECT<") and kind != "OBJECT<>":
        return [f for name, inner in split_fields(kind[7:-1]) for f in fields_of_type(inner, (*outer, name))]
    # Nested objects within arrays stay variants; nulls alone tell no type.
    plain = "VARIANT" if "OBJECT" in kind or "ARRAY" in kind or kind == "VOID" else kind
    return [JsonField(outer, plain)] if outer else []


def json_fields(df: DataFrame, column: str) -> list[JsonField]:
    """All fields found in any row, as many as the texts have names for."""
    found = type_of_texts(df, column)
    return fields_of_type(found) if found else []


def with_json_columns(df: DataFrame, column: str, fields: list[JsonField], separator: str = ".") -> DataFrame:
    """Append a typed column for every field, named by its path; null where a row lacks it.

    Texts are parsed once. A value that does not fit the field's type is null.
    """
    parsed = df.withColumn("__json", F.explode_outer(F.array(variants(named(column)))))
    new = {separator.join(f.names): F.try_variant_get("__json", f.path, f.kind) for f in fields}
    return parsed.select(*[named(c) for c in df.columns if c not in new], *[c.alias(name) for name, c in new.items()])


def json_maps(texts: Column) -> Column:
    """Top-level keys with their values as JSON texts; null for texts that are no objects."""
    return F.from_json(texts, "map<string,string>")


def key_statistics(df: DataFrame, column: str) -> DataFrame:
    """(key, n_rows, n_numbers, total): every top-level key, how often it occurs and what its numbers add up to."""
    each = df.select(F.explode(F.map_filter(json_maps(named(column)), lambda k, v: k.isNotNull())).alias("key", "value"))
    number = F.expr("try_cast(value AS DECIMAL(38, 6))")
    return each.groupBy("key").agg(
        F.count("*").alias("n_rows"), F.count(number).alias("n_numbers"), F.sum(number).cast("double").alias("total"))
