"""Prioritised lookup enrichment.

Sources are staged under one schema, reduced to one row per key, and left-joined to the
input; the outcome of each row is a reason column that routes it.

How it holds up at size
* Sources are cut to key and mapped columns and filtered before the only shuffle on that
  side. The pick is a `min` over a struct, so each map task sends one row per key however
  often a key repeats.
* The index is written once and its size measured; below a limit it is broadcast and
  nothing of the input is shuffled.
* Beyond it, rows with a blank key and rows of very frequent keys are dealt over several
  tasks by a salt from their content, and the index rows of frequent keys repeated for each
  salt, in one join that reads input and index once. A key is frequent above 1/MAX_HOT_KEYS
  of all rows, so no more than MAX_HOT_KEYS index rows are repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rowmend.columns import named
from rowmend.functions.text import normal_key, strip
from rowmend.sources.files import (
    conform, csv_scan, files_by_header, list_lookup_files, plain_path, write_csv, write_report,
)
from rowmend.sources.workspace import written
from rowmend.specs import LookupSource, LookupSpec, Mapping

KEY, SALT = "norm_key", "__salt"
# Where a row stands: the folder's turn, the file's name, the split, the place within it.
FILE_PLACE = "struct<folder:int,file:string,block:bigint,pos:bigint>"
SALTS = 64
PREFIX = "__lookup_"
INVALID, NO_MATCH = "INVALID_OR_BLANK_KEY", "NO_MATCH_FOUND"
PRIORITY = {"special_lookup": 1, "main_lookup": 2}
MAX_HOT_KEYS = 1000
TRACKED_KEYS = 8192
SKETCH_GROUPS = 512
BROADCAST_BYTES = 64 * 1024 * 1024


def stage_source(source: LookupSource, spec: LookupSpec, ordinal: int) -> DataFrame | None:
    """Key, targets and rank of one source; None when it lacks the key column."""
    special = source.kind == "special_lookup"
    key = spec.special_key if special else spec.main_key
    mappings = spec.special_mappings if special else spec.main_mappings
    have = set(source.frame.columns)
    if key not in have:
        return None
    renamed = {m.target: m.lookup_column for m in mappings if m.lookup_column in have}
    moved = {m.lookup_column for m in mappings if m.target != m.lookup_column}

    def value(target: str) -> Column:
        # An unmapped source column that already bears the target's name is taken as is.
        name = renamed.get(target) or (target if target in have - moved else None)
        return F.coalesce(named(name).cast("string"), F.lit("")) if name else F.lit("")

    usable = normal_key(named(key), spec.key_type) != ""
    for m in mappings:
        if m.mandatory and m.lookup_column in have:
            cell = F.coalesce(named(m.lookup_column).cast("string"), F.lit(""))
            usable = usable & (strip(cell) != "")
    order = named(source.row_order).cast("long") if source.row_order else F.lit(0).cast("long")
    place = named(source.file_order) if source.file_order else F.lit(None)
    return source.frame.filter(usable).select(
        normal_key(named(key), spec.key_type).alias(KEY),
        F.struct(
            F.lit(PRIORITY[source.kind]).alias("priority"),
            F.lit(ordinal).alias("ordinal"),
            place.cast(FILE_PLACE).alias("file_order"),
            order.alias("row_order"),
            *[value(t).alias(t) for t in spec.targets],
            F.lit(source.kind).alias("source_type"),
        ).alias("row"),
    )


def build_index(sources: Sequence[LookupSource], spec: LookupSpec) -> DataFrame:
    """One row per key: best priority, then source order or file order, row order, row content.

    The whole row wins; blanks in it are not filled from lower-priority rows. Content as
    the last criterion makes the pick the same on every run and after every retry.
    """
    filed = next((i for i, s in enumerate(sources) if s.file_order), 0)
    staged = [stage_source(s, spec, filed if s.file_order else i) for i, s in enumerate(sources)]
    staged = [s for s in staged if s is not None]
    if not staged:
        raise ValueError("no lookup source has the key column")
    union = staged[0]
    for other in staged[1:]:
        union = union.unionByName(other)
    best = union.groupBy(KEY).agg(F.min("row").alias("row"))
    return best.select(
        KEY, *[F.col("row").getField(t).alias(t) for t in spec.targets],
        F.col("row.source_type").alias("source_type"), F.col("row.priority").alias("priority"),
    )


@dataclass(frozen=True)
class IndexSize:
    keys: int
    text_bytes: int


def measure_index(index: DataFrame) -> IndexSize:
    """Exact key count and text volume in one pass."""
    texts = [c for c, t in index.dtypes if t == "string"]
    per_row = sum((F.octet_length(F.coalesce(named(c), F.lit(""))) + 8 for c in texts), F.lit(16))
    row = index.agg(F.count("*"), F.coalesce(F.sum(per_row.cast("long")), F.lit(0))).first()
    return IndexSize(row[0], row[1])


def frequent_keys(keys: DataFrame, column: str = KEY, limit: int = MAX_HOT_KEYS) -> list[str]:
    """Non-blank values holding more than 1/limit of all rows: at most `limit` of them.

    One narrow scan into fixed-size sketches, merged in two steps so that no task receives
    one from every scan task; no row is shuffled. The answer steers the plan only, results
    are the same for any answer.
    """
    def sketch(function: str, *args: Column | int) -> Column:
        return F.call_function(function, *[F.lit(a) if isinstance(a, int) else a for a in args])

    partial = keys.filter(named(column) != "").groupBy(
        (F.spark_partition_id() % SKETCH_GROUPS).alias("part")
    ).agg(sketch("approx_top_k_accumulate", named(column), TRACKED_KEYS).alias("sketch"),
          F.count("*").alias("n"))
    # Grouped by a constant: combining sketches fails on no input at all.
    found = partial.groupBy(F.lit("all")).agg(
        sketch("approx_top_k_combine", F.col("sketch"), TRACKED_KEYS).alias("sketch"),
        F.sum("n").alias("n"),
    ).select("n", sketch("approx_top_k_estimate", F.col("sketch"), limit).alias("top")).first()
    if found is None:
        return []
    return [item["item"] for item in found.top if item["count"] >= max(found.n / limit, 2)]


def _pick(spec: LookupSpec, column: str, columns: set[str]) -> Column:
    if column not in spec.targets:
        return named(column)
    fetched = F.coalesce(named(PREFIX + column), F.lit(""))
    if column not in columns:
        return fetched.alias(column)
    own = F.coalesce(named(column).cast("string"), F.lit(""))
    mode = spec.write_mode(column)
    if mode == "fill_if_blank":
        return F.when(strip(own) == "", fetched).otherwise(own).alias(column)
    if mode == "overwrite":
        return F.coalesce(named(PREFIX + column), own).alias(column)
    return own.alias(column)


def join_keys(rows: DataFrame, side: DataFrame, how: str, hot_keys: Sequence[str]) -> DataFrame:
    """One join on key and salt; `side` has one row per key and no blank one.

    Rows of blank and hot keys get one of SALTS salts, which only hot rows of `side` are
    repeated for, so neither meets in one task. All others have salt 0.
    """
    hot = F.col(KEY).isin(list(hot_keys)) if hot_keys else F.lit(False)
    spread = F.pmod(F.xxhash64(*[named(c) for c in rows.columns]), F.lit(SALTS)).cast("int")
    salted = rows.withColumn(SALT, F.when((F.col(KEY) == "") | hot, spread).otherwise(0))
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(side.withColumn(SALT, F.explode(salts)), [KEY, SALT], how).drop(SALT)


def match(df: DataFrame, index: DataFrame, spec: LookupSpec, hot_keys: Sequence[str] = (),
          small_index: bool = False) -> DataFrame:
    """Left join on the normalised key; the consolidated output with status and reason.

    `small_index` is for an index of measured size. Otherwise blank and hot keys are spread.
    """
    spec.validate(df.columns)
    columns = set(df.columns)
    rows = df.withColumn(KEY, normal_key(named(spec.input_key), spec.key_type))
    fetched = [named(t).alias(PREFIX + t) for t in spec.targets]
    side = index.select(KEY, *fetched, F.lit(True).alias(PREFIX + "found"))
    if small_index:
        joined = rows.join(F.broadcast(side), KEY, "left")
    else:
        joined = join_keys(rows, side, "left", hot_keys)
    reason = (
        F.when(F.col(KEY) == "", F.lit(INVALID))
        .when(F.col(PREFIX + "found").isNull(), F.lit(NO_MATCH))
        .otherwise(F.lit(""))
    )
    status = F.when(F.col("reason") == "", F.lit("MATCHED")).otherwise(F.lit("UNMATCHED"))
    base = [_pick(spec, c, columns) for c in spec.headers["matched"]]
    return (
        joined.select(*base, reason.alias("reason"))
        .withColumn("match_status", status)
        .select([named(c) for c in spec.headers["consolidated"]])
    )


def enrich(df: DataFrame, sources: Sequence[LookupSource], spec: LookupSpec) -> DataFrame:
    """Consolidated output from the sources, whose index is written once and measured."""
    spec.validate(df.columns)
    return matched(df, written(build_index(sources, spec), "index"), spec)


def matched(df: DataFrame, index: DataFrame, spec: LookupSpec, size: IndexSize | None = None,
            hot_keys: Sequence[str] | None = None) -> DataFrame:
    """Match against a written index, by broadcast where its measured size allows.

    Hot keys are looked for beside a large index unless they are given. A stream cannot be
    looked through, so give those of an earlier run.
    """
    small = (size or measure_index(index)).text_bytes <= BROADCAST_BYTES
    if hot_keys is None:
        keys = df.select(normal_key(named(spec.input_key), spec.key_type).alias(KEY))
        hot_keys = [] if small or df.isStreaming else frequent_keys(keys)
    return match(df, index, spec, hot_keys, small_index=small)


def route(consolidated: DataFrame, spec: LookupSpec) -> dict[str, DataFrame]:
    """The three outputs with their fixed column lists."""
    hit = F.col("reason") == ""
    return {
        "matched": conform(consolidated.filter(hit), spec.headers["matched"]),
        "unmatched": conform(consolidated.filter(~hit), spec.headers["unmatched"]),
        "consolidated": consolidated,
    }


def _keyed(df: DataFrame, spec: LookupSpec) -> DataFrame:
    spec.validate(df.columns)
    return df.withColumn(KEY, normal_key(named(spec.input_key), spec.key_type))


def by_partner(df: DataFrame, index: DataFrame, spec: LookupSpec, how: str) -> DataFrame:
    """Semi or anti join with the keys of the index, which are written and measured first."""
    rows, keys = _keyed(df, spec), written(index.select(KEY), "keys")
    if measure_index(keys).text_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(keys), KEY, how).drop(KEY)
    return join_keys(rows, keys, how, frequent_keys(rows.select(KEY))).drop(KEY)


def with_partner(df: DataFrame, index: DataFrame, spec: LookupSpec) -> DataFrame:
    """Input rows whose key is in the index, nothing fetched."""
    return by_partner(df, index, spec, "left_semi")


def without_partner(df: DataFrame, index: DataFrame, spec: LookupSpec) -> DataFrame:
    """Input rows whose key is blank or not in the index."""
    return by_partner(df, index, spec, "left_anti")


def _counters() -> list[Column]:
    hit = F.col("reason") == ""
    return [
        F.count("*").alias("processed_rows"),
        F.count_if(hit).alias("matched_rows"),
        F.count_if(~hit).alias("unmatched_rows"),
    ]


def run_statistics(consolidated: DataFrame) -> DataFrame:
    return consolidated.agg(*_counters())


def observed(consolidated: DataFrame, observation: Observation | str) -> DataFrame:
    """Attach the run counters to whatever action consumes the output."""
    return consolidated.observe(observation, *_counters())


def run_lookup(df: DataFrame, sources: Sequence[LookupSource], spec: LookupSpec,
               output: str) -> dict[str, int]:
    """The whole job: index, match, three outputs and a summary under `output`.

    Index and consolidated output are written once and read back, so the join runs once
    and the two narrower outputs are scans of its result.
    """
    index = written(build_index(sources, spec), "index", f"{output}/index")
    size = measure_index(index)
    done = written(matched(df, index, spec, size), "consolidated", f"{output}/consolidated")
    for name, part in route(done, spec).items():
        write_csv(part, f"{output}/{name}_output", spec.headers[name])
    summary = run_statistics(done).withColumn("unique_lookup_keys_indexed", F.lit(size.keys))
    write_report(summary, f"{output}/summary")
    counts = summary.first().asDict()
    line = f"Processed: {counts['processed_rows']} | Matched: {counts['matched_rows']}"
    summary.select(F.lit(line)).write.text(f"{output}/summary_text")
    return counts


def folder_sources(spark: SparkSession, folders: Sequence[str], special_file: str = "",
                   **options) -> list[LookupSource]:
    """Sources from CSV folders, and an optional override file.

    Files that share a header are one scan. Of rows with one key the first wins: by folder in
    the given order, file name and place in the file, whatever headers the files have.
    """
    found = [special_source(csv_scan(spark, special_file, **options))] if special_file else []
    turns = F.lit(len(folders))
    for turn, folder in reversed(list(enumerate(folders))):
        within = F.startswith(F.col("__place.path"), F.lit(plain_path(folder).rstrip("/") + "/"))
        turns = F.when(within, turn).otherwise(turns)
    place = F.struct(turns.alias("folder"), F.regexp_extract("__place.path", "[^/]*$", 0).alias("file"),
                     F.col("__place.block").alias("block"), F.col("__place.pos").alias("pos"))
    for header, paths in files_by_header(spark, list_lookup_files(spark, folders)).items():
        rows = csv_scan(spark, paths, list(header), place_column="__place", **options)
        found.append(main_source(rows.withColumn("__place", place), file_order="__place"))
    return found


def main_source(frame: DataFrame, row_order: str = "", file_order: str = "") -> LookupSource:
    return LookupSource(frame, "main_lookup", row_order, file_order)


def special_source(frame: DataFrame, row_order: str = "") -> LookupSource:
    return LookupSource(frame, "special_lookup", row_order)


__all__ = [
    "LookupSource", "LookupSpec", "Mapping", "build_index", "by_partner", "enrich", "folder_sources",
    "frequent_keys", "main_source", "match", "measure_index", "observed", "route", "run_lookup",
    "run_statistics", "special_source", "with_partner", "without_partner",
]
