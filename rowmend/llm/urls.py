"""URL filters: host and path rules, and gradient-boosted trees for what no rule decides.

Everything is DataFrame expressions and Spark's own tree learner. The rules label the URLs
they fit; trees learn from a bounded sample of those, and judge the others by the look of
the URL. The suffix statistics are one row per last host label, joined as Spark sees fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmend.columns import sql_list
from rowmend.llm.common import pick
from rowmend.sources.workspace import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Labelled URLs of each verdict that the trees learn from, those with the smallest hash.
TRAIN_ROWS = 10_000
TREES, DEPTH, SEED = 20, 4, 42
# Pseudo-counts that pull the block share of a rarely labelled suffix to one half.
PRIOR = 10.0
FEATURES = ["url_chars", "host_chars", "path_chars", "host_depth", "path_depth", "digit_ratio", "entropy",
            "parameters", "has_fragment", "suffix_log_count", "suffix_block_share"]


class Rule(NamedTuple):
    """A rule fits its host with all subdomains where the path starts with its path."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(line: str) -> Rule:
    """'block example.com/de/' -> Rule."""
    verdict, _, target = line.strip().partition(" ")
    host, slash, path = target.strip().partition("/")
    if verdict not in ("allow", "block") or not host or not slash:
        raise ValueError(f"not a rule: {line!r}")
    return Rule(host.lower(), "/" + path, verdict)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Longest fitting rule as a struct (size, rule, verdict), null if none; block wins a tie."""
    listed = F.expr("array(" + ",".join(
        f"named_struct('size', {len(r.text)}, 'rule', {sql_list([r.text])}, 'verdict', {sql_list([r.verdict])},"
        f" 'host', {sql_list([r.host])}, 'path', {sql_list([r.path])})" for r in rules) + ")")
    fits = F.filter(listed, lambda r: (
        ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])))
    return F.array_max(F.transform(fits, lambda r: F.struct(
        r["size"].alias("size"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))))


def entropy(text: Column) -> Column:
    """Bits per character; 0 for the empty text."""
    size = F.length(text).cast("double")

    def part(character: Column) -> Column:
        share = (size - F.length(F.replace(text, character, F.lit("")))) / size
        return -share * F.log2(share)

    parts = F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), part)
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)


def with_features(rows: DataFrame) -> DataFrame:
    """Lexical features of `url`, `host` and `path`; a null url looks like an empty one."""
    url = F.coalesce("url", F.lit(""))
    size = F.length(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    number = lambda column: column.cast("double")
    return rows.withColumns({
        "suffix": F.substring_index("host", ".", -1),
        "url_chars": number(size), "host_chars": number(F.length("host")), "path_chars": number(F.length("path")),
        "host_depth": number(F.size(F.filter(F.split("host", r"\."), lambda x: x != ""))),
        "path_depth": number(F.size(F.filter(F.split("path", "/"), lambda x: x != ""))),
        "digit_ratio": F.when(size == 0, 0.0).otherwise(F.regexp_count(url, F.lit("[0-9]")) / size),
        "entropy": entropy(url),
        "parameters": number(F.size(F.filter(F.split(query, "&"), lambda x: x != ""))),
        "has_fragment": number(F.contains(url, F.lit("#")).cast("int")),
    })


def with_suffix_statistics(rows: DataFrame) -> DataFrame:
    """How common the host's suffix is, and how often labelled URLs of it are blocked."""
    blocked = F.count_if(F.col("label") == 1)
    statistics = rows.groupBy("suffix").agg(
        F.log1p(F.count("*")).alias("suffix_log_count"),
        ((blocked + PRIOR / 2) / (F.count("label") + PRIOR)).alias("suffix_block_share"))
    return rows.join(statistics, "suffix")


def judged_urls(df: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) per row; the longest fitting rule decides, else the trees.

    A null URL and one without '://' have empty host and path; they fit no rule and are judged
    by the trees like any other. Where rules label URLs of one verdict only, or none, there is
    nothing to learn and what no rule decides is allowed. Repeated rows are all returned; an
    empty table gives an empty result. Other columns are not read.
    """
    rows = pick(df, id=id_col, url=url_col)
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    best = best_rule(F.col("host"), F.col("path"), rules) if rules else F.lit(None).cast(
        "struct<size:int,verdict:string,rule:string>")
    rows = rows.withColumn("best", best).withColumn(
        "label", F.when(F.col("best").isNotNull(), (F.col("best.verdict") == "block").cast("double")))
    ready = written(with_suffix_statistics(with_features(rows)), "urls")
    samples = [ready.where(F.col("label") == v).orderBy(F.xxhash64("url", "id"), "url", "id").limit(TRAIN_ROWS)
               for v in (0, 1)]
    sample = written(samples[0].unionByName(samples[1]).select("label", *FEATURES), "url_sample")
    decided = F.col("best.verdict")
    if sample.select("label").distinct().count() == 2:
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        trees = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.3)
        model = trees.fit(assembler.transform(sample).select("label", "features"))
        judged = model.transform(assembler.transform(ready))
        verdict = F.coalesce(decided, F.when(F.col("prediction") == 1, "block").otherwise("allow"))
    else:
        judged, verdict = ready, F.coalesce(decided, F.lit("allow"))
    return judged.select("id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
