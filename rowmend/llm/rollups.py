"""Delta-maintained token counts.

A change inserts, deletes or revises the count of one document under one tokenizer version.
A batch of changes becomes signed rows: minus what was counted before, plus what counts now.
Totals by source, language and tokenizer are sums of signed rows, so a batch costs what it
changes. A batch is committed by the success marker of its folder; committing it again does
nothing, and one that broke off is written anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ["source", "lang", "tokenizer"]
KEY = ["doc_id", "tokenizer"]
OPERATIONS = ("insert", "delete", "revise")
ENTRY = "doc_id bigint, source string, lang string, tokenizer string, docs long, tokens long"
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def piece_count(text: Column) -> Column:
    """Runs of letters, single digits and single other characters that are not white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\p{L}+|[^\p{L}\x20\x09-\x0D]")), F.lit(0)).cast("long")


def byte_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up: a provisional count."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def changes(docs: DataFrame, operation: str, tokenizer: str, tokens: Column) -> DataFrame:
    """One change per document, all of the same kind."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}")
    return docs.select(
        "doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(operation).alias("operation"),
        F.lit(0).cast("long").alias("sequence"), tokens.alias("tokens"))


@dataclass(frozen=True)
class Rollup:
    """Totals kept under a shared folder, as signed entries per document and signed sums per batch."""

    spark: SparkSession
    folder: str

    def committed(self, part: str) -> list[str]:
        """Names of the batches whose folders carry the success marker."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        found = (s.getPath() for s in files.listStatus(root))
        return sorted(p.getName() for p in found if files.exists(
            self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{part}/{name}" for name in self.committed(part)]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        """What every document counts now: signed entries add up, and cancelled ones vanish."""
        whole = self.read("entries", ENTRY).groupBy("doc_id", *GROUP).agg(
            F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return whole.where((F.col("docs") != 0) | (F.col("tokens") != 0))

    def signed(self, batch: DataFrame) -> DataFrame:
        """Signed entries of a batch; of several changes of one count the last in sequence holds.

        An insert of a counted document replaces its count, a revision of an uncounted one
        inserts it, and the deletion of an uncounted one does nothing. Changes without a
        document id cannot be found again and are left out, as are unknown operations; a
        missing count is 0. Null sources and languages are groups of their own.
        """
        known = batch.where(F.col("doc_id").isNotNull() & F.col("operation").isin(*OPERATIONS))
        value = F.struct("sequence", "operation", F.coalesce("tokens", F.lit(0)).alias("tokens"), "source", "lang")
        last = known.groupBy(*KEY).agg(F.max(value).alias("last")).select(*KEY, "last.*")
        new = last.where("operation <> 'delete'").select(
            "doc_id", *GROUP, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))
        if not self.committed("entries"):
            return new
        old = self.current().join(last.select(*KEY), KEY, "left_semi").select(
            "doc_id", *GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        return old.unionByName(new).groupBy("doc_id", *GROUP).agg(
            F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def commit(self, name: str, batch: DataFrame) -> bool:
        """Apply a batch under its name; False if it was applied before."""
        if "/" in name or name.startswith(("_", ".")):
            raise ValueError(f"not a batch name: {name!r}")
        fresh = name not in self.committed("entries")
        if fresh:
            self.signed(batch).write.mode("overwrite").parquet(f"{self.folder}/entries/{name}")
        if fresh or name not in self.committed("deltas"):
            entries = self.spark.read.schema(ENTRY).parquet(f"{self.folder}/entries/{name}")
            delta = entries.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            delta.write.mode("overwrite").parquet(f"{self.folder}/deltas/{name}")
        return fresh

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer; groups without documents are left out."""
        return self.read("deltas", DELTA).groupBy(*GROUP).agg(
            F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0")
