"""Registered queries of the corpus operators, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmend.llm.alignment import aligned_texts, load_aligner
from rowmend.llm.bpe import ids_digest, round_trip
from rowmend.llm.chunked_bpe import encode_texts, load_ranks
from rowmend.llm.decontaminate import with_leaks
from rowmend.llm.embeddings import near_vectors
from rowmend.llm.lines import drop_boilerplate
from rowmend.llm.negatives import hard_negatives
from rowmend.llm.ppm import ppm_scores
from rowmend.llm.rollups import Rollup, byte_estimate, changes, piece_count, word_count
from rowmend.llm.simhash import simhash_groups
from rowmend.llm.toxicity import fit, scored
from rowmend.llm.urls import judged_urls, parse_rule
from rowmend.llm.warc import read_warc, write_warc
from rowmend.sources.workspace import new_path

TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels"), folds=5, held_out=0), folds=5, held_out=0)


RULES = ["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/"]


@query("op2_url_filter")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judged_urls(pages, [parse_rule(r) for r in RULES]).withColumnRenamed("id", "page_id")


@query("op3_ppm_score")
def op3_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(table(spark, sf_dir, "documents"), folds=7, held_out=2)


@query("op4_warc")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder, least_bytes=0)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_embedding_near_dedup")
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.93).withColumnRenamed("id", "vec_id")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_bpe_round_trip")
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"]).select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), ids_digest().alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("leaks"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"), width=4, radius=4)
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return groups.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


LINES_SQL = r"""
WITH pages AS (SELECT row_number() OVER () AS k, doc_id, source, text FROM documents),
     lines AS (
       SELECT DISTINCT k, source, trim(line, chr(32) || chr(9) || chr(13)) AS line
       FROM (SELECT k, source, unnest(string_split(text, chr(10))) AS line FROM pages)),
     totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
     counted AS (SELECT source, line, count(*) AS n FROM lines WHERE line <> '' GROUP BY source, line),
     found AS (
       SELECT c.source, list(c.line) AS listed
       FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
       WHERE c.n >= 3 AND c.n > 0.05 * t.pages GROUP BY c.source),
     kept AS (
       SELECT p.doc_id, p.text, string_split(p.text, chr(10)) AS whole,
              list_filter(string_split(p.text, chr(10)),
                          lambda x: NOT list_contains(coalesce(f.listed, []::VARCHAR[]), trim(x, chr(32) || chr(9) || chr(13)))) AS lines
       FROM pages p LEFT JOIN found f ON p.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(lines, chr(10)) END AS text,
       coalesce(len(whole) - len(lines), 0)::BIGINT AS n_dropped
FROM kept
"""


@query("op10_line_dedup", LINES_SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, ratio=0.05, min_pages=3, dropped_col="n_dropped").select(
        "doc_id", "text", "n_dropped")


# A load under two tokenizers, one of them provisional, and its recount; short documents deleted and put back.
ROLLUP_SQL = r"""
WITH counted AS (
  SELECT source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(coalesce(text, ''), '\p{L}+|[^\p{L}\x20\x09-\x0D]')) AS pieces
  FROM documents WHERE doc_id IS NOT NULL)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs, sum(words)::BIGINT AS n_tokens
FROM counted GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces-1', count(*), sum(pieces)::BIGINT FROM counted GROUP BY source, lang
"""


@query("op8_token_rollup", ROLLUP_SQL)
def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    load = changes(docs, "insert", "words-1", word_count(text)).unionByName(
        changes(docs, "insert", "pieces-1", byte_estimate(text)))
    recount = changes(docs, "revise", "pieces-1", piece_count(text))
    short = docs.where(word_count(text) < 20)
    none = F.lit(None).cast("long")
    clean = changes(short, "delete", "words-1", none).unionByName(changes(short, "delete", "pieces-1", none))
    # The clean-up went too far: what it deleted comes back, as an insert and as a revision.
    restore = changes(short, "insert", "words-1", word_count(text)).unionByName(
        changes(short, "revise", "pieces-1", piece_count(text)))
    rollup = Rollup(spark, new_path(spark, "rollup"))
    batches = {"load": load, "recount": recount, "clean": clean, "restore": restore}
    for name in (*batches, "clean", "load"):
        rollup.commit(name, batches[name])
    return rollup.totals()


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligner = load_aligner(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return aligned_texts(table(spark, sf_dir, "documents"), aligner).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        digest.alias("groups_sha256"))


NEGATIVES_SQL = """
WITH kept AS (
       SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
              list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
       FROM embeddings
       WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     scored AS (
       SELECT a.k AS anchor, a.vec_id AS anchor_id, b.k, b.vec_id, a.label = b.label AS same,
              list_dot_product(a.v, b.v)::BIGINT AS score
       FROM kept a JOIN kept b ON a.k <> b.k AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
     positives AS (
       SELECT * FROM scored WHERE same
       QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, k) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY n.score DESC, n.vec_id, n.k)::INTEGER AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same
 AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY n.score DESC, n.vec_id, n.k) <= 10
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


@query("op13_chunked_bpe")
def op13_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe = load_ranks(tokenizer_path("byte_bpe_50k.tiktoken"))
    return encode_texts(table(spark, sf_dir, "documents"), bpe, bytes_col="decoded", keep=["doc_id"]).select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
