"""Base64 payloads made from document texts: wrapped, damaged and unpadded ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmend.operators.payload import decode_payloads, name_payloads
from rowmend.plans.registry import query, table
from rowmend.sources.files import spread

# A third of all files lie in one folder.
FOLDER = "CASE WHEN doc_id % 3 = 0 THEN 'scans' ELSE source END"
PATH = f"'/in/' || {FOLDER} || '/doc_' || CAST(doc_id AS STRING) || '.txt'"
LEAD = """CASE doc_id % 9 WHEN 0 THEN 'FFD8FF' WHEN 1 THEN '255044462D' WHEN 2 THEN '89504E470D0A1A0A'
    WHEN 3 THEN '255044462D' WHEN 5 THEN '89504E470D0A1A0A' ELSE '' END"""
CONTENT = """CASE doc_id % 9
    WHEN 0 THEN '<img src="data:image/jpeg;base64,' || coded
    WHEN 1 THEN 'data:application/pdf;base64,' || replace(coded, '=', '')
    WHEN 2 THEN 'data:image/png;base64,' || coded
    WHEN 3 THEN replace(coded, '=', '') || ' ' || chr(10) || chr(9)
    WHEN 4 THEN coded
    WHEN 5 THEN '<img src="data:image/png;base64,' || coded || '" />'
    WHEN 6 THEN '  ' || chr(10) || ' -- '
    WHEN 7 THEN 'abc=def' || coded
    ELSE left(coded, 40) || chr(13) || chr(10) || substr(coded, 41) END"""
ENCODED_SQL = f"SELECT doc_id, source, to_base64(unhex({LEAD}) || encode(text)) AS coded FROM documents"
DECODED_CTE = f"""
    encoded AS ({ENCODED_SQL}),
    files AS (SELECT {PATH} AS path, {FOLDER} AS folder, {CONTENT} AS content FROM encoded),
    bare AS (
        SELECT path, folder, regexp_replace(replace(replace(replace(replace(content, '<img src="', ''),
               'data:image/jpeg;base64,', ''), 'data:image/png;base64,', ''),
               'data:application/pdf;base64,', ''), '[^A-Za-z0-9+/=]', '', 'g') AS p
        FROM files),
    decoded AS (
        SELECT path, folder,
               CASE WHEN starts_with(p, 'JVBERi0') THEN '.pdf' WHEN starts_with(p, '/9j/') THEN '.jpg'
                    WHEN starts_with(p, 'iVBORw0KGgo') THEN '.png' ELSE '.bin' END AS ext,
               TRY(from_base64(CASE WHEN length(p) % 4 = 0 THEN p
                               ELSE p || repeat('=', CAST(4 - length(p) % 4 AS INT)) END)) AS content
        FROM bare WHERE p <> '')"""


def files(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    coded = F.base64(F.concat(F.unhex(F.expr(LEAD)), F.encode("text", "UTF-8")))
    return docs.withColumn("coded", coded).selectExpr(f"{PATH} AS path", f"{CONTENT} AS content")


@query("payloads_decoded", f"""WITH {DECODED_CTE}
    SELECT path, folder, ext, sha256(content) AS digest, octet_length(content) AS bytes,
           CASE WHEN content IS NULL THEN 'invalid base64' ELSE '' END AS error
    FROM decoded""")
def payloads_decoded(spark, sf_dir):
    return decode_payloads(files(spark, sf_dir)).select(
        "path", "folder", "ext", F.sha2("content", 256).alias("digest"),
        F.octet_length("content").cast("long").alias("bytes"), "error")


@query("payloads_named", f"""WITH {DECODED_CTE},
    numbered AS (SELECT *, row_number() OVER (PARTITION BY folder, ext ORDER BY path) - 1 AS nth
                 FROM decoded WHERE content IS NOT NULL)
    SELECT path, folder || CASE WHEN nth = 0 THEN '' ELSE '_' || nth END || ext AS name, ext,
           sha256(content) AS digest
    FROM numbered""")
def payloads_named(spark, sf_dir):
    named = name_payloads(decode_payloads(files(spark, sf_dir)))
    return named.select("path", "name", "ext", F.sha2("content", 256).alias("digest"))
