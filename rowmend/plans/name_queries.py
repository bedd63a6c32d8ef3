"""Name cleaning over order contacts and pairwise name scoring over parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmend.functions.similarity import simple_soundex
from rowmend.functions.word_lists import ADDRESS_WORDS, BUSINESS_WORDS, GENERIC_WORDS, HONORIFICS
from rowmend.operators.name_clean import categorise, name_summary, reason_breakdown, route_names
from rowmend.operators.name_match import match_names
from rowmend.plans.registry import derived, derived_sql, query, table

# One raw name per rule; the order key varies the harmless ones.
RAW_NAMES = [
    "''", "'a' || CAST(o_orderkey AS STRING) || '@b.org'", "'see www.site.org now'",
    "CAST(o_orderkey AS STRING)", "'Mr.'", "'guest'", "'Guest  unknown'",
    "'Ann 123456 ' || CAST(o_orderkey AS STRING)", "'A'", "'A B'", "'City Hospital Pharmacy'",
    "'Flat near Road'", "'Ravi, 4th Cross'", "'Bank 1' || lpad(CAST(o_orderkey % 1000 AS STRING), 4, '2')",
    "'MR ravi  ravi kumar'", "'Ann Lee Ann Lee'", "'one two three four five six seven'",
    "'Dr. José Núñez'", "'customer PETER o''neil'", "'Zoë  van der Berg'", "o_orderpriority",
    "'a bb ccc dddd eeeee ffffff'", "'https://x.org'", "'test demo'", "'school Ravi'",
]
CASES = " ".join(f"WHEN {i} THEN {text}" for i, text in enumerate(RAW_NAMES))
CONTACTS = {
    "phone": "' +91 ' || CAST(o_custkey AS STRING)",
    "response": f"CASE o_orderkey % {len(RAW_NAMES)} {CASES} END",
    "state": """CASE o_orderkey % 4 WHEN 0 THEN 'Found' WHEN 1 THEN ' found ' WHEN 2 THEN 'Not Found'
        ELSE CAST(NULL AS STRING) END""",
}


def _listed(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _hits(words: list[str]) -> str:
    return f"len(list_filter(regexp_extract_all(lower(o), '[a-z]+'), lambda w: w IN {_listed(words)}))"


def names_cte(contacts: str) -> str:
    """Verdicts over the phone, response and state of some contacts."""
    return f"""
    raw AS (
        SELECT trim(regexp_replace(phone, '\\s+', ' ', 'g')) AS mobile,
               trim(regexp_replace(coalesce(response, ''), '\\s+', ' ', 'g')) AS o,
               trim(regexp_replace(coalesce(state, ''), '\\s+', ' ', 'g')) AS status
        FROM ({contacts})),
    letters AS (SELECT *, lower(trim(regexp_replace(strip_accents(o), '[^A-Za-z]+', ' ', 'g'))) AS l FROM raw),
    w1 AS (SELECT *, list_filter(string_split(l, ' '), lambda w: w <> '' AND w NOT IN {_listed(HONORIFICS)}) AS a
           FROM letters),
    w2 AS (SELECT *, CASE WHEN len(a) > 0 AND a[1] IN {_listed(GENERIC_WORDS)} THEN a[2:] ELSE a END AS b FROM w1),
    w3 AS (SELECT *, CASE WHEN len(b) >= 4 AND len(b) % 2 = 0 AND b[1:len(b)//2] = b[len(b)//2+1:]
                          THEN b[1:len(b)//2] ELSE b END AS c FROM w2),
    w4 AS (SELECT *, list_filter(c, lambda w, i: list_position(c, w) = i) AS d FROM w3),
    named AS (SELECT *, array_to_string(list_transform(d, lambda w: upper(w[1]) || w[2:]), ' ') AS n,
                     len(regexp_extract_all(o, '[0-9]')) AS digits, contains(o, ',') AS comma,
                     {_hits(ADDRESS_WORDS)} AS ah, {_hits(BUSINESS_WORDS)} AS bh FROM w4),
    judged AS (
        SELECT *, CASE
            WHEN o = '' THEN 'empty_original'
            WHEN contains(o, '@') OR contains(lower(o), 'http://') OR contains(lower(o), 'https://')
                 OR contains(lower(o), 'www.') THEN 'contains_email_or_url'
            WHEN l = '' THEN 'empty_after_cleaning'
            WHEN len(a) = 0 THEN 'only_honorific'
            WHEN len(b) = 0 THEN 'generic_non_name'
            WHEN digits >= 6 THEN 'contains_many_digits'
            WHEN length(n) <= 1 THEN 'too_short'
            WHEN len(d) = 1 AND lower(n) IN {_listed(GENERIC_WORDS)} THEN 'generic_non_name'
            WHEN len(list_filter(d, lambda w: length(w) > 1)) = 0 THEN 'initials_only'
            WHEN len(d) > 6 THEN 'too_long'
            WHEN bh >= 2 THEN 'business_name'
            WHEN ah >= 2 OR (ah >= 1 AND (digits >= 1 OR comma)) OR (digits >= 4 AND (ah >= 1 OR bh >= 1))
                 THEN 'looks_like_address'
            ELSE '' END AS removed_reason
        FROM named),
    consolidate AS (
        SELECT mobile, o AS lookup_response, CASE WHEN removed_reason = '' THEN n ELSE '' END AS cleaned_name,
               status, CASE WHEN lower(status) = 'found' THEN 'Found' ELSE 'Not Found' END AS status_bucket,
               CASE WHEN removed_reason = '' THEN 'Yes' ELSE 'No' END AS is_clean, removed_reason
        FROM judged)"""


NAMES_CTE = names_cte(derived_sql("orders", CONTACTS))


def consolidate(spark, sf_dir):
    contacts = derived(spark, sf_dir, "orders", CONTACTS, needs=["o_orderkey", "o_custkey", "o_orderpriority"])
    return categorise(contacts, "phone", "response", "state")


@query("names_consolidate", f"WITH {NAMES_CTE} SELECT * FROM consolidate")
def names_consolidate(spark, sf_dir):
    return route_names(consolidate(spark, sf_dir))["consolidate"]


@query("names_clean_with_not_found", f"""WITH {NAMES_CTE}
    SELECT mobile, cleaned_name AS name, lookup_response, status, status_bucket
    FROM consolidate WHERE is_clean = 'Yes'""")
def names_clean_with_not_found(spark, sf_dir):
    return route_names(consolidate(spark, sf_dir))["clean_with_not_found"]


@query("names_only_clean", f"""WITH {NAMES_CTE}
    SELECT mobile, cleaned_name AS name, lookup_response, status
    FROM consolidate WHERE is_clean = 'Yes' AND status_bucket = 'Found'""")
def names_only_clean(spark, sf_dir):
    return route_names(consolidate(spark, sf_dir))["only_clean"]


@query("names_not_found_data", f"""WITH {NAMES_CTE}
    SELECT mobile, lookup_response, cleaned_name, status, is_clean, removed_reason
    FROM consolidate WHERE status_bucket <> 'Found'""")
def names_not_found_data(spark, sf_dir):
    return route_names(consolidate(spark, sf_dir))["not_found_data"]


@query("names_summary", f"""WITH {NAMES_CTE}
    SELECT count(*) AS total_rows, count(*) FILTER (status_bucket = 'Found') AS found_rows,
           count(*) FILTER (status_bucket <> 'Found') AS not_found_rows,
           count(*) FILTER (is_clean = 'Yes') AS clean_names_total,
           count(*) FILTER (is_clean = 'No') AS non_clean_names_total,
           count(*) AS consolidate_rows, count(*) FILTER (is_clean = 'Yes') AS clean_with_not_found_rows,
           count(*) FILTER (is_clean = 'Yes' AND status_bucket = 'Found') AS only_clean_rows,
           count(*) FILTER (status_bucket <> 'Found') AS not_found_data_rows
    FROM consolidate""")
def names_summary(spark, sf_dir):
    return name_summary(consolidate(spark, sf_dir))


@query("names_reason_breakdown", f"""WITH {NAMES_CTE}
    SELECT removed_reason, count(*) AS rows FROM consolidate WHERE is_clean = 'No' GROUP BY 1""")
def names_reason_breakdown(spark, sf_dir):
    return reason_breakdown(consolidate(spark, sf_dir))


# Each part against the next one, with titles and suffixes on some.
LEFT_PART = {
    "id": "p_partkey",
    "left_name": """CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN 'Mr. ' || p_name
        WHEN p_partkey % 7 = 0 THEN p_name || ', Jr' WHEN p_partkey % 4 = 0 THEN p_name || ' ' || p_type
        ELSE p_name END""",
}
RIGHT_PART = {
    "id": "p_partkey - 1",
    "right_name": """CASE WHEN p_partkey % 19 = 0 THEN CAST(NULL AS STRING)
        WHEN p_partkey % 3 = 0 THEN 'dr.' || p_name WHEN p_partkey % 6 = 1 THEN upper(p_name)
        ELSE p_name || '-' || p_type END""",
}


def _scrub(c: str) -> str:
    plain = (f"upper(trim(regexp_replace(translate(coalesce({c}, ''), '.,:;/\\-_' || chr(9), "
             f"'         '), '\\s+', ' ', 'g')))")
    heads = "(?:MR |MRS |MS |MISS |DR |PROF |SIR |MADAM |SHRI |SMT )"
    tails = "(?:(?:^| )(?:JR|SR|JUNIOR|SENIOR|II|III|ESQ))+$"
    return f"regexp_replace(regexp_replace({plain}, '^(?:{heads}\\s*)+', ''), '{tails}', '')"


def _sql_soundex(word: str) -> str:
    letters = f"regexp_replace(upper({word}), '[^A-Z]', '', 'g')"
    codes = f"translate(substr({letters}, 2), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000')"
    for digit in "123456":
        codes = f"regexp_replace({codes}, '{digit}+', '{digit}', 'g')"
    return (f"CASE WHEN {letters} = '' THEN '' ELSE "
            f"left(rpad(left({letters}, 1) || replace({codes}, '0', ''), 4, '0'), 4) END")


PAIRS_CTE = f"""
    pairs AS (SELECT l.id, l.left_name, r.right_name
              FROM ({derived_sql('part', LEFT_PART)}) l LEFT JOIN ({derived_sql('part', RIGHT_PART)}) r ON l.id = r.id),
    scrubbed AS (SELECT *, {_scrub('left_name')} AS a, {_scrub('right_name')} AS b FROM pairs),
    scored AS (
        SELECT *, CASE WHEN a <> '' AND b <> '' THEN round_even(jaro_winkler_similarity(a, b) * 100, 1) END AS s,
               string_split(a, ' ') AS ta, string_split(b, ' ') AS tb FROM scrubbed),
    parts AS (SELECT *, ta[1] AS fa, tb[1] AS fb, ta[-1] AS la, tb[-1] AS lb FROM scored)"""
NOTE = f"""
    CASE WHEN a = '' AND b = '' THEN 'Both blank' WHEN a = '' OR b = '' THEN 'One name missing' ELSE
        CASE WHEN s >= 98 THEN 'Exact match'
             WHEN s >= 90 AND fa = fb AND la = lb THEN 'Very strong match (minor spelling differences)'
             WHEN s >= 90 THEN 'Very strong match'
             WHEN s >= 75 AND fa = fb AND la <> lb THEN 'Strong match (first name identical, surname differs)'
             WHEN s >= 75 AND fa = fb THEN 'Strong match (first name matched)'
             WHEN s >= 75 THEN 'Strong partial match'
             WHEN s >= 50 AND fa = fb THEN 'Partial match (first name same)'
             WHEN s >= 50 THEN 'Partial / phonetic match' ELSE 'Low similarity' END
        || CASE WHEN len(ta) <> len(tb) AND (fa = fb OR la = lb)
                THEN ' (possible extra or missing middle name)' ELSE '' END
        || CASE WHEN s >= 90 THEN ''
                WHEN {_sql_soundex('fa')} = {_sql_soundex('fb')} THEN ' (first name sounds similar)'
                WHEN {_sql_soundex('la')} = {_sql_soundex('lb')} THEN ' (surname sounds similar)'
                ELSE '' END END"""


def pairs(spark, sf_dir):
    return derived(spark, sf_dir, "part", LEFT_PART).join(derived(spark, sf_dir, "part", RIGHT_PART), "id", "left")


@query("name_pairs_scored", f"""WITH {PAIRS_CTE}
    SELECT id, left_name, right_name, s AS score, {NOTE} AS "Notes" FROM parts""")
def name_pairs_scored(spark, sf_dir):
    return match_names(pairs(spark, sf_dir), "left_name", "right_name", "score")


@query("name_pairs_notes", f"""WITH {PAIRS_CTE}
    SELECT {NOTE} AS "Notes", count(*) AS pairs FROM parts GROUP BY 1""")
def name_pairs_notes(spark, sf_dir):
    scored = match_names(pairs(spark, sf_dir), "left_name", "right_name")
    return scored.groupBy("Notes").agg(F.count("*").alias("pairs"))


@query("name_soundex", f"""
    SELECT p_partkey, {_sql_soundex("p_name")} AS whole, {_sql_soundex("p_type")} AS kind,
           {_sql_soundex("CAST(p_partkey AS VARCHAR)")} AS digits FROM part""")
def name_soundex(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", simple_soundex(F.col("p_name")).alias("whole"),
        simple_soundex(F.col("p_type")).alias("kind"),
        simple_soundex(F.col("p_partkey").cast("string")).alias("digits"))


# Names and lines that the tables hold themselves.
GIVEN_SQL = """
    SELECT CAST(p_partkey AS VARCHAR) AS phone, p_name AS response, p_brand AS state FROM part
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, 'Found' FROM customer
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name || ', ' || CAST(s_nationkey AS VARCHAR), 'not found' FROM supplier
    UNION ALL SELECT CAST(doc_id AS VARCHAR), unnest(string_split(text, chr(10))), source FROM documents WHERE lang = 'en'"""


@query("names_of_given_texts", f"WITH {names_cte(GIVEN_SQL)} SELECT * FROM consolidate")
def names_of_given_texts(spark, sf_dir):
    """Names of parts, customers and suppliers, and every line of the English documents."""
    names = [table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS STRING) AS phone", "p_name AS response", "p_brand AS state"),
             table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS STRING)", "c_name", "'Found'"),
             table(spark, sf_dir, "supplier").selectExpr(
                 "CAST(s_suppkey AS STRING)", "concat(s_name, ', ', CAST(s_nationkey AS STRING))", "'not found'"),
             table(spark, sf_dir, "documents").where("lang = 'en'").select(
                 F.col("doc_id").cast("string"), F.explode(F.split("text", "\n")), "source")]
    contacts = names[0]
    for more in names[1:]:
        contacts = contacts.union(more)
    return categorise(contacts, "phone", "response", "state")
