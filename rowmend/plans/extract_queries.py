"""Field extraction over whole document texts under marksheet headings."""

from __future__ import annotations

from rowmend.functions import document_rules as rules
from rowmend.operators.extract import extract_fields, for_review, review_count
from rowmend.plans.registry import derived, derived_sql, query

NL = " || chr(10) || "


def _page(*lines: str) -> str:
    return NL.join(lines)


ID = "CAST(doc_id AS STRING)"
PAGES = [
    _page("'Statement of Marks for Bachelor of Arts Examination  2017'", "'University of  Mysore'",
          f"'Roll No: AB' || {ID}", "'Candidate''s Name: Ann Lee'", "'Study Centre: City College of Arts'",
          "'Result: Pass'", "text"),
    _page("'SEAT NO.'", f"'S-' || {ID} || 'x'", "'DISCIPLINE'", "'Civil Engineering.'", "'Centre'",
          "'12 Green Valley School'", "'| State Board of Examinations |'", "'RAVI KUMAR'", "'--- Page 2'",
          "'established 1956'", "'Year of Passing 2018'", "'needs improvement'", "text"),
    "text",
    "' ' || chr(10) || chr(9)",
    _page(f"'Registration No. 77/' || {ID} || '-A'", "'Mother name: Eva Paul'", "'Shri / Smt. Peter  Paul'",
          "'Course Name : B.Com.'", "'Trade: none'", "'Polytechnic Campus'",
          "'has appeared for the exam dated 03-04-1999'", "'Board Council Mysore'", "'Council Board Mysore'",
          "text"),
    _page("'Roll'", "'name'", "'roll no'", f"'Z99 ' || {ID}", "'course'", "'xy'", "'Programme'",
          "'Fine Arts'", "'school'", "'no'", "'3 Hill Academy'", "'Student''s Name: 12 Tom'",
          "'TOM O HARA'", "'he did fail'", "'members of the Board of Studies'", "text"),
    _page("'University examination result'", "text"),
    _page("'promoted to semester 4, grade B'", f"'enrollment no: ' || {ID}", "text"),
    _page("'student course completed ' || CAST(1990 + doc_id % 40 AS STRING)", "'Name: Eva  Maria'", "text"),
]
CASES = " ".join(f"WHEN {i} THEN {page}" for i, page in enumerate(PAGES))
DOCS = {
    "file": f"'doc_' || {ID} || '.pdf'",
    "body": f"CASE doc_id % {len(PAGES)} {CASES} END",
    "confidence": "CAST((doc_id * 37) % 101 AS DOUBLE) / 100",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {_quoted(w)})" for w in words) + ")"


def _in(text: str, words) -> str:
    return f"{text} IN ({', '.join(_quoted(w) for w in words)})"


def _clean(text: str) -> str:
    return f"trim(regexp_replace(trim(coalesce({text}, '')), '\\s{{2,}}', ' ', 'g'), {_quoted(rules.VALUE_EDGES)})"


def _words(text: str) -> str:
    return f"(CASE WHEN trim({text}) = '' THEN 0 ELSE len(regexp_extract_all(trim({text}), '\\s+')) + 1 END)"


def _first(items: str) -> str:
    return f"coalesce(({items})[1], '')"


def _match(lines: str, patterns, excluded=()) -> str:
    if excluded:
        lines = f"list_filter({lines}, lambda l: NOT {_any('lower(l)', excluded)})"
    groups = ", ".join(f"nullif({_clean(f'''regexp_extract(l, {_quoted(p)}, 1, 'i')''')}, '')" for p in patterns)
    return _first(f"list_filter(list_transform({lines}, lambda l: coalesce({groups}, '')), lambda v: v <> '')")


def _like_name(v: str) -> str:
    return f"({_words(v)} >= 2 AND NOT regexp_matches({v}, '[0-9]') AND NOT {_any(f'lower({v})', rules.NAME_REJECTS)})"


def _like_roll(v: str) -> str:
    return f"(length({v}) >= 4 AND regexp_matches({v}, '[A-Za-z0-9]') AND NOT {_in(f'lower({v})', rules.ROLL_REJECTS)})"


def _next(headings, accept: str) -> str:
    below = f"list_transform(ls, lambda l, i: CASE WHEN {_in('lower(l)', headings)} THEN {_clean('ls[i + 1]')} END)"
    return _first(f"list_filter({below}, lambda v: v IS NOT NULL AND v <> '' AND {accept})")


YEAR = "'\\b(19\\d{2}|20\\d{2}|21\\d{2})\\b'"
STATUS = "CASE " + " ".join(
    f"WHEN regexp_matches(blob, {_quoted(p)}) THEN {_quoted(s)}" for s, p in rules.STATUS_RULES
) + " ELSE 'Unknown' END"
CAPITALS = f"""({_like_name('v')} AND len(regexp_extract_all(v, '\\p{{Lu}}')) /
    greatest(len(regexp_extract_all(v, '\\p{{L}}')), 1) > 0.8 AND {_words('v')} <= 4
    AND NOT {_any('lower(v)', rules.NAME_LINE_REJECTS)})"""
BELOW = f"""flatten(list_transform(ls, lambda l, i: CASE WHEN {_any('lower(l)', rules.INSTITUTE_HEADINGS)}
    THEN [regexp_replace({_clean('ls[i + 1]')}, '^\\d+\\s*', ''),
          regexp_replace({_clean('ls[i + 2]')}, '^\\d+\\s*', '')] ELSE [] END))"""
REPORT_CTE = f"""
    docs AS ({derived_sql('documents', DOCS)}),
    cleaned AS (
        SELECT file, confidence, trim(regexp_replace(regexp_replace(body, '[ \\t]+', ' ', 'g'),
               '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM docs),
    gated AS (
        SELECT *, ({' + '.join(f"CAST(contains(lower(t), {_quoted(w)}) AS INT)" for w in rules.RELEVANT_WORDS)}) >= 2
               AS ok FROM cleaned),
    split AS (
        SELECT *, CASE WHEN ok THEN list_filter(list_transform(
            regexp_split_to_array(t, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'),
            lambda l: trim(regexp_replace(trim(l), '[|]+', ' ', 'g'))),
            lambda l: l <> '' AND NOT starts_with(l, '--- Page')) ELSE [] END AS ls FROM gated),
    matched AS (
        SELECT *, lower(array_to_string(ls, ' ')) AS blob, {_match('ls', rules.ROLL_PATTERNS)} AS roll,
               {_match('ls', rules.NAME_PATTERNS, rules.NAME_LINE_EXCLUDES)} AS name,
               {_match('ls', rules.COURSE_PATTERNS)} AS course,
               {_match('ls', rules.INSTITUTE_PATTERNS)} AS institute,
               list_filter(ls, lambda l: {_any('lower(l)', rules.UNIVERSITY_WORDS)}
                   AND NOT {_any('lower(l)', rules.UNIVERSITY_REJECTS)}
                   AND {_words(_clean('l'))} BETWEEN 2 AND 10) AS unis
        FROM split),
    fields AS (
        SELECT file, confidence, t, ok,
            CASE WHEN {_like_roll('roll')} THEN roll ELSE {_next(rules.ROLL_HEADINGS, _like_roll('v'))} END
                AS roll_no,
            {_first(f"list_sort(list_transform(unis, lambda l: struct_pack(r := -length({_clean('l')}), n := {_clean('l')})))")
              .replace('[1]', '[1].n')} AS university,
            CASE WHEN course <> '' AND NOT {_in('lower(course)', rules.COURSE_REJECTS)} THEN course
                 ELSE {_next(rules.COURSE_HEADINGS, 'length(v) > 2')} END AS course_name,
            {_first(f'''list_filter(list_transform(list_concat(
                list_filter(ls, lambda l: {_any('lower(l)', rules.YEAR_LINE_WORDS)}), ls),
                lambda l: regexp_extract(l, {YEAR}, 1)), lambda y: y <> '')''')} AS year,
            CASE WHEN {_like_name('name')} THEN name ELSE {_first(
                f"list_filter(list_transform(ls, lambda l: {_clean('l')}), lambda v: {CAPITALS})")} END AS candidate,
            CASE WHEN ok THEN {STATUS} ELSE 'Unknown' END AS status,
            CASE WHEN {_any('lower(institute)', rules.INSTITUTE_WORDS)}
                  AND NOT {_in('lower(institute)', rules.INSTITUTE_REJECTS)} THEN institute
                 ELSE {_first(f"list_filter({BELOW}, lambda v: {_any('lower(v)', rules.INSTITUTE_WORDS)})")} END
                AS institute_name
        FROM matched),
    scored AS (
        SELECT *, CASE WHEN ok THEN round_even(0.7::DOUBLE * confidence + 0.3::DOUBLE * round_even((
            CAST(roll_no <> '' AS INT) + CAST(university <> '' AS INT) + CAST(course_name <> '' AS INT)
            + CAST(year <> '' AS INT) + CAST(candidate <> '' AS INT) + CAST(institute_name <> '' AS INT))
            / 6.0::DOUBLE, 2), 4) ELSE 0.0::DOUBLE END AS total
        FROM fields),
    report AS (
        SELECT file AS "File Name", roll_no AS "Roll No", university AS "University Name",
            {_clean('course_name')} AS "Course Name", year AS "Passing Year", candidate AS "Candidate Name",
            status AS "Passing Status", institute_name AS "Institute Name", total AS "Confidence",
            confidence AS "OCR Confidence",
            CASE WHEN t = '' THEN 'No text extracted' WHEN NOT ok THEN 'Skipped: not an education document'
                 ELSE 'Success' END AS "Status",
            CASE WHEN t = '' THEN 'none' WHEN NOT ok THEN 'skipped' ELSE 'smart_rules' END AS "Extraction Mode",
            (candidate = '' OR year = '' OR total < 0.60 OR NOT ok) AS "Review Required"
        FROM scored)"""


def report(spark, sf_dir):
    docs = derived(spark, sf_dir, "documents", DOCS, needs=["doc_id", "text"])
    return extract_fields(docs, "file", "body", "confidence")


@query("extracted_fields", f"WITH {REPORT_CTE} SELECT * FROM report")
def extracted_fields(spark, sf_dir):
    return report(spark, sf_dir)


@query("extracted_for_review", f"""WITH {REPORT_CTE} SELECT * FROM report WHERE "Review Required" """)
def extracted_for_review(spark, sf_dir):
    return for_review(report(spark, sf_dir))


@query("extracted_review_count", f"""WITH {REPORT_CTE}
    SELECT count(*) AS documents, count(*) FILTER ("Review Required") AS review_count FROM report""")
def extracted_review_count(spark, sf_dir):
    return review_count(report(spark, sf_dir))
