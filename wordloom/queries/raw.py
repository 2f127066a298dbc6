"""p2: records of verb paradigm files, broken ones set apart."""

from __future__ import annotations

from wordloom.session import table
from wordloom.sources import rawrows


def p2_found(spark, d):
    return rawrows.broken(table(spark, d, "verb_raw", "src_file", "line_no", "raw")).select("src_file", "line_no", "reason")


def p2_broken_fields(spark, d):
    """As ``p2_found``, with the position of the first broken field (one past the last if there is more than the fields)."""
    return rawrows.broken(table(spark, d, "verb_raw", "src_file", "line_no", "raw"))


def p2_loaded(spark, d):
    return rawrows.loaded(table(spark, d, "verb_raw", "src_file", "line_no", "raw"))


def p2_manifest(spark, d):
    parsed = rawrows.parse_records(table(spark, d, "verb_raw", "src_file", "line_no", "raw"))
    return rawrows.against_manifest(parsed, table(spark, d, "parse_stats", "src_file", "rows_read", "rows_rejected"))


QUERIES = {"p2_found": p2_found, "p2_loaded": p2_loaded, "p2_manifest": p2_manifest, "p2_broken_fields": p2_broken_fields}

_F = r'(?:"(?:[^"]|"")*"|[^",][^,]*|)'
_RECORDS = f"""
  recs AS (SELECT src_file, line_no, min(raw) AS raw FROM verb_raw WHERE line_no IS DISTINCT FROM 1 GROUP BY ALL),
  body AS (SELECT src_file, line_no, CASE WHEN right(raw, 1) = chr(13) THEN left(raw, length(raw) - 1) ELSE raw END AS b FROM recs),
  quoted AS (SELECT *, regexp_full_match(b, '(?s){_F}(?:,{_F})*') AS q_ok, regexp_full_match(b, '(?s){_F}(?:,{_F}){{5}}') AS w_ok,
    regexp_extract(b, '(?s)^({_F}),({_F}),({_F}),({_F}),({_F}),({_F})$', ['a1', 'a2', 'a3', 'a4', 'a5', 'a6']) AS f FROM body),
  fields AS (SELECT src_file, line_no, b, q_ok, w_ok,
    {', '.join(f"CASE WHEN f.a{i}[1] = chr(34) THEN replace(f.a{i}[2:-2], chr(34) || chr(34), chr(34)) ELSE f.a{i} END AS v{i}" for i in range(1, 7))} FROM quoted),
  judged AS (SELECT *, CASE WHEN b IS NULL THEN 'columns' WHEN NOT q_ok THEN 'quoting' WHEN NOT w_ok THEN 'columns'
    WHEN NOT (regexp_full_match(regexp_replace(nfc_normalize(v1), '[\\x{{0591}}-\\x{{05C7}}]', '', 'g'), '[א-ת]+')
      AND regexp_full_match(v4, '[0-9]+') AND coalesce(try_cast(v4 AS HUGEINT) <= 2147483647, false)
      AND regexp_full_match(v5, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(v5 AS DATE) IS NOT NULL) THEN 'value' END AS reason FROM fields)
"""
SQL = {
    "p2_found": f"WITH {_RECORDS} SELECT src_file, line_no, reason FROM judged WHERE reason IS NOT NULL",
    "p2_loaded": f"""WITH {_RECORDS} SELECT src_file, line_no, v1 AS vocalized_inflection, v2 AS base_form, v3 AS morphology,
      v4::INT AS attested, v5::DATE AS checked_on, v6 AS note FROM judged WHERE reason IS NULL""",
    "p2_manifest": f"""WITH {_RECORDS}, per AS (SELECT src_file, count(*) AS n_read, count(reason) AS n_rejected,
      count(*) FILTER (reason = 'quoting') AS n_quoting, count(*) FILTER (reason = 'columns') AS n_columns, count(*) FILTER (reason = 'value') AS n_value FROM judged GROUP BY 1),
      said AS (SELECT src_file, max(rows_read) AS stated_read, max(rows_rejected) AS stated_rejected FROM parse_stats GROUP BY 1)
      SELECT *, n_read = stated_read AND n_rejected = stated_rejected AS agrees FROM per FULL OUTER JOIN said USING (src_file)""",
}
