"""Pieces that several query modules share: the token tables and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.plans import tables
from wordloom.session import spread, table

BOUNDARY_SQL = "[.!?;:\\n\\x{05C3}]|--"
#: sent(doc_id, source, sent_id, s), toks(doc_id, source, sent_id, a), tok(doc_id, source, sent_id, pos, n, token).
TOK = f"""sent AS (SELECT doc_id, source, unnest(string_split_regex(text, '{BOUNDARY_SQL}')) AS s, generate_subscripts(string_split_regex(text, '{BOUNDARY_SQL}'), 1) - 1 AS sent_id FROM documents),
  toks AS (SELECT doc_id, source, sent_id, regexp_extract_all(s, '[א-ת]+') AS a FROM sent),
  tok AS (SELECT doc_id, source, sent_id, unnest(a) AS token, generate_subscripts(a, 1) - 1 AS pos, len(a) AS n FROM toks)"""
#: ids(doc_id, source, sent_id, pos, n, token, id): tokens with their lexicon id, null if they have none.
IDS = f"{TOK}, ids AS (SELECT tok.*, word_id AS id FROM tok LEFT JOIN lexicon ON word = token)"


def log_sql(x: str) -> str:
    return f"least(255, greatest(0, round(round(log2({x} + 1) * 8, 6))))::INT"


def hash_sql(line: str) -> str:
    """The content hash of a group's lines."""
    sums = ", ".join(f"coalesce(sum(('0x' || substr(md5({line}), {1 + 8 * i}, 8))::BIGINT), 0)::VARCHAR" for i in range(4))
    return f"sha256(concat_ws(',', count({line})::VARCHAR, {sums}))"


#: bi(first_id, second_id, cnt, log_count): adjacent pairs seen at least five times.
BI = f"""{IDS}, adj AS (SELECT id AS first_id, lead(id) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS second_id FROM ids),
  allbi AS (SELECT first_id, second_id, count(*) AS cnt FROM adj WHERE first_id IS NOT NULL AND second_id IS NOT NULL GROUP BY 1, 2),
  bi AS (SELECT first_id, second_id, cnt, {log_sql('cnt')} AS log_count FROM allbi WHERE cnt >= 5)"""


def docs(spark, d):
    return spread(table(spark, d, "documents", "doc_id", "source", "text"))


def sents(spark, d):
    return tables.sentence_tokens(docs(spark, d))


def toks(spark, d):
    return tables.explode_tokens(sents(spark, d))


def lex(spark, d):
    return table(spark, d, "lexicon", "word_id", "word", "cnt", "log_freq")


def bi(spark, d, min_count=5):
    return tables.pruned(tables.bigrams(sents(spark, d), lex(spark, d)), min_count)


def r6(c):
    return F.round(c, 6)
