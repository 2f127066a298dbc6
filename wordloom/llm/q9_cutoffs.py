"""p9 queries: texts whose end is missing."""

from __future__ import annotations

from wordloom.llm import cutoffs
from wordloom.session import spread, table


def _judged(spark, d):
    return cutoffs.judge(spread(table(spark, d, "documents", "doc_id", "text", "source", "n_chars")))


def p9_found(spark, d):
    return _judged(spark, d).filter("cut").select("doc_id")


def p9_by_source(spark, d):
    return cutoffs.by_source(_judged(spark, d))


QUERIES = {"p9_found": p9_found, "p9_by_source": p9_by_source}
