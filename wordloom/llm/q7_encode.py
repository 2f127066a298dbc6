"""p7 queries: the corpus as token ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.llm import bpe
from wordloom.session import spread, table


def p7_ids(spark, d):
    return bpe.encode(spread(table(spark, d, "documents", "doc_id", "text")))


def p7_tokens_by_source(spark, d):
    """Documents, tokens and characters per token of each source."""
    docs = table(spark, d, "documents", "doc_id", "source", "text")
    n = bpe.count_tokens(docs.select("doc_id", "text"))
    sizes = docs.select("doc_id", "source", F.length("text").alias("chars")).join(n, "doc_id")
    return sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.round(F.sum("chars") / F.sum("n_tokens"), 4).alias("chars_per_token"))


QUERIES = {"p7_ids": p7_ids, "p7_tokens_by_source": p7_tokens_by_source}
