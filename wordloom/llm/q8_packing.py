"""p8 queries: documents into containers of a token capacity."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.llm import bpe, packing
from wordloom.session import materialize, spread, table

#: Attention capacity of a container, as a share of its tokens squared.
ATTENTION = 0.5


def _limits(spark, d):
    row = table(spark, d, "pack_limits", "tokenizer", "capacity_tokens").first()
    return row.tokenizer, packing.Limits(tokens=row.capacity_tokens, attention=ATTENTION * row.capacity_tokens**2)


def _packed(spark, d):
    tokenizer, limits = _limits(spark, d)
    sizes = bpe.count_tokens(spread(table(spark, d, "documents", "doc_id", "text")), name=tokenizer)
    return packing.pack(sizes, limits), limits


def p8_found(spark, d):
    packed, _ = _packed(spark, d)
    return packed.filter("n_pieces > 1 AND piece = 0").select("doc_id")


def p8_packed(spark, d):
    return _packed(spark, d)[0]


def p8_fill(spark, d):
    return packing.fill_report(*_packed(spark, d))


def p8_checked(spark, d):
    """One row: documents and their tokens, pieces of texts of one container or less that were split, tokens in pieces, and containers
    beyond a capacity: tokens, documents, attention."""
    packed, limits = _packed(spark, d)
    packed = materialize(packed, "p8-packed")
    per = packed.groupBy("container").agg(F.sum("length").alias("t"), F.count("*").alias("n"), F.max("length").cast("double").alias("m"), F.sum(F.col("length") * F.col("length")).cast("double").alias("a"))
    over = F.when(F.col("m") * F.col("m") > limits.attention_limit, F.col("a") - F.col("m") * F.col("m") > limits.beside_limit).otherwise(F.col("a") > limits.attention_limit)
    bad = per.agg(F.count_if(F.col("t") > limits.tokens).alias("over_tokens"), F.count_if(F.col("n") > limits.documents).alias("over_documents"), F.count_if(over).alias("over_attention"))
    docs = packed.groupBy("doc_id").agg(F.count("*").alias("k"), F.max("n_pieces").alias("p"), F.sum("length").alias("t"))
    whole = docs.agg(F.count("*").alias("documents"), F.count_if((F.col("k") != F.col("p")) | (F.col("k") != F.greatest(F.lit(1), F.ceil(F.col("t") / limits.tokens)))).alias("wrongly_split"))
    return whole.join(F.broadcast(bad))  # one row each


QUERIES = {"p8_found": p8_found, "p8_packed": p8_packed, "p8_fill": p8_fill, "p8_checked": p8_checked}
SQL = {"p8_checked": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS wrongly_split, 0::BIGINT AS over_tokens, 0::BIGINT AS over_documents, 0::BIGINT AS over_attention FROM documents"}
