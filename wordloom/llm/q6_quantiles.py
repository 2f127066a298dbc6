"""p6 queries: percentiles of answering times."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.llm import quantiles as Q
from wordloom.session import table

def _answers(spark, d, *more):
    return table(spark, d, "label_answers", "answer_id", "batch_id", "ms", *more).filter("batch_id IS NOT NULL AND ms > 0")


def _qs(limits):
    """The percentiles that there are limits of: whole numbers from 0 to 100, so at most 101."""
    return sorted(r.q for r in limits.filter("q BETWEEN 0 AND 100").select("q").distinct().collect())


def p6_found(spark, d):
    limits = table(spark, d, "ms_limits", "q", "limit_ms")
    parts = Q.sketches(_answers(spark, d), ["batch_id"], "ms", once="answer_id")
    return Q.over_limits(Q.percentiles(Q.merged(parts, ["batch_id"]), ["batch_id"], _qs(limits)), limits).select("batch_id", "q")


def p6_percentiles(spark, d):
    parts = Q.sketches(_answers(spark, d), ["batch_id"], "ms", once="answer_id")
    return Q.percentiles(Q.merged(parts, ["batch_id"]), ["batch_id"], [1, 25, 50, 75, 90, 95, 99])


def p6_daily(spark, d):
    """Percentiles of each day of receipt, and of all days from the days' sketches merged (day null)."""
    rows = _answers(spark, d, "received_at").withColumn("day", F.to_date("received_at"))
    days = Q.merged(Q.sketches(rows, ["day"], "ms", once="answer_id"), ["day"])
    every = Q.merged(days.withColumn("day", F.lit(None).cast("date")), ["day"])
    return Q.percentiles(days.unionByName(every), ["day"], [50, 90, 95])


def p6_prices(spark, d):
    """Percentiles of a column of fractions, the prices of line items by return flag, sketched where they are read."""
    rows = table(spark, d, "lineitem", "l_returnflag", "l_extendedprice")
    return Q.percentiles(Q.merged(Q.sketches(rows, ["l_returnflag"], "l_extendedprice"), ["l_returnflag"]), ["l_returnflag"], [1, 50, 99])


def _within(found, exact, key, value):
    """Whether each percentile lies within one percentage point of rank of its exact place: (key, q, n, ok)."""
    j = found.join(exact.select(F.col(key).alias("_k"), F.col(value).alias("_x")), F.col(key).eqNullSafe(F.col("_k")))
    by = j.groupBy(key, "q", "n").agg((F.count_if(F.col("_x") < F.col("value")) / F.count("*")).alias("lo"), (F.count_if(F.col("_x") <= F.col("value")) / F.count("*")).alias("hi"))
    return by.select(key, "q", "n", ((F.col("lo") <= F.col("q") / 100 + 0.01) & (F.col("hi") >= F.col("q") / 100 - 0.01)).alias("ok"))


def p6_accuracy(spark, d):
    """Each batch's percentiles against their exact ranks over all answers."""
    rows = _answers(spark, d).groupBy("batch_id", "answer_id").agg(F.min("ms").alias("ms"))
    return _within(p6_percentiles(spark, d), rows, "batch_id", "ms")


def p6_price_accuracy(spark, d):
    return _within(p6_prices(spark, d), table(spark, d, "lineitem", "l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice")


QUERIES = {"p6_found": p6_found, "p6_percentiles": p6_percentiles, "p6_daily": p6_daily, "p6_prices": p6_prices, "p6_accuracy": p6_accuracy, "p6_price_accuracy": p6_price_accuracy}
_A = "a AS (SELECT batch_id, answer_id, min(ms) AS ms FROM label_answers WHERE batch_id IS NOT NULL AND ms > 0 GROUP BY 1, 2)"
SQL = {
    # The value at a share of the ranks is the least whose rank reaches it.
    "p6_found": f"""WITH {_A}, r AS (SELECT batch_id, ms, row_number() OVER (PARTITION BY batch_id ORDER BY ms) AS k, count(*) OVER (PARTITION BY batch_id) AS n FROM a)
      SELECT batch_id, q FROM r, (SELECT DISTINCT q, limit_ms FROM ms_limits) WHERE k = greatest(1, ceil(q * n / 100.0 - 1e-9)) AND ms > limit_ms""",
    "p6_accuracy": f"WITH {_A} SELECT batch_id, q::INT AS q, count(*) AS n, true AS ok FROM a, (VALUES (1), (25), (50), (75), (90), (95), (99)) v(q) GROUP BY 1, 2",
    "p6_price_accuracy": "SELECT l_returnflag, q::INT AS q, count(*) AS n, true AS ok FROM lineitem, (VALUES (1), (50), (99)) v(q) GROUP BY 1, 2",
}
