"""p5: items that appear together, by stripes, and how much more often than chance.

A stripe is an item's associative array of neighbours. Each unordered pair lies in the stripe of its lesser item, so
nothing is stored twice. Stripes are made in pieces, by a hash of the neighbour, and rows are salted by their session
before the first shuffle: no item, pair or user, however hot, is one task's burden, and both shuffles move partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.session import materialize, small

#: Rows of one pair, and neighbours of one item, that a task takes at most if it gets no others; least numbers of ways to split them.
PAIR_ROWS, STRIPE_ITEMS = 2_000_000, 100_000
PAIR_SALTS, STRIPE_PIECES = 8, 16


def stripes(log: DataFrame, first: str = "first_id", second: str = "second_id", cnt: str = "cnt", session: str = "session_id", obs: str = "obs_id") -> DataFrame:
    """(item, piece, total, neighbours): ``neighbours`` is an array of (item, t, s) with t the summed count and s the distinct
    sessions of the pair, ``total`` the sum of its t. Each pair of items is in one stripe piece, that of the lesser item.

    Rows with a null or negative id, twice the same item or a null or non-positive count take no part. Rows repeated
    under one ``obs`` count once; rows of one pair and session without an ``obs`` count once together. A null session
    adds to t but is no session.

    The ways to split follow the number of rows: were they all of one pair, or of one item, no task would get too many.
    """
    n = log.count()  # from the files' footers where ``log`` is a table
    salts, pieces = max(PAIR_SALTS, -(-n // PAIR_ROWS)), max(STRIPE_PIECES, min(-(-n // STRIPE_ITEMS), 1024))
    rows = log.filter((F.col(first) >= 0) & (F.col(second) >= 0) & (F.col(first) != F.col(second)) & (F.col(cnt) > 0)).select(
        F.least(first, second).alias("a"), F.greatest(first, second).alias("b"), F.pmod(F.hash(session), F.lit(salts)).cast("int").alias("salt"),
        F.col(session).alias("session"), F.col(obs).alias("obs"), F.col(cnt).cast("bigint").alias("cnt"),
    )
    # One shuffle serves three aggregations, as each groups by more columns than it was shuffled by.
    rows = rows.repartition("a", "b", "salt")
    once = rows.groupBy("a", "b", "salt", "session", "obs").agg(F.max("cnt").alias("cnt"))
    by_session = once.groupBy("a", "b", "salt", "session").agg(F.sum("cnt").alias("t"))
    part = by_session.groupBy("a", "b", "salt").agg(F.sum("t").alias("t"), F.count("session").alias("s"))
    part = part.select("a", "b", F.pmod(F.hash("b"), F.lit(pieces)).cast("int").alias("piece"), "t", "s").repartition("a", "piece")
    merged = part.groupBy("a", "piece", "b").agg(F.sum("t").alias("t"), F.sum("s").alias("s"))
    return merged.groupBy("a", "piece").agg(F.sum("t").alias("total"), F.collect_list(F.struct(F.col("b").alias("item"), "t", "s")).alias("neighbours")).withColumnRenamed("a", "item")


def item_weights(striped: DataFrame) -> DataFrame:
    """(item, w): the summed count of all pairs that an item is in, on either side."""
    own = striped.select("item", F.col("total").alias("t"))
    other = striped.select(F.explode("neighbours").alias("n")).select(F.col("n.item").alias("item"), F.col("n.t").alias("t"))
    return own.union(other).groupBy("item").agg(F.sum("t").alias("w"))


def _entropy(*counts: Column) -> Column:
    """Sum of x ln x."""
    out = F.lit(0.0)
    for c in counts:
        out = out + F.when(c > 0, c * F.log(c)).otherwise(F.lit(0.0))
    return out


def log_likelihood(t: Column, wa: Column, wb: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of the table of the pair, either item alone, and neither."""
    k11, k12, k21 = t.cast("double"), (wa - t).cast("double"), (wb - t).cast("double")
    k22 = F.greatest((n - wa - wb + t).cast("double"), F.lit(0.0))
    total = k11 + k12 + k21 + k22
    g = _entropy(k11, k12, k21, k22) + _entropy(total) - _entropy(k11 + k12, k21 + k22) - _entropy(k11 + k21, k12 + k22)
    return F.greatest(2 * g, F.lit(0.0))


def associations(log: DataFrame, min_sessions: int = 1, **columns: str) -> DataFrame:
    """(first_id, second_id, t, s, w_first, w_second, n, lift, llr) of each pair seen in at least ``min_sessions`` sessions,
    the smaller id first. The weights and n are those of all pairs, whatever their sessions."""
    striped = materialize(stripes(log, **columns), "p5-stripes")
    n = striped.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first().n
    weights = small(materialize(item_weights(striped), "p5-weights"))
    pairs = striped.select(F.col("item").alias("first_id"), F.explode(F.filter("neighbours", lambda x: x["s"] >= min_sessions)).alias("n"))
    pairs = pairs.select("first_id", F.col("n.item").alias("second_id"), "n.t", "n.s")
    for side in ("first", "second"):
        pairs = pairs.join(weights.select(F.col("item").alias(f"{side}_id"), F.col("w").alias(f"w_{side}")), f"{side}_id")
    total = F.lit(n).cast("bigint")
    lift = F.col("t").cast("double") * n / (F.col("w_first").cast("double") * F.col("w_second"))
    return pairs.select("first_id", "second_id", "t", "s", "w_first", "w_second", total.alias("n"), lift.alias("lift"), log_likelihood(F.col("t"), F.col("w_first"), F.col("w_second"), total).alias("llr"))


def above_chance(pairs: DataFrame, times: int) -> DataFrame:
    """Pairs seen at least ``times`` as often as chance would have them; the test is in whole numbers, without rounding."""
    big = "decimal(38,0)"
    return pairs.filter(F.col("t").cast(big) * F.col("n").cast("decimal(19,0)") >= (F.col("w_first").cast("decimal(19,0)") * F.col("w_second").cast("decimal(18,0)")) * F.lit(times))
