"""Per-user counts that only count once they come back in another session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.numeric import log_scale
from wordloom.profiles import MIN_SESSIONS, RETAIN, USER_CAPACITY


def user_pairs(log: DataFrame) -> DataFrame:
    """(user_id, first_id, second_id, cnt, sessions): how often a user typed a pair, and in how many sessions.

    Each observation counts once; ids below -1 and non-positive counts are refused. A session has one user, so rows are
    first merged per session: a user who holds a large share of all rows is counted by many tasks.
    """
    ok = log.filter((F.col("first_id") >= -1) & (F.col("second_id") >= -1) & (F.col("cnt") > 0))
    once = ok.select("obs_id", "user_id", "session_id", "first_id", "second_id").distinct()
    part = once.groupBy("user_id", "session_id", "first_id", "second_id").agg(F.count("*").alias("cnt"))
    return part.groupBy("user_id", "first_id", "second_id").agg(F.sum("cnt").alias("cnt"), F.count("session_id").alias("sessions"))


def gated(pairs: DataFrame, sessions: int = MIN_SESSIONS) -> DataFrame:
    """Pairs that may be used, with their scaled count."""
    return pairs.filter(F.col("sessions") >= sessions).withColumn("log_count", log_scale(F.col("cnt")))


def evicted(pairs: DataFrame, capacity: int = USER_CAPACITY, retain: float = RETAIN) -> DataFrame:
    """What a user's model keeps: everything up to the capacity; beyond it the share ``retain`` of the capacity, most
    sessions first, then counts, then the lesser ids.

    Users beyond the capacity are told apart by a count. Their pairs are ranked in parts first, as many as the pairs are
    times the capacity, and what a part can't lose is ranked as a whole: no task sorts all pairs of a user.
    """
    keep = int(capacity * retain)
    order = [F.desc("sessions"), F.desc("cnt"), "first_id", "second_id"]
    n = pairs.groupBy("user_id").agg(F.count("*").alias("_n"))
    sized = pairs.join(n, "user_id")
    over = sized.filter(F.col("_n") > capacity)
    part = F.pmod(F.hash("first_id", "second_id"), F.ceil(F.col("_n") / max(capacity, 1)).cast("int"))
    over = over.withColumn("_part", part).withColumn("_k", F.row_number().over(Window.partitionBy("user_id", "_part").orderBy(*order))).filter(F.col("_k") <= keep)
    over = over.withColumn("_k", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).filter(F.col("_k") <= keep)
    return sized.filter(F.col("_n") <= capacity).select(*pairs.columns).unionByName(over.select(*pairs.columns))


def remembered(log: DataFrame, wipes: DataFrame, pauses: DataFrame | None = None) -> DataFrame:
    """The rows of a log that a model may still know: later than their user's last wipe (user_id, ts), and in none of their user's
    pauses (user_id, since, until; ``until`` null for one that lasts). Wiping forgets, pausing only stops learning. Rows
    without a time are forgotten by a wipe and not touched by a pause; users without either keep all."""
    last = wipes.groupBy("user_id").agg(F.max("ts").alias("_wiped"))
    out = log.join(last, "user_id", "left").filter(F.col("_wiped").isNull() | F.coalesce(F.col("ts") > F.col("_wiped"), F.lit(False))).select(*log.columns)
    if pauses is not None:
        p = pauses.groupBy("user_id").agg(F.collect_list(F.struct("since", "until")).alias("_p"))  # a user's own switches
        off = F.exists("_p", lambda x: (F.col("ts") >= x["since"]) & (x["until"].isNull() | (F.col("ts") < x["until"])))
        out = out.join(p, "user_id", "left").filter(~F.coalesce(off, F.lit(False))).select(*log.columns)
    return out
