"""Simulated users: blocks of sentences whose first part teaches a user's model and whose rest asks it for next words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.numeric import log_scale
from wordloom.operators import lookup as L
from wordloom.plans import tables as T
from wordloom.plans.rank import top
from wordloom.profiles import NEXT_CANDIDATES, SUGGESTIONS, USER_CAP
from wordloom.session import materialize, small

#: The id of all words outside the lexicon.
UNKNOWN = -1


def positions(blocks: DataFrame, lex: DataFrame) -> DataFrame:
    """(block, at, first_id, second_id): neighbours of the sentences (block, at, tokens), ``at`` counted within the block; unknown
    words share one id."""
    pair = F.arrays_zip(F.slice("tokens", F.lit(1), F.size("tokens") - 1).alias("a"), F.slice("tokens", F.lit(2), F.size("tokens") - 1).alias("b"))
    t = blocks.filter(F.size("tokens") > 1).select("block", "at", F.explode(pair).alias("p")).select("block", "at", "p.a", "p.b")
    t = L.ids(t, lex, "a", "first_id", second_id="b").drop("a")
    return t.select("block", "at", F.coalesce("first_id", F.lit(UNKNOWN)).alias("first_id"), F.coalesce("second_id", F.lit(UNKNOWN)).alias("second_id"))


def learnt(taught: DataFrame, by: list[str], sessions: Column | int = 2, weight: Column | None = None) -> DataFrame:
    """(by, first_id, second_id, cnt, log_count): what users learnt from (by, at, first_id, second_id), pairs of at least
    ``sessions`` sentences; ``weight`` is how often one observation counts."""
    one = F.lit(1) if weight is None else weight
    g = taught.groupBy(*by, "first_id", "second_id").agg(F.sum(one).alias("cnt"), F.countDistinct("at").alias("_in"))
    return g.filter(F.col("_in") >= sessions).withColumn("log_count", log_scale(F.col("cnt"))).drop("_in")


def bounded(log: Column, weight: Column | float, cap: int = USER_CAP) -> Column:
    return weight * F.least(F.coalesce(log, F.lit(0)), F.lit(cap))


def ranked(asked: DataFrame, by: list[str], static: DataFrame, mine: DataFrame, score: Callable[[DataFrame], DataFrame] | None = None, n: int = SUGGESTIONS) -> DataFrame:
    """(by, first_id, second_id, rank): the best continuations of each distinct (by, first_id) asked for.

    Candidates are the 16 most frequent of the pair table ``static`` and of the user's ``mine`` (by, first_id, second_id,
    cnt, term); their score is the scaled count plus the term. ``score`` may put further terms into the column ``more`` of
    (by, first_id, second_id, s).
    """
    q = asked.select(*by, "first_id").distinct()
    cut = top(static, ["first_id"], [F.desc("cnt"), F.col("second_id")], NEXT_CANDIDATES, "k").select("first_id", "second_id", F.col("log_count").cast("double").alias("s"))
    own = top(mine, [*by, "first_id"], [F.desc("cnt"), F.col("second_id")], NEXT_CANDIDATES, "k").select(*by, "first_id", "second_id", F.col("term").cast("double").alias("s"))
    rows = q.join(small(cut), "first_id").select(*by, "first_id", "second_id", "s").unionByName(own.join(q, [*by, "first_id"], "left_semi"))
    rows = rows.filter("second_id >= 0").groupBy(*by, "first_id", "second_id").agg(F.sum("s").alias("s"))
    if score is not None:
        rows = score(rows).withColumn("s", F.col("s") + F.coalesce("more", F.lit(0.0)))
    return top(rows, [*by, "first_id"], [F.desc("s"), F.col("second_id")], n).select(*by, "first_id", "second_id", "rank")


def scored(asked: DataFrame, by: list[str], found: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, attempts, offered, top1, top3) of positions (by, first_id, second_id) against the ranked continuations. Positions are
    counted up by their words before anything is looked up."""
    counts = asked.groupBy(*by, "first_id", "second_id").agg(F.count("*").alias("n"))
    offered = found.select(*by, "first_id").distinct().withColumn("_offered", F.lit(1))
    j = counts.join(found, [*by, "first_id", "second_id"], "left").join(offered, [*by, "first_id"], "left")
    n = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).cast("bigint")
    return j.groupBy(*cell).agg(F.sum("n").alias("attempts"), n(F.col("_offered") == 1).alias("offered"), n(F.col("rank") == 1).alias("top1"), n(F.col("rank").isNotNull()).alias("top3"))


def evaluated(pairs: DataFrame, arms: DataFrame, static: DataFrame) -> DataFrame:
    """(arm, attempts, offered, top1, top3) of arms (arm, history, sessions, weight): each block's first ``history`` sentences teach,
    the rest asks. An arm of weight 0 has no user model; a word outside the lexicon before the cursor offers nothing.

    Candidates, scores and order are those of ``ranked``. All that a block holds after one word is gathered into one row, and
    arms are worked out inside it: positions are shuffled once, whatever the number of arms, and no row is made per candidate.
    """
    span = lambda lo, hi: (F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    rows = pairs.repartition("block", "first_id").groupBy("block", "first_id", "second_id").agg(F.collect_list("at").alias("ats"), *span("at", "at"))
    rows = rows.groupBy("block", "first_id").agg(F.collect_list(F.struct("second_id", "ats")).alias("after"), *span("lo", "hi"))
    cut = top(static, ["first_id"], [F.desc("cnt"), F.col("second_id")], NEXT_CANDIDATES, "k")
    # Structs sort as the order of candidates does: the best score first, then the id.
    known = F.array_sort(F.collect_list(F.struct((-F.col("log_count").cast("double")).alias("s"), F.col("second_id"))))
    cut = cut.groupBy("first_id").agg(known.alias("known"))
    rows = rows.join(small(cut), "first_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<struct<s: double, second_id: int>>")))
    rows = rows.join(F.broadcast(arms), F.col("hi") >= F.col("history"))  # a handful of arms; without a position that asks, nothing counts
    asks = F.transform("after", lambda x: F.struct(x.second_id.alias("second_id"), F.size(F.filter(x.ats, lambda t: t >= F.col("history"))).alias("n")))
    rows = rows.withColumn("asks", F.filter(asks, lambda x: x.n > 0))
    taught = F.transform("after", lambda x: F.struct(x.second_id.alias("second_id"), F.filter(x.ats, lambda t: t < F.col("history")).alias("ats")))
    mine = F.filter(taught, lambda x: (F.size(x.ats) > 0) & (F.size(F.array_distinct(x.ats)) >= F.col("sessions")))
    mine = F.array_sort(F.transform(mine, lambda x: F.struct((-F.size(x.ats)).alias("c"), x.second_id.alias("second_id"))))
    mine = F.transform(F.slice(mine, 1, NEXT_CANDIDATES), lambda x: F.struct(bounded(log_scale(-x.c), F.col("weight")).alias("term"), x.second_id.alias("second_id")))
    rows = rows.withColumn("mine", F.when((F.col("weight") > 0) & (F.col("first_id") >= 0) & (F.col("lo") < F.col("history")), mine))
    both = F.transform("mine", lambda x: F.struct((F.coalesce(F.get(F.filter("known", lambda y: y.second_id == x.second_id), F.lit(0)).s, F.lit(0.0)) - x.term).alias("s"), x.second_id.alias("second_id")))
    rest = F.filter("known", lambda y: ~F.exists("mine", lambda x: x.second_id == y.second_id))
    best = F.array_sort(F.filter(F.concat(both, rest), lambda x: x.second_id >= 0))
    best = F.slice(F.when(F.size("mine") > 0, best).otherwise(F.col("known")), 1, SUGGESTIONS)
    rows = rows.select("arm", "asks", best.getField("second_id").alias("best"))
    n = lambda kept: F.aggregate(F.filter("asks", kept), F.lit(0).cast("bigint"), lambda a, x: a + x.n)
    every, first, any_ = n(lambda x: F.lit(True)), n(lambda x: F.get("best", F.lit(0)) == x.second_id), n(lambda x: F.array_contains("best", x.second_id))
    rows = rows.select("arm", every.alias("attempts"), F.when(F.size("best") > 0, every).otherwise(0).alias("offered"), first.alias("top1"), any_.alias("top3"))
    return rows.groupBy("arm").agg(*(F.sum(c).alias(c) for c in ("attempts", "offered", "top1", "top3")))


def directions(pairs: DataFrame, static: DataFrame, history: int = 40, weight: float = 2.0, endorsed: int = 40) -> DataFrame:
    """(direction, attempts, offered, top1, top3) of ways to learn, on the same split: ``current`` pairs alone; ``word`` with how often
    the user types a word; ``bucket`` with the pairs of one of two alternating contexts; ``endorsed`` with pairs that the
    corpus knows well counting fourfold."""
    taught, asked = pairs.filter(F.col("at") < history), pairs.filter(F.col("at") >= history)
    by = ["block"]
    plain = learnt(taught, by)
    term = lambda df: df.withColumn("term", bounded(F.col("log_count"), weight))
    words = taught.groupBy("block", "second_id").agg(F.count("*").alias("c"), F.countDistinct("at").alias("k")).filter("k >= 2")
    words = words.select("block", "second_id", bounded(log_scale(F.col("c")), weight).alias("more"))
    once = plain.select("block", "first_id", "second_id")
    bucket = taught.filter("at % 2 = 0").groupBy("block", "first_id", "second_id").agg(F.count("*").alias("c")).join(once, ["block", "first_id", "second_id"], "left_semi")
    bucket = bucket.select("block", "first_id", "second_id", bounded(log_scale(F.col("c")), weight).alias("more"))
    known = static.select("first_id", "second_id", (F.col("log_count") > endorsed).alias("_well"))
    heavy = learnt(taught.join(small(known), ["first_id", "second_id"], "left"), by, weight=F.when(F.coalesce("_well", F.lit(False)), 4).otherwise(1))
    arms = {
        "current": (plain, None), "word": (plain, lambda r: r.join(words, ["block", "second_id"], "left")),
        "bucket": (plain, lambda r: r.join(bucket, ["block", "first_id", "second_id"], "left")), "endorsed": (heavy, None),
    }
    out = None
    for name, (mine, more) in arms.items():
        s = scored(asked.withColumn("direction", F.lit(name)), by + ["direction"], ranked(asked, by, static, term(mine), more).withColumn("direction", F.lit(name)), ["direction"])
        out = s if out is None else out.unionByName(s)
    return out


def split_blocks(sents: DataFrame, size: int = 80) -> tuple[DataFrame, DataFrame]:
    """(blocks (block, at, tokens), sentences to train on): of the sentences of 4 to 40 tokens in corpus order, whole blocks of
    ``size``; odd blocks are users, everything else is the corpus that they have no part in."""
    from wordloom.operators.windows import numbered

    s = numbered(sents.filter(F.size("tokens").between(4, 40)), ["doc_id", "sent_id"])
    s = s.withColumn("block", F.floor(F.col("rn") / size).cast("int")).withColumn("at", (F.col("rn") % size).cast("int"))
    whole = s.groupBy("block").agg(F.count("*").alias("_n")).filter((F.col("_n") == size) & (F.col("block") % 2 == 1)).select("block")
    users = s.join(whole, "block", "left_semi").select("block", "at", "doc_id", "sent_id", "tokens")
    rest = sents.join(users.select("doc_id", "sent_id"), ["doc_id", "sent_id"], "left_anti")
    return users, rest


def user_blocks(ordered: DataFrame, size: int = 80) -> DataFrame:
    """(block, at, tokens): the users of ``split_blocks``, of sentences whose partitions are ranges of the corpus order and are sorted:
    the places are counted as the rows are written, without a shuffle or a sort of sentences."""
    at = F.monotonically_increasing_id()  # the partition's number and, in the last 33 bits, the row's within it
    s = materialize(ordered.filter(F.size("tokens").between(4, 40)).select(at.alias("_at"), "tokens"), "ordered")
    s = s.select("tokens", F.shiftright("_at", 33).alias("_p"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_k"))
    prior = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: the windows and the broadcast are over those.
    before = s.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_n0"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    s = s.join(F.broadcast(before), "_p").withColumn("rn", F.col("_n0") + F.col("_k")).withColumn("block", F.floor(F.col("rn") / size).cast("int"))
    return s.filter((F.col("block") % 2 == 1) & ((F.col("block") + 1) * F.lit(size).cast("bigint") <= F.col("_all"))).select("block", (F.col("rn") % size).cast("int").alias("at"), "tokens")


def without(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(first_id, second_id, cnt) of a corpus's pairs without those of its users' positions, which are a part of it."""
    theirs = pairs.filter("first_id >= 0 AND second_id >= 0").groupBy("first_id", "second_id").agg(F.count("*").alias("_n"))
    return counts.join(theirs, ["first_id", "second_id"], "left").select("first_id", "second_id", (F.col("cnt") - F.coalesce("_n", F.lit(0))).alias("cnt"))


def static_table(sents: DataFrame, lex: DataFrame, pairs: DataFrame, min_count: int = 5) -> DataFrame:
    """Pair table of all sentences but those that the users' positions ``pairs`` are from."""
    all_ = T.bigrams(sents, lex).filter(F.col("cnt") >= min_count)
    return T.pruned(without(all_, pairs), min_count)
