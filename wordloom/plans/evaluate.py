"""Evaluation: deterministic errors, accuracy cells, sweeps, intervals, label batches and their verdicts."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.hashing import below, order_key
from wordloom.functions.numeric import wilson
from wordloom.functions.similarity import neighbours
from wordloom.profiles import HEBREW, Profile

#: Attempts at a typo that is no word, per word.
ATTEMPTS = 40


#: Cumulative shares of a Poisson count of mean 1, up to a count that one in 10**12 exceeds.
POISSON = tuple(sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(15))


def corrupted(word: Column, attempt: Column, seed: str, p: Profile = HEBREW) -> Column:
    """A word with one letter inserted, dropped, replaced or swapped, drawn from the word and the attempt alone."""
    n = F.length(word)
    op, at = below(4, seed, word, attempt, F.lit("op")), below(n, seed, word, attempt, F.lit("at")).cast("int")
    letter = F.substring(F.lit(p.alphabet), (below(len(p.alphabet), seed, word, attempt, F.lit("letter")) + 1).cast("int"), F.lit(1))
    left, mid, right = F.substring(word, F.lit(1), at), F.substring(word, at + 1, F.lit(1)), F.substring(word, at + 2, n)
    s = F.least(at, n - 2)
    crossed = F.concat(F.substring(word, F.lit(1), s), F.substring(word, s + 2, F.lit(1)), F.substring(word, s + 1, F.lit(1)), F.substring(word, s + 3, n))
    return F.when(op == 0, F.concat(left, letter, mid, right)).when(op == 1, F.concat(left, right)).when(op == 2, F.concat(left, letter, right)).otherwise(F.when(n < 2, word).otherwise(crossed))


def slipped(word: Column, attempt: Column, seed: str, p: Profile = HEBREW) -> Column:
    """A word with one letter replaced by the one beside it on the keyboard's row."""
    n = F.length(word)
    at = below(n, seed, word, attempt, F.lit("slip")).cast("int")
    beside = {c: "".join(x for x in sorted(ns) if any(c + x in r or x + c in r for r in p.rows)) for c, ns in neighbours(p).items()}
    table = F.create_map(*(x for c, ns in sorted(beside.items()) for x in (F.lit(c), F.lit(ns))))
    options = F.coalesce(F.try_element_at(table, F.substring(word, at + 1, F.lit(1))), F.lit(""))
    k = below(F.greatest(F.length(options), F.lit(1)), seed, word, attempt, F.lit("side")).cast("int")
    return F.when(F.length(options) > 0, F.concat(F.substring(word, F.lit(1), at), F.substring(options, k + 1, F.lit(1)), F.substring(word, at + 2, n)))


def golden(words: DataFrame, lex: DataFrame, seed: str, how=corrupted) -> DataFrame:
    """(typo, expected, attempts): for each distinct word of four or more letters the first typo that is no known word. Words
    for which no attempt succeeds are left out."""
    tries = words.filter(F.length("word") >= 4).select("word", F.explode(F.sequence(F.lit(1), F.lit(ATTEMPTS))).alias("attempt"))
    tries = tries.withColumn("typo", how(F.col("word"), F.col("attempt"), seed)).filter("typo IS NOT NULL AND typo <> word")
    ok = tries.join(lex.select(F.col("word").alias("typo")), "typo", "left_anti")
    return ok.groupBy("word").agg(F.min_by("typo", "attempt").alias("typo"), F.min("attempt").alias("attempts")).select("typo", F.col("word").alias("expected"), "attempts")


def accuracy(expected: DataFrame, ranked: DataFrame, auto: DataFrame) -> DataFrame:
    """One row: attempts, how many have the expected word first, among the ranked ones, nothing or something offered, and how many
    would be replaced unasked by the expected word and by another."""
    by = ranked.groupBy("typed").agg(F.collect_list(F.struct("rank", "word")).alias("s"))  # as many as are suggested
    j = expected.join(by, expected["typo"] == by["typed"], "left").join(auto.select(F.col("typed").alias("_t"), F.col("word").alias("_auto")), F.col("typo") == F.col("_t"), "left")
    hit = F.coalesce(F.exists("s", lambda x: x["word"] == F.col("expected")), F.lit(False))
    first = F.coalesce(F.exists("s", lambda x: (x["rank"] == 1) & (x["word"] == F.col("expected"))), F.lit(False))
    return j.agg(
        F.count("*").alias("attempts"), F.count_if(first).alias("top1"), F.count_if(hit).alias("top3"), F.count_if(F.col("s").isNull()).alias("none"), F.count_if(F.col("s").isNotNull()).alias("offered"),
        F.count_if(F.col("_auto") == F.col("expected")).alias("auto_right"), F.count_if(F.col("_auto") != F.col("expected")).alias("auto_wrong"),
    )


def bootstrap(rows: DataFrame, unit: str, hit: Column, draws: int = 1000, seed: str = "bootstrap") -> DataFrame:
    """(mean, lo, hi): the share of hits and the 95 % interval of resampled units.

    Each unit weighs in each draw as often as a Poisson count of mean 1 drawn by its own hash, so that nothing is
    shuffled by unit: sums per draw are all that moves. Units are summed up before they are multiplied by draws.
    """
    per = rows.groupBy(unit).agg(F.count("*").alias("n"), F.count_if(hit).alias("k"))
    u = below(10**15, seed, F.col(unit), F.col("draw")) / 1e15
    levels = POISSON
    weight = sum((F.when(u >= x, 1).otherwise(0) for x in levels), F.lit(0))
    drawn = per.select(unit, "n", "k", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("w", weight)
    means = drawn.groupBy("draw").agg(F.try_divide(F.sum(F.col("k") * F.col("w")).cast("double"), F.sum(F.col("n") * F.col("w"))).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.expr("percentile(m, 0.025)").alias("lo"), F.expr("percentile(m, 0.975)").alias("hi"))


def batch(pool: DataFrame, sizes: dict[str, int], seed: str) -> DataFrame:
    """(id, source_id, stratum, seq, flipped): a blinded batch of so many records per stratum, dealt and turned by hash.
    The pool is (source_id, stratum) of records not used before. A batch is what a person can judge: its size is small."""
    from wordloom.plans.rank import top

    want = F.create_map(*(x for k, v in sizes.items() for x in (F.lit(k), F.lit(v))))
    drawn = top(pool.filter(F.col("stratum").isin(*sizes)), ["stratum"], [order_key(seed, F.col("source_id")), F.col("source_id")], max(sizes.values()), "k")
    drawn = drawn.filter(F.col("k") <= want[F.col("stratum")]).drop("k").withColumn("g", F.lit(0))
    dealt = top(drawn, ["g"], [order_key(seed + "-deal", F.col("source_id")), F.col("source_id")], sum(sizes.values()), "seq")
    return dealt.select(F.concat(F.lit(seed + "-"), F.lpad(F.col("seq").cast("string"), 3, "0")).alias("id"), "source_id", "stratum", "seq", (below(2, seed + "-flip", F.col("source_id")) == 0).alias("flipped"))


def scored(judged: DataFrame, controls: float = 0.9, abstain: float = 0.3, good: float = 0.6, poor: float = 0.4) -> DataFrame:
    """Per batch the counts and one verdict, by rules in order: VOID if controls fail, NOT-DECIDABLE if too many abstain,
    NOT-MEASURED without real items, else by the lower and upper bound of the decided share.

    ``judged`` is (batch_id, stratum, bucket, choice, other_option, text_option). An injected item is right if the other
    option was chosen, a clean one if the text's or both were.
    """
    s, c = F.col("stratum"), F.col("choice")
    control = s.isin("injected", "clean")
    right = ((s == "injected") & (c == F.col("other_option"))) | ((s == "clean") & ((c == F.col("text_option")) | (c == 3)))
    real = s == "real"
    by = judged.groupBy("batch_id").agg(
        F.count_if(control).alias("controls"), F.count_if(control & right).alias("right"), F.count_if(real).alias("real"),
        F.count_if(real & (F.col("bucket") == "suggestion")).alias("suggestion"), F.count_if(real & F.col("bucket").isin("both", "unclear")).alias("abstained"),
    )
    lo, hi = wilson(F.col("suggestion"), F.col("real") - F.col("abstained"))
    verdict = (
        F.when((F.col("controls") > 0) & (F.col("right") < F.ceil(F.col("controls") * controls)), "VOID")
        .when(F.col("real") == 0, "NOT-MEASURED")
        .when(F.col("abstained") > F.col("real") * abstain, "NOT-DECIDABLE")
        .when(lo >= good, "SHIP").when(hi < poor, "WITHDRAW").otherwise("NOISE")
    )
    return by.withColumn("verdict", verdict)


def labeller(items: DataFrame, kind: str, seed: str = "labeller") -> DataFrame:
    """Answers of a synthetic labeller: ``agrees``, ``disagrees``, ``random`` or ``unsure`` on the real items; all but the
    random one know the controls."""
    s = F.col("stratum")
    dice = below(4, seed, F.col("id"), F.lit(kind)) + 1
    real = {"agrees": F.col("other_option"), "disagrees": F.col("text_option"), "unsure": F.lit(4), "random": dice}[kind]
    known = F.when(s == "injected", F.col("other_option")).when(s == "clean", F.col("text_option"))
    return items.withColumn("choice", real if kind == "random" else F.coalesce(known, real).cast("int"))
