"""Simulated users: whole results from one shuffle of their positions."""

import random
from collections import Counter
from math import log2

from pyspark.sql import functions as F

from wordloom.plans import learning as Y
from wordloom.plans import tables as T

ARMS = [("static", 6, 2, 0.0), ("adaptive", 6, 2, 2.0), ("once", 3, 1, 0.5), ("none asks", 10, 1, 1.0)]


def scale(n):
    return min(255, round(round(log2(n + 1) * 8, 6)))


def expected(pairs, arms, static):
    out = {}
    by_cnt = lambda d: sorted(d.items(), key=lambda x: (-x[1], x[0]))[:16]
    for arm, history, sessions, weight in arms:
        got = [0, 0, 0, 0]
        for block, at, f, s in pairs:
            if at < history:
                continue
            taught = [(p[3], p[1]) for p in pairs if p[0] == block and p[2] == f and p[1] < history] if f >= 0 and weight > 0 else []
            mine = {k: n for k, n in Counter(k for k, _ in taught).items() if len({a for x, a in taught if x == k}) >= sessions}
            score = Counter({k: scale(n) for k, n in by_cnt({k: n for (a, k), n in static.items() if a == f})})
            for k, n in by_cnt(mine):
                score[k] += weight * min(scale(n), 32)
            best = [k for k, _ in sorted(score.items(), key=lambda x: (-x[1], x[0])) if k >= 0][:3]
            got = [a + b for a, b in zip(got, (1, bool(best), best[:1] == [s], s in best))]
        if got[0]:
            out[arm] = tuple(got)
    return out


def test_arms_in_one_shuffle(spark):
    rnd = random.Random(4)
    # Word 1 has more than 16 continuations, of which many are as frequent as others; -1 is unknown, 7 is not in the pair table.
    pairs = [(b, at, rnd.choice([1, 1, 2, 3, 7, -1]), rnd.choice([-1, *range(4), rnd.randrange(25)])) for b in (1, 3, 5) for at in range(10) for _ in range(12)]
    static = {(f, s): rnd.choice([5, 5, 6, 9, 40]) for f in (1, 2, 3) for s in range(22 if f == 1 else 4)}
    p = spark.createDataFrame(pairs, "block int, at int, first_id int, second_id int").repartition(3)
    t = T.pruned(spark.createDataFrame([(f, s, n) for (f, s), n in static.items()], "first_id int, second_id int, cnt bigint"), 5)
    got = Y.evaluated(p, spark.createDataFrame(ARMS, "arm string, history int, sessions int, weight double"), t)
    assert {r.arm: tuple(r)[1:] for r in got.collect()} == expected(pairs, ARMS, static)
    # Rows of positions are shuffled once; what is ranked of them is no row of its own.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Window" not in plan and plan.count("Join") == 2


def test_users_and_their_pair_table(spark):
    rnd = random.Random(5)
    rows = [(d, k, [rnd.choice("אבגדה") for _ in range(rnd.choice([1, 2, 3, 4, 9, 40, 41]))]) for d in range(120) for k in range(rnd.randrange(4))]
    sents = spark.createDataFrame(rows, "doc_id bigint, sent_id int, tokens array<string>").withColumn("source", F.lit("x"))
    lex = spark.createDataFrame([(i, w) for i, w in enumerate("אבגד")], "word_id int, word string")
    users, rest = Y.split_blocks(sents, 10)
    ordered = sents.repartitionByRange(5, "doc_id", "sent_id").sortWithinPartitions("doc_id", "sent_id")
    found = Y.user_blocks(ordered, 10)
    key = lambda df: sorted((r.block, r["at"], r.tokens) for r in df.collect())
    assert key(found) == key(users) and len({b for b, *_ in key(found)}) > 3
    # A corpus of whole blocks only keeps its last one.
    first = [r for r in rows if 4 <= len(r[2]) <= 40][:40]
    few = spark.createDataFrame(first, "doc_id bigint, sent_id int, tokens array<string>").repartitionByRange(3, "doc_id", "sent_id").sortWithinPartitions("doc_id", "sent_id")
    assert {b for b, *_ in key(Y.user_blocks(few, 10))} == {1, 3} and Y.user_blocks(few.limit(0), 10).count() == 0
    table = Y.static_table(sents, lex, Y.positions(found, lex), 20)
    whole = T.pruned(T.bigrams(rest, lex), 20)
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, whole.collect())) and table.count() > 3 and table.dtypes == whole.dtypes
