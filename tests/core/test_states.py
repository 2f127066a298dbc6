"""Models' life, suggestions put into a text, packed models, places in ranges, predictions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from wordloom import session
from wordloom.functions import similarity as S
from wordloom.functions import text as X
from wordloom.operators import lookup as L
from wordloom.operators import users as U
from wordloom.operators import vectors as V
from wordloom.operators import windows as W
from wordloom.plans import learning as Y
from wordloom.plans import rank as R
from wordloom.sources import readers as I
from wordloom.sources import sinks as O
from wordloom.streaming.typing import Buffer


def test_suggestions_in_a_text():
    b = Buffer("אני או", 6)
    assert b.accept("אוהב", "COMPLETION") and b.text == "אני אוהב" and b.cursor == 8
    assert not b.accept("לחם", "NEXT_WORD") and b.text == "אני אוהב"
    b.commit(" ")
    assert not b.accept("אוהב", "CORRECTION") and b.accept("לחם", "NEXT_WORD") and b.text == "אני אוהב לחם"
    c = Buffer("דיברתי אם, המורה ", 17)
    assert c.accept("עם", "REAL_WORD_ERROR", "אם", 2) and c.text == "דיברתי עם, המורה "
    assert not c.accept("עם", "REAL_WORD_ERROR", "אם", 2) and not c.accept("x", "REAL_WORD_ERROR", "אם", 9) and not c.accept("x", "REAL_WORD_ERROR", None, 1)
    c.wipe()
    assert (c.text, c.known, c.cursor) == ("", False, 17) and not c.accept("x", "COMPLETION")


def test_backspace_takes_a_whole_character(spark):
    texts = ["", None, "a", "שָׁ", "x👨‍👩‍👧", "a\r\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.backspace_width(F.col("t")).alias("n"), X.key_plan(F.lit("NONE"), F.lit("x"), F.lit(False), F.col("t")).alias("p")).orderBy("i").collect()
    assert [r.n for r in rows] == [1, 1, 1, 3, 5, 2] and all(r.p is None for r in rows)


def test_storable(spark):
    words = {"שלום": None, "שָׁלוֹם": None, "": "empty", None: "empty", " ": "more than one word", "א ב": "more than one word", "א1": "digits", "abc": "not letters", "א" * 33: "too long", "ְ": "not letters"}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.storable(F.col("w")).alias("why")).collect()
    assert {r.w: r.why for r in rows} == words


def test_wipes_and_pauses(spark):
    t = lambda d: f"2024-01-{d:02d} 00:00:00"
    log = spark.createDataFrame([(1, t(1)), (1, t(5)), (1, None), (2, t(1)), (2, None), (2, t(9)), (3, t(2))], "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    wipes = spark.createDataFrame([(1, t(3)), (1, t(2))], "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    pauses = spark.createDataFrame([(2, t(8), None)], "user_id int, since string, until string").select("user_id", F.col("since").cast("timestamp"), F.col("until").cast("timestamp"))
    got = sorted((r.user_id, r.ts and r.ts.day) for r in U.remembered(log, wipes, pauses).collect() if r.ts) + [r.user_id for r in U.remembered(log, wipes, pauses).filter("ts IS NULL").collect()]
    assert got == [(1, 5), (2, 1), (3, 2), 2]


def test_eviction_in_parts_is_whole(spark):
    rnd = random.Random(1)
    rows = [(u, i, rnd.randrange(9), rnd.randrange(4), rnd.randrange(5)) for u, n in ((1, 900), (2, 10), (3, 11)) for i in range(n)]
    df = spark.createDataFrame(rows, "user_id int, first_id int, second_id int, cnt int, sessions int")
    want = set()
    for u in (1, 2, 3):
        own = sorted((r for r in rows if r[0] == u), key=lambda r: (-r[4], -r[3], r[1], r[2]))
        want |= set(own if len(own) <= 10 else own[:9])
    assert {tuple(r) for r in U.evicted(df, 10, 0.9).collect()} == want


def test_packed_models(spark):
    pairs = spark.createDataFrame([(1, -1, 5, 2, 1), (1, 7, 8, 3, 2), (2, 3, 4, 9, 9)], "user_id bigint, first_id int, second_id int, cnt bigint, sessions bigint")
    packed = O.packed_models(pairs)
    assert {tuple(r) for r in O.unpacked_models(packed).drop("status").collect()} == {tuple(r) for r in pairs.collect()}
    good = {r.user_id: bytes(r.content) for r in packed.collect()}
    bad = [(1, None), (2, b""), (3, b"X" + good[1][1:]), (4, good[1][:4] + b"\x07" + good[1][5:]), (5, good[1] + b"x"), (6, good[1][:-1])]
    got = {r.user_id: r.status for r in O.unpacked_models(spark.createDataFrame(bad, "user_id bigint, content binary")).collect()}
    assert got == {1: "null", 2: "short", 3: "mark", 4: "version", 5: "length", 6: "length"}


def test_as_of_across_ranges(spark):
    """One key holds nearly all rows and lies in every range."""
    rnd = random.Random(4)
    left = [(i, 0 if i % 20 else 1, rnd.randrange(3000)) for i in range(600)]
    right = [(0 if i % 30 else 1, rnd.randrange(1, 3000) if i > 3 else 5, i) for i in range(60)]
    got = {r.id: r.last_v for r in L.as_of(spark.createDataFrame(left, "id int, k int, t int").repartition(4), spark.createDataFrame(right, "k int, t int, v int"), "k", "t", ["t", "v"]).collect()}
    for i, k, t in left:
        hits = [(x[1], x[2]) for x in right if x[0] == k and x[1] <= t]
        assert got[i] == (max(hits)[1] if hits else None)


def test_first_of_each_and_ranks(spark):
    rnd = random.Random(5)
    rows = [(i, "hot" if rnd.random() < 0.8 else rnd.choice(["a", None]), rnd.choice([None, 1.0, 2.0, rnd.random()])) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, c string, x double").repartition(5)
    got = {tuple(r) for r in W.first_of_each(df, "c", ["i"], 7).collect()}
    want = {r for c in ("hot", "a", None) for r in [x for x in rows if x[1] == c][:7]}
    assert got == want
    for share in (0.01, 0.5, 1.0):
        place = lambda n: F.greatest(F.lit(1), F.ceil(n * share))  # noqa: B023, E731
        got = {r.c: r.value for r in W.at_rank(df, "c", "x", place).collect()}
        for c in ("hot", "a", None):
            xs = sorted(x[2] for x in rows if x[1] == c and x[2] is not None)
            assert got[c] == xs[max(1, -int(-(len(xs) * share) // 1)) - 1]


def test_cost_model(spark):
    def dist(a, b, swap, ins, dele):
        d = {(i, 0): i * dele for i in range(len(a) + 1)} | {(0, j): j * ins for j in range(len(b) + 1)}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + dele, d[i, j - 1] + ins, d[i - 1, j - 1] + (0 if a[i - 1] == b[j - 1] else 100))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + swap)
        return d[len(a), len(b)]

    rnd = random.Random(6)
    pairs = [("".join(rnd.choice("abc") for _ in range(rnd.randrange(7))), "".join(rnd.choice("abc") for _ in range(rnd.randrange(7)))) for _ in range(150)]
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.osa(F.col("a"), F.col("b"), None, 100, 70, 90, 110).alias("d")).collect():
        assert r.d == dist(r.a, r.b, 70, 90, 110)


def test_predictions(spark):
    lex = spark.createDataFrame([(0, "אוהב", 50), (1, "אני", 60), (2, "חלב", 40), (3, "כלב", 45), (4, "לחם", 30), (5, "מס", 20), (6, "מסך", 10)], "word_id int, word string, log_freq int")
    bi = spark.createDataFrame([(1, 0, 9, 27), (0, 2, 9, 27), (2, 4, 9, 27), (0, 4, 5, 21)], "first_id int, second_id int, cnt bigint, log_count int")
    abbr = spark.createDataFrame([("מס", "מס׳", 5), ("צהל", "צה״ל", 5)], "bare string, canonical string, cnt bigint")
    ctx = spark.createDataFrame([("", 0), ("", None), ("מס", None), ("צהל", None), ("צה״ל", 1), ("אוה", None), ("ab", 0), ("חלת", 0)], "current string, prev int")
    got = {}
    for r in R.ordinary(ctx, lex, bi, abbr).orderBy("rank").collect():
        got.setdefault((r.current, r.prev), []).append((r.word, r.kind))
    assert got["", 0] == [("חלב", "NEXT_WORD"), ("לחם", "NEXT_WORD")] and ("", None) not in got and ("ab", 0) not in got
    assert got["מס", None] == [("מסך", "COMPLETION"), ("מס׳", "ABBREVIATION")] and got["צהל", None][0] == ("צה״ל", "ABBREVIATION")
    assert got["צה״ל", 1] == [("אוהב", "NEXT_WORD")] and got["אוה", None][0] == ("אוהב", "COMPLETION") and got["חלת", 0][0] == ("חלב", "CORRECTION")
    # After "אני אוהב כלב לחם" the dog was milk: its neighbours know the one and not the other.
    asked = spark.createDataFrame([(1, "", "לחם", "כלב", "אוהב", "אני"), (2, "א", "לחם", "חלב", "אוהב", "אני"), (3, "", None, None, None, None)], "k int, current string, c1 string, c2 string, c3 string, c4 string")
    rows = {(r.k, r["rank"]): (r.word, r.kind, r.replaces) for r in R.predicted(asked, ["k"], lex, bi, abbr).collect()}
    assert rows[1, 1] == ("חלב", "REAL_WORD_ERROR", "כלב") and rows[2, 1][1] == "COMPLETION" and not any(k == 3 for k, _ in rows)


def test_users_are_held_out(spark):
    sents = spark.createDataFrame([(i, 0, ["א", "ב", "ג", "ד"]) for i in range(25)], "doc_id int, sent_id int, tokens array<string>").withColumn("source", F.lit("x"))
    users, rest = Y.split_blocks(sents, 10)
    assert sorted(r.doc_id for r in users.collect()) == list(range(10, 20)) and rest.count() == 15


def test_prefix_tree_and_optional(spark, tmp_path):
    tree = L.prefix_tree(spark.createDataFrame([(0, "a"), (1, "ab"), (2, "b")], "word_id int, word string"))
    assert {(r.prefix, r.words, r.ends) for r in tree.collect()} == {("a", 2, True), ("ab", 1, True), ("b", 1, True)} and L.unsorted(tree).count() == 0
    assert L.unsorted(L.prefix_tree(spark.createDataFrame([(0, "a"), (1, "b"), (2, "ab")], "word_id int, word string"))).count() == 1
    df, missing = I.optional(spark, f"{tmp_path}/none", "a int")
    assert missing and df.count() == 0


def test_scratch_is_deleted(spark, monkeypatch):
    df = session.materialize(spark.range(3), "x")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    session.release(spark, path)
    with pytest.raises(Exception):
        df.count()


def test_int8_step(spark):
    w_in, w_state = V.weights8(3, 4, 1), V.weights8(3, 3, 2)
    row = spark.createDataFrame([([1, -2, 3, 100], [5, 0, 127])], "x array<int>, h array<int>").select(V.recurrent8(F.col("x"), F.col("h"), w_in, w_state, [1, 2, 3]).alias("h")).first()
    x, h = [1, -2, 3, 100], [5, 0, 127]
    assert row.h == [min(127, max(0, (sum(a * b for a, b in zip(p, x, strict=True)) + sum(a * b for a, b in zip(q, h, strict=True)) + c) >> 7)) for p, q, c in zip(w_in, w_state, [1, 2, 3], strict=True)]
