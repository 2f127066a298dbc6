"""Ranking models, user models, segmentation, checks: metamorphic and control tests."""

from pyspark.sql import functions as F

from wordloom.functions import bidi
from wordloom.functions import numeric as N
from wordloom.operators import users as U
from wordloom.plans import checks as C
from wordloom.plans import evaluate as E
from wordloom.plans import rank as R
from wordloom.plans import tables as T

TEXT = "אני אוהב חלב. אני אוהב לחם. אני אוהב חלב! אתה אוהב כלב; אני רואה כלב"


def corpus(spark):
    docs = spark.createDataFrame([(1, "a", TEXT), (2, "a", TEXT), (3, "b", None), (4, "b", "")], "doc_id bigint, source string, text string")
    sents = T.sentence_tokens(docs)
    return docs, sents, T.lexicon(T.counted(T.explode_tokens(sents)), 1)


def test_tables(spark):
    _, sents, lex = corpus(spark)
    words = [r.word for r in lex.orderBy("word_id").collect()]
    assert words == sorted(words) and [r.word_id for r in lex.orderBy("word_id").collect()] == list(range(len(words)))
    ids = {w: i for i, w in enumerate(words)}
    big = {(r.first_id, r.second_id): r.cnt for r in T.bigrams(sents, lex).collect()}
    assert big[ids["אוהב"], ids["חלב"]] == 4 and (ids["חלב"], ids["אני"]) not in big
    assert {(r.first_id, r.second_id): r.cnt for r in T.skipgrams(sents, lex).collect()}[ids["אני"], ids["חלב"]] == 4
    less = lex.filter("word <> 'אוהב'")
    assert all(ids["אוהב"] not in (r.first_id, r.second_id) for r in T.bigrams(sents, less).collect())
    assert T.bigrams(sents.limit(0), lex).count() == 0
    mix = {(r.first_id, r.second_id): r.cnt for r in T.blend(T.bigrams(sents, lex), T.bigrams(sents, lex).limit(0), 0.25).collect()}
    assert mix[ids["אוהב"], ids["חלב"]] == 3.0


def test_empty_user_model_changes_nothing(spark):
    _, sents, lex = corpus(spark)
    bi = T.pruned(T.bigrams(sents, lex), 1)
    ctx = spark.createDataFrame([("חל", 0), ("כל", None)], "prefix string, prev int")
    none = spark.createDataFrame([], "first_id int, second_id int, cnt bigint, log_count int")
    plain = {tuple(r) for r in R.completions(ctx, lex, bi, (2,)).collect()}
    with_user = R.completions(ctx, lex, bi, (2,), user=none).collect()
    assert {tuple(r)[:-1] for r in with_user} == plain and not any(r.from_user for r in with_user)
    assert {tuple(r) for r in R.next_words(bi, none).collect()} == {tuple(r) for r in R.next_words(bi).collect()}


def test_detector_control(spark):

    _, sents, lex = corpus(spark)
    sites = R.sites(sents, lex)
    bi = T.pruned(T.bigrams(sents, lex), 1)
    assert R.detected(R.evidence(sites, lex, bi.limit(0))).count() == 0
    ev = R.evidence(sites, lex, bi)
    assert R.detected(ev, margin=1, require_zero=False).count() >= R.detected(ev, margin=1).count()
    assert R.detected_wide(ev, skip_margin=0, prior_margin=0).count() == R.detected(ev).count()


def test_user_sessions(spark):
    rows = [(i, 1, 1, 5, 6, 1) for i in range(20)] + [(100, 1, 2, 7, 8, 1), (101, 1, 3, 7, 8, 1), (101, 1, 3, 7, 8, 1), (102, 1, 3, -2, 8, 1), (103, 1, 3, 7, 9, 0), (104, 1, 3, -1, 9, 1)]
    up = U.user_pairs(spark.createDataFrame(rows, "obs_id bigint, user_id bigint, session_id bigint, first_id int, second_id int, cnt bigint"))
    got = {(r.first_id, r.second_id): (r.cnt, r.sessions) for r in up.collect()}
    assert got == {(5, 6): (20, 1), (7, 8): (2, 2), (-1, 9): (1, 1)}
    assert [(r.first_id, r.second_id) for r in U.gated(up).collect()] == [(7, 8)]
    kept = {(r.first_id, r.second_id) for r in U.evicted(up, 2, 0.5).collect()}
    assert kept == {(7, 8)}


def test_scales(spark):
    row = spark.range(1).select(N.log_scale(F.lit(0)).alias("a"), N.log_scale(F.lit(1)).alias("b"), N.log_scale(F.lit(5)).alias("c"), N.wilson(F.lit(0), F.lit(0))[0].alias("d"), N.contrast(F.lit(-1), F.lit(-16777216)).alias("e"), N.ratio_text(F.lit(12.349)).alias("f")).first()
    assert (row.a, row.b, row.c, row.d, row.f) == (0, 8, 21, 0.0, "12.34") and abs(row.e - 21) < 1e-6


def test_golden_and_labellers(spark):
    _, _, lex = corpus(spark)
    words = lex.filter("length(word) >= 4").select("word")
    known = {r.word for r in lex.collect()}
    rows = E.golden(words, lex, "s").collect()
    assert rows and all(r.typo not in known for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, E.golden(words.repartition(5), lex, "s").collect()))
    assert all(r.typo not in known for r in E.golden(words, lex, "s", E.slipped).collect())


def test_every_check_can_fail(spark):
    lex = spark.createDataFrame([(i, chr(0x5D0 + i), 1, 1) for i in range(20)], "word_id int, word string, cnt bigint, log_freq int")
    digest = lex.agg(C.content_hash(F.col("word")).alias("h")).first().h
    checks = [C.at_least(10), C.ascending("word"), C.unique("word_id"), C.matches("word", r"\A[א-ת]+\z", "x"), C.same_content(digest, "word"), C.close_to(20), C.floor_is("log_freq", 0)]
    assert {r.name: r.status for r in C.run(lex, checks).collect()} == {c.name: "PASS" for c in checks}
    broken = C.Check("blind", "row", lambda df: df.agg(F.count("*").alias("denominator"), F.lit(0).cast("bigint").alias("findings")), lambda df: df)
    assert C.run(lex, [broken]).first().status == "NOT-A-GATE"
    assert C.run(lex.limit(0), [C.matches("word", "a", "b")]).first().status in ("NOT-MEASURED", "NOT-A-GATE")
    assert C.run(lex.withColumn("word", F.lit("z")), [C.matches("word", r"\A[א-ת]+\z", "x")]).first().status == "FAIL"


def test_bidi():
    assert bidi.reorder("abc", 0) == "abc" and bidi.reorder("אבג", 0) == "גבא" == bidi.reorder("אבג", 1)
    assert bidi.reorder("abc אבג", 0) == "abc גבא" and bidi.reorder("abc אבג", 1) == "גבא abc"
    assert bidi.reorder("אב 12", 1) == "12 בא" and bidi.reorder("(א)", 1) == "(א)" and bidi.reorder("", 1) == ""
