"""Lookups against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from wordloom.functions import similarity as S
from wordloom.operators import lookup as L
from wordloom.operators import windows as W
from wordloom.profiles import HEBREW


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def words(n, alphabet="abcא", longest=7, seed=1):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, longest))) for _ in range(n)})


def test_distance(spark):
    pairs = [("ab", "ba"), ("ca", "abc"), ("kitten", "sitting"), ("", "abc"), ("abc", ""), ("", ""), (None, "a"), ("a", None)]
    pairs += list(zip(words(300), reversed(words(300)), strict=True))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.osa(F.col("a"), F.col("b")).alias("d"))
    for r in df.collect():
        assert r.d == (None if r.a is None or r.b is None else 100 * osa(r.a, r.b)), r
    assert osa("ca", "abc") == 3


def lexicon(spark, ws):
    return spark.createDataFrame([(i, w, i % 7) for i, w in enumerate(ws)], "word_id int, word string, log_freq int")


def test_fuzzy_finds_all(spark):
    lex, typed = words(400), words(120, seed=2) + ["", "x" * 200]
    for edits in (1, 2):
        got = {(r.typed, r.word): r.cost for r in L.fuzzy(spark.createDataFrame([(t,) for t in typed] + [(None,)], "typed string"), lexicon(spark, lex), edits).collect()}
        assert got == {(t, w): 100 * osa(t, w) for t in typed for w in lex if t and osa(t, w) <= edits}


def test_stems(spark):
    lex = ["שלום", "ספרים", "כתב", "ושלום"]
    got = {r.word: (r.prefix, r.stem) for r in L.stems(spark.createDataFrame([(w,) for w in ["שלום", "ושלום", "כשבשלום", "הספרים", "וכתב", "שלו", ""]], "word string"), lexicon(spark, lex)).collect()}
    assert got == {"שלום": ("", "שלום"), "ושלום": ("", "ושלום"), "כשבשלום": ("כשב", "שלום"), "הספרים": ("ה", "ספרים")}
    assert len(HEBREW.prefixes) == 79 and max(map(len, HEBREW.prefixes)) == 5


def test_overlaps(spark):
    rnd = random.Random(3)
    iv = [(i, lo, lo + rnd.randrange(-3, 60)) for i in range(150) for lo in [rnd.randrange(500)]]
    df = spark.createDataFrame(iv + [(900, None, 3)], "id int, lo bigint, hi bigint")
    got = sorted((r.a_id, r.b_id) for r in L.overlaps(df, df, 17).collect())
    ok = [x for x in iv if x[1] <= x[2]]
    assert got == sorted((a[0], b[0]) for a in ok for b in ok if a[1] <= b[2] and b[1] <= a[2])


def test_as_of(spark):
    rnd = random.Random(4)
    left = [(i, rnd.randrange(3), rnd.randrange(50)) for i in range(80)] + [(99, 0, None)]
    right = [(rnd.randrange(3), rnd.randrange(50), i) for i in range(40)] + [(0, None, 77)]
    got = {r.id: r.last_v for r in L.as_of(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int"), "k", "t", ["t", "v"]).collect()}
    for i, k, t in left:
        hits = [(x[1], x[2]) for x in right if x[0] == k and x[1] is not None and t is not None and x[1] <= t]
        assert got[i] == (max(hits)[1] if hits else None)


def test_confusions_and_twins(spark):
    lex = lexicon(spark, ["חלב", "כלב", "קלב", "ספור", "ספר", "מים", "דג"])
    got = {(r.word, r.variant) for r in L.confusions(lex.select("word"), lex).collect()}
    assert got == {("חלב", "כלב"), ("כלב", "חלב"), ("כלב", "קלב"), ("קלב", "כלב")}
    assert {(r.word, r.twin) for r in L.dropped_twins(lex).collect()} == {("ספור", "ספר")}
    words_ = spark.createDataFrame([("מימ",), ("דג",)], "word string")
    assert [(r.word, r.twin) for r in L.final_twins(words_, lex).collect()] == [("מימ", "מים")]


def test_numbering_is_global(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 5).alias("n")).repartition(7)
    rows = sorted(W.numbered(df, ["k"], amount=F.col("n")).collect(), key=lambda r: r.k)
    total = 0
    for i, r in enumerate(rows):
        assert r.rn == i and r.before == total
        total += r.n
    assert W.numbered(df.limit(0), ["k"]).count() == 0


def test_blocks_drop_the_partial_one(spark):
    df = spark.range(25).select(F.col("id").alias("rn"))
    assert sorted({r.block for r in W.blocks(df, 10, 9).collect()}) == [0, 1]
    assert [r.rn for r in W.strided(df, 1, 7, 3).orderBy("rn").collect()] == [1, 8, 15]


def test_fuzzy_finds_long_words(spark):
    rnd = random.Random(5)
    lex = sorted({"".join(rnd.choice("abא") for _ in range(n)) for n in (9, 10, 11, 12, 13, 14, 15, 20, 33) for _ in range(6)})
    typed = {"".join(rnd.choice("abא") for _ in range(13)) for _ in range(10)} | {"x" * 200, ""}
    for w in lex:
        for _ in range(5):
            x = list(w)
            for _ in range(rnd.randrange(4)):
                i = rnd.randrange(len(x) - 1)
                x[i : i + 2] = rnd.choice([[x[i + 1], x[i]], [x[i]], [x[i], "c", x[i + 1]], ["c", x[i + 1]]])
            typed.add("".join(x))
    typed |= {w + "c" for w in lex if len(w) == 12}
    for edits in (1, 2):
        want = {(t, w): 100 * osa(t, w) for t in typed for w in lex if t and abs(len(t) - len(w)) <= edits and osa(t, w) <= edits}
        rows = L.fuzzy(spark.createDataFrame([(t,) for t in sorted(typed)] + [(None,)], "typed string"), lexicon(spark, lex), edits).collect()
        assert len(rows) == len(want) and {(r.typed, r.word): r.cost for r in rows} == want
        assert any(len(t) > 12 for t, _ in want) and any(len(t) <= 12 < len(w) for t, w in want) and any(len(w) <= 12 < len(t) for t, w in want)


def test_prefixes_of_any_length(spark):
    lex = words(60) + ["", "abcabcabc", "abcabcabcd"]
    ps = ["a", "ab", "abcabcab", "abcabcabc", "", "zz"]
    got = {(r.prefix, r.word) for r in L.by_prefix(spark.createDataFrame([(p,) for p in ps], "prefix string"), lexicon(spark, lex), None).collect()}
    assert got == {(p, w) for p in ps for w in lex if p and w.startswith(p)} and ("abcabcab", "abcabcabc") in got
