"""p5: pairs against brute force."""

import math
import random
from collections import defaultdict

from wordloom.llm import cooccurrence as C


def brute(rows):
    t, s, w, n, seen = defaultdict(int), defaultdict(set), defaultdict(int), 0, set()
    for obs, sess, a, b, c in rows:
        if a is None or b is None or c is None or a < 0 or b < 0 or a == b or c <= 0 or (obs is not None and obs in seen):
            continue
        seen.add(obs)
        k = (min(a, b), max(a, b))
        t[k] += c
        s[k] |= {sess} - {None}
        w[a] += c
        w[b] += c
        n += c
    return t, s, w, n


def g2(t, wa, wb, n):
    table = [(t, wa, wb), (wa - t, wa, n - wb), (wb - t, n - wa, wb), (n - wa - wb + t, n - wa, n - wb)]
    return 2 * sum(k * math.log(k * n / (r * c)) for k, r, c in table if k > 0)


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(i, rnd.randrange(40), rnd.choice([-2, -1, 0, 0, 0, 1, 2, 3, 30, None]), rnd.choice([0, 1, 2, 3, 4, 31]), rnd.choice([1, 1, 2, 0, -1, None, 50])) for i in range(3000)]
    rows += rows[:200] + [(5000 + i, 7, 0, 1, 1) for i in range(500)] + [(None, 1, 90, 91, 3), (None, 1, 90, 91, 3), (9000, None, 90, 91, 2)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "obs_id bigint, session_id bigint, first_id int, second_id int, cnt bigint").withColumn("total", C.F.lit("clash")).withColumn("item", C.F.lit(1))
    t, s, w, n = brute([r for i, r in enumerate(rows) if r[0] is not None or r not in rows[:i]])
    got = {(r.first_id, r.second_id): r for r in C.associations(df).collect()}
    assert set(got) == set(t)
    for k, r in got.items():
        assert (r.t, r.s, r.w_first, r.w_second, r.n) == (t[k], len(s[k]), w[k[0]], w[k[1]], n)
        assert math.isclose(r.lift, r.t * n / (w[k[0]] * w[k[1]])) and abs(r.llr - max(g2(r.t, w[k[0]], w[k[1]], n), 0)) < 1e-6 * max(1, r.llr)
    five = {(r.first_id, r.second_id) for r in C.above_chance(C.associations(df, min_sessions=5), 2).collect()}
    assert five == {k for k in t if len(s[k]) >= 5 and t[k] * n >= 2 * w[k[0]] * w[k[1]]}
    monkeypatch.setattr(C, "PAIR_SALTS", 1)
    monkeypatch.setattr(C, "STRIPE_PIECES", 3)
    assert {(r.first_id, r.second_id): r.llr for r in C.associations(df).collect()} == {k: r.llr for k, r in got.items()}


def test_empty(spark):
    df = spark.createDataFrame([], "obs_id bigint, session_id bigint, first_id int, second_id int, cnt bigint")
    assert C.above_chance(C.associations(df), 20).count() == 0


def test_query_gives_every_pair(spark, tmp_path):
    from wordloom.llm import q5_cooccurrence as Q

    rnd = random.Random(4)
    rows = [(i, rnd.randrange(30), rnd.choice([0, 0, 0, 1, 2, 3, 30]), rnd.choice([0, 1, 2, 3, 4, 31]), rnd.choice([1, 1, 2, 50])) for i in range(2000)]
    rows += [(9000 + i, i, 90, 91, 400) for i in range(4)] + [(9100, 1, 92, 0, 1)]
    spark.createDataFrame(rows, "obs_id bigint, session_id bigint, first_id int, second_id int, cnt bigint").write.parquet(f"{tmp_path}/pair_log.parquet")
    t, s, w, n = brute(rows)
    got = {(r.first_id, r.second_id): r for r in Q.p5_associations(spark, str(tmp_path)).collect()}
    assert set(got) == set(t)
    for (a, b), r in got.items():
        llr = max(g2(r.t, w[a], w[b], n), 0)
        assert (r.t, r.s) == (t[a, b], len(s[a, b])) and abs(r.lift - r.t * n / (w[a] * w[b])) < 1e-6 and abs(r.llr - llr) < 1e-3
        assert r.significant == (llr >= 10.83)
    assert got[90, 91].s == 4 and got[90, 91].significant and got[90, 91].lift > 1 and got[0, 92].s == 1
    assert any(r.lift <= 1 and r.significant for r in got.values()) and any(r.lift <= 1 and not r.significant for r in got.values())
