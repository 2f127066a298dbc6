"""p3: draws against targets. p4: picks that stay."""

import itertools
import random

import numpy as np

from wordloom.llm import sampling as S


def test_rake():
    cells = np.array([40, 10, 30, 20, 5])
    rows, cols = (np.array([0, 0, 1, 1, 2]), np.array([30.0, 10.0, 2.0])), (np.array([0, 1, 0, 1, 1]), np.array([21.0, 21.0]))
    third = (np.array([0, 1, 1, 0, 0]), np.array([25.0, 17.0]))
    x = S.rake(cells, [rows, cols])
    assert np.allclose(np.bincount(rows[0], x), rows[1], atol=1e-6) and np.allclose(np.bincount(cols[0], x), cols[1], atol=1e-6)
    x = S.rake(np.array([9, 8, 7, 6, 5, 4, 3, 2]), [(np.arange(8) // 4, np.array([6.0, 4.0])), (np.arange(8) // 2 % 2, np.array([5.0, 5.0])), (np.arange(8) % 2, np.array([7.0, 3.0]))])
    assert np.allclose([x[:4].sum(), x[[0, 1, 4, 5]].sum(), x[::2].sum()], [6, 5, 7], atol=1e-6) and third[1].sum() == 42


def most(want, cells, prefix):
    """Most records that the categories of ``prefix`` can have together: the least cut."""
    return min(sum(n for cats, n in cells if set(cats) & set(t)) + sum(want[s] for s in prefix if s not in t) for k in range(len(prefix) + 1) for t in itertools.combinations(prefix, k))


def test_repair_leaves_no_closable_gap():
    rnd = random.Random(9)
    for _ in range(300):
        cats = "abcd"[: rnd.randrange(1, 5)]
        cells = {f"c{i}": (rnd.sample(cats, rnd.randrange(1, len(cats) + 1)), rnd.randrange(6)) for i in range(rnd.randrange(1, 6))}
        want = {s: rnd.randrange(8) for s in cats}
        free, drawn, left = {}, {}, dict(want)
        for c, (own, n) in cells.items():
            for s in own:
                k = min(rnd.randrange(n + 1), left[s])
                if k:
                    drawn[c, s] = k
                    left[s] -= k
                    n -= k
            free[c] = n
        have, moves = S.repair(free, drawn, {c: own for c, (own, _) in cells.items()}, want, list(cats))
        for k in range(1, len(cats) + 1):
            assert sum(have[s] for s in cats[:k]) == most(want, list(cells.values()), cats[:k])
        end = dict(drawn)
        for c, a, b, n in moves:
            assert n > 0 and (a is None or end[c, a] >= n)
            if a is not None:
                end[c, a] -= n
            if b is not None:
                assert b in cells[c][0]
                end[c, b] = end.get((c, b), 0) + n
        assert {s: sum(n for (_, t), n in end.items() if t == s) for s in cats} == have
        assert all(sum(n for (x, _), n in end.items() if x == c) <= size for c, (_, size) in cells.items())


def keys(spark, n=4000, parts=3):
    rnd = random.Random(4)
    names = ["real"] * 20 + [" REAL", "Real ", "clean", "CLEAN", "injected", "repeat:batch-1", "Repeat:b", None, "rare"]
    rows = [("c1" if i % 4 else "c2", rnd.choice(names), f"s{rnd.randrange(n)}" if i % 50 else None, rnd.choice(["adjacent"] * 5 + ["prior", None])) for i in range(n)]
    rows = [r for r in rows if r[1] != "rare" or rnd.random() < 0.05]
    return rows, spark.createDataFrame(rows + rows[:100], "campaign string, stratum string, source_id string, path string").withColumn("wanted", S.F.lit("clash")).repartition(parts)


TARGETS = [("d1", "c1", 200, "real", 0.6, 2), ("d1", "c1", 200, "clean", 0.2, 5), ("d1", "c1", 200, "repeat", 0.0, 3), ("d1", "c1", 200, "rare", 0.19, 40), ("d2", "c2", 20, "nowhere", 0.0, 1), ("d2", "c2", 20, "real", 1.0, 0), ("d3", "c9", 20, "real", 1.0, 0), ("d4", "c1", None, "clean", None, None)]
SHAPE = "draw_id string, campaign string, sample_size int, stratum string, target_share double, min_rows int"


def test_draw(spark):
    rows, df = keys(spark)
    targets = spark.createDataFrame(TARGETS, SHAPE)
    have = {}
    for c, s, i, _ in rows:
        if s is not None and i is not None:
            have.setdefault((c, s.strip().lower().split(":")[0]), set()).add(i)
    got = {(r.draw_id, r.stratum): r for r in S.report(df, targets).collect()}
    assert len(got) == len(TARGETS)
    for d, c, size, s, share, least in TARGETS:
        r, n = got[d, s], len(have.get((c, s), ()))
        want = max(least or 0, round((share or 0) * (size or 0)))
        assert (r.wanted, r.available, r.gap) == (want, n, max(0, want - n)) and r.taken <= min(want, n)
    assert got["d1", "real"].taken == 120 and got["d2", "real"].taken == 20 and got["d1", "rare"].gap > 0
    picked = [tuple(r) for r in S.draw(df, targets).collect()]
    assert len({(d, i) for d, _, i in picked}) == len(picked)
    assert all(i in have[{"d1": "c1", "d2": "c2"}[d], s] for d, s, i in picked)
    for (d, s), r in got.items():
        assert sum(x[:2] == (d, s) for x in picked) == r.taken and r.residual_gap == r.wanted - r.taken
    again = [tuple(r) for r in S.draw(keys(spark, parts=7)[1], targets).collect()]
    assert sorted(again) == sorted(picked)


def test_empty(spark):
    _, df = keys(spark)
    targets = spark.createDataFrame(TARGETS, SHAPE)
    assert S.draw(df, targets.limit(0)).count() == 0 and S.draw(df.limit(0), targets).count() == 0
    assert all(r.available == 0 and r.taken == 0 for r in S.report(df.limit(0), targets).collect())


def test_keys_follow_weights(spark):
    df = spark.range(20_000).select(S.F.lit("c").alias("campaign"), S.F.lit("real").alias("stratum"), S.F.col("id").cast("string").alias("source_id"), S.F.when(S.F.col("id") % 4 == 0, "a").otherwise("b").alias("path"))
    targets = spark.createDataFrame([("d", "c", 4000, "real", 1.0, 0)], SHAPE)
    shares = S.draw(df, targets).select((S.F.col("id").cast("int") % 4 == 0).alias("a")).groupBy("a").count().collect()
    assert abs({r.a: r["count"] for r in shares}[True] / 4000 - 0.25) < 0.03


def test_shared_records_are_moved(spark):
    rows = [("c", s, f"x{i}", "p") for i in range(10) for s in ("a", "b")] + [("c", "b", f"y{i}", "p") for i in range(10)]
    df = spark.createDataFrame(rows, "campaign string, stratum string, source_id string, path string")
    targets = spark.createDataFrame([("d", "c", 20, "a", 0.5, 10), ("d", "c", 20, "b", 0.5, 10)], SHAPE)
    got = {(r.stratum, r.id) for r in S.draw(df, targets).collect()}
    assert got == {("a", f"x{i}") for i in range(10)} | {("b", f"y{i}") for i in range(10)}
    assert all(r.residual_gap == 0 for r in S.report(df, targets).collect())
    more = spark.createDataFrame([("d", "c", 30, "a", 0.5, 0), ("d", "c", 30, "b", 0.5, 15)], SHAPE)
    assert {r.stratum: (r.taken, r.gap, r.residual_gap) for r in S.report(df, more).collect()} == {"a": (10, 5, 5), "b": (10, 0, 5)}


def test_second_margin_has_targets_of_its_own(spark):
    df = spark.range(20_000).select(S.F.lit("c").alias("campaign"), S.F.when(S.F.col("id") % 3 == 0, "x").otherwise("y").alias("stratum"), S.F.col("id").cast("string").alias("source_id"), S.F.when(S.F.col("id") % 10 == 0, "rare").otherwise("often").alias("path"))
    targets = spark.createDataFrame([("d", "c", 400, "x", 0.5, 0), ("d", "c", 400, "y", 0.5, 0)], SHAPE)
    shares = spark.createDataFrame([("d", 0, "rare", 0.5), ("d", 0, "often", 0.5), ("d", 0, "none", 0.1)], "draw_id string, margin int, value string, share double")
    picked = S.draw(df, targets, shares=shares).select("stratum", (S.F.col("id").cast("int") % 10 == 0).alias("rare")).groupBy("stratum", "rare").count().collect()
    assert sum(r["count"] for r in picked) == 400 and all(abs(r["count"] - 100) < 30 for r in picked)


def waves(spark, upto):
    rnd = random.Random(5)
    rows = [(f"s{rnd.randrange(3000)}", rnd.randrange(5), rnd.choice([1.0, 0.2, 3.0, None])) for _ in range(9000)]
    return spark.createDataFrame([r for r in rows if r[1] <= upto] + [(None, 0, 1.0)], "source_id string, wave int, w double")


def test_picks_stay(spark):
    last = set()
    for upto in range(5):
        weighted = S.running_weights(waves(spark, upto), "source_id", "wave", S.F.col("w"))
        got = {r.id for r in S.poisson(weighted.repartition(upto + 1), S.F.lit(11), 0.1).collect()}
        assert last <= got
        last = got
    n = len(last) / 3000
    assert 0.1 < n < 0.3
    other = {r.id for r in S.poisson(S.running_weights(waves(spark, 4), "source_id", "wave", S.F.col("w")), S.F.lit(12), 0.1).collect()}
    assert other != last
    assert S.poisson(S.running_weights(waves(spark, 4).limit(0), "source_id", "wave", S.F.col("w")), S.F.lit(1), 0.1).count() == 0


def test_weights_never_fall(spark):
    rows = {}
    for r in S.running_weights(waves(spark, 4), "source_id", "wave", S.F.col("w")).collect():
        rows.setdefault(r.id, []).append((r.wave, r.weight))
    for seen in rows.values():
        seen.sort()
        assert all(a[1] <= b[1] for a, b in zip(seen, seen[1:]))
