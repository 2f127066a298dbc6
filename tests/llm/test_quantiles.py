"""p6: sketches against exact ranks."""

import numpy as np
import pytest

from wordloom.llm import quantiles as Q

QS = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]


def errors(sketch, values, qs=QS):
    y = np.sort(values)
    return [max(0, np.searchsorted(y, v, "left") / len(y) - q, q - np.searchsorted(y, v, "right") / len(y)) for q, v in zip(qs, sketch.quantiles(qs), strict=True)]


@pytest.mark.parametrize("order", ["as it is", "sorted", "reversed", "few values"])
def test_error_and_top(order):
    x = np.random.default_rng(1).lognormal(8, 1.5, 300_000).astype(np.int64)
    x = {"sorted": np.sort, "reversed": lambda v: np.sort(v)[::-1], "few values": lambda v: v % 7}.get(order, lambda v: v)(x)
    s = Q.Sketch()
    for part in np.array_split(x, 111):
        s.add(part)
    assert max(errors(s, x)) < 0.01 and sum(map(len, s.levels)) < 5000 and s.n == len(x)
    assert errors(s, x, [0.9999])[0] < 1e-4 and s.quantiles([1.0]) == [x.max()]


def test_merge_is_as_good():
    x = np.random.default_rng(2).lognormal(8, 1, 200_000).astype(np.int64)
    total = Q.Sketch()
    for part in np.array_split(x, 97):
        s = Q.Sketch()
        s.add(part)
        total.merge(Q.Sketch.load(s.dump()))
    assert total.n == len(x) and max(errors(total, x)) < 0.01 and Q.Sketch().quantiles([0.5]) == [None]


def test_spark(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "hot" if i % 3 else None if i % 7 == 0 else f"b{i % 40}", int(v)) for i, v in enumerate(rng.lognormal(8, 1, 30_000))]
    rows += rows[:3000] + [(90_000, "b1", None), (90_001, "empty", None)]
    df = spark.createDataFrame(rows, "answer_id bigint, batch_id string, ms bigint").withColumn("n", Q.F.lit("clash"))
    exact = {}
    for _, b, v in {r[0]: r for r in rows}.values():
        if v is not None:
            exact.setdefault(b, []).append(v)
    parts = Q.sketches(df, ["batch_id"], "ms", once="answer_id")
    got = {(r.batch_id, r.q): r for r in Q.percentiles(Q.merged(parts, ["batch_id"]), ["batch_id"], [50, 95]).collect()}
    assert {b for b, _ in got} == set(exact) and "empty" not in exact
    for (b, q), r in got.items():
        y = np.sort(exact[b])
        assert r.n == len(y) and np.searchsorted(y, r.value, "left") / len(y) <= q / 100 + 0.01 and np.searchsorted(y, r.value, "right") / len(y) >= q / 100 - 0.01
    limits = spark.createDataFrame([(50, 0), (95, 10**9)], "q int, limit_ms bigint")
    assert {r.q for r in Q.over_limits(Q.percentiles(parts, ["batch_id"], [50, 95]), limits).collect()} == {50}
    assert Q.merged(Q.sketches(df.limit(0), ["batch_id"], "ms", once="answer_id"), ["batch_id"]).count() == 0
    assert sum(r.n for r in Q.sketches(df, ["batch_id"], "ms").collect()) == 33_000


def test_fractions_and_many_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 3, None if i % 5 == 0 else f"g{i % 11}", float(v)) for i, v in enumerate(rng.normal(0, 0.01, 20_000))] + [(0, "g0", float("nan")), (0, "g0", None)]
    df = spark.createDataFrame(rows, "a int, b string, x double").repartition(5)
    exact = {}
    for a, b, v in rows[:-2]:
        exact.setdefault((a, b), []).append(v)
    parts = Q.sketches(df, ["a", "b"], "x")
    assert sum(r.n for r in parts.collect()) == 20_000
    got = Q.percentiles(Q.merged(parts, ["a", "b"]), ["a", "b"], [10, 50, 99]).collect()
    assert {(r.a, r.b) for r in got} == set(exact)
    for r in got:
        y = np.sort(exact[r.a, r.b])
        assert r.value in y and abs(np.searchsorted(y, r.value) / len(y) - r.q / 100) < 0.011


def test_a_task_passes_sketches_on(spark, monkeypatch):
    monkeypatch.setattr(Q, "HELD", 4000)
    df = spark.range(30_000).select((Q.F.col("id") % 700).alias("g"), Q.F.col("id").alias("v")).coalesce(1)
    parts = Q.sketches(df, ["g"], "v")
    assert sum(r.n for r in parts.collect()) == 30_000 and Q.merged(parts, ["g"]).count() == 700
