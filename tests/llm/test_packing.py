"""p8: containers hold what they may, all of it, and little less than they can."""

import random

import numpy as np

from wordloom.llm import packing


def check(rows, items, limits):
    """Every constraint, and that nothing is lost or split without need."""
    by, got = {}, {}
    for r in rows:
        by.setdefault(r.container, []).append(r.length)
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.n_pieces))
    for lengths in by.values():
        alone = max(lengths) ** 2 if max(lengths) ** 2 > limits.attention_limit else 0
        assert sum(lengths) <= limits.tokens and len(lengths) <= limits.documents and sum(x * x for x in lengths) - alone <= (limits.beside_limit if alone else limits.attention_limit)
    want = {}
    for k, n in items:
        want.setdefault(k, []).append(max(0, n or 0))
    for k, sizes in want.items():
        assert sum(x[1] for x in got[k]) == sum(sizes)
        assert len(got[k]) == sum(max(1, -(-s // limits.tokens)) for s in sizes)
    assert set(got) == set(want)
    return len(by)


def test_pack(spark):
    rnd = random.Random(1)
    items = [(i, int(rnd.expovariate(1 / 300))) for i in range(3000)] + [(5000, None), (5001, 0), (5002, -3), (5003, 10_000), (5004, 4096), (5004, 4096), (None, 7)]
    df = spark.createDataFrame(items, "doc_id bigint, n_tokens bigint")
    limits = packing.Limits(4096)
    rows = packing.pack(df.repartition(7), limits).collect()
    n = check(rows, items, limits)
    least = -(-sum(max(0, x or 0) for _, x in items) // 4096)
    assert n <= least * 1.02 + 1
    again = packing.pack(df.repartition(2), limits).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)


def test_other_capacities_bind(spark):
    items = [(i, 10 + i % 50) for i in range(500)]
    df = spark.createDataFrame(items, "doc_id bigint, n_tokens bigint")
    for limits in (packing.Limits(1000, documents=7), packing.Limits(1000, attention=20_000.0), packing.Limits(1000, group=2)):
        check(packing.pack(df, limits).collect(), items, limits)


def test_equal_sizes_and_empty(spark):
    limits = packing.Limits(100)
    df = spark.createDataFrame([(i, 50) for i in range(40)], "doc_id bigint, n_tokens bigint")
    assert check(packing.pack(df, limits).collect(), [(i, 50) for i in range(40)], limits) == 20
    assert packing.pack(df.limit(0), limits).count() == 0
    assert packing.fill_report(packing.pack(df.limit(0), limits), limits).first().containers == 0


def test_best_fit_takes_the_tightest():
    limits = packing.Limits(10, weights=(1, 0, 0))
    assert packing.best_fit(np.array([7, 6, 4, 3]), limits).tolist() == [0, 1, 1, 0]


def test_attention_keeps_unlike_items_apart(spark):
    items = [(i, 60) for i in range(10)] + [(100 + i, 38) for i in range(10)] + [(200 + i, 5) for i in range(40)]
    df = spark.createDataFrame(items, "doc_id bigint, n_tokens bigint")
    shared = lambda rows: {r.container for r in rows if r.length == 60} & {r.container for r in rows if r.length == 38}
    limits = packing.Limits(100, attention=5000.0)
    rows = packing.pack(df, limits).collect()
    check(rows, items, limits)
    assert not shared(rows) and len(shared(packing.pack(df, packing.Limits(100, attention=1e9)).collect())) == 10
    report = packing.fill_report(packing.pack(df, limits), limits).first()
    assert report.most_attention <= limits.attention_limit and report.most_tokens <= 100
    big = [(i, 90) for i in range(5)] + [(100 + i, 1) for i in range(50)] + [(200, 10), (201, 10)]
    check(packing.pack(spark.createDataFrame(big, "doc_id bigint, n_tokens bigint"), packing.Limits(100, attention=5000.0, beside=4.0)).collect(), big, packing.Limits(100, attention=5000.0, beside=4.0))
