"""Streams equal their batch twins."""

import datetime
import random

from wordloom.streaming import typing as S


def events(spark, n=400):
    rnd = random.Random(6)
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(minutes=i, seconds=rnd.randrange(50)), rnd.randrange(5), rnd.choice(["click", "error", "view", "key"]), rnd.random() * 40) for i in range(n)]
    rows += [(900, None, 1, "click", 1.0), (901, t0, None, "click", 1.0), (902, t0, 1, None, None)]
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")


def stream(spark, tmp_path, parts=3):
    df = events(spark).orderBy("ts")
    rows = df.collect()
    for k in range(parts):  # files in order of time, as they would arrive
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    return df, S.events_stream(spark, str(tmp_path / "events"), df.schema)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_buffer_stream_is_the_batch(spark, tmp_path):
    df, st = stream(spark, tmp_path)
    out = S.latest(S.run_available(S.buffer_stream(st)), ["user_id"])
    assert as_set(out.select("user_id", "text", "cursor", "known", "desyncs", "n")) == as_set(S.buffers(df))


def test_sessions_and_counters(spark, tmp_path):
    df, st = stream(spark, tmp_path)
    out = S.run_available(S.sessions(st.withWatermark("ts", "1 day")), "complete")
    last = out.agg({"batch": "max"}).first()[0]
    assert as_set(out.filter(f"batch = {last}").drop("batch")) == as_set(S.sessions(df))
    out = S.latest(S.run_available(S.counters(st)), ["user_id"])
    assert as_set(out.select("user_id", "requests", "produced", "last_ts")) == as_set(S.counters(df))


def test_buffer_rules():
    b = S.Buffer()
    b.commit("abc")
    b.delete(1)
    assert (b.text, b.cursor, b.known) == ("ab", 2, True)
    b.delete(5)
    assert (b.text, b.cursor, b.known) == ("", 0, False)
    b.commit("x" * 5000)
    assert len(b.text) == 2048 and b.cursor == 5000
    b.moved(5000)
    assert b.desyncs == 0
    b.moved(7)
    assert (b.text, b.cursor, b.known, b.desyncs) == ("", 7, False, 1)
