"""Streams of typing events: sessions, per-key state, latest-wins, windowed latencies. Each has a batch twin."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.profiles import BUFFER
from wordloom.session import scratch

GAP = "30 minutes"


def events_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A stream of the files of a table, ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_available(stream: DataFrame, mode: str = "update", every: str | None = None) -> DataFrame:
    """Run a stream over all that is there and return its output: each micro-batch is written as a whole beside its number,
    so that a batch that is retried replaces itself, and the checkpoint lies in the shared folder. ``every``: what has
    arrived is written at most so often, whatever came in between (a debounced write), until nothing is left."""
    spark = stream.sparkSession
    base = scratch(spark, "stream")

    def put(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(put)
    if every is None:
        writer.trigger(availableNow=True).start().awaitTermination()
    else:
        query = writer.trigger(processingTime=every).start()
        query.processAllAvailable()
        query.stop()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/out")


def latest(out: DataFrame, keys: list[str]) -> DataFrame:
    """The last written row of each key: what an update stream's readers see."""
    rest = [c for c in out.columns if c not in (*keys, "batch")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, *(f"v.{c}" for c in rest))


def sessions(events: DataFrame) -> DataFrame:
    """(user_id, started, n) of each user's runs of events without a gap of 30 minutes; works on streams and tables."""
    e = events.filter("ts IS NOT NULL").groupBy("user_id", F.session_window("ts", GAP).alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("started"), "n")


def latest_wins(events: DataFrame) -> DataFrame:
    """(user_id, event_id, value) of each user's last request: a later one cancels those before it, whichever arrives first; ties
    by id. Works on streams and tables."""
    e = events.filter("ts IS NOT NULL").groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("v"))
    return e.select("user_id", "v.event_id", "v.value")


def counters(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "click").alias("produced"), F.max("ts").alias("last_ts"))


def latencies(events: DataFrame, window: str = "1 day") -> DataFrame:
    """Windowed count and percentiles; late events of over a day are dropped by the watermark of a stream."""
    e = events.filter("ts IS NOT NULL AND value IS NOT NULL").withWatermark("ts", "1 day") if events.isStreaming else events.filter("ts IS NOT NULL AND value IS NOT NULL")
    by = e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.percentile_approx("value", [0.5, 0.95], 10_000).alias("p"))
    return by.select(F.col("w.start").alias("day"), "event_type", "n", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))


#: A word as it stands in a text, and what of one stands at the end.
_WORD, _WORD_END = re.compile(r"[\w֑-ׇ׳״'\"]+"), re.compile(r"[\w֑-ׇ׳״'\"]*\Z")


class Buffer:
    """The text before a cursor as far as it is known: bounded, and forgotten when the cursor moves by itself."""

    __slots__ = ("text", "cursor", "known", "desyncs")

    def __init__(self, text: str | None = "", cursor: int = 0, known: bool = True, desyncs: int = 0):
        self.text, self.cursor, self.known, self.desyncs = text or "", cursor, known, desyncs

    def commit(self, text: str) -> None:
        self.text, self.cursor = (self.text + text)[-BUFFER:], self.cursor + len(text)

    def delete(self, count: int) -> None:
        if count > 0:
            gone = min(count, len(self.text))
            self.text, self.cursor = self.text[: len(self.text) - gone], max(0, self.cursor - count)
            self.known = self.known and gone == count

    def moved(self, to: int) -> None:
        if to != self.cursor:
            self.text, self.cursor, self.known, self.desyncs = "", max(0, to), False, self.desyncs + 1

    def word(self) -> str:
        """The word begun before the cursor."""
        return _WORD_END.search(self.text)[0]

    def wipe(self) -> None:
        """Forgets the text; the cursor and the count of desyncs stay."""
        self.text, self.known = "", False

    def accept(self, word: str, kind: str, replaces: str | None = None, words_back: int = 0) -> bool:
        """Puts a suggestion into the text, if it still applies; says whether it did.

        A next word is appended if no word has been begun meanwhile; anything else takes the place of the word begun. With
        ``words_back`` it replaces an earlier word, carrying along all that follows, and only if that is still there.
        """
        if words_back > 0:
            starts = [m.start() for m in _WORD.finditer(self.text, 0, len(self.text) - len(self.word()))]
            if len(starts) < words_back or not replaces:
                return False
            tail = self.text[starts[-words_back] :]
            if not tail.startswith(replaces):
                return False
            self.delete(len(tail))
            self.commit(word + tail[len(replaces) :])
            return True
        begun = self.word()
        if (kind == "NEXT_WORD") == bool(begun):
            return False
        self.delete(len(begun))
        self.commit(word)
        return True

    def apply(self, kind: str, amount: float) -> None:
        """An event as an edit: an error deletes, a view reports the cursor, anything else types its first letter."""
        n = int(amount or 0)
        if kind == "error":
            self.delete(n % 4)
        elif kind == "view":
            self.moved(self.cursor if n % 10 else n)
        else:
            self.commit(kind[:1] if n % 5 else " ")


_ROW = "user_id bigint, text string, cursor bigint, known boolean, desyncs bigint, n bigint"


def _fold(user, rows: pd.DataFrame, buffer: Buffer, n: int) -> tuple[pd.DataFrame, int]:
    rows = rows.sort_values(["ts", "event_id"], kind="stable")
    for kind, value in zip(rows["event_type"], rows["value"], strict=True):
        buffer.apply(kind, value)
    n += len(rows)
    return pd.DataFrame({"user_id": [user], "text": [buffer.text], "cursor": [buffer.cursor], "known": [buffer.known], "desyncs": [buffer.desyncs], "n": [n]}), n


def buffers(events: DataFrame) -> DataFrame:
    """Batch twin: each user's buffer after all events in order of time, ties by id. Rows without user, time or kind are none."""
    e = events.filter("user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL").select("event_id", "user_id", "ts", "event_type", "value")
    return e.groupBy("user_id").applyInPandas(lambda key, rows: _fold(key[0], rows, Buffer(), 0)[0], _ROW)


def buffer_stream(events: DataFrame) -> DataFrame:
    """The same as a stream: the buffer is the state of its user, events of a micro-batch are applied in order of time."""
    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        text, cursor, known, desyncs, n = state.get if state.exists else ("", 0, True, 0, 0)
        buffer = Buffer(text, cursor, known, desyncs)
        out, n = _fold(key[0], pd.concat(list(parts)), buffer, n)
        state.update((buffer.text, buffer.cursor, buffer.known, buffer.desyncs, n))
        yield out

    e = events.filter("user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL").select("event_id", "user_id", "ts", "event_type", "value")
    return e.groupBy("user_id").applyInPandasWithState(step, _ROW, "text string, cursor bigint, known boolean, desyncs bigint, n bigint", "update", "NoTimeout")


_ACCEPT = "id bigint, text string, cursor bigint, applied boolean"


def accepted(requests: DataFrame) -> DataFrame:
    """(id, text, cursor, applied) after one suggestion each, of (id, text, word, kind, replaces, words_back). Null texts are empty."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for i, text, word, kind, replaces, back in zip(p["id"], p["text"], p["word"], p["kind"], p["replaces"], p["words_back"], strict=True):
                b = Buffer(text, len(text or ""))
                done = b.accept(word, kind, replaces, int(back))
                out.append((i, b.text, b.cursor, done))
            yield pd.DataFrame(out, columns=["id", "text", "cursor", "applied"])

    return requests.select("id", "text", "word", "kind", "replaces", "words_back").filter("word IS NOT NULL").mapInPandas(run, _ACCEPT)


def session_credit(events: DataFrame) -> DataFrame:
    """(user_id, event_type, cnt, sessions): how often and in how many of the user's sessions each kind came."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce(F.col("ts") - F.lag("ts").over(w) >= F.expr(f"INTERVAL {GAP}"), F.lit(True)).cast("int")
    s = events.filter("ts IS NOT NULL").withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "event_type").agg(F.count("*").alias("cnt"), F.countDistinct("session").alias("sessions"))
