"""Queries of sources, sinks, streams and checks: what is written is read again and compared."""

from __future__ import annotations

import bz2
import uuid

import pandas as pd
from pyspark.sql import functions as F

from wordloom.functions.hashing import content_hash
from wordloom.plans import checks as C
from wordloom.plans import tables as T
from wordloom.queries.common import BI, bi, docs, hash_sql, lex, sents
from wordloom.session import materialize, scratch, table
from wordloom.sources import readers as I
from wordloom.sources import sinks as O
from wordloom.streaming import typing as ST

QUERIES, SQL = {}, {}
_c = F.col


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT word, cnt FROM lexicon WHERE cnt >= 5")
def q_src2_snk1_word_counts(spark, d):
    p = scratch(spark, "counts")
    O.sorted_lines(lex(spark, d), F.concat_ws(" ", "word", "cnt"), p, "word")
    return I.word_counts(spark, p, 5)[0]


@query("SELECT count(*) AS read, 0::BIGINT AS malformed, count(*) FILTER (cnt < 5) AS below FROM lexicon")
def q_src2_counters(spark, d):
    p = scratch(spark, "counts")
    O.sorted_lines(lex(spark, d), F.concat_ws(" ", "word", "cnt"), p, "word")
    return I.word_counts(spark, p, 5)[1]


@query("SELECT DISTINCT form_id, base_form FROM verb_forms WHERE morphology LIKE '%PAST%' AND base_form IS NOT NULL")
def q_src3_json_array(spark, d):
    p = scratch(spark, "array")
    f = table(spark, d, "verb_forms", "form_id", "base_form", "morphology").filter("base_form IS NOT NULL").distinct()
    f.select(F.concat(F.to_json(F.struct("form_id", "base_form", "morphology")), F.lit(",")).alias("value")).write.text(p)
    return I.json_array_lines(spark, p, "form_id string, base_form string, morphology string", "PAST").filter(_c("morphology").contains("PAST")).select("form_id", "base_form")


@query("SELECT DISTINCT doc_id // 100 * 1000 AS \"offset\" FROM documents")
def q_src4_offsets(spark, d):
    p = scratch(spark, "index")
    docs(spark, d).select(F.concat_ws(":", (F.floor(_c("doc_id") / 100) * 1000).cast("string"), "doc_id", "source").alias("value")).write.text(p)
    return I.offsets(spark, p)


@query("SELECT doc_id, md5(regexp_extract('<text bytes=\"1\">' || text || '</text>', '(?s)<text\\b[^>]*>(.*?)</text>', 1)) AS digest FROM documents WHERE text IS NOT NULL")
def q_src6_text_elements(spark, d):
    """Each text inside a page; one that holds a closing tag ends there."""
    t = docs(spark, d).filter("text IS NOT NULL")
    xml = F.concat(F.lit('<page><text bytes="1">'), "text", F.lit("</text></page>"))
    return t.select("doc_id", F.element_at(I.text_elements(xml), 1).alias("t")).select("doc_id", F.md5("t").alias("digest"))


@query("""WITH s AS (SELECT unnest(string_split_regex(text, '[.!?;:\\n\\x{05C3}]|--')) AS s FROM documents), t AS (SELECT array_to_string(regexp_extract_all(s, '[א-ת]+'), ' ') AS line, len(regexp_extract_all(s, '[א-ת]+')) AS n FROM s) SELECT line, n::INT AS n, count(*) AS times FROM t WHERE n >= 2 GROUP BY ALL""")
def q_src7_sentences(spark, d):
    p = scratch(spark, "sentences")
    sents(spark, d).filter("size(tokens) >= 2").select(F.array_join("tokens", " ").alias("value")).write.option("compression", "gzip").text(p)
    return I.sentences(spark, p).groupBy(F.array_join("tokens", " ").alias("line"), F.size("tokens").alias("n")).agg(F.count("*").alias("times"))


@query("SELECT DISTINCT typed AS typo, other AS expected FROM label_keys WHERE typed IS NOT NULL AND other IS NOT NULL AND typed <> '' AND other <> ''")
def q_src8_snk4_pairs(spark, d):
    p = scratch(spark, "pairs")
    O.tsv(table(spark, d, "label_keys", "typed", "other").filter("typed <> '' AND other <> ''").distinct(), p)
    return I.tsv(spark, p, "typo string, expected string")


@query("SELECT DISTINCT trim(regexp_replace(split_part(line, chr(9), 1), '\\s+', ' ', 'g')) AS text FROM (SELECT unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS line FROM documents WHERE source = 'subtitles') WHERE trim(regexp_replace(split_part(line, chr(9), 1), '\\s+', ' ', 'g')) <> ''")
def q_src9_first_column(spark, d):
    p = scratch(spark, "comments")
    docs(spark, d).filter("source = 'subtitles'").select(_c("text").alias("value")).filter("value IS NOT NULL").write.text(p)
    return I.first_column(spark, p).distinct()


@query("SELECT word_id, word FROM lexicon")
def q_src11_src12_words_blob(spark, d):
    """The blob in order is the lexicon again: ids are places."""
    p = scratch(spark, "blob")
    O.sorted_lines(lex(spark, d), _c("word"), p, "word")
    from wordloom.operators.windows import numbered

    return numbered(I.words_blob(spark, p), ["word"], "word_id").select(_c("word_id").cast("int").alias("word_id"), "word")


@query("SELECT base_form, min(form_id) AS form_id FROM verb_forms WHERE base_form IS NOT NULL GROUP BY 1")
def q_src17_first_wins(spark, d):
    return I.first_wins(table(spark, d, "verb_forms", "base_form", "form_id").filter("base_form IS NOT NULL").select("base_form", "form_id"), "base_form", "form_id")


@query("SELECT base_form, max(form_id) AS form_id FROM verb_forms WHERE base_form IS NOT NULL GROUP BY 1")
def q_src14_last_wins(spark, d):
    return I.last_wins(table(spark, d, "verb_forms", "base_form", "form_id").filter("base_form IS NOT NULL"), "base_form", "form_id")


@query("SELECT DISTINCT id, source_id, typed FROM label_keys WHERE lower(trim(stratum)) = 'clean'")
def q_src15_snk5_candidates(spark, d):
    p = scratch(spark, "pool")
    k = table(spark, d, "label_keys", "id", "source_id", "typed", "stratum").distinct()
    O.json_lines(k.select(F.lower(F.trim("stratum")).alias("kind"), "id", "source_id", "typed"), p)
    return I.kinds(spark, p, "kind string, id string, source_id string, typed string", "clean").select("id", "source_id", "typed").distinct()


@query()
def q_src5_blocks(spark, d):
    """Every text packed as a block of its own, about one in sixteen cut short and as many with a wrong checksum, read again."""
    p = scratch(spark, "blocks")

    @F.pandas_udf("binary")
    def packed(texts: pd.Series, harm: pd.Series) -> pd.Series:
        out = []
        for t, h in zip(texts, harm, strict=True):
            c = bytearray(bz2.compress(t.encode()))
            if h == 0:
                del c[len(c) // 2 :]
            elif h == 1:
                c[12] ^= 255
            out.append(bytes(c))
        return pd.Series(out, dtype=object)

    rows = docs(spark, d).filter("text IS NOT NULL").select("doc_id", "source", packed("text", F.pmod(F.xxhash64("doc_id"), F.lit(16))).alias("content"))
    rows.write.parquet(p)
    return I.unpacked(spark.read.parquet(p), "doc_id", "source").select("doc_id", "source", "ok", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query("SELECT 3::BIGINT AS files, sum(strlen('{\"word_id\":' || word_id || ',\"word\":\"' || word || '\"}') + 1)::BIGINT AS bytes FROM lexicon")
def q_src18_files(spark, d):
    p = scratch(spark, "dir")
    O.json_lines(lex(spark, d).select("word_id", "word").repartition(3), p)
    return I.files(spark, p).filter(_c("name").endswith(".json")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


@query(f"WITH {BI} SELECT first_id, second_id, cnt, row_number() OVER (PARTITION BY first_id ORDER BY cnt DESC, second_id) AS rank FROM bi QUALIFY rank <= 64")
def q_snk2_src13_bucketed(spark, d):
    name = f"wordloom_bigrams_{uuid.uuid4().hex}"
    O.bucketed(T.capped(bi(spark, d), 64).select("first_id", "second_id", "cnt", "rank"), name, scratch(spark, "bucketed"), 8, "first_id", "rank")
    out = materialize(spark.table(name), "unbucketed")
    O.drop(spark, name)
    return out


@query(f"SELECT count(*) AS entries, {hash_sql('word')} AS digest, 'lexicon' AS name, 'made for tests' AS source FROM lexicon")
def q_snk3_manifest(spark, d):
    p = scratch(spark, "manifest")
    O.manifest(lex(spark, d), _c("word"), p, name="lexicon", source="made for tests")
    return spark.read.schema("entries bigint, digest string, name string, source string").json(p)


@query("SELECT DISTINCT typed, typed AS back, true AS guarded FROM label_keys WHERE typed IS NOT NULL")
def q_snk8_sealed(spark, d):
    k = table(spark, d, "label_keys", "typed").filter("typed IS NOT NULL").distinct().withColumn("s", O.sealed(_c("typed"), "0123456789abcdef"))
    return k.select("typed", O.opened(_c("s"), "0123456789abcdef").alias("back"), O.opened(_c("s"), "another-key-here").isNull().alias("guarded"))


_SESS = """g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)"""


@query(f"WITH {_SESS} SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session")
def q_stm7_sessions(spark, d):
    return ST.sessions(table(spark, d, "events", "user_id", "ts"))


def _stream(spark, d, *columns):
    """The table as a stream. The path is a pattern, as a stream takes a lone file by no other name; event times get the zoned
    type that watermarks need."""
    schema = table(spark, d, "events").schema
    return ST.events_stream(spark, f"{d}/events.parque[t]", schema).withColumn("ts", _c("ts").cast("timestamp")).select(*columns)


@query(f"WITH {_SESS} SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session")
def q_stm7_sessions_stream(spark, d):
    out = ST.run_available(ST.sessions(_stream(spark, d, "user_id", "ts").withWatermark("ts", "1 day")), "complete")
    last = out.agg(F.max("batch").alias("batch"))
    out = out.join(F.broadcast(last), "batch", "left_semi")
    return out.select("user_id", _c("started").cast("timestamp_ntz").alias("started"), "n")


@query(f"WITH {_SESS} SELECT user_id, event_type, count(*) AS cnt, count(DISTINCT session) AS sessions FROM s GROUP BY 1, 2")
def q_stm6_stm7_credit(spark, d):
    return ST.session_credit(table(spark, d, "events", "event_id", "user_id", "ts", "event_type"))


@query()
def q_stm1_stm2_stm3_stm4_buffers(spark, d):
    return ST.buffers(table(spark, d, "events"))


@query()
def q_stm1_stm4_buffer_stream(spark, d):
    return ST.latest(ST.run_available(ST.buffer_stream(_stream(spark, d, "event_id", "user_id", "ts", "event_type", "value"))), ["user_id"])


@query("SELECT user_id, event_id, value FROM events WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q_stm9_latest_wins(spark, d):
    """The same answer as a stream: each micro-batch replaces what it overtakes."""
    return ST.latest(ST.run_available(ST.latest_wins(_stream(spark, d, "user_id", "event_id", "ts", "value"))), ["user_id"])


@query()
def q_stm11_latencies(spark, d):
    return ST.latencies(table(spark, d, "events"))


@query("SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'click') AS produced, max(ts) AS last_ts FROM events GROUP BY 1")
def q_stm10_stm12_counters_stream(spark, d):
    out = ST.latest(ST.run_available(ST.counters(_stream(spark, d, "user_id", "event_type", "ts")), every="1 second"), ["user_id"])
    return out.withColumn("last_ts", _c("last_ts").cast("timestamp_ntz"))


@query("SELECT 'integers only' AS name, 5::BIGINT AS denominator, 0::BIGINT AS findings, 'PASS' AS status")
def q_dq11_integers_only(spark, d):
    from wordloom.operators.users import user_pairs

    p = user_pairs(table(spark, d, "pair_log", "obs_id", "user_id", "session_id", "first_id", "second_id", "cnt"))
    return C.run(p, [C.only_integers()]).select("name", "denominator", "findings", "status")
