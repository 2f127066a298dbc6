"""Queries of user models' life, of suggestions put into a text, of optional tables, and of data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.functions.hashing import content_hash
from wordloom.operators import users as U
from wordloom.operators import vectors as V
from wordloom.plans import checks as C
from wordloom.plans import learning as Y
from wordloom.plans import rank as R
from wordloom.profiles import HEBREW
from wordloom.queries.common import BI, bi, hash_sql, lex, sents
from wordloom.queries.models import _CTX, _UP, _log, contexts
from wordloom.queries.predicting import _USERS
from wordloom.queries.raw import _RECORDS
from wordloom.session import materialize, scratch, small, table
from wordloom.sources import rawrows
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


REQUIRED = ("vocalized_inflection", "base_form", "morphology", "attested")


@query(f"""WITH h AS (SELECT src_file, min(raw) FILTER (line_no = 1) AS h FROM verb_raw GROUP BY 1), c AS (SELECT src_file, list_transform(string_split(CASE WHEN right(x, 1) = chr(13) THEN left(x, length(x) - 1) ELSE x END, ','), lambda v: trim(v, '" ')) AS c FROM (SELECT src_file, CASE WHEN left(h, 1) = chr(65279) THEN substr(h, 2) ELSE coalesce(h, '') END AS x FROM h)),
  {_RECORDS.strip()} SELECT c.src_file, array_to_string(c.c, ',') AS columns, array_to_string(list_filter([{", ".join(f"'{r}'" for r in REQUIRED)}], lambda r: NOT list_contains(c.c, r)), ',') AS missing, count(j.src_file) AS n_read, count(reason) AS n_rejected FROM c LEFT JOIN judged j ON j.src_file = c.src_file GROUP BY ALL""")
def q_src1_headers(spark, d):
    """Each file's header without its byte-order mark, the required columns it lacks, and its records read and rejected."""
    raw = table(spark, d, "verb_raw", "src_file", "line_no", "raw")
    by = rawrows.parse_records(raw).groupBy("src_file").agg(F.count("*").alias("n_read"), F.count("reason").alias("n_rejected"))
    h = I.headers(raw, REQUIRED).select("src_file", F.array_join("columns", ",").alias("columns"), F.array_join("missing", ",").alias("missing"))
    return h.join(by, "src_file", "left").fillna(0, ["n_read", "n_rejected"])


@query("SELECT doc_id FROM (SELECT doc_id, coalesce(sum(coalesce(strlen(text), 0)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 65536")
def q_src10_leading_bytes(spark, d):
    """The texts that a scan of the first 64 KiB of the corpus reads: the bound is what the operator is."""
    return I.leading(table(spark, d, "documents", "doc_id", "text"), ["doc_id"], 65_536, "text").select("doc_id")


_EVICT = f"WITH {_UP}, r AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY sessions DESC, cnt DESC, first_id, second_id) AS k FROM up)"


@query(f"{_EVICT} SELECT user_id, 'ok' AS status, first_id, second_id, cnt, sessions FROM r WHERE (n <= 100 OR k <= 90) AND user_id % 5 <> 0 UNION ALL SELECT DISTINCT user_id, CASE user_id % 4 WHEN 0 THEN 'length' WHEN 1 THEN 'mark' WHEN 2 THEN 'version' ELSE 'short' END, NULL::INT, NULL::INT, NULL::BIGINT, NULL::BIGINT FROM up WHERE user_id % 5 = 0")
def q_snk9_packed_models(spark, d):
    """Models packed into bytes and read again; those of every fifth user are damaged in one of four ways, and refused."""
    kept = U.evicted(U.user_pairs(_log(spark, d)), 100)
    p = scratch(spark, "models")
    c, u = _c("content"), _c("user_id")
    bad = F.when(u % 4 == 0, F.concat(c, F.unhex(F.lit("00")))).when(u % 4 == 1, F.concat(F.unhex(F.lit("58")), F.substring(c, F.lit(2), F.length(c)))).when(u % 4 == 2, F.concat(F.substring(c, 1, 4), F.unhex(F.lit("09")), F.substring(c, F.lit(6), F.length(c)))).otherwise(F.substring(c, 1, 7))
    O.packed_models(kept).withColumn("content", F.when(u % 5 == 0, bad).otherwise(c)).write.parquet(p)
    return O.unpacked_models(spark.read.parquet(p))


@query("SELECT word_id, word FROM lexicon WHERE cnt = 0")
def q_snk10_replaced(spark, d):
    """A table written twice to one place: the second takes the first one's place as a whole."""
    p = scratch(spark, "replaced")
    l = lex(spark, d).select("word_id", "word", "cnt")
    O.replaced(l.filter("cnt > 0").select("word_id", "word"), p)
    O.replaced(l.filter("cnt = 0").select("word_id", "word"), p)
    return spark.read.parquet(p)


@query("""WITH k AS (SELECT DISTINCT id, typed, other, path FROM label_keys WHERE typed IS NOT NULL AND other IS NOT NULL AND regexp_full_match(typed, '[א-ת]+') AND regexp_full_match(other, '[א-ת]+')), n AS (SELECT *, row_number() OVER (ORDER BY id, typed, other, path) AS i FROM k)
  SELECT i AS id, CASE i % 4 WHEN 0 THEN 'לא ' || other WHEN 1 THEN 'לא ' || other || ' כאן ' WHEN 2 THEN 'לא ' || typed || ' כאן ' ELSE typed || ' ' || other END AS text,
    length(CASE i % 4 WHEN 0 THEN 'לא ' || other WHEN 1 THEN 'לא ' || other || ' כאן ' WHEN 2 THEN 'לא ' || typed || ' כאן ' ELSE typed || ' ' || other END)::BIGINT AS cursor, i % 4 <> 2 AS applied FROM n""")
def q_stm13_accepted(spark, d):
    """Suggestions taken: in place of the word begun, of an earlier word that is still there, of one that isn't, and as a next word."""
    from wordloom.operators.windows import numbered

    k = table(spark, d, "label_keys", "id", "typed", "other", "path").filter(X.is_word(_c("typed")) & X.is_word(_c("other"))).distinct()
    n = numbered(k, ["id", "typed", "other", "path"], "i", 1)
    m = _c("i") % 4
    at = lambda *x: F.when(m == 0, x[0]).when(m == 1, x[1]).when(m == 2, x[2]).otherwise(x[3])
    no = F.lit("לא ")
    text = at(F.concat(no, "typed"), F.concat(no, "typed", F.lit(" כאן ")), F.concat(no, "typed", F.lit(" כאן ")), F.concat("typed", F.lit(" ")))
    kind = at(F.lit("CORRECTION"), F.lit("REAL_WORD_ERROR"), F.lit("REAL_WORD_ERROR"), F.lit("NEXT_WORD"))
    r = n.select(_c("i").alias("id"), text.alias("text"), _c("other").alias("word"), kind.alias("kind"), F.when(m == 2, F.concat(F.lit("zz"), "typed")).otherwise(_c("typed")).alias("replaces"), F.when(m.isin(1, 2), 2).otherwise(0).alias("words_back"))
    return ST.accepted(r)


@query(f"""WITH w AS (SELECT user_id, min(ts) + (max(ts) - min(ts)) / 2 AS wiped FROM pair_log WHERE user_id % 3 = 0 GROUP BY 1), p AS (SELECT user_id, min(ts) + (max(ts) - min(ts)) / 4 AS since FROM pair_log WHERE user_id % 3 = 1 GROUP BY 1),
  kept AS (SELECT l.* FROM pair_log l LEFT JOIN w ON w.user_id = l.user_id LEFT JOIN p ON p.user_id = l.user_id WHERE (wiped IS NULL OR coalesce(l.ts > wiped, false)) AND NOT coalesce(l.ts >= since AND l.ts < since + INTERVAL 30 DAY, false)), {_UP.replace('FROM pair_log', 'FROM kept')}
  SELECT user_id, count(*) AS pairs, sum(cnt)::BIGINT AS seen FROM up GROUP BY 1""")
def q_stm14_wiped(spark, d):
    """What users' models know after a third of them wiped theirs halfway, and a third paused learning for thirty days."""
    log = table(spark, d, "pair_log", "obs_id", "user_id", "session_id", "first_id", "second_id", "cnt", "ts")
    span = log.groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    wipes = span.filter("user_id % 3 = 0").select("user_id", F.expr("lo + (hi - lo) / 2").alias("ts"))
    since = F.expr("lo + (hi - lo) / 4")
    pauses = span.filter("user_id % 3 = 1").select("user_id", since.alias("since"), (since + F.expr("INTERVAL 30 DAY")).alias("until"))
    return U.user_pairs(U.remembered(log, wipes, pauses)).groupBy("user_id").agg(F.count("*").alias("pairs"), F.sum("cnt").alias("seen"))


@query("SELECT * FROM (SELECT 'lexicon' AS asset, count(*) AS n, false AS missing FROM lexicon UNION ALL SELECT 'bigrams', 0, true UNION ALL SELECT 'abbreviations', 0, true UNION ALL SELECT 'completions of ה', 3, false)")
def q_stm15_stm12_degraded(spark, d):
    """A start without pair table and abbreviations: both are empty, the state says so, and completions are served all the same."""
    at, none = f"{d}/lexicon.parquet", scratch(spark, "nowhere")
    l, gone = I.optional(spark, at, "word_id int, word string, cnt bigint, log_freq smallint")
    pairs, no_pairs = I.optional(spark, f"{none}/bigrams", "first_id int, second_id int, cnt bigint, log_count int")
    abbr, no_abbr = I.optional(spark, f"{none}/abbreviations", "bare string, canonical string, cnt bigint")
    served = R.ordinary(spark.createDataFrame([("ה", None)], "current string, prev int"), l, pairs, abbr)
    row = lambda df, name, missing: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("asset"), "n", F.lit(missing).alias("missing"))
    return row(l, "lexicon", gone).unionByName(row(pairs, "bigrams", no_pairs)).unionByName(row(abbr, "abbreviations", no_abbr)).unionByName(row(served, "completions of ה", False))


W_IN, W_STATE, W_OUT, BIAS = V.weights8(6, 8, 7), V.weights8(6, 6, 8), V.weights8(8, 6, 9), [3 * i - 7 for i in range(6)]
_M = lambda m: "[" + ", ".join("[" + ", ".join(map(str, r)) + "]" for r in m) + "]"
_MV = lambda m, x: f"list_transform({_M(m)}, lambda r: list_sum(list_transform(list_zip(r, {x}), lambda p: p[1] * p[2]))::BIGINT)"
_RQ = lambda s: f"list_transform({s}, lambda v: greatest(0, least(127, v >> 7)))"


@query(f"""WITH x AS (SELECT vec_id, list_transform(embedding[1:8], lambda v: trunc(v::DOUBLE * 100)::INT) AS x FROM embeddings), h AS (SELECT vec_id, {_RQ(f"list_transform(list_zip({_MV(W_IN, 'x')}, {BIAS}), lambda p: p[1] + p[2])")} AS h FROM x)
  SELECT vec_id, array_to_string(h, ',') AS state, array_to_string({_RQ(_MV(W_OUT, 'h'))}, ',') AS projected FROM h""")
def q_mod25_int8_step(spark, d):
    """One recurrent step of 8-bit numbers from an empty state on each vector's first eight values, and its projection."""
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    v = v.withColumn("x", F.transform(F.slice("embedding", 1, 8), lambda a: (a.cast("double") * 100).cast("int"))).drop("embedding")
    h = v.withColumn("h", V.recurrent8(_c("x"), F.array(*[F.lit(0)] * 6), W_IN, W_STATE, BIAS))
    return h.select("vec_id", F.array_join("h", ",").alias("state"), F.array_join(V.requantised(V.matvec8(W_OUT, _c("h"))), ",").alias("projected"))


@query(f"""WITH {BI}, {_CTX}, s AS (SELECT ctx.prefix, prev, word_id, word, log_freq, log_freq + coalesce(log_count, 0) * 3 - length(word) AS score FROM ctx JOIN pc ON pc.prefix = ctx.prefix AND place <= 24 AND word <> ctx.prefix LEFT JOIN bi ON first_id = prev AND second_id = word_id)
  SELECT prefix, prev, word, score::INT AS score, row_number() OVER (PARTITION BY prefix, prev ORDER BY score DESC, log_freq DESC, word_id) AS rank FROM s QUALIFY rank <= 3""")
def q_udf3_own_score(spark, d):
    """Completions under a score of one's own: pairs count threefold, and longer words less."""
    score = _c("log_freq") + F.coalesce("log_count", F.lit(0)) * 3 - F.length("word")
    return R.completions(contexts(spark, d), lex(spark, d), bi(spark, d), (2,), score=score).select("prefix", "prev", "word", _c("score").cast("int").alias("score"), "rank")


# Checks. Their SQL counts the same things by other means.


@query(f"""WITH {_RECORDS.strip()}, per AS (SELECT src_file, count(*) AS r, count(reason) AS x FROM judged GROUP BY 1), s AS (SELECT src_file, max(rows_read) AS r, max(rows_rejected) AS x FROM parse_stats GROUP BY 1)
  SELECT src_file, CASE WHEN s.r IS NULL THEN 'NOT-MEASURED' WHEN abs(coalesce(per.r, 0) - s.r) <= 0.01 * s.r THEN 'PASS' ELSE 'FAIL' END AS read, CASE WHEN s.x IS NULL THEN 'NOT-MEASURED' WHEN coalesce(per.x, 0) = s.x THEN 'PASS' ELSE 'FAIL' END AS rejected FROM s LEFT JOIN per USING (src_file)""")
def q_dq2_dq13_against_manifest(spark, d):
    """Per file: records read within a hundredth of the manifest's figure, records rejected exactly as many."""
    return C.against_stated(rawrows.parse_records(table(spark, d, "verb_raw", "src_file", "line_no", "raw")), table(spark, d, "parse_stats", "src_file", "rows_read", "rows_rejected"))


@query(f"SELECT 'as stored' AS copy, {hash_sql('word')} AS digest, count(*) AS entries, 'PASS' AS status FROM lexicon UNION ALL SELECT 'one word short', {hash_sql('word')}, count(*), 'FAIL' FROM lexicon WHERE word_id <> 3")
def q_dq1_content(spark, d):
    """A stored word list against the manifest written with it, and a copy that lost a word."""
    l = lex(spark, d)
    p, m = scratch(spark, "list"), scratch(spark, "manifest")
    O.sorted_lines(l, _c("word"), p, "word")
    said = O.manifest(l, _c("word"), m, name="lexicon").first()
    again = I.words_blob(spark, p)
    copies = {"as stored": again, "one word short": again.join(small(l.filter("word_id = 3").select("word")), "word", "left_anti")}
    out = None
    for name, df in copies.items():
        row = df.agg(content_hash(_c("word")).alias("digest"), F.count("*").alias("entries"))
        row = row.select(F.lit(name).alias("copy"), "digest", "entries", F.when((_c("digest") == said.digest) & (_c("entries") == said.entries), "PASS").otherwise("FAIL").alias("status"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH {_USERS}, u AS (SELECT doc_id, sent_id, array_to_string(a, ' ') AS k FROM us JOIN toks USING (doc_id, sent_id)), r AS (SELECT doc_id, sent_id, array_to_string(a, ' ') AS k FROM toks ANTI JOIN us USING (doc_id, sent_id) WHERE len(a) >= 1)
  SELECT 'places' AS name, (SELECT count(*) FROM u) AS denominator, (SELECT count(*) FROM u SEMI JOIN r USING (doc_id, sent_id)) AS findings UNION ALL SELECT 'word for word', (SELECT count(*) FROM u), (SELECT count(*) FROM u WHERE k IN (SELECT k FROM r))""")
def q_dq4_disjoint(spark, d):
    """Sentences that users are scored on against those that the pair table is trained on: none in common by place; how many recur
    word for word is told."""
    users, rest = Y.split_blocks(sents(spark, d))
    u = materialize(users.select("doc_id", "sent_id", F.array_join("tokens", " ").alias("k")), "users")
    r = materialize(rest.select("doc_id", "sent_id", F.array_join("tokens", " ").alias("k")), "rest")
    n = u.agg(F.count("*").alias("denominator"))
    rows = [("places", u.join(r, ["doc_id", "sent_id"], "left_semi")), ("word for word", u.join(r.select("k").distinct(), "k", "left_semi"))]
    one = [hit.agg(F.count("*").alias("findings")).join(F.broadcast(n)).select(F.lit(name).alias("name"), "denominator", "findings") for name, hit in rows]
    return one[0].unionByName(one[1])


@query(f"""WITH {BI}, o AS (SELECT first_id, second_id, row_number() OVER (PARTITION BY first_id ORDER BY second_id) AS by_id, row_number() OVER (PARTITION BY first_id ORDER BY cnt DESC, second_id) AS by_count FROM bi)
  SELECT 'by id' AS stored, count(*) AS denominator, 0::BIGINT AS findings, 'PASS' AS status FROM o UNION ALL SELECT 'by count', count(*), count(*) FILTER (second_id <= p), CASE WHEN count(*) FILTER (second_id <= p) > 0 THEN 'FAIL' ELSE 'PASS' END FROM (SELECT *, lag(second_id) OVER (PARTITION BY first_id ORDER BY by_count) AS p FROM o)""")
def q_dq6_groups_ascend(spark, d):
    """Whether the pairs of each first word ascend by their second one as stored: in order of ids they do, by counts they don't."""
    from pyspark.sql import Window

    w = Window.partitionBy("first_id")
    b = materialize(bi(spark, d).select("first_id", "second_id", F.row_number().over(w.orderBy("second_id")).alias("by_id"), F.row_number().over(w.orderBy(F.desc("cnt"), "second_id")).alias("by_count")), "ranked")
    out = [C.strictly_by_group(b.withColumnRenamed(f"by_{k}", "rank"), "first_id", "second_id").withColumn("stored", F.lit(f"by {k}")) for k in ("id", "count")]
    return out[0].unionByName(out[1]).select("stored", "denominator", "findings", F.when(_c("findings") > 0, "FAIL").otherwise("PASS").alias("status"))


def _document_checks():
    own = C.Check("figure is the length", "text", lambda df: C._row(df.filter("n_chars IS NOT NULL AND text IS NOT NULL"), _c("n_chars") != F.length("text")), lambda df: df.withColumn("n_chars", _c("n_chars") + 1))
    none = C.Check("source is nowhere", "text", lambda df: C._row(df.filter("source = 'nowhere'"), F.lit(True)), lambda df: df.withColumn("source", F.lit("nowhere")))
    blind = C.Check("never looks", "text", lambda df: C._row(df, F.lit(False)), lambda df: df)
    return [C.unique("doc_id"), C.at_least(100), C.floor_is("doc_id", 0), own, none, blind]


_FIGURES = "(SELECT count(*) FROM documents WHERE n_chars IS NOT NULL AND text IS NOT NULL) AS d, (SELECT count(*) FROM documents WHERE n_chars <> length(text)) AS f"
_STATES = f"""SELECT 'doc_id is unique' AS name, (SELECT count(DISTINCT doc_id) FROM documents) AS denominator, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS findings, 'PASS' AS good UNION ALL SELECT 'denominator', count(*), CASE WHEN count(*) < 100 THEN 1 ELSE 0 END, 'PASS' FROM documents
  UNION ALL SELECT 'least doc_id', count(*), count(*) FILTER (doc_id < 0), 'PASS' FROM documents UNION ALL SELECT 'figure is the length', d, f, 'PASS' FROM (SELECT {_FIGURES}) UNION ALL SELECT 'source is nowhere', 0, 0, 'NOT-MEASURED' UNION ALL SELECT 'never looks', count(*), 0, 'NOT-A-GATE' FROM documents"""


def _document_report(spark, d):
    return C.run(table(spark, d, "documents", "doc_id", "text", "source", "n_chars"), _document_checks())


@query(f"SELECT name, denominator, findings, CASE WHEN good = 'PASS' AND findings > 0 THEN 'FAIL' ELSE good END AS status FROM ({_STATES})")
def q_dq3_dq8_dq9_gates(spark, d):
    """Checks of each outcome: those that hold, one that doesn't, one without a denominator, one whose planted defect it can't see."""
    return _document_report(spark, d).select("name", "denominator", "findings", "status")


@query(f"SELECT CASE WHEN good = 'PASS' AND findings > 0 THEN 'FAIL' ELSE good END AS status, count(*) AS checks FROM ({_STATES}) GROUP BY 1")
def q_dq10_summary(spark, d):
    return C.summary(_document_report(spark, d))


#: Published figures of the profile: name, figure.
PUBLISHED = (("prefixes", 79), ("longest prefix", 5), ("letters", 27), ("letter pairs", 6))


@query(f"""WITH {_RECORDS.strip()}, per AS (SELECT src_file, count(*) AS r, count(reason) AS x FROM judged GROUP BY 1), s AS (SELECT src_file, max(rows_read) AS r, max(rows_rejected) AS x FROM parse_stats GROUP BY 1)
  SELECT 'read ' || src_file AS name, s.r AS published, coalesce(per.r, 0) AS computed, s.r = coalesce(per.r, 0) AS agrees FROM s LEFT JOIN per USING (src_file) UNION ALL SELECT 'rejected ' || src_file, s.x, coalesce(per.x, 0), s.x = coalesce(per.x, 0) FROM s LEFT JOIN per USING (src_file)
  UNION ALL SELECT * FROM (VALUES {", ".join(f"('{n}', {v}::BIGINT, {v}::BIGINT, true)" for n, v in PUBLISHED)})""")
def q_dq14_published(spark, d):
    """Published figures beside computed ones: of the files' manifests and of the language profile; null where none is published."""
    computed = {"prefixes": len(HEBREW.prefixes), "longest prefix": max(map(len, HEBREW.prefixes)), "letters": len(HEBREW.alphabet), "letter pairs": len(HEBREW.confusions)}
    own = spark.createDataFrame([(n, v, computed[n]) for n, v in PUBLISHED], "name string, published bigint, computed bigint")
    parsed = rawrows.parse_records(table(spark, d, "verb_raw", "src_file", "line_no", "raw")).groupBy("src_file").agg(F.count("*").alias("r"), F.count("reason").alias("x"))
    said = table(spark, d, "parse_stats", "src_file", "rows_read", "rows_rejected").groupBy("src_file").agg(F.max("rows_read").alias("pr"), F.max("rows_rejected").alias("px"))
    both = said.join(parsed, "src_file", "left").fillna(0, ["r", "x"])
    rows = both.select(F.explode(F.array(F.struct(F.concat(F.lit("read "), "src_file").alias("name"), _c("pr").alias("published"), _c("r").alias("computed")), F.struct(F.concat(F.lit("rejected "), "src_file").alias("name"), _c("px").alias("published"), _c("x").alias("computed")))).alias("f")).select("f.*")
    return rows.unionByName(own).withColumn("agrees", _c("published") == _c("computed"))
