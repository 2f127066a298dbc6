"""Queries of the aggregations, windows, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wordloom.functions import numeric as N
from wordloom.functions import text as X
from wordloom.operators import lookup as L
from wordloom.operators import windows as W
from wordloom.plans import tables as T
from wordloom.queries.common import BI, IDS, TOK, bi, docs, lex, log_sql, sents, toks
from wordloom.queries.joins import _BUCKETS, buckets
from wordloom.session import small, table

QUERIES, SQL = {}, {}
_c = F.col


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {TOK}, c AS (SELECT token AS word, count(*) AS cnt FROM tok GROUP BY 1 HAVING count(*) >= 5) SELECT (row_number() OVER (ORDER BY word) - 1)::INT AS word_id, word, cnt, {log_sql('cnt')}::SMALLINT AS log_freq FROM c ORDER BY cnt DESC, word LIMIT 20")
def q_agg1_unigrams(spark, d):
    """The twenty most frequent words of the corpus's own lexicon, with id and scaled frequency."""
    return T.lexicon(T.counted(toks(spark, d)), 5).orderBy(F.desc("cnt"), "word").limit(20)


@query(f"WITH {TOK}, c AS (SELECT token AS word, count(*) AS cnt FROM tok GROUP BY 1 HAVING count(*) >= 5) SELECT (row_number() OVER (ORDER BY word) - 1)::INT AS word_id, word, cnt, {log_sql('cnt')}::SMALLINT AS log_freq FROM c")
def q_win1_lexicon(spark, d):
    return T.lexicon(T.counted(toks(spark, d)), 5)


@query(f"WITH {BI} SELECT first_id, second_id, cnt FROM allbi")
def q_agg2_bigrams(spark, d):
    return T.bigrams(sents(spark, d), lex(spark, d))


_SK = "sk AS (SELECT first_id, second_id, count(*) AS cnt FROM (SELECT id AS first_id, lead(id, 2) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS second_id FROM ids) WHERE first_id IS NOT NULL AND second_id IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {IDS}, {_SK} SELECT * FROM sk")
def q_agg3_skipgrams(spark, d):
    return T.skipgrams(sents(spark, d), lex(spark, d))


_REG = f"""{IDS}, adj AS (SELECT source, id AS first_id, lead(id) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS second_id FROM ids),
  ra AS (SELECT first_id, second_id, count(*) AS cnt FROM adj WHERE source <> 'subtitles' AND first_id IS NOT NULL AND second_id IS NOT NULL GROUP BY 1, 2), rb AS (SELECT first_id, second_id, count(*) AS cnt FROM adj WHERE source = 'subtitles' AND first_id IS NOT NULL AND second_id IS NOT NULL GROUP BY 1, 2),
  mixed AS (SELECT first_id, second_id, coalesce(ra.cnt, 0) * 0.75::DOUBLE + coalesce(rb.cnt, 0) * 0.25::DOUBLE AS cnt FROM ra FULL JOIN rb USING (first_id, second_id))"""


def blended(spark, d, weight=0.25):
    s, l = sents(spark, d), lex(spark, d)
    return T.blend(T.bigrams(s.filter("source <> 'subtitles'"), l), T.bigrams(s.filter("source = 'subtitles'"), l), weight)


@query(f"WITH {_REG} SELECT first_id, second_id, round(cnt, 6) AS cnt, {log_sql('cnt')} AS log_count FROM mixed WHERE cnt >= 2")
def q_agg4_blend(spark, d):
    return T.pruned(blended(spark, d), 2).withColumn("cnt", F.round("cnt", 6))


@query("SELECT l_partkey, max(l_quantity) AS most FROM lineitem GROUP BY 1")
def q_agg5_max(spark, d):
    return table(spark, d, "lineitem", "l_partkey", "l_quantity").groupBy("l_partkey").agg(F.max("l_quantity").alias("most"))


@query(f"WITH {BI} SELECT f AS floor, count(*) AS pairs, sum(cnt)::BIGINT AS mass, count(DISTINCT first_id) AS groups, count(DISTINCT first_id) * 6 + count(*) * 5 AS bytes FROM allbi, (VALUES (1), (2), (3), (5), (10), (20), (50), (100)) t(f) WHERE cnt >= f GROUP BY 1")
def q_agg6_thresholds(spark, d):
    return T.thresholds(T.bigrams(sents(spark, d), lex(spark, d)))


@query(f"WITH {BI}, g AS (SELECT f AS floor, first_id, count(*) AS n FROM allbi, (VALUES (2), (5), (10)) t(f) WHERE cnt >= f GROUP BY 1, 2) SELECT floor, cap, sum(least(n, cap))::BIGINT AS pairs, count(*) AS groups, count(*) * 6 + sum(least(n, cap))::BIGINT * 5 AS bytes FROM g, (VALUES (1), (4), (16), (64)) c(cap) GROUP BY 1, 2")
def q_agg7_size_grid(spark, d):
    return T.size_grid(T.bigrams(sents(spark, d), lex(spark, d)))


@query(f"WITH {BI} SELECT first_id, second_id, cnt FROM bi ORDER BY cnt DESC, first_id, second_id LIMIT 500")
def q_agg8_agg9_top_pairs(spark, d):
    """A top-k report of the pruned table."""
    return T.top_pairs(bi(spark, d), 500).select("first_id", "second_id", "cnt")


_RATES = ", ".join(f"""round(count(*) FILTER (source = '{s}' AND regexp_matches(line, '{{p}}')) / nullif(count(*) FILTER (source = '{s}'), 0), 6) AS {s}""" for s in ("subtitles", "typed_comments", "wiki_dump"))


@query(" UNION ALL ".join(f"""SELECT '{n}' AS class, {_RATES.replace("{p}", p.replace("'", "''"))} FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)""" for n, p in X.PRESENCE))
def q_agg14_register_pivot(spark, d):
    """Share of lines with each class of characters, one column per register."""
    lines = docs(spark, d).select("source", F.explode(F.split("text", "\n", -1)).alias("line"))
    flags = F.array(*(F.struct(F.lit(n).alias("class"), _c("line").rlike(p).cast("int").alias("has")) for n, p in X.PRESENCE))
    return lines.select("source", F.explode(flags).alias("f")).select("source", "f.*").groupBy("class").pivot("source", ["subtitles", "typed_comments", "wiki_dump"]).agg(F.round(F.avg("has"), 6))


_SAY = "SELECT batch_id, ms FROM (SELECT DISTINCT answer_id, batch_id, ms FROM label_answers) WHERE batch_id IS NOT NULL AND ms > 0"


@query(f"""WITH a AS ({_SAY}), r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ms) AS k, count(*) OVER (PARTITION BY batch_id) AS n FROM a)
  SELECT batch_id, max(n) AS n, max(ms) FILTER (k = greatest(1, ceil(0.95 * n))) AS nearest, max(ms) FILTER (k = floor((n - 1) * 0.95) + 1) AS lower, max(ms) FILTER (k = least(n, floor(0.95 * n) + 1)) AS upper FROM r GROUP BY 1""")
def q_agg20_percentiles(spark, d):
    """The three definitions of the 95th percentile: nearest rank, floor of (n - 1) p, and floor of n p."""
    a = table(spark, d, "label_answers", "answer_id", "batch_id", "ms").filter("batch_id IS NOT NULL AND ms > 0").dropDuplicates(["answer_id", "batch_id", "ms"])
    w = Window.partitionBy("batch_id")
    r = a.withColumn("k", F.row_number().over(w.orderBy("ms"))).withColumn("n", F.count("*").over(w))
    at = lambda e: F.max(F.when(_c("k") == e, _c("ms")))
    ends = (F.greatest(F.lit(1), F.ceil(_c("n") * 0.95)), F.floor((_c("n") - 1) * 0.95) + 1, F.least(_c("n"), F.floor(_c("n") * 0.95) + 1))
    return r.groupBy("batch_id").agg(F.max("n").alias("n"), *(at(e).alias(x) for e, x in zip(ends, ("nearest", "lower", "upper"), strict=True)))


@query("SELECT count(*) FILTER (log_freq = 0) AS zeros, min(log_freq) FILTER (log_freq > 0) AS least, max(log_freq) AS most, count(DISTINCT log_freq) AS kinds, round(avg(log_freq), 6) AS mean FROM lexicon")
def q_agg21_histogram(spark, d):
    f = _c("log_freq")
    return lex(spark, d).agg(F.count_if(f == 0).alias("zeros"), F.min(F.when(f > 0, f)).alias("least"), F.max(f).alias("most"), F.countDistinct(f).alias("kinds"), F.round(F.avg(f), 6).alias("mean"))


@query("WITH g AS (SELECT substr(word, 1, 1) AS p, count(*) AS n FROM lexicon GROUP BY 1 UNION ALL SELECT substr(word, 1, 2), count(*) FROM lexicon GROUP BY 1) SELECT length(p)::INT AS prefix, count(*) AS groups, max(n) AS most, quantile_disc(n, 0.5) AS median FROM g GROUP BY 1")
def q_agg22_fanout(spark, d):
    w = lex(spark, d)
    g = w.select(F.substring("word", 1, 1).alias("p")).union(w.select(F.substring("word", 1, 2).alias("p"))).groupBy("p").agg(F.count("*").alias("n"))
    return g.groupBy(F.length("p").alias("prefix")).agg(F.count("*").alias("groups"), F.max("n").alias("most"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").cast("bigint").alias("median"))


@query(f"""WITH {_BUCKETS}, p AS (SELECT DISTINCT batch_id, id, path FROM label_keys) SELECT split_part(stratum, ':', 1) AS stratum, path, count(*) FILTER (bucket = 'suggestion') AS suggestion, count(*) FILTER (bucket = 'text') AS text, count(*) FILTER (bucket = 'both') AS both, count(*) FILTER (bucket = 'unclear') AS unclear
  FROM b JOIN p USING (batch_id, id) GROUP BY 1, 2""")
def q_agg25_buckets(spark, d):
    b = buckets(spark, d).groupBy(F.substring_index("stratum", ":", 1).alias("stratum"), "path")
    return b.agg(*(F.count_if(_c("bucket") == x).alias(x) for x in ("suggestion", "text", "both", "unclear")))


@query(f"""WITH {_BUCKETS}, g AS (SELECT batch_id, count(*) AS n, count(*) FILTER (bucket = 'suggestion') AS k FROM b WHERE stratum = 'real' GROUP BY 1),
  c AS (SELECT *, k + (SELECT count(*) FROM b WHERE b.batch_id = g.batch_id AND stratum = 'real' AND bucket IN ('both', 'unclear')) AS k2 FROM g),
  w AS (SELECT *, (k / n + 1.9208 / n) / (1 + 3.8416 / n) AS m1, 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n::DOUBLE * n)) / (1 + 3.8416 / n) AS h1, (k2 / n + 1.9208 / n) / (1 + 3.8416 / n) AS m2, 1.96 * sqrt(k2 / n * (1 - k2 / n) / n + 0.9604 / (n::DOUBLE * n)) / (1 + 3.8416 / n) AS h2 FROM c)
  SELECT batch_id, n, k AS floor_k, k2 AS ceiling_k, round(greatest(0, m1 - h1), 6) AS floor_lo, round(least(1, m1 + h1), 6) AS floor_hi, round(greatest(0, m2 - h2), 6) AS ceiling_lo, round(least(1, m2 + h2), 6) AS ceiling_hi FROM w""")
def q_agg26_agg27_precision(spark, d):
    """Per batch: precision with every abstention a loss, and a win, with score intervals."""
    b = buckets(spark, d).filter("stratum = 'real'")
    g = b.groupBy("batch_id").agg(F.count("*").alias("n"), F.count_if(_c("bucket") == "suggestion").alias("floor_k"), F.count_if(_c("bucket").isin("suggestion", "both", "unclear")).alias("ceiling_k"))
    cols = []
    for name in ("floor", "ceiling"):
        lo, hi = N.wilson(_c(f"{name}_k"), _c("n"))
        cols += [F.round(lo, 6).alias(f"{name}_lo"), F.round(hi, 6).alias(f"{name}_hi")]
    return g.select("batch_id", "n", "floor_k", "ceiling_k", *cols)


@query(f"""WITH {_BUCKETS}, r AS (SELECT r.batch_id, r.source_id, min(p.bucket) AS before, min(r.bucket) AS after FROM b r JOIN b p ON p.source_id = r.source_id AND r.stratum = 'repeat:' || p.batch_id GROUP BY 1, 2),
  f AS (SELECT *, before IN ('suggestion', 'text') AND after IN ('suggestion', 'text') AS decided FROM r) SELECT count(*) AS n, count(*) FILTER (before = after) AS same, count(*) FILTER (decided) AS decided, count(*) FILTER (decided AND before <> after) AS reversals,
  round(count(*) FILTER (before = after) / count(*), 6) AS four_way, round(1 - count(*) FILTER (decided AND before <> after) / count(*) FILTER (decided), 6) AS direction FROM f""")
def q_agg28_agreement(spark, d):
    from wordloom.queries.joins import q_join16_rejudged

    r = q_join16_rejudged(spark, d)
    decided = _c("before").isin("suggestion", "text") & _c("after").isin("suggestion", "text")
    out = r.agg(F.count("*").alias("n"), F.count_if(_c("before") == _c("after")).alias("same"), F.count_if(decided).alias("decided"), F.count_if(decided & (_c("before") != _c("after"))).alias("reversals"))
    return out.withColumn("four_way", F.round(F.try_divide(_c("same").cast("double"), _c("n")), 6)).withColumn("direction", F.round(1 - F.try_divide(_c("reversals").cast("double"), _c("decided")), 6))


_USER = """o AS (SELECT DISTINCT obs_id, user_id, session_id, first_id, second_id FROM pair_log WHERE first_id >= -1 AND second_id >= -1 AND cnt > 0),
  up AS (SELECT user_id, first_id, second_id, count(*) AS cnt, count(DISTINCT session_id) AS sessions FROM o GROUP BY 1, 2, 3)"""


@query(f"""WITH {_USER}, u AS (SELECT user_id, count(*) AS pairs, count(*) FILTER (sessions >= 2) AS eligible, count(*) FILTER (first_id < 0 OR second_id < 0) AS oov FROM up GROUP BY 1)
  SELECT count(*) AS users, sum(pairs)::BIGINT AS pairs, sum(eligible)::BIGINT AS eligible, sum(oov)::BIGINT AS oov, max(pairs) AS most FROM u""")
def q_agg31_agg33_user_shape(spark, d):
    from wordloom.operators.users import user_pairs

    up = user_pairs(table(spark, d, "pair_log", "obs_id", "user_id", "session_id", "first_id", "second_id", "cnt"))
    u = up.groupBy("user_id").agg(F.count("*").alias("pairs"), F.count_if(_c("sessions") >= 2).alias("eligible"), F.count_if((_c("first_id") < 0) | (_c("second_id") < 0)).alias("oov"))
    return u.agg(F.count("*").alias("users"), *(F.sum(x).alias(x) for x in ("pairs", "eligible", "oov")), F.max("pairs").alias("most"))


@query(f"WITH {BI} SELECT count(DISTINCT first_id) AS groups, count(*) AS pairs, min(log_count) AS least, min(log_count) = {log_sql('5')} AS at_floor FROM bi")
def q_agg32_dq12_totals(spark, d):
    by = bi(spark, d).groupBy("first_id").agg(F.count("*").alias("n"), F.min("log_count").alias("least"))
    return by.agg(F.count("*").alias("groups"), F.sum("n").alias("pairs"), F.min("least").alias("least"), (F.min("least") == N.log_scale(F.lit(5))).alias("at_floor"))


@query(f"""WITH {BI}, g AS (SELECT second_id - lag(second_id, 1, -1) OVER (PARTITION BY first_id ORDER BY second_id) AS gap, log_count FROM bi), h AS (SELECT gap, count(*) AS n FROM g GROUP BY 1), k AS (SELECT log_count, count(*) AS n FROM g GROUP BY 1)
  SELECT (SELECT round(-sum(n / t * log2(n / t)), 6) FROM h, (SELECT sum(n)::DOUBLE AS t FROM h)) AS gap_bits, (SELECT round(-sum(n / t * log2(n / t)), 6) FROM k, (SELECT sum(n)::DOUBLE AS t FROM k)) AS count_bits""")
def q_agg34_win10_gap_entropy(spark, d):
    w = Window.partitionBy("first_id").orderBy("second_id")
    g = bi(spark, d).select((_c("second_id") - F.lag("second_id", 1, -1).over(w)).alias("gap"), "log_count")

    def bits(col, name):
        h = g.groupBy(col).agg(F.count("*").alias("n"))
        return h.join(F.broadcast(h.agg(F.sum("n").cast("double").alias("t")))).agg(F.round(N.entropy_of_counts(_c("n"), _c("t")), 6).alias(name))

    return bits("gap", "gap_bits").join(F.broadcast(bits("log_count", "count_bits")))


@query("SELECT user_id, count(*) AS offered, count(*) FILTER (event_type = 'click') AS accepted, round(count(*) FILTER (event_type = 'click') / count(*), 6) AS rate FROM events GROUP BY 1")
def q_agg36_benefit(spark, d):
    ok = F.count_if(_c("event_type") == "click")
    return table(spark, d, "events", "user_id", "event_type").groupBy("user_id").agg(F.count("*").alias("offered"), ok.alias("accepted"), F.round(ok / F.count("*"), 6).alias("rate"))


@query(f"WITH {TOK} SELECT doc_id, sent_id, pos, lag(token, 2) OVER w AS prev2, lag(token) OVER w AS prev, lead(token) OVER w AS next, lead(token, 2) OVER w AS next2 FROM tok WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY pos)")
def q_win2_win14_neighbours(spark, d):
    near = {"prev2": "w-2", "prev": "w-1", "next": "w1", "next2": "w2"}
    return T.neighbours(sents(spark, d), 2, 2).select("doc_id", "sent_id", "pos", *(_c(w).alias(name) for name, w in near.items()))


_ELIG = f"{TOK}, elig AS (SELECT doc_id, sent_id, len(a) AS n, row_number() OVER (ORDER BY doc_id, sent_id) - 1 AS rn FROM toks WHERE len(a) BETWEEN 4 AND 40)"


def eligible(spark, d):
    """Sentences of 4 to 40 tokens in corpus order, numbered from 0, with the tokens before them."""
    s = sents(spark, d).select("doc_id", "sent_id", F.size("tokens").alias("n")).filter("n BETWEEN 4 AND 40")
    return W.numbered(s, ["doc_id", "sent_id"], amount=_c("n"))


@query(f"WITH {_ELIG} SELECT doc_id, sent_id FROM elig WHERE rn >= 1 AND (rn - 1) % 37 = 0 AND (rn - 1) // 37 < 6000")
def q_win4_stride(spark, d):
    return W.strided(eligible(spark, d), 1, 37, 6000).select("doc_id", "sent_id")


@query(f"WITH {_ELIG} SELECT doc_id, sent_id, rn % 20 = 0 AS held_out FROM elig")
def q_win5_holdout(spark, d):
    return W.held_out(eligible(spark, d)).select("doc_id", "sent_id", "held_out")


@query(f"WITH {_ELIG}, s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM elig) SELECT doc_id, sent_id, n FROM s WHERE before < 20000")
def q_win6_token_budget(spark, d):
    return eligible(spark, d).filter("before < 20000").select("doc_id", "sent_id", "n")


@query(f"""WITH {_ELIG}, rest AS (SELECT doc_id, sent_id, row_number() OVER (ORDER BY rn) - 1 AS rn FROM elig WHERE NOT (rn >= 1 AND (rn - 1) % 37 = 0)), k AS (SELECT *, (rn // 80)::INT AS block, count(*) OVER (PARTITION BY rn // 80) AS size FROM rest)
  SELECT doc_id, sent_id, block, CASE WHEN block % 2 = 0 THEN 'dev' ELSE 'test' END AS split, rn % 80 < 60 AS history FROM k WHERE size = 80 AND block < 120""")
def q_win7_win8_win11_blocks(spark, d):
    """Blocks of 80 sentences that no stride has used, dev and test by turns; the first 60 of a block are its history."""
    rest = eligible(spark, d).filter("NOT (rn >= 1 AND (rn - 1) % 37 = 0)").select("doc_id", "sent_id")
    out = W.blocks(W.numbered(rest, ["doc_id", "sent_id"]), 80, 120)
    return out.select("doc_id", "sent_id", "block", "split", (_c("rn") % 80 < 60).alias("history"))


@query(f"WITH {TOK}, k AS (SELECT doc_id, sent_id, pos, length(token) AS cell, row_number() OVER (PARTITION BY length(token) ORDER BY doc_id, sent_id, pos) AS k FROM tok) SELECT doc_id, sent_id, pos, cell FROM k WHERE k <= 2000")
def q_win9_attempt_cap(spark, d):
    """The first 2,000 attempts of each cell, in corpus order: the cap is what the operator is."""
    t = toks(spark, d).select("doc_id", "sent_id", "pos", F.length("token").alias("cell"))
    return W.first_of_each(t, "cell", ["doc_id", "sent_id", "pos"], 2000)


@query(f"""WITH {TOK} SELECT doc_id, sent_id, pos, array_to_string(list_reverse(list(token) OVER (PARTITION BY doc_id, sent_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)), ' ') AS completed FROM tok""")
def q_win15_completed_words(spark, d):
    t = T.neighbours(sents(spark, d), 4)
    return t.select("doc_id", "sent_id", "pos", F.nullif(F.concat_ws(" ", "w-1", "w-2", "w-3", "w-4"), F.lit("")).alias("completed"))


@query(f"WITH {TOK} SELECT doc_id, sent_id, array_to_string(a[greatest(len(a) - 1, 1):len(a)], ' ') AS tail FROM toks WHERE len(a) >= 1")
def q_win16_tail(spark, d):
    """A sentence from its last word but one."""
    return sents(spark, d).select("doc_id", "sent_id", F.array_join(F.slice("tokens", F.greatest(F.size("tokens") - 1, F.lit(1)), 2), " ").alias("tail"))


@query("SELECT batch_id, id, row_number() OVER (PARTITION BY batch_id ORDER BY sha256('deal:' || id), id)::BIGINT AS seq FROM (SELECT DISTINCT batch_id, id FROM label_keys)")
def q_win17_dealing(spark, d):
    from wordloom.functions.hashing import order_key

    k = table(spark, d, "label_keys", "batch_id", "id").distinct()
    return k.withColumn("seq", F.row_number().over(Window.partitionBy("batch_id").orderBy(order_key("deal", _c("id")), "id")).cast("bigint"))


@query("SELECT word FROM (SELECT word FROM lexicon UNION SELECT other FROM label_keys WHERE other IS NOT NULL)")
def q_set1_union(spark, d):
    return lex(spark, d).select("word").union(table(spark, d, "label_keys", "other").filter("other IS NOT NULL")).distinct()


@query("SELECT DISTINCT typed AS word FROM label_keys WHERE typed IN (SELECT other FROM label_keys)")
def q_set3_intersect(spark, d):
    k = table(spark, d, "label_keys", "typed", "other")
    return k.select(_c("typed").alias("word")).intersect(k.select("other"))


@query(f"""WITH {TOK}, g AS (SELECT unnest(regexp_extract_all(text, '(?m)^== (.*) ==$', 1)) AS g FROM documents WHERE source = 'wiki_dump'), h AS (SELECT DISTINCT unnest(regexp_extract_all(g, '[א-ת]+')) AS word FROM g) SELECT word FROM h WHERE length(word) >= 2 AND word NOT IN (SELECT word FROM lexicon)""")
def q_set6_titles(spark, d):
    """Words of the pages' headings that the lexicon lacks."""
    h = docs(spark, d).filter("source = 'wiki_dump'").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^== (.*) ==$"), F.lit(1))).alias("h"))
    w = h.select(F.explode(X.tokens(_c("h"))).alias("word")).filter(F.length("word") >= 2)
    return w.distinct().join(small(lex(spark, d).select("word")), "word", "left_anti")


@query(f"""WITH {TOK}, s AS (SELECT source, token, count(*) AS n FROM tok GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, token) AS k, lead(n) OVER (PARTITION BY source ORDER BY n DESC, token) AS n2 FROM s) SELECT source, token, n, n - n2 AS margin FROM r WHERE k = 1""")
def q_win12_margin(spark, d):
    """The most frequent word of each register and its lead over the second."""
    s = toks(spark, d).groupBy("source", "token").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("n"), "token")
    return s.withColumn("k", F.row_number().over(w)).filter("k <= 2").withColumn("n2", F.lead("n").over(w)).filter("k = 1").select("source", "token", "n", (_c("n") - _c("n2")).alias("margin"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, value AS threshold FROM r WHERE k = greatest(1, floor(n * 0.2))""")
def q_win13_threshold(spark, d):
    """The value above which a fifth of each kind's events lie."""
    e = table(spark, d, "events", "event_type", "value")
    return W.at_rank(e, "event_type", "value", lambda n: n - F.greatest(F.lit(1), F.floor(n * 0.2)) + 1, "threshold")


@query("""WITH c AS (SELECT t, count(*) FILTER (value >= t) AS kept, count(*) FILTER (value >= t AND event_type = 'purchase') AS hits, count(*) AS n FROM events, (VALUES (1), (5), (10), (20), (40), (80)) v(t) GROUP BY 1), p AS (SELECT t, kept / n AS retention, hits / nullif(kept, 0) AS precision FROM c)
  SELECT max_by(t, retention) FILTER (precision >= 0.1) AS best_t, max_by(t, precision) FILTER (retention >= 0.1) AS sharp_t FROM p""")
def q_top9_top10_argmax(spark, d):
    """The threshold that keeps most at a precision of 0.1, and the most precise one that keeps a tenth."""
    e = table(spark, d, "events", "value", "event_type")
    ts = (1, 5, 10, 20, 40, 80)
    one = e.agg(F.count("*").alias("n"), *(F.count_if(_c("value") >= t).alias(f"k{t}") for t in ts), *(F.count_if((_c("value") >= t) & (_c("event_type") == "purchase")).alias(f"h{t}") for t in ts))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(t).alias("t"), (_c(f"k{t}") / _c("n")).alias("r"), F.try_divide(_c(f"h{t}").cast("double"), _c(f"k{t}")).alias("p")) for t in ts))).alias("x")).select("x.*")
    return rows.agg(F.max_by("t", F.when(_c("p") >= 0.1, _c("r"))).alias("best_t"), F.max_by("t", F.when(_c("r") >= 0.1, _c("p"))).alias("sharp_t"))


@query("""WITH e AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS q FROM e WHERE vec_id % 100 = 0),
  s AS (SELECT query_id, vec_id, list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) AS score FROM q, e WHERE query_id <> vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s) SELECT query_id, vec_id, round(score, 5) AS score FROM r WHERE k <= 8""")
def q_sim7_topk_dot(spark, d):
    """The eight best dot products of each query (every row whose id is divisible by 100) against all rows: the queries are
    taken in blocks as one array each, so rows meet blocks by an equi-join and only each block's best pass on."""
    from wordloom.operators.vectors import top_dot

    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return top_dot(e.filter("vec_id % 100 = 0"), e, 8).withColumn("score", F.round("score", 5))
