"""Queries of the ranking models, user models and segmentation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.operators import lookup as L
from wordloom.operators import users as U
from wordloom.plans import rank as R
from wordloom.plans import tables as T
from wordloom.queries.common import BI, IDS, TOK, bi, lex, log_sql, sents, toks
from wordloom.queries.joins import _AB, _ONE, _PREFIX, _STEMS, _SWAP, _VERB, _oov, _words, abbr, two_sql
from wordloom.session import materialize, small, table

QUERIES, SQL = {}, {}
_c = F.col


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {TOK}, {_STEMS} SELECT DISTINCT word FROM stems")
def q_mod1_valid(spark, d):
    return R.valid(_words(spark, d), lex(spark, d))


_BAD = f"{_STEMS}, {_ONE}, bad AS (SELECT t, c.word_id, word, log_freq FROM cand c JOIN lexicon USING (word_id) WHERE t NOT IN (SELECT word FROM stems))"


@query(f"WITH {TOK}, {_BAD}, r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY log_freq DESC, word_id) AS rank FROM bad) SELECT t AS typed, word, 100 AS cost, rank FROM r WHERE rank <= 3")
def q_mod2_top1_suggest_1edit(spark, d):
    return R.suggestions(R.candidates(_oov(spark, d), lex(spark, d), 1)).select("typed", "word", "cost", "rank")


_BAD2 = f"{_STEMS}, oov AS (SELECT DISTINCT token AS t FROM tok ANTI JOIN lexicon ON word = token WHERE length(token) >= 3), bad0 AS (SELECT t FROM oov WHERE t NOT IN (SELECT word FROM stems)), {two_sql('bad0')}"


@query(f"WITH {TOK}, {_BAD2} SELECT t AS typed, word, cost, row_number() OVER (PARTITION BY t ORDER BY cost, log_freq DESC, word_id) AS rank FROM two JOIN lexicon USING (word) QUALIFY rank <= 3")
def q_mod2_suggest_2edit(spark, d):
    return R.suggestions(R.candidates(_oov(spark, d), lex(spark, d), 2)).select("typed", "word", "cost", "rank")


@query()
def q_mod3_rerank(spark, d):
    return R.suggestions(R.reranked(R.candidates(_oov(spark, d), lex(spark, d), 2))).select("typed", "word", "cost", "rank")


@query(f"WITH {TOK}, {_BAD} SELECT t AS typed, max(word) AS word FROM bad GROUP BY t HAVING count(*) = 1 AND max(log_freq) > 0")
def q_mod4_auto_replace(spark, d):
    return R.auto_replaced(R.candidates(_oov(spark, d), lex(spark, d), 1))


@query(f"""WITH {TOK}, {_BAD2}, r AS (SELECT t, word, cost, log_freq, row_number() OVER w AS rank, lead(cost) OVER w AS nxt FROM two JOIN lexicon USING (word) WINDOW w AS (PARTITION BY t ORDER BY cost, log_freq DESC, word_id))
  SELECT t AS typed, word FROM r WHERE rank = 1 AND cost <= 100 AND log_freq > 0 AND (nxt IS NULL OR nxt > cost)""")
def q_mod4_auto_replace_2edit(spark, d):
    """As ``q_mod4_auto_replace`` with all words within two edits as rivals."""
    return R.auto_replaced(R.candidates(_oov(spark, d), lex(spark, d), 2))


@query(f"""WITH {TOK}, {_BAD2} SELECT t AS typed, word, row_number() OVER (PARTITION BY t ORDER BY word) AS hit, cost FROM two QUALIFY hit <= 5""")
def q_top6_truncated(spark, d):
    """The first five hits of each search in the order of words, as a search that is cut off would find them; suggestions never
    are."""
    return R.truncated(R.candidates(_oov(spark, d), lex(spark, d), 2), 5).select("typed", "word", "hit", "cost")


def contexts(spark, d, k=2):
    """Distinct (prefix of k letters, previous known word) of the corpus."""
    t = T.neighbours(sents(spark, d)).filter(F.length("token") > k).select(F.substring("token", 1, k).alias("prefix"), _c("w-1").alias("w")).distinct()
    return L.ids(t, lex(spark, d), "w", "prev").drop("w").distinct()


_CTX = f"""ctx AS (SELECT DISTINCT substr(token, 1, 2) AS prefix, prev FROM (SELECT token, lag(id) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS prev FROM ids) WHERE length(token) > 2),
  pc AS (SELECT prefix, word_id, word, log_freq, row_number() OVER (PARTITION BY prefix ORDER BY log_freq DESC, word_id) AS place FROM (SELECT DISTINCT prefix FROM ctx) JOIN lexicon ON substr(word, 1, 2) = prefix)"""


@query(f"""WITH {BI}, {_CTX}, s AS (SELECT ctx.prefix, prev, word_id, word, log_freq + 2.0::DOUBLE * coalesce(log_count, 0) AS score, log_freq FROM ctx JOIN pc ON pc.prefix = ctx.prefix AND place <= 24 AND word <> ctx.prefix LEFT JOIN bi ON first_id = prev AND second_id = word_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY prefix, prev ORDER BY score DESC, log_freq DESC, word_id) AS rank FROM s) SELECT prefix, prev, word, score, rank FROM r WHERE rank <= 3""")
def q_mod5_top2_complete(spark, d):
    return R.completions(contexts(spark, d), lex(spark, d), bi(spark, d), (2,)).select("prefix", "prev", "word", "score", "rank")


@query(f"WITH {IDS}, {_CTX} SELECT prefix, word, place FROM pc WHERE place <= 3")
def q_mod15_context_free(spark, d):
    cand = L.by_prefix(contexts(spark, d), lex(spark, d), (2,))
    return R.top(cand, ["prefix"], [F.desc("log_freq"), _c("word_id")], 3, "place").select("prefix", "word", "place")


@query(f"WITH {BI}, r AS (SELECT *, row_number() OVER (PARTITION BY first_id ORDER BY cnt DESC, second_id) AS k FROM bi), s AS (SELECT first_id, second_id, log_count::DOUBLE AS score, row_number() OVER (PARTITION BY first_id ORDER BY log_count DESC, second_id) AS rank FROM r WHERE k <= 16) SELECT * FROM s WHERE rank <= 3")
def q_mod6_next_word(spark, d):
    return R.next_words(bi(spark, d)).select("first_id", "second_id", "score", "rank")


def _log(spark, d):
    return table(spark, d, "pair_log", "obs_id", "user_id", "session_id", "first_id", "second_id", "cnt")


_UP = """o AS (SELECT DISTINCT obs_id, user_id, session_id, first_id, second_id FROM pair_log WHERE first_id >= -1 AND second_id >= -1 AND cnt > 0),
  up AS (SELECT user_id, first_id, second_id, count(*) AS cnt, count(DISTINCT session_id) AS sessions FROM o GROUP BY 1, 2, 3)"""
_ALL = f"""oo AS (SELECT first_id, second_id, count(*) AS cnt, count(DISTINCT session_id) AS sessions FROM o GROUP BY 1, 2), everyone AS (SELECT *, {log_sql('cnt')} AS log_count FROM oo WHERE sessions >= 2)"""


def everyone(spark, d):
    """All users' log taken as one model: pairs seen in two or more sessions."""
    return U.gated(U.user_pairs(_log(spark, d).withColumn("user_id", F.lit(0).cast("bigint")))).select("first_id", "second_id", "cnt", "log_count")


@query(f"""WITH {BI}, {_UP}, {_ALL}, a AS (SELECT first_id, second_id, log_count::DOUBLE AS s FROM bi QUALIFY row_number() OVER (PARTITION BY first_id ORDER BY cnt DESC, second_id) <= 16),
  b AS (SELECT first_id, second_id, 2.0::DOUBLE * least(log_count, 32) AS s FROM everyone QUALIFY row_number() OVER (PARTITION BY first_id ORDER BY cnt DESC, second_id) <= 16),
  s AS (SELECT first_id, second_id, sum(s) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE second_id >= 0 GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY first_id ORDER BY score DESC, second_id) AS rank FROM s QUALIFY rank <= 3""")
def q_top4_next_word_with_user(spark, d):
    return R.next_words(bi(spark, d), everyone(spark, d)).select("first_id", "second_id", "score", "rank")


@query(f"""WITH {BI}, {_CTX}, {_UP}, {_ALL}, s AS (SELECT ctx.prefix, prev, pc.word_id, word, log_freq, log_freq + 2.0::DOUBLE * coalesce(bi.log_count, 0) AS base, 2.0::DOUBLE * least(coalesce(e.log_count, 0), 32) AS term FROM ctx JOIN pc ON pc.prefix = ctx.prefix AND place <= 24 AND word <> ctx.prefix LEFT JOIN bi ON bi.first_id = prev AND bi.second_id = pc.word_id LEFT JOIN everyone e ON e.first_id = prev AND e.second_id = pc.word_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY prefix, prev ORDER BY base DESC, log_freq DESC, word_id) AS alone, row_number() OVER (PARTITION BY prefix, prev ORDER BY base + term DESC, log_freq DESC, word_id) AS rank FROM s) SELECT prefix, prev, word, base + term AS score, rank, term > 0 AND alone > 3 AS from_user FROM r WHERE rank <= 3""")
def q_mod11_attribution(spark, d):
    return R.completions(contexts(spark, d), lex(spark, d), bi(spark, d), (2,), user=everyone(spark, d)).select("prefix", "prev", "word", "score", "rank", "from_user")


def _abbreviations(spark, d):
    a, l = abbr(spark, d), lex(spark, d)
    k = a.join(l.select(_c("word").alias("w")), _c("bare") == _c("w"), "left").select("bare", "canonical", _c("w").isNotNull().alias("is_word"))
    c = L.by_prefix(a.select(_c("bare").alias("prefix")), l).filter("word <> prefix").withColumnRenamed("prefix", "bare")
    c = R.top(c, ["bare"], [F.desc("log_freq"), _c("word_id")], 3)
    u = k.select("bare", _c("canonical").alias("word"), F.lit("ABBREVIATION").alias("kind"), F.when(_c("is_word"), 15).otherwise(0).alias("place"))
    u = u.unionByName(c.select("bare", "word", F.lit("COMPLETION").alias("kind"), (_c("rank") * 10).alias("place")))
    return R.top(u, ["bare"], [_c("place")], 3).select("bare", "word", "kind", "rank")


@query(f"""WITH {_AB}, one AS (SELECT bare, max(canonical) AS canonical FROM abbr GROUP BY bare HAVING count(*) = 1), c AS (SELECT bare, word, row_number() OVER (PARTITION BY bare ORDER BY log_freq DESC, word_id) AS rank FROM one JOIN lexicon ON starts_with(word, bare) AND word <> bare),
  k AS (SELECT bare, canonical, bare IN (SELECT word FROM lexicon) AS is_word FROM one), u AS (SELECT bare, canonical AS word, 'ABBREVIATION' AS kind, CASE WHEN is_word THEN 15 ELSE 0 END AS place FROM k UNION ALL SELECT bare, word, 'COMPLETION', rank * 10 FROM c WHERE rank <= 3)
  SELECT bare, word, kind, row_number() OVER (PARTITION BY bare ORDER BY place) AS rank FROM u QUALIFY rank <= 3""")
def q_mod7_abbreviation(spark, d):
    """An abbreviation leads where its letters are no word, else it comes second."""
    return _abbreviations(spark, d)


_MIX = f"""fix AS (SELECT t AS typed, word, row_number() OVER (PARTITION BY t ORDER BY log_freq DESC, word_id) AS rank FROM bad QUALIFY rank <= 3),
  fin AS (SELECT DISTINCT t AS typed, l.word, log_freq, l.word_id FROM (SELECT DISTINCT t FROM bad) b JOIN lexicon l ON starts_with(l.word, t) AND l.word <> t), fin3 AS (SELECT typed, word, row_number() OVER (PARTITION BY typed ORDER BY log_freq DESC, word_id) AS rank FROM fin QUALIFY rank <= 3)"""


def _mix(spark, d, policy):
    cand = materialize(R.candidates(_oov(spark, d), lex(spark, d), 1), "mix")
    fin = L.by_prefix(cand.select(_c("typed").alias("prefix")), lex(spark, d), None).filter("word <> prefix").withColumnRenamed("prefix", "typed")
    return R.mixed(R.top(fin, ["typed"], [F.desc("log_freq"), _c("word_id")], 3), R.suggestions(cand), policy)


@query(f"""WITH {TOK}, {_BAD}, {_MIX}, u AS (SELECT typed, word, 'COMPLETION' AS kind, rank AS place FROM fin3 UNION ALL SELECT typed, word, 'CORRECTION', 1000000 + rank FROM fix), f AS (SELECT typed, word, min(place) AS place, min_by(kind, place) AS kind FROM u GROUP BY 1, 2)
  SELECT typed, word, kind, row_number() OVER (PARTITION BY typed ORDER BY place) AS rank FROM f QUALIFY rank <= 3""")
def q_mod8_set5_completions_first(spark, d):
    return _mix(spark, d, "COMPLETIONS_FIRST")


@query(f"""WITH {TOK}, {_BAD}, {_MIX}, u AS (SELECT typed, word, 'COMPLETION' AS kind, rank * 2 AS place FROM fin3 UNION ALL SELECT typed, word, 'CORRECTION', rank * 2 + 1 FROM fix), f AS (SELECT typed, word, min(place) AS place, min_by(kind, place) AS kind FROM u GROUP BY 1, 2)
  SELECT typed, word, kind, row_number() OVER (PARTITION BY typed ORDER BY place) AS rank FROM f QUALIFY rank <= 3""")
def q_mod8_arr3_arr4_interleaved(spark, d):
    return _mix(spark, d, "INTERLEAVED")


@query(f"""WITH {TOK}, {_BAD}, {_MIX}, u AS (SELECT typed, word, 'COMPLETION' AS kind, 1000000 + rank AS place FROM fin3 UNION ALL SELECT typed, word, 'CORRECTION', rank FROM fix), f AS (SELECT typed, word, min(place) AS place, min_by(kind, place) AS kind FROM u GROUP BY 1, 2)
  SELECT typed, word, kind, row_number() OVER (PARTITION BY typed ORDER BY place) AS rank FROM f QUALIFY rank <= 3""")
def q_mod8_corrections_first(spark, d):
    return _mix(spark, d, "CORRECTIONS_FIRST")


@query(f"WITH {TOK}, {_VERB}, p AS (SELECT DISTINCT substr(token, 1, 2) AS prefix FROM tok WHERE length(token) > 2) SELECT prefix, surface AS word, row_number() OVER (PARTITION BY prefix ORDER BY surface) AS rank FROM p JOIN verbs ON substr(surface, 1, 2) = prefix AND length(surface) > 2 QUALIFY rank <= 3")
def q_mod10_personal(spark, d):
    """Completions from a personal dictionary, here the verbs' surfaces: longer than the prefix, in order."""
    mine = table(spark, d, "verb_forms", "vocalized_inflection").filter("vocalized_inflection IS NOT NULL").select(X.strip_points(_c("vocalized_inflection")).alias("word")).distinct()
    p = toks(spark, d).filter(F.length("token") > 2).select(F.substring("token", 1, 2).alias("prefix")).distinct()
    hits = mine.filter(F.length("word") > 2).withColumn("prefix", F.substring("word", 1, 2)).join(p, "prefix", "left_semi")
    return R.top(hits, ["prefix"], [_c("word")], 3).select("prefix", "word", "rank")


_EVID = f"""{_SWAP}, lp AS (SELECT word, word_id, log_freq, unnest(range(1, length(word) + 1)) AS i FROM lexicon), v AS (SELECT DISTINCT word_id AS id, log_freq AS typed_freq, substr(word, 1, i - 1) || b || substr(word, i + 1) AS variant FROM lp JOIN swaps ON a = substr(word, i, 1)),
  conf AS (SELECT id, typed_freq, variant, l.word_id AS variant_id, l.log_freq AS variant_freq FROM v JOIN lexicon l ON l.word = variant),
  site AS (SELECT doc_id, sent_id, pos, token, id, lag(id, 2) OVER w AS prev2, lag(id) OVER w AS prev, lead(id) OVER w AS next, lead(id, 2) OVER w AS next2 FROM ids WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY pos)),
  ev AS (SELECT s.doc_id, s.sent_id, s.pos, s.token, variant, variant_id, typed_freq, variant_freq, prev2, next2, (prev IS NOT NULL)::INT + (next IS NOT NULL)::INT AS context, coalesce(a.log_count, 0) + coalesce(b.log_count, 0) AS typed_ev, coalesce(c.log_count, 0) + coalesce(e.log_count, 0) AS variant_ev
    FROM site s JOIN conf USING (id) LEFT JOIN bi a ON a.first_id = prev AND a.second_id = id LEFT JOIN bi b ON b.first_id = id AND b.second_id = next LEFT JOIN bi c ON c.first_id = prev AND c.second_id = variant_id LEFT JOIN bi e ON e.first_id = variant_id AND e.second_id = next WHERE length(token) >= 2)"""


def evidence(spark, d, counts=None, skips=None):
    return R.evidence(R.sites(sents(spark, d), lex(spark, d)), lex(spark, d), bi(spark, d) if counts is None else counts, skips)


@query(f"WITH {BI}, {_EVID} SELECT doc_id, sent_id, pos, token, variant, variant_ev FROM ev WHERE context > 0 AND typed_ev = 0 AND variant_ev >= 21 QUALIFY row_number() OVER (PARTITION BY doc_id, sent_id, pos ORDER BY variant_ev DESC, variant_id) = 1")
def q_mod12_detect(spark, d):
    return R.detected(evidence(spark, d)).select("doc_id", "sent_id", "pos", "token", "variant", "variant_ev")


@query("SELECT 0::BIGINT AS findings")
def q_mod12_control_empty(spark, d):
    """Control: without pair counts nothing may be found."""
    return R.detected(evidence(spark, d, bi(spark, d).limit(0))).agg(F.count("*").alias("findings"))


@query(f"""WITH {BI}, {_EVID}, near AS (SELECT *, 'adjacent' AS path, variant_ev AS strength FROM ev WHERE context > 0 AND typed_ev = 0 AND variant_ev >= 21 QUALIFY row_number() OVER (PARTITION BY doc_id, sent_id, pos ORDER BY variant_ev DESC, variant_id) = 1),
  blind AS (SELECT *, max(greatest(typed_ev, variant_ev)) OVER (PARTITION BY doc_id, sent_id, pos) AS any_ FROM ev), prior AS (SELECT *, 'prior' AS path, variant_freq::INT AS strength FROM blind WHERE any_ = 0 AND variant_freq - typed_freq >= 104 QUALIFY row_number() OVER (PARTITION BY doc_id, sent_id, pos ORDER BY variant_freq DESC, variant_id) = 1)
  SELECT doc_id, sent_id, pos, token, variant, path, strength FROM near UNION ALL SELECT doc_id, sent_id, pos, token, variant, path, strength FROM prior""")
def q_mod13_detect_wide(spark, d):
    return R.detected_wide(evidence(spark, d)).select("doc_id", "sent_id", "pos", "token", "variant", "path", "strength")


@query()
def q_mod13_detect_skips(spark, d):
    skips = T.pruned(T.skipgrams(sents(spark, d), lex(spark, d)), 5)
    return R.detected_wide(evidence(spark, d, None, skips), skip_margin=21).select("doc_id", "sent_id", "pos", "token", "variant", "path", "strength")


@query(f"WITH {BI}, {_EVID} SELECT doc_id, sent_id, pos, token, variant FROM ev WHERE variant_freq - typed_freq >= 56 QUALIFY row_number() OVER (PARTITION BY doc_id, sent_id, pos ORDER BY variant_freq DESC, variant_id) = 1")
def q_mod14_frequency_only(spark, d):
    ok = evidence(spark, d).filter("variant_freq - typed_freq >= 56")
    return R.top(ok, R.SITE, [F.desc("variant_freq"), _c("variant_id")], 1).select(*R.SITE, "token", "variant")


@query(f"WITH {_UP} SELECT user_id, first_id, second_id, cnt, sessions, {log_sql('cnt')} AS log_count FROM up WHERE sessions >= 2")
def q_mod16_mod17_stm7_user_pairs(spark, d):
    return U.gated(U.user_pairs(_log(spark, d)))


@query(f"WITH {_UP}, r AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY sessions DESC, cnt DESC, first_id, second_id) AS k FROM up) SELECT user_id, first_id, second_id, cnt, sessions FROM r WHERE n <= 100 OR k <= 90")
def q_top7_stm8_evict(spark, d):
    """Models of at most a hundred pairs: the capacity is what the operator is."""
    return U.evicted(U.user_pairs(_log(spark, d)), 100).select("user_id", "first_id", "second_id", "cnt", "sessions")


def _after_prefixes(spark, d, words):
    from wordloom.profiles import HEBREW

    w = words.withColumnRenamed("word", "token")
    options = F.array_compact(F.array(*(F.when(_c("token").startswith(x) & (F.length("token") >= len(x) + 2), F.lit(x)) for x in HEBREW.prefixes)))
    c = w.select("token", F.explode(options).alias("p")).withColumn("prefix", F.expr("substring(token, length(p) + 1, 2)"))
    f = R.top(L.by_prefix(c, lex(spark, d), (2,)), ["prefix"], [F.desc("log_freq"), _c("word_id")], 3, "k")
    rows = c.join(f, "prefix").select("token", "p", F.concat("p", "word").alias("completion"), "log_freq")
    return R.top(rows, ["token"], [F.desc("log_freq"), _c("completion"), _c("p")], 3).select("token", "completion", "log_freq", "rank")


@query(f"""WITH {BI}, {_PREFIX}, w AS (SELECT DISTINCT token FROM tok), c AS (SELECT token, prefix, substr(token, length(prefix) + 1, 2) AS head FROM w JOIN prefixes ON starts_with(token, prefix) AND length(token) >= length(prefix) + 2),
  f AS (SELECT substr(word, 1, 2) AS head, word, log_freq FROM lexicon QUALIFY row_number() OVER (PARTITION BY substr(word, 1, 2) ORDER BY log_freq DESC, word_id) <= 3) SELECT token, prefix || word AS completion, log_freq, row_number() OVER (PARTITION BY token ORDER BY log_freq DESC, prefix || word, prefix) AS rank FROM c JOIN f USING (head) QUALIFY rank <= 3""")
def q_mod18_prefix_completion(spark, d):
    """After each prefix of a word, completions of two letters of the rest."""
    return _after_prefixes(spark, d, _words(spark, d))


@query(f"""WITH {BI}, s AS (SELECT first_id, second_id, log_count, lead(log_count) OVER w AS n2, row_number() OVER w AS k FROM bi WINDOW w AS (PARTITION BY first_id ORDER BY log_count DESC, second_id)) SELECT first_id, second_id, log_count - coalesce(n2, 0) AS margin FROM s WHERE k = 1 AND log_count >= 28 AND log_count - coalesce(n2, 0) >= 2""")
def q_mod19_offer(spark, d):
    """Next words offered only where they score well and lead the second."""
    w = Window.partitionBy("first_id").orderBy(F.desc("log_count"), "second_id")
    s = bi(spark, d).withColumn("k", F.row_number().over(w)).withColumn("n2", F.coalesce(F.lead("log_count").over(w), F.lit(0)))
    return s.filter((_c("k") == 1) & (_c("log_count") >= 28) & (_c("log_count") - _c("n2") >= 2)).select("first_id", "second_id", (_c("log_count") - _c("n2")).alias("margin"))


@query(f"WITH {TOK}, {_STEMS}, n AS (SELECT token AS word, count(*) AS n FROM tok GROUP BY 1) SELECT stem, sum(n)::BIGINT AS n, count(*) AS forms FROM stems JOIN n USING (word) GROUP BY 1")
def q_agg23_mod24_stem_mass(spark, d):
    counts = T.counted(toks(spark, d))
    return L.stems(counts.select("word"), lex(spark, d)).join(counts, "word").groupBy("stem").agg(F.sum("cnt").alias("n"), F.count("*").alias("forms"))
