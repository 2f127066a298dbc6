"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wordloom.functions import similarity as S
from wordloom.functions import text as X
from wordloom.operators import lookup as L
from wordloom.plans import rank as R
from wordloom.plans import tables as T
from wordloom.profiles import HEBREW
from wordloom.queries.common import BI, IDS, TOK, bi, docs, lex, sents, toks
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


def _words(spark, d):
    """Distinct tokens of the corpus."""
    return toks(spark, d).select(_c("token").alias("word")).distinct()


@query(f"WITH {IDS} SELECT source, count(*) AS tokens, count(*) FILTER (id IS NULL) AS oov, round(count(*) FILTER (id IS NULL) / count(*), 6) AS rate FROM ids GROUP BY 1")
def q_join1_oov_rate(spark, d):
    ids = L.ids(toks(spark, d), lex(spark, d))
    oov = F.count_if(_c("id").isNull())
    return ids.groupBy("source").agg(F.count("*").alias("tokens"), oov.alias("oov"), F.round(oov / F.count("*"), 6).alias("rate"))


@query(f"WITH {BI}, r AS (SELECT *, row_number() OVER (PARTITION BY first_id ORDER BY cnt DESC, second_id) AS rank FROM bi) SELECT first_id, second_id, log_count, rank FROM r WHERE rank <= 16")
def q_join2_win3_continuations(spark, d):
    return T.capped(bi(spark, d), 16).select("first_id", "second_id", "log_count", "rank")


@query(f"WITH {BI}, p AS (SELECT DISTINCT first_id, second_id FROM pair_log) SELECT p.first_id, p.second_id, coalesce(log_count, 0) AS log_count FROM p LEFT JOIN bi USING (first_id, second_id)")
def q_join3_pair_count(spark, d):
    p = table(spark, d, "pair_log", "first_id", "second_id").distinct()
    return p.join(bi(spark, d).select("first_id", "second_id", "log_count"), ["first_id", "second_id"], "left").fillna(0, ["log_count"])


@query(f"WITH {BI} SELECT word_id, word FROM lexicon WHERE word_id IN (SELECT first_id FROM bi)")
def q_join4_has_continuations(spark, d):
    return lex(spark, d).select("word_id", "word").join(bi(spark, d).select(_c("first_id").alias("word_id")), "word_id", "left_semi")


_PREFIX = f"prefixes(prefix) AS (VALUES {', '.join(f'({chr(39)}{p}{chr(39)})' for p in HEBREW.prefixes)})"
_STEMS = f"""{_PREFIX}, words AS (SELECT DISTINCT token AS word FROM tok),
  stem_cand AS (SELECT w.word, prefix, substr(w.word, length(prefix) + 1) AS stem FROM words w JOIN prefixes ON starts_with(w.word, prefix) ANTI JOIN lexicon l ON l.word = w.word),
  stem_hit AS (SELECT c.*, row_number() OVER (PARTITION BY c.word ORDER BY length(prefix) DESC, prefix) AS r FROM stem_cand c JOIN lexicon l ON l.word = c.stem WHERE length(stem) >= 4),
  stems AS (SELECT word, '' AS prefix, word AS stem FROM words SEMI JOIN lexicon USING (word) UNION ALL SELECT word, prefix, stem FROM stem_hit WHERE r = 1)"""


@query(f"WITH {TOK}, {_STEMS} SELECT * FROM stems")
def q_join5_stem(spark, d):
    return L.stems(_words(spark, d), lex(spark, d))


_GRID = "UNION ALL ".join(f"SELECT {k} AS min_stem, word FROM stem_cand c JOIN lexicon l ON l.word = c.stem WHERE length(stem) >= {k} " for k in (2, 3, 4, 5))


@query(f"""WITH {TOK}, {_STEMS}, ok AS (SELECT DISTINCT * FROM (SELECT k AS min_stem, word FROM words SEMI JOIN lexicon USING (word), (VALUES (0), (2), (3), (4), (5)) v(k) UNION ALL {_GRID.replace('word FROM', 'c.word FROM')})),
  n AS (SELECT token AS word, count(*) AS n FROM tok GROUP BY 1) SELECT min_stem, sum(n)::BIGINT AS tokens, count(*) AS types, round(sum(n) / (SELECT count(*) FROM tok), 6) AS share FROM ok JOIN n USING (word) GROUP BY 1""")
def q_join6_agg10_coverage(spark, d):
    """Token and type coverage by least stem; stems are sought once per distinct word. 0 stands for no stripping."""
    counts = T.counted(toks(spark, d))
    words, l = counts.select("word"), lex(spark, d)
    arms = [L.stems(words, l, min_stem=99).select(F.lit(0).alias("min_stem"), "word")] + [L.stems(words, l, min_stem=k).select(F.lit(k).alias("min_stem"), "word") for k in (2, 3, 4, 5)]
    ok = arms[0]
    for arm in arms[1:]:
        ok = ok.union(arm)
    total = counts.agg(F.sum("cnt").alias("total"))
    by = ok.join(counts, "word").groupBy("min_stem").agg(F.sum("cnt").alias("tokens"), F.count("*").alias("types"))
    return by.join(F.broadcast(total)).select("min_stem", "tokens", "types", F.round(_c("tokens") / _c("total"), 6).alias("share"))


@query(f"""WITH {TOK}, w AS (SELECT DISTINCT token AS word FROM tok), c AS (SELECT word, n, substr(word, n + 1) AS stem FROM w, (VALUES (1), (2), (3)) v(n) WHERE length(word) > n + 1 AND regexp_full_match(substr(word, 1, n), '[והבכלמש]+'))
  SELECT c.word, substr(c.word, 1, max(n)) AS prefix, substr(c.word, max(n) + 1) AS stem FROM c JOIN lexicon l ON l.word = stem GROUP BY 1""")
def q_join7_chain(spark, d):
    return L.chains(_words(spark, d), lex(spark, d))


@query(f"WITH {TOK}, p AS (SELECT DISTINCT substr(token, 1, k) AS prefix FROM tok, (VALUES (2), (3)) v(k) WHERE length(token) >= k) SELECT prefix, count(*) AS words, max(log_freq) AS best FROM p JOIN lexicon ON starts_with(word, prefix) GROUP BY 1")
def q_join8_top3_fanout(spark, d):
    w = _words(spark, d)
    p = w.filter(F.length("word") >= 2).select(F.substring("word", 1, 2).alias("prefix")).union(w.filter(F.length("word") >= 3).select(F.substring("word", 1, 3).alias("prefix")))
    return L.by_prefix(p, lex(spark, d), (2, 3)).groupBy("prefix").agg(F.count("*").alias("words"), F.max("log_freq").alias("best"))


def _oov(spark, d):
    """Unknown words of three letters or more."""
    return _words(spark, d).filter(F.length("word") >= 3).join(small(lex(spark, d).select("word")), "word", "left_anti").select(_c("word").alias("typed"))


_ONE = """oov AS (SELECT DISTINCT token AS t FROM tok ANTI JOIN lexicon ON word = token WHERE length(token) >= 3),
  pos AS (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM oov), wpos AS (SELECT word_id, word, unnest(range(1, length(word) + 1)) AS i FROM lexicon),
  cand AS (SELECT t, word_id FROM pos JOIN lexicon ON word = substr(t, 1, i - 1) || substr(t, i + 1)
    UNION SELECT t, word_id FROM wpos JOIN oov ON t = substr(word, 1, i - 1) || substr(word, i + 1)
    UNION SELECT t, word_id FROM pos p JOIN wpos w ON p.i = w.i AND length(t) = length(word) AND substr(t, 1, p.i - 1) = substr(word, 1, w.i - 1) AND substr(t, p.i + 1) = substr(word, w.i + 1)
    UNION SELECT t, word_id FROM pos JOIN lexicon ON word = substr(t, 1, i - 1) || substr(t, i + 1, 1) || substr(t, i, 1) || substr(t, i + 2) WHERE i < length(t))"""


def two_sql(typed: str) -> str:
    """two(t, word, cost): words within two edits of each of ``typed`` (t). Words that near share what is left after two deletions;
    an optimal string alignment of two edits is two plain ones, or a swap with one edit on either side of it, not within."""
    swapped = "substr(t, i + 1, 1) || substr(t, i, 1)"
    rest = "(length(t) - i - 1)"
    # The distances of DuckDB count bytes: letters are written in one byte each meanwhile.
    latin = "abcdefghijklmnopqrstuvwxyzA"
    ascii_ = lambda x: f"translate({x}, '{HEBREW.alphabet}', '{latin}')"
    hebrew = lambda x: f"translate({x}, '{latin}', '{HEBREW.alphabet}')"
    return f"""cut0 AS (SELECT k, w, s, unnest(range(0, length(s) + 1)) AS i FROM (SELECT 0 AS k, {ascii_('t')} AS w, {ascii_('t')} AS s FROM {typed} UNION ALL SELECT 1, {ascii_('word')}, {ascii_('word')} FROM lexicon)),
  cut1 AS (SELECT DISTINCT k, w, CASE WHEN i = 0 THEN s ELSE substr(s, 1, i - 1) || substr(s, i + 1) END AS s FROM cut0),
  cut2 AS (SELECT DISTINCT k, w, CASE WHEN i = 0 OR length(w) - length(s) > 1 THEN s ELSE substr(s, 1, i - 1) || substr(s, i + 1) END AS s FROM (SELECT *, unnest(range(0, length(s) + 1)) AS i FROM cut1)),
  near2 AS (SELECT DISTINCT a.w AS t, b.w AS word FROM cut2 a JOIN cut2 b ON a.s = b.s AND a.k = 0 AND b.k = 1 WHERE abs(length(a.w) - length(b.w)) <= 2),
  two0 AS (SELECT t, word, CASE WHEN damerau_levenshtein(t, word) <= 1 THEN damerau_levenshtein(t, word) WHEN levenshtein(t, word) = 2 THEN 2
    WHEN damerau_levenshtein(t, word) = 2 AND len(list_filter(range(1, length(t)), lambda i:
      (substr(word, 1, i - 1) = substr(t, 1, i - 1) AND substr(word, i, 2) = {swapped} AND damerau_levenshtein(substr(t, i + 2), substr(word, i + 2)) <= 1)
      OR (length(word) >= {rest} + 2 AND right(word, {rest}) = right(t, {rest}) AND substr(word, length(word) - {rest} - 1, 2) = {swapped} AND damerau_levenshtein(substr(t, 1, i - 1), substr(word, 1, length(word) - {rest} - 2)) <= 1))) > 0 THEN 2 END AS cost FROM near2),
  two AS (SELECT {hebrew('t')} AS t, {hebrew('word')} AS word, (cost * 100)::INT AS cost FROM two0 WHERE cost IS NOT NULL)"""


@query(f"WITH {TOK}, {_ONE} SELECT t AS typed, word_id, 100 AS cost FROM cand")
def q_join9_fuzzy_one_edit(spark, d):
    return L.fuzzy(_oov(spark, d), lex(spark, d), edits=1).select("typed", "word_id", "cost")


@query(f"WITH {TOK}, oov AS (SELECT DISTINCT token AS t FROM tok ANTI JOIN lexicon ON word = token WHERE length(token) >= 3), {two_sql('oov')} SELECT t AS typed, word_id, word, log_freq, cost FROM two JOIN lexicon USING (word)")
def q_join9_fuzzy_two_edits(spark, d):
    return L.fuzzy(_oov(spark, d), lex(spark, d), edits=2).select("typed", "word_id", "word", "log_freq", "cost")


_SWAP = f"swaps(a, b) AS (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for x in HEBREW.confusions for a, b in (x, x[::-1]))})"


@query(f"""WITH {_SWAP}, p AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM lexicon), v AS (SELECT DISTINCT word, substr(word, 1, i - 1) || b || substr(word, i + 1) AS variant FROM p JOIN swaps ON a = substr(word, i, 1))
  SELECT v.word, variant, l.word_id AS variant_id, l.log_freq AS variant_freq FROM v JOIN lexicon l ON l.word = variant""")
def q_join10_confusions(spark, d):
    return L.confusions(lex(spark, d).select("word"), lex(spark, d))


@query("WITH p AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM lexicon), v AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS twin FROM p WHERE substr(word, i, 1) IN ('ו', 'י')) SELECT v.word, twin FROM v JOIN lexicon l ON l.word = twin")
def q_join11_twins(spark, d):
    return L.dropped_twins(lex(spark, d))


@query(f"WITH {TOK}, w AS (SELECT DISTINCT token AS word FROM tok), t AS (SELECT word, substr(word, 1, length(word) - 1) || translate(right(word, 1), 'כמנפצ', 'ךםןףץ') AS twin FROM w WHERE right(word, 1) IN ('כ', 'מ', 'נ', 'פ', 'צ')) SELECT t.word, twin FROM t JOIN lexicon l ON l.word = twin")
def q_join12_final_twins(spark, d):
    return L.final_twins(_words(spark, d), lex(spark, d))


@query("WITH r AS (SELECT doc_id AS id, doc_id * 400 AS lo, doc_id * 400 + n_chars AS hi FROM documents) SELECT a.id AS a_id, b.id AS b_id FROM r a JOIN r b ON a.id % 2 = 0 AND b.id % 2 = 1 AND a.lo <= b.hi AND b.lo <= a.hi")
def q_join13_overlap(spark, d):
    """Ranges that texts would take in a file of 400 characters per id: even ids against odd ones."""
    r = table(spark, d, "documents", "doc_id", "n_chars").select(_c("doc_id").alias("id"), (_c("doc_id") * 400).alias("lo"), (_c("doc_id") * 400 + _c("n_chars")).alias("hi"))
    return L.overlaps(r.filter("id % 2 = 0"), r.filter("id % 2 = 1"), 4000)


@query("""WITH k AS (SELECT DISTINCT batch_id, id, source_id, path, other_option, text_option, typed, other FROM label_keys), a AS (SELECT DISTINCT answer_id, batch_id, id, choice FROM label_answers), i AS (SELECT DISTINCT id, position, len(sentence) AS words FROM label_items)
  SELECT a.answer_id, k.source_id, k.path, i.position, i.words, CASE WHEN choice = other_option THEN 'suggestion' WHEN choice = text_option THEN 'text' WHEN choice = 3 THEN 'both' ELSE 'unclear' END AS bucket, l.log_freq AS typed_freq
  FROM k JOIN a ON a.batch_id = k.batch_id AND a.id = k.id JOIN i ON i.id = k.id LEFT JOIN lexicon l ON l.word = k.typed""")
def q_join14_src16_label_star(spark, d):
    k = table(spark, d, "label_keys", "batch_id", "id", "source_id", "path", "other_option", "text_option", "typed").distinct()
    a = table(spark, d, "label_answers", "answer_id", "batch_id", "id", "choice").distinct()
    i = table(spark, d, "label_items", "id", "position", F.size("sentence").alias("words")).distinct()
    bucket = F.when(_c("choice") == _c("other_option"), "suggestion").when(_c("choice") == _c("text_option"), "text").when(_c("choice") == 3, "both").otherwise("unclear")
    star = k.join(a, ["batch_id", "id"]).join(i, "id").join(small(lex(spark, d)), _c("typed") == _c("word"), "left")
    return star.select("answer_id", "source_id", "path", "position", "words", bucket.alias("bucket"), _c("log_freq").alias("typed_freq"))


@query("""SELECT e.event_id, c.ts AS last_ts, c.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN
  (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def q_join15_as_of(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value")
    left, right = e.filter("event_type = 'error'").select("event_id", "user_id", "ts"), e.filter("event_type = 'click'").select("user_id", "ts", "value")
    return L.as_of(left, right, "user_id", "ts", ["ts", "value"]).select("event_id", "last_ts", "last_value")


_BUCKETS = """k AS (SELECT DISTINCT batch_id, id, source_id, lower(trim(stratum)) AS stratum, other_option, text_option FROM label_keys WHERE source_id IS NOT NULL),
  a AS (SELECT batch_id, id, max(choice) AS choice FROM (SELECT DISTINCT answer_id, batch_id, id, choice FROM label_answers) WHERE choice IS NOT NULL GROUP BY 1, 2),
  b AS (SELECT k.*, CASE WHEN choice = other_option THEN 'suggestion' WHEN choice = text_option THEN 'text' WHEN choice = 3 THEN 'both' ELSE 'unclear' END AS bucket FROM k JOIN a USING (batch_id, id))"""


def buckets(spark, d):
    """(batch_id, id, source_id, stratum, path, bucket): one judgement per item, the greatest choice of its answers."""
    k = table(spark, d, "label_keys", "batch_id", "id", "source_id", "stratum", "path", "other_option", "text_option").filter("source_id IS NOT NULL").withColumn("stratum", F.lower(F.trim("stratum"))).distinct()
    a = table(spark, d, "label_answers", "answer_id", "batch_id", "id", "choice").filter("choice IS NOT NULL").groupBy("batch_id", "id").agg(F.max("choice").alias("choice"))
    bucket = F.when(_c("choice") == _c("other_option"), "suggestion").when(_c("choice") == _c("text_option"), "text").when(_c("choice") == 3, "both").otherwise("unclear")
    return k.join(a, ["batch_id", "id"]).select("batch_id", "id", "source_id", "stratum", "path", bucket.alias("bucket"), "choice", "other_option", "text_option")


@query(f"""WITH {_BUCKETS} SELECT r.batch_id, r.source_id, min(p.bucket) AS before, min(r.bucket) AS after FROM b r JOIN b p ON p.source_id = r.source_id AND r.stratum = 'repeat:' || p.batch_id GROUP BY 1, 2""")
def q_join16_rejudged(spark, d):
    b = buckets(spark, d)
    r = b.filter(_c("stratum").startswith("repeat:")).select("batch_id", "source_id", F.expr("substring(stratum, 8)").alias("of"), "bucket")
    p = b.select(_c("batch_id").alias("of"), "source_id", _c("bucket").alias("before"))
    return r.join(p, ["of", "source_id"]).groupBy("batch_id", "source_id").agg(F.min("before").alias("before"), F.min("bucket").alias("after"))


_KEYS = f"keys(i, c, l, t, r, b) AS (VALUES {', '.join(f'({i}, {chr(39)}{c}{chr(39)}, {x}::DOUBLE, {t}::DOUBLE, {r}::DOUBLE, {b}::DOUBLE)' for i, (c, _, x, t, r, b) in enumerate(S.keys(HEBREW)))})"


@query(f"""WITH {_KEYS}, p AS (SELECT event_id, (event_id * 37 % 1200)::DOUBLE AS x, (event_id * 91 % 760)::DOUBLE AS y FROM events),
  d AS (SELECT event_id, c, row_number() OVER (PARTITION BY event_id ORDER BY pow(greatest(l - x, x - r, 0), 2) + pow(greatest(t - y, y - b, 0), 2), i) AS k FROM p, keys) SELECT event_id, c AS key FROM d WHERE k = 1""")
def q_join18_nearest_key(spark, d):
    e = table(spark, d, "events", "event_id")
    return e.select("event_id", L.nearest_key(S.keys(HEBREW), (_c("event_id") * 37 % 1200).cast("double"), (_c("event_id") * 91 % 760).cast("double")).alias("key"))


@query(f"""WITH {TOK}, k AS (SELECT doc_id, source, sent_id, array_to_string(a, ' ') AS key FROM toks WHERE len(a) >= 1) SELECT doc_id, sent_id FROM k WHERE source = 'typed_comments' AND key IN (SELECT key FROM k WHERE source = 'subtitles')""")
def q_join19_contamination(spark, d):
    """Sentences of one register that another holds word for word."""
    k = sents(spark, d).select("doc_id", "source", "sent_id", F.array_join("tokens", " ").alias("key"))
    return k.filter("source = 'typed_comments'").join(k.filter("source = 'subtitles'").select("key"), "key", "left_semi").select("doc_id", "sent_id")


@query(f"WITH {TOK} SELECT DISTINCT token AS word FROM tok ANTI JOIN lexicon ON word = token")
def q_join20_set2_anti(spark, d):
    return _words(spark, d).join(small(lex(spark, d).select("word")), "word", "left_anti")


@query("""WITH k AS (SELECT DISTINCT batch_id, source_id FROM label_keys WHERE source_id IS NOT NULL) SELECT batch_id, source_id FROM k WHERE NOT EXISTS (SELECT 1 FROM k e WHERE e.source_id = k.source_id AND e.batch_id < k.batch_id)""")
def q_join21_unused(spark, d):
    k = table(spark, d, "label_keys", "batch_id", "source_id").filter("source_id IS NOT NULL").groupBy("source_id").agg(F.min("batch_id").alias("batch_id"))
    return k.select("batch_id", "source_id")


_VERB = "verbs AS (SELECT regexp_replace(nfc_normalize(vocalized_inflection), '[\\x{0591}-\\x{05C7}]', '', 'g') AS surface, min(form_id) AS form_id FROM verb_forms WHERE vocalized_inflection IS NOT NULL GROUP BY 1)"


@query(f"""WITH {TOK}, {_VERB}, w AS (SELECT DISTINCT token AS word FROM tok) SELECT w.word, coalesce('L:' || form_id, 'W:' || word_id, 'S:' || w.word) AS unit FROM w LEFT JOIN verbs ON surface = w.word LEFT JOIN lexicon l ON l.word = w.word""")
def q_join22_priority(spark, d):
    verbs = table(spark, d, "verb_forms", "form_id", "vocalized_inflection").filter("vocalized_inflection IS NOT NULL").select(X.strip_points(_c("vocalized_inflection")).alias("surface"), "form_id").groupBy("surface").agg(F.min("form_id").alias("form_id"))
    w = _words(spark, d)
    j = w.join(verbs, _c("word") == _c("surface"), "left").join(small(lex(spark, d).select(_c("word").alias("w2"), "word_id")), _c("word") == _c("w2"), "left")
    return j.select("word", F.coalesce(F.concat(F.lit("L:"), "form_id"), F.concat(F.lit("W:"), _c("word_id").cast("string")), F.concat(F.lit("S:"), "word")).alias("unit"))


_AB = """f AS (SELECT unnest(regexp_extract_all(' ' || raw || ' ', '[^\\wא-ת]([א-ת]{1,6}["״][א-ת]{1,4}|[א-ת]{2,8}[''׳])(?:[^\\wא-ת]|$)', 1)) AS f FROM verb_raw),
  abbr AS (SELECT translate(c, '״׳"''', '') AS bare, c AS canonical, count(*) AS cnt FROM (SELECT translate(f, '"''', '״׳') AS c FROM f) WHERE NOT regexp_matches(c, '[גזצת]׳$') GROUP BY 1, 2 HAVING count(*) >= 10)"""


def abbr_forms(spark, d):
    return T.abbreviations(_c("raw"), table(spark, d, "verb_raw", "raw"))


def abbr(spark, d):
    return T.unambiguous(abbr_forms(spark, d))


@query(f"WITH {_AB} SELECT bare, max(canonical) AS canonical, max(cnt) AS cnt, bare IN (SELECT word FROM lexicon) AS collides FROM abbr GROUP BY bare HAVING count(*) = 1")
def q_join23_agg15_abbreviations(spark, d):
    a = abbr(spark, d)
    j = a.join(lex(spark, d).select("word"), _c("bare") == _c("word"), "left")
    return j.select("bare", "canonical", "cnt", _c("word").isNotNull().alias("collides"))


@query(f"WITH {TOK}, {_VERB} SELECT DISTINCT token AS word FROM tok WHERE token IN (SELECT word FROM lexicon UNION SELECT surface FROM verbs)")
def q_join24_semi_union(spark, d):
    mine = table(spark, d, "verb_forms", "vocalized_inflection").filter("vocalized_inflection IS NOT NULL").select(X.strip_points(_c("vocalized_inflection")).alias("word"))
    return _words(spark, d).join(lex(spark, d).select("word").union(mine), "word", "left_semi")


_EV = f"""{BI}, allsk AS (SELECT first_id, second_id, count(*) AS cnt FROM (SELECT id AS first_id, lead(id, 2) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS second_id FROM ids) WHERE first_id IS NOT NULL AND second_id IS NOT NULL GROUP BY 1, 2)"""


@query(f"""WITH {BI}, n AS (SELECT doc_id, sent_id, pos, id, lag(id) OVER w AS prev, lead(id) OVER w AS next FROM ids WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY pos))
  SELECT doc_id, sent_id, pos, coalesce(a.log_count, 0) + coalesce(b.log_count, 0) AS evidence FROM n LEFT JOIN bi a ON a.first_id = prev AND a.second_id = id LEFT JOIN bi b ON b.first_id = id AND b.second_id = next WHERE id IS NOT NULL""")
def q_join25_evidence(spark, d):
    return evidence(spark, d, 1, bi(spark, d))


def evidence(spark, d, distance, counts):
    """(doc_id, sent_id, pos, evidence) of each known token: scaled counts with the known tokens ``distance`` before and after,
    looked up once per distinct three of them."""
    before, after = f"w-{distance}", f"w{distance}"
    t = T.neighbours(sents(spark, d), distance, distance).select("doc_id", "sent_id", "pos", _c("token").alias("w"), before, after)
    n = materialize(L.ids(t, lex(spark, d), "w", "id", prev=before, next=after).drop("w").filter("id IS NOT NULL"), "tokens")
    ctx = R._looked_up(n.select("prev", "id", "next").distinct(), small(counts.select("first_id", "second_id", "log_count")), "prev", "id", "next", "evidence")
    ctx = ctx.select(_c("prev").alias("_x"), _c("id").alias("_i"), _c("next").alias("_y"), "evidence")
    j = n.join(ctx, (_c("id") == _c("_i")) & _c("prev").eqNullSafe(_c("_x")) & _c("next").eqNullSafe(_c("_y")))
    return j.select("doc_id", "sent_id", "pos", "evidence")


@query(f"""WITH {_EV}, sk AS (SELECT *, {'least(255, round(round(log2(cnt + 1) * 8, 6)))::INT'} AS log_count FROM allsk WHERE cnt >= 5), n AS (SELECT doc_id, sent_id, pos, id, lag(id, 2) OVER w AS prev, lead(id, 2) OVER w AS next FROM ids WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY pos))
  SELECT doc_id, sent_id, pos, coalesce(a.log_count, 0) + coalesce(b.log_count, 0) AS evidence FROM n LEFT JOIN sk a ON a.first_id = prev AND a.second_id = id LEFT JOIN sk b ON b.first_id = id AND b.second_id = next WHERE id IS NOT NULL""")
def q_join26_skip_evidence(spark, d):
    return evidence(spark, d, 2, T.pruned(T.skipgrams(sents(spark, d), lex(spark, d)), 5))


@query("""WITH s AS (SELECT DISTINCT batch_id AS slice, source_id FROM label_keys WHERE source_id IS NOT NULL) SELECT a.slice AS slice_a, b.slice AS slice_b, count(*) AS shared FROM s a JOIN s b ON a.source_id = b.source_id AND a.slice < b.slice GROUP BY 1, 2""")
def q_join27_dq5_set3_shared(spark, d):
    """Slices that share records. Each record's slices are gathered first; a record is in few, a pair of slices in one row."""
    s = table(spark, d, "label_keys", _c("batch_id").alias("slice"), "source_id").filter("source_id IS NOT NULL").distinct()
    several = s.join(s.groupBy("source_id").agg(F.count("*").alias("k")).filter("k > 1"), "source_id")
    a, b = several.select("source_id", _c("slice").alias("slice_a")), several.select("source_id", _c("slice").alias("slice_b"))
    return a.join(b, "source_id").filter("slice_a < slice_b").groupBy("slice_a", "slice_b").agg(F.count("*").alias("shared"))
