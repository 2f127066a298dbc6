"""Queries of the string, character, numeric, policy, array and hash functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wordloom.functions import hashing as H
from wordloom.functions import numeric as N
from wordloom.functions import policy as P
from wordloom.functions import similarity as S
from wordloom.functions import text as X
from wordloom.operators import lookup as L
from wordloom.plans import tables as T
from wordloom.queries.common import TOK, docs, hash_sql, log_sql, sents, toks
from wordloom.profiles import HEBREW
from wordloom.session import table

QUERIES, SQL = {}, {}
_c = F.col


def query(sql=None):
    """Registers a function under its name, with its SQL if that can express it."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _forms(spark, d):
    return table(spark, d, "verb_forms", "form_id", "vocalized_inflection", "morphology").distinct()


def _options(spark, d):
    return table(spark, d, "label_items", "options").select(F.explode("options").alias("w")).distinct()


@query("SELECT DISTINCT form_id, regexp_replace(nfc_normalize(vocalized_inflection), '[\\x{0591}-\\x{05C7}]', '', 'g') AS bare FROM verb_forms")
def q_str1_strip_points(spark, d):
    return _forms(spark, d).select("form_id", X.strip_points(_c("vocalized_inflection")).alias("bare")).distinct()


@query("SELECT DISTINCT w, regexp_full_match(w, '[א-ת]+') AS word, regexp_full_match(w, '[א-ת][א-ת״׳\"'']*') AS marked FROM (SELECT unnest(options) AS w FROM label_items)")
def q_str2_str3_word_predicates(spark, d):
    return _options(spark, d).select("w", X.is_word(_c("w")).alias("word"), X.is_word_or_abbreviation(_c("w")).alias("marked"))


@query("""SELECT CASE WHEN c BETWEEN 'א' AND 'ת' THEN 'letter' WHEN c IN ('־', '׀', '׃', '׆') THEN 'punctuation' WHEN c BETWEEN chr(1425) AND chr(1479) THEN 'mark' ELSE 'other' END AS kind, count(*) AS n
  FROM (SELECT unnest(string_split(vocalized_inflection, '')) AS c FROM verb_forms WHERE vocalized_inflection <> '') GROUP BY 1""")
def q_str4_char_kinds(spark, d):
    c = table(spark, d, "verb_forms", "vocalized_inflection").filter("vocalized_inflection <> ''").select(F.explode(F.split("vocalized_inflection", "")).alias("c"))
    kind = F.when(_c("c").between("א", "ת"), "letter").when(_c("c").isin("־", "׀", "׃", "׆"), "punctuation").when(_c("c").between("֑", "ׇ"), "mark").otherwise("other")
    return c.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


_ABBR = """runs AS (SELECT unnest(regexp_extract_all(raw, '[\\wא-ת"׳״'']+')) AS r FROM verb_raw),
  forms AS (SELECT unnest(regexp_extract_all(' ' || raw || ' ', '[^\\wא-ת]([א-ת]{1,6}["״][א-ת]{1,4}|[א-ת]{2,8}[''׳])(?:[^\\wא-ת]|$)', 1)) AS f FROM verb_raw)"""


@query(f"WITH {_ABBR} SELECT translate(f, '\"''', '״׳') AS canonical, count(*) AS n FROM forms GROUP BY 1")
def q_str9_str6_abbreviation_forms(spark, d):
    f = table(spark, d, "verb_raw", "raw").select(F.explode(X.abbreviations(_c("raw"))).alias("f"))
    return f.groupBy(X.canonical(_c("f")).alias("canonical")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT doc_id, translate(substr(text, 1, length(text)), '״׳\"''', '') AS bare, regexp_matches(text, '[גזצת]׳$') AS phonetic FROM documents WHERE text IS NOT NULL")
def q_str5_str7_str8_marks(spark, d):
    return docs(spark, d).filter("text IS NOT NULL").select("doc_id", X.strip_marks(_c("text")).alias("bare"), X.is_phonetic(_c("text")).alias("phonetic")).distinct()


@query(f"WITH {TOK} SELECT doc_id, count(DISTINCT sent_id) AS sentences, count(*) AS tokens, max(length(token)) AS longest FROM tok GROUP BY 1")
def q_str10_str11_tokens_per_text(spark, d):
    return sents(spark, d).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.size("tokens")).alias("tokens"), F.max(F.array_max(F.transform("tokens", F.length))).alias("longest"))


def _markup_sql():
    s = "text"
    for p, by in X.BEFORE:
        s = f"regexp_replace({s}, '{p}', '{by}', 'g')"
    for _ in range(X.NESTING):
        s = f"regexp_replace(regexp_replace({s}, '{X.TEMPLATE}', ' ', 'g'), '{X.TABLE}', ' ', 'g')"
    for p, by in X.AFTER:
        s = f"regexp_replace({s}, '{p}', '{by}', 'g')".replace("'$1'", "'\\1'").replace("'''|''|=", "''''''|''''|=")
    return s


@query(f"SELECT doc_id, md5({_markup_sql()}) AS digest FROM documents")
def q_str12_strip_markup(spark, d):
    """The markup rules alone, which SQL can express; q_str12_markup_all resolves character references first."""
    return docs(spark, d).select("doc_id", F.md5(X.strip_markup(_c("text"), references=False)).alias("digest"))


@query()
def q_str12_markup_all(spark, d):
    return docs(spark, d).select("doc_id", X.strip_markup(_c("text")).alias("plain"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[א-ת]+'), ' ') AS key FROM documents")
def q_str13_token_key(spark, d):
    return docs(spark, d).select("doc_id", X.token_key(_c("text")).alias("key"))


_SPACE = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0B}\\x{1C}-\\x{1F}]"
_CLASS_SQL = f"CASE WHEN regexp_full_match(c, '{_SPACE}') THEN 'whitespace' " + " ".join(f"""WHEN regexp_full_match(c, '[{body.replace("'", "''")}]') THEN '{name}'""" for name, body in X.CLASSES) + " ELSE 'other' END"


@query(f"SELECT source, {_CLASS_SQL} AS class, sum(n) AS n FROM (SELECT source, c, count(*) AS n FROM (SELECT source, unnest(string_split(text, '')) AS c FROM documents WHERE text <> '') GROUP BY ALL) GROUP BY ALL")
def q_str14_char_classes(spark, d):
    chars = docs(spark, d).filter("text <> ''").select("source", F.explode(F.split("text", "")).alias("c")).groupBy("source", "c").agg(F.count("*").alias("n"))
    return chars.groupBy("source", X.char_class(_c("c")).alias("class")).agg(F.sum("n").alias("n"))


@query("SELECT source, " + ", ".join(f"""count(*) FILTER (regexp_matches(line, '{p.replace("'", "''")}')) AS {n}""" for n, p in X.PRESENCE) + ", count(*) AS lines FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def q_str15_class_presence(spark, d):
    lines = docs(spark, d).select("source", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("source").agg(*(F.count_if(_c("line").rlike(p)).alias(n) for n, p in X.PRESENCE), F.count("*").alias("lines"))


_KIND_SQL = f"""CASE WHEN regexp_matches(t, '[{X.EMOJI}]') THEN 'emoji' WHEN regexp_full_match(t, '[0-9]+') THEN 'digits' WHEN regexp_full_match(t, '[A-Za-z]+') THEN 'latin'
  WHEN regexp_full_match(t, '[^\\wא-ת]+') THEN 'punctuation' WHEN regexp_matches(t, '[A-Za-z].*[א-ת]|[א-ת].*[A-Za-z]') THEN 'mixed'
  WHEN regexp_full_match(t, '[׳״''"]*[א-ת]+[׳״''"][א-ת׳״''"]*|[׳״''"]+[א-ת]+') THEN 'marked' WHEN regexp_full_match(t, '[א-ת]+') THEN 'word' ELSE 'other' END"""
_WS = "[ \\t\\n\\r]+"


@query(f"""WITH t AS (SELECT unnest(string_split_regex(text, '{_WS}')) AS t FROM documents), o AS (SELECT t FROM t WHERE length(t) >= 3), k AS (SELECT {_KIND_SQL} AS kind, t FROM o ANTI JOIN lexicon ON word = t)
  SELECT kind, count(*) AS n, count(DISTINCT t) AS types, round(count(*) / sum(count(*)) OVER (), 6) AS of_oov, round(count(*) / (SELECT count(*) FROM o), 6) AS of_tokens FROM k GROUP BY 1""")
def q_str16_agg11_oov_kinds(spark, d):
    t = docs(spark, d).select(F.explode(F.split("text", _WS, -1)).alias("t")).filter(F.length("t") >= 3)
    counts = t.groupBy("t").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    oov = counts.join(table(spark, d, "lexicon", "word"), _c("t") == _c("word"), "left_anti").withColumn("kind", X.oov_kind(_c("t")))
    by = oov.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("types"))
    # Eight kinds at most: the window and the one-row join are over those.
    share = F.round(_c("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6)
    return by.join(F.broadcast(total)).select("kind", "n", "types", share.alias("of_oov"), F.round(_c("n") / _c("total"), 6).alias("of_tokens"))


@query("SELECT DISTINCT w, regexp_matches(w, '[A-Za-z]') AS latin, regexp_matches(w, '[0-9]') AS digit, regexp_matches(w, '[׳״\"'']') AS quote, right(w, 1) IN ('ך','ם','ן','ף','ץ') AS final, right(w, 1) IN ('כ','מ','נ','פ','צ') AS unfinal FROM (SELECT unnest(options) AS w FROM label_items)")
def q_str17_script_flags(spark, d):
    last = F.right("w", F.lit(1))
    a, b = zip(*HEBREW.finals, strict=True)
    return _options(spark, d).select("w", _c("w").rlike("[A-Za-z]").alias("latin"), _c("w").rlike("[0-9]").alias("digit"), _c("w").rlike("[׳״\"']").alias("quote"), last.isin(*b).alias("final"), last.isin(*a).alias("unfinal"))


@query("""WITH k AS (SELECT DISTINCT typed, other FROM label_keys WHERE length(typed) = length(other)), p AS (SELECT typed, other, list_filter(list_zip(string_split(typed, ''), string_split(other, '')), lambda x: x[1] <> x[2])[1] AS x FROM k)
  SELECT typed, other, x[1] AS a, x[2] AS b FROM p WHERE x IS NOT NULL""")
def q_str18_confusion_pair(spark, d):
    k = table(spark, d, "label_keys", "typed", "other").distinct().withColumn("x", X.difference(_c("typed"), _c("other")))
    return k.filter("x IS NOT NULL").select("typed", "other", "x.a", "x.b")


@query("SELECT DISTINCT id, array_to_string(list_transform(sentence, lambda w, i: CASE WHEN i - 1 = position THEN '[' || w || ']' ELSE w END), ' ') AS marked FROM label_items")
def q_str19_marked_sentence(spark, d):
    return table(spark, d, "label_items", "id", "sentence", "position").select("id", X.marked_sentence(_c("sentence"), _c("position")).alias("marked")).distinct()


@query("SELECT a.word_id, a.word < b.word AS ascending FROM lexicon a JOIN lexicon b ON b.word_id = a.word_id + 1")
def q_str20_byte_order(spark, d):
    a = table(spark, d, "lexicon", "word_id", "word")
    b = a.select((_c("word_id") - 1).alias("word_id"), _c("word").alias("next"))
    return a.join(b, "word_id").select("word_id", (_c("word") < _c("next")).alias("ascending"))


@query("SELECT doc_id, length(text)::INT AS points, length_grapheme(replace(text, chr(13) || chr(10), chr(10)))::INT AS clusters, CASE WHEN ends_with(text, chr(13) || chr(10)) THEN 2 ELSE length(right_grapheme(text, 1)) END::INT AS backspace FROM documents WHERE text <> ''")
def q_str21_graphemes(spark, d):
    return docs(spark, d).filter("text <> ''").select("doc_id", F.length("text").alias("points"), F.size(X.graphemes(_c("text"))).alias("clusters"), F.length(F.element_at(X.graphemes(_c("text")), -1)).alias("backspace"))


@query("SELECT doc_id, translate(text, '()[]{}<>', ')(][}{><') AS swapped, regexp_replace(text, '[A-Za-z0-9]+', '⁨\\0⁩', 'g') AS isolated FROM documents")
def q_str23_bidi_arms(spark, d):
    return docs(spark, d).select("doc_id", X.swap_brackets(_c("text")).alias("swapped"), X.isolate_runs(_c("text")).alias("isolated"))


@query("SELECT doc_id, doc_id % 3 <> 0 AND coalesce(CASE WHEN doc_id % 2 = 0 THEN '' END = '', false) AND regexp_matches(text, '[א-ת]') AS pin FROM documents")
def q_str24_pin(spark, d):
    before = F.when(_c("doc_id") % 2 == 0, F.lit(""))
    return docs(spark, d).select("doc_id", X.should_pin(_c("text"), before, _c("doc_id") % 3 == 0).alias("pin"))


@query("""SELECT DISTINCT typed, other, path, CASE path WHEN 'adjacent' THEN other || ', replaces ' || coalesce(typed, '') || ' earlier in the sentence' WHEN 'prior' THEN other || ', completion' ELSE other || ', next word' END AS says FROM label_keys""")
def q_str25_describe(spark, d):
    kind = F.when(_c("path") == "adjacent", "REAL_WORD_ERROR").when(_c("path") == "prior", "COMPLETION").otherwise("NEXT_WORD")
    return table(spark, d, "label_keys", "typed", "other", "path").distinct().withColumn("says", X.describe(_c("other"), kind, _c("typed")))


@query(f"""WITH o AS (SELECT DISTINCT unnest(options) AS w FROM label_items), p AS (SELECT w, regexp_replace(nfc_normalize(w), '[\\x{{0591}}-\\x{{05C7}}]', '', 'g') AS b FROM o)
  SELECT w, CASE WHEN w IS NULL OR w = '' THEN 'empty' WHEN length(w) <= 32 AND length(b) <= 32 AND regexp_full_match(b, '[א-ת]+') THEN NULL WHEN length(w) > 32 THEN 'too long' WHEN regexp_matches(w, '{_SPACE}') THEN 'more than one word' WHEN regexp_matches(w, '\\p{{Nd}}') THEN 'digits' ELSE 'not letters' END AS why FROM p""")
def q_str26_storable(spark, d):
    return _options(spark, d).select("w", X.storable(_c("w")).alias("why"))


_B1 = "CASE p_partkey % 4 WHEN 0 THEN a WHEN 1 THEN substr(a, 1, 2) || substr(a, 4) WHEN 2 THEN substr(a, 1, 2) || substr(a, 4, 1) || substr(a, 3, 1) || substr(a, 5) ELSE 'q' || a END"


@query(f"WITH p AS (SELECT p_partkey, p_name AS a FROM part), q AS (SELECT a, {_B1} AS b FROM p) SELECT DISTINCT a, b, levenshtein(a, b)::INT AS lev, damerau_levenshtein(a, b)::INT * 100 AS osa FROM q WHERE damerau_levenshtein(a, b) <= 1")
def q_sim1_osa_whole_names(spark, d):
    """Up to one edit optimal string alignment and unrestricted transposition are the same."""
    p = table(spark, d, "part", "p_partkey", _c("p_name").alias("a"))
    p = p.select("a", F.expr(_B1).alias("b")).distinct()
    return p.select("a", "b", F.levenshtein("a", "b").alias("lev"), S.osa(_c("a"), _c("b")).alias("osa")).filter("osa <= 100")


@query()
def q_sim3_adjacent_cost(spark, d):
    k = table(spark, d, "label_keys", _c("typed").alias("a"), _c("other").alias("b")).distinct()
    return k.select("a", "b", S.osa(_c("a"), _c("b")).alias("neutral"), S.osa(_c("a"), _c("b"), S.adjacency_map(HEBREW), 80).alias("discounted"))


def _rect_sql():
    rows = ", ".join(f"('{c}', {i}, {x}::DOUBLE, {r}::DOUBLE)" for c, i, x, _, r, _ in S.keys(HEBREW))
    return f"keys(c, row, l, r) AS (VALUES {rows})"


@query(f"""WITH {_rect_sql()} SELECT a.c AS a, b.c AS b FROM keys a JOIN keys b ON a.c <> b.c AND abs(a.row - b.row) <= 1
  AND CASE WHEN a.row = b.row THEN abs(a.r - b.l) < 1 OR abs(b.r - a.l) < 1 ELSE least(a.r, b.r) - greatest(a.l, b.l) > 0.15 * least(a.r - a.l, b.r - b.l) END""")
def q_sim4_join17_adjacency(spark, d):
    return spark.createDataFrame([(a, b) for a, bs in sorted(S.neighbours(HEBREW).items()) for b in sorted(bs)], "a string, b string")


@query("""WITH s AS (SELECT DISTINCT id, list_distinct(flatten(list_transform(sentence, lambda w: string_split(w, '')))) AS x, list_distinct(flatten(list_transform(options, lambda w: string_split(w, '')))) AS y FROM label_items)
  SELECT id, round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 0), 9) AS jaccard, round(coalesce(least(len(x), len(y)) / nullif(greatest(len(x), len(y)), 0), 0), 9) AS ceiling FROM s""")
def q_sim5_sim6_jaccard(spark, d):
    chars = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda w: F.split(w, ""))))
    s = table(spark, d, "label_items", "id", chars("sentence").alias("x"), chars("options").alias("y"))
    return s.select("id", F.round(S.jaccard(_c("x"), _c("y")), 9).alias("jaccard"), F.round(S.size_ceiling(_c("x"), _c("y")), 9).alias("ceiling")).distinct()


_LOGS = ["word_id", "cnt"]


@query(f"SELECT word_id, {log_sql('cnt')} AS scaled, greatest(1, floor(pow(2, log_freq / 8.0))::INT - 1) AS back FROM lexicon")
def q_mth1_mth2_log_scale(spark, d):
    return table(spark, d, "lexicon", *_LOGS, "log_freq").select("word_id", N.log_scale(_c("cnt")).alias("scaled"), N.log_unscale(_c("log_freq")).alias("back"))


@query("""WITH c AS (SELECT l_returnflag AS g, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS k FROM lineitem GROUP BY 1),
  w AS (SELECT *, k / n AS p, 1 + 3.8416 / n AS dd FROM c), x AS (SELECT *, (p + 1.9208 / n) / dd AS mid, 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n::DOUBLE * n)) / dd AS half FROM w)
  SELECT g, n, k, round(greatest(0, mid - half), 9) AS lo, round(least(1, mid + half), 9) AS hi FROM x""")
def q_mth3_wilson(spark, d):
    c = table(spark, d, "lineitem", "l_returnflag", "l_discount").groupBy(_c("l_returnflag").alias("g")).agg(F.count("*").alias("n"), F.count_if(_c("l_discount") > 0.05).alias("k"))
    lo, hi = N.wilson(_c("k"), _c("n"))
    return c.select("g", "n", "k", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@query("""WITH h AS (SELECT log_freq, count(*) AS n FROM lexicon GROUP BY 1) SELECT round(-sum(n / t * log2(n / t)), 6) AS bits, count(*)::BIGINT AS kinds FROM h, (SELECT sum(n)::DOUBLE AS t FROM h)""")
def q_mth4_entropy(spark, d):
    h = table(spark, d, "lexicon", "log_freq").groupBy("log_freq").agg(F.count("*").alias("n"))
    h = h.join(F.broadcast(h.agg(F.sum("n").cast("double").alias("t"))))
    return h.agg(F.round(N.entropy_of_counts(_c("n"), _c("t")), 6).alias("bits"), F.count("*").alias("kinds"))


@query("""WITH g AS (SELECT first_id, count(DISTINCT second_id) AS n FROM pair_log WHERE first_id >= 0 AND second_id >= 0 GROUP BY 1)
  SELECT first_id, n, ceil(log2(greatest(20000.0 / n, 2.0)))::BIGINT + 2 AS bits, 6 + n * 5 AS bytes FROM g""")
def q_mth5_mth6_table_sizes(spark, d):
    g = table(spark, d, "pair_log", "first_id", "second_id").filter("first_id >= 0 AND second_id >= 0").distinct().groupBy("first_id").agg(F.count("*").alias("n"))
    return g.select("first_id", "n", N.elias_fano_bits(F.lit(20000.0), _c("n")).alias("bits"), N.table_bytes(F.lit(1), _c("n")).alias("bytes"))


def _lum_sql(c):
    ch = lambda s: f"(CASE WHEN (({c} >> {s}) & 255) / 255.0 <= 0.03928 THEN (({c} >> {s}) & 255) / 255.0 / 12.92 ELSE pow(((({c} >> {s}) & 255) / 255.0 + 0.055) / 1.055, 2.4) END)"
    return f"(0.2126 * {ch(16)} + 0.7152 * {ch(8)} + 0.0722 * {ch(0)})"


_A, _B = "(4278190080 + p_partkey * 7919 % 16777216)", "(CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 4278190080 END + p_partkey * 104729 % 16777216)"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN round((greatest({_lum_sql(_A)}, {_lum_sql(_B)}) + 0.05) / (least({_lum_sql(_A)}, {_lum_sql(_B)}) + 0.05), 6) END AS contrast FROM part")
def q_mth8_contrast(spark, d):
    a = F.lit(0xFF000000).cast("bigint") + _c("p_partkey") * 7919 % 16777216
    b = F.when(_c("p_partkey") % 10 == 0, F.lit(0).cast("bigint")).otherwise(F.lit(0xFF000000).cast("bigint")) + _c("p_partkey") * 104729 % 16777216
    return table(spark, d, "part", "p_partkey").select("p_partkey", F.round(N.contrast(a, b), 6).alias("contrast"))


@query("""SELECT p_partkey, round(CASE WHEN p_retailprice > 1000 THEN 40 * 1000 / p_retailprice ELSE 40 END, 6) AS size, p_retailprice > 1000.5 AS overflows, p_size * 10 - 24 - 100 AS clearance,
  (trunc(p_retailprice * 100)::BIGINT // 100)::VARCHAR || '.' || lpad((trunc(p_retailprice * 100)::BIGINT % 100)::VARCHAR, 2, '0') AS shown, abs(p_retailprice - 1000) <= 10 AS near FROM part""")
def q_mth9_mth10_mth11_fit(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_retailprice", "p_size")
    price = _c("p_retailprice")
    return p.select("p_partkey", F.round(N.fit(F.lit(40.0), price, F.lit(1000.0)), 6).alias("size"), (price > 1000.5).alias("overflows"), (_c("p_size") * 10 - 24 - 100).alias("clearance"), N.ratio_text(price).alias("shown"), N.within(price, F.lit(1000.0)).alias("near"))


@query("SELECT word_id, round(100 * (length(word) - 2) - 0.5 * (log_freq / 255.0), 9) AS score FROM lexicon")
def q_mth7_score(spark, d):
    return table(spark, d, "lexicon", "word_id", "word", "log_freq").select("word_id", F.round(100 * (F.length("word") - 2) - 0.5 * (_c("log_freq") / 255.0), 9).alias("score"))


_FIELD = "SELECT doc_id, CAST(doc_id % 7 + (doc_id // 7 % 17) * 16 + CASE WHEN doc_id % 11 = 0 THEN 524288 ELSE 0 END AS INT) AS kind, CAST(CASE WHEN doc_id % 13 = 0 THEN 16777216 ELSE 0 END AS INT) AS opts, source AS hint, CASE WHEN doc_id % 5 = 0 THEN 'sms code' END AS name, CAST(doc_id % 12 AS INT) AS len FROM documents"
_TEXT_CASE = " ".join(f"WHEN (kind & 4080) = {v} THEN '{r}'" for v, r in P.TEXT_REASONS.items())


def _fields(spark, d):
    i = _c("doc_id")
    kind = (i % 7 + F.floor(i / 7) % 17 * 16 + F.when(i % 11 == 0, 0x80000).otherwise(0)).cast("int")
    return docs(spark, d).select("doc_id", kind.alias("kind"), F.when(i % 13 == 0, 0x1000000).otherwise(0).cast("int").alias("opts"), _c("source").alias("hint"), F.when(i % 5 == 0, "sms code").alias("name"), (i % 12).cast("int").alias("len"))


_REASONS = f"""f AS ({_FIELD}), r AS (SELECT *, list_filter([CASE WHEN (kind & 15) = 1 THEN CASE WHEN (kind & 4080) IN {P.SAFE_TEXT} THEN NULL {_TEXT_CASE} ELSE 'UNRECOGNISED_INPUT_TYPE' END WHEN (kind & 15) = 2 THEN 'NUMBER' WHEN (kind & 15) = 3 THEN 'PHONE'
  WHEN (kind & 15) NOT IN (0, 4) THEN 'UNRECOGNISED_INPUT_TYPE' END, CASE WHEN (kind & 15) = 2 AND (kind & 4080) = 16 THEN 'NUMERIC_PASSWORD' END, CASE WHEN (kind & 524288) <> 0 THEN 'NO_SUGGESTIONS_FLAG' END, CASE WHEN (opts & 16777216) <> 0 THEN 'NO_PERSONALIZED_LEARNING_FLAG' END,
  CASE WHEN regexp_matches(lower(concat_ws(' ', hint, name)), '{"|".join(P.CODE_WORDS)}') OR ((kind & 15) = 2 AND len BETWEEN 4 AND 8) THEN 'OTP_HEURISTIC' END], lambda x: x IS NOT NULL) AS reasons,
  CASE WHEN (kind & 15) = 1 THEN CASE (kind & 4080) WHEN 96 THEN 'PERSON_NAME' WHEN 112 THEN 'POSTAL_ADDRESS' END END AS learn FROM f)"""


@query(f"WITH {_REASONS} SELECT doc_id, array_to_string(reasons, ',') AS reasons, learn, len(reasons) = 0 AS may_read, len(reasons) = 0 AND learn IS NULL AS may_learn FROM r")
def q_pol1_pol2_pol3_fields(spark, d):
    f = _fields(spark, d).withColumn("r", P.reasons(_c("kind"), _c("opts"), _c("hint"), _c("name"), _c("len"))).withColumn("learn", P.no_learn(_c("kind")))
    free = F.size("r") == 0
    return f.select("doc_id", F.array_join("r", ",").alias("reasons"), "learn", free.alias("may_read"), (free & _c("learn").isNull()).alias("may_learn"))


@query(f"WITH {_REASONS} SELECT r.doc_id, text FROM r JOIN documents USING (doc_id) WHERE len(reasons) = 0")
def q_pol4_gated_text(spark, d):
    """Text of the fields that may be read: the gate comes before the text in the plan."""
    f = _fields(spark, d).filter(F.size(P.reasons(_c("kind"), _c("opts"), _c("hint"), _c("name"), _c("len"))) == 0).select("doc_id")
    return f.join(docs(spark, d).select("doc_id", "text"), "doc_id")


@query("SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN count(*) FILTER (event_type = 'error' AND value > 50) = 0 END AS clean FROM events GROUP BY 1")
def q_pol5_verdict(spark, d):
    by = table(spark, d, "events", "user_id", "event_type", "value").groupBy("user_id").agg(F.count_if(_c("event_type") == "error").alias("seen"), F.count_if((_c("event_type") == "error") & (_c("value") > 50)).alias("served"))
    return by.select("user_id", P.verdict(_c("seen"), _c("served")).alias("clean"))


@query(f"""WITH {TOK}, l AS (SELECT tok.*, word_id AS id, lead(word_id) OVER w AS nxt, lead(word_id, 2) OVER w AS nxt2 FROM tok LEFT JOIN lexicon ON word = token WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY pos))
  SELECT doc_id, count(*) FILTER (id IS NOT NULL AND nxt IS NOT NULL) AS adjacent, count(*) FILTER (id IS NOT NULL AND nxt2 IS NOT NULL) AS apart FROM l GROUP BY 1""")
def q_arr1_arr2_zips(spark, d):
    t = T.neighbours(sents(spark, d), 0, 2).withColumn("w", _c("token"))
    t = L.ids(t, table(spark, d, "lexicon", "word", "word_id"), "w", "id", n1="w1", n2="w2")
    both = lambda n: F.count_if(_c("id").isNotNull() & _c(n).isNotNull())
    return t.groupBy("doc_id").agg(both("n1").alias("adjacent"), both("n2").alias("apart"))


@query("""SELECT DISTINCT form_id, coalesce(nullif(array_to_string(list_sort(list_filter(string_split(morphology, ';'), lambda x: x <> '')), '+'), ''), 'NONE') AS bundle, list_filter([base_form, vocalized_inflection], lambda x: x <> '')[1] AS lemma FROM verb_forms""")
def q_arr5_arr6_bundles(spark, d):
    f = table(spark, d, "verb_forms", "form_id", "morphology", "base_form", "vocalized_inflection")
    parts = F.array_sort(F.filter(F.split("morphology", ";"), lambda x: x != ""))
    bundle = F.coalesce(F.nullif(F.array_join(parts, "+"), F.lit("")), F.lit("NONE"))
    return f.select("form_id", bundle.alias("bundle"), F.get(F.filter(F.array("base_form", "vocalized_inflection"), lambda x: x != ""), F.lit(0)).alias("lemma")).distinct()


@query("""WITH m AS (SELECT batch_id, id, max(choice) AS choice, max(ms) AS ms FROM label_answers WHERE batch_id IS NOT NULL AND choice IS NOT NULL GROUP BY 1, 2) SELECT batch_id, id, choice, ms FROM m""")
def q_arr7_answer_map(spark, d):
    """Each batch's answers as a map id -> (choice, ms), and back to rows."""
    a = table(spark, d, "label_answers", "batch_id", "id", "choice", "ms").filter("batch_id IS NOT NULL AND choice IS NOT NULL AND id IS NOT NULL")
    a = a.groupBy("batch_id", "id").agg(F.max("choice").alias("choice"), F.max("ms").alias("ms"))
    maps = a.groupBy("batch_id").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("choice", "ms").alias("v")))).alias("answers"))
    return maps.select("batch_id", F.explode("answers").alias("id", "v")).select("batch_id", "id", "v.choice", "v.ms")


@query(f"""WITH c AS (SELECT source, list_distinct(list({_CLASS_SQL})) AS present FROM (SELECT DISTINCT source, unnest(string_split(text, '')) AS c FROM documents WHERE text <> '') GROUP BY 1), d AS (SELECT *, ['whitespace', 'hebrew_letter', 'ascii_punct', 'latin_letter'] AS declared FROM c)
  SELECT source, array_to_string(list_sort(list_filter(present, lambda x: NOT list_contains(declared, x))), ',') AS undeclared, array_to_string(list_sort(list_filter(declared, lambda x: NOT list_contains(present, x))), ',') AS absent FROM d""")
def q_arr8_set4_dq7_alphabet(spark, d):
    declared = F.array(*map(F.lit, ("whitespace", "hebrew_letter", "ascii_punct", "latin_letter")))
    c = docs(spark, d).filter("text <> ''").select("source", F.explode(F.split("text", "")).alias("c")).distinct().groupBy("source").agg(F.collect_set(X.char_class(_c("c"))).alias("present"))
    join = lambda a: F.array_join(F.array_sort(a), ",")
    return c.select("source", join(F.array_except("present", declared)).alias("undeclared"), join(F.array_except(declared, "present")).alias("absent"))


@query("SELECT o_orderkey, (('0x' || substr(sha256('golden:' || o_orderkey), 1, 15))::BIGINT % 100) AS draw FROM orders")
def q_rnd1_counter(spark, d):
    return table(spark, d, "orders", "o_orderkey").select("o_orderkey", H.below(100, "golden", _c("o_orderkey")).alias("draw"))


@query("SELECT doc_id FROM documents ORDER BY sha256('heldout:' || doc_id), doc_id LIMIT 100")
def q_rnd2_rnd4_seeded_sample(spark, d):
    """A sampling operator: the hundred least digests."""
    return docs(spark, d).select("doc_id").orderBy(H.order_key("heldout", _c("doc_id")), "doc_id").limit(100)


@query(f"SELECT source, {hash_sql('text')} AS digest FROM documents GROUP BY 1")
def q_rnd3_content_hash(spark, d):
    return docs(spark, d).groupBy("source").agg(H.content_hash(_c("text")).alias("digest"))


@query("SELECT DISTINCT batch_id, id, ('0x' || substr(sha256('flip:' || batch_id || ':' || id), 1, 15))::BIGINT % 2 = 0 AS flipped FROM label_keys")
def q_rnd5_coin_flips(spark, d):
    return table(spark, d, "label_keys", "batch_id", "id").distinct().select("batch_id", "id", (H.below(2, "flip", _c("batch_id"), _c("id")) == 0).alias("flipped"))
