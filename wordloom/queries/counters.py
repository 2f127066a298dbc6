"""Queries of counters: what makes tokens hard, what would help, how judgements spread; key plans and sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import numeric as N
from wordloom.functions import similarity as S
from wordloom.functions import text as X
from wordloom.operators import lookup as L
from wordloom.profiles import HEBREW
from wordloom.queries.common import docs, lex
from wordloom.queries.joins import _AB, _BUCKETS, _PREFIX, abbr_forms, buckets
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


COUNTERS = ("latin", "digit", "mixed_script", "marked", "hebrew", "in_lexicon", "oov", "oov_but_prefixed", "prefixed", "prefixed_and_in_lexicon", "ends_final", "ends_nonfinal", "final_would_be_word", "vowel_twin")
_FINAL, _PLAIN = "ךםןףץ", "כמנפצ"
_IN = lambda letters: "z IN (" + ", ".join(f"'{c}'" for c in letters) + ")"
_ON = ("lat", "dig", "lat OR dig", "ger", "heb", "heb AND lex", "heb AND NOT lex", "heb AND NOT lex AND pre", "heb AND pre", "heb AND pre AND lex", f"heb AND {_IN(_FINAL)}", f"heb AND {_IN(_PLAIN)}", f"heb AND {_IN(_PLAIN)} AND fw", "heb AND twin")


@query(f"""WITH t AS (SELECT source, unnest(string_split_regex(text, '[ \\t\\n\\r]+')) AS t FROM documents), w AS (SELECT source, t, count(*) AS n FROM t WHERE t <> '' GROUP BY 1, 2), d AS (SELECT DISTINCT t FROM w),
  pf AS (SELECT DISTINCT t FROM d, (VALUES (1), (2), (3)) v(k) WHERE length(t) > k + 1 AND regexp_full_match(substr(t, 1, k), '[והבכלמש]+') AND substr(t, k + 1) IN (SELECT word FROM lexicon)),
  tw AS (SELECT DISTINCT t FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM d SEMI JOIN lexicon ON word = t) WHERE substr(t, i, 1) IN ('ו', 'י') AND substr(t, 1, i - 1) || substr(t, i + 1) IN (SELECT word FROM lexicon)),
  f0 AS (SELECT t, regexp_extract(t, '([א-ת])[^א-ת]*$', 1) AS z FROM d),
  f AS (SELECT t, z, regexp_matches(t, '[A-Za-z]') AS lat, regexp_matches(t, '[0-9]') AS dig, regexp_matches(t, '[׳״"'']') AS ger, regexp_matches(t, '[א-ת]') AS heb, t IN (SELECT word FROM lexicon) AS lex, t IN (SELECT t FROM pf) AS pre, t IN (SELECT t FROM tw) AS twin,
    substr(t, 1, length(t) - 1) || translate(z, '{_PLAIN}', '{_FINAL}') IN (SELECT word FROM lexicon) AS fw FROM f0)
  SELECT source, sum(n)::BIGINT AS tokens, {", ".join(f"coalesce(sum(n) FILTER ({c}), 0)::BIGINT AS {a}" for a, c in zip(COUNTERS, _ON, strict=True))} FROM w JOIN f USING (t) GROUP BY 1""")
def q_agg13_friction(spark, d):
    """Fourteen counts of what makes tokens hard, per register: scripts and marks over all tokens, the rest over those with Hebrew
    letters. Each distinct token is looked at once."""
    w = docs(spark, d).select("source", F.explode(F.split("text", r"[ \t\n\r]+", -1)).alias("t")).filter("t <> ''").groupBy("source", "t").agg(F.count("*").alias("n"))
    w = materialize(w, "words")
    l = lex(spark, d).select("word")
    t = w.select("t").distinct()
    known = materialize(t.join(small(l), _c("t") == _c("word"), "left").select("t", _c("word").isNotNull().alias("lex")), "known")
    pre = L.chains(known.select(_c("t").alias("word")), l).select(_c("word").alias("t"), F.lit(True).alias("pre"))
    twin = L.dropped_twins(l).select(_c("word").alias("t"), F.lit(True).alias("twin")).distinct()
    z = F.regexp_extract("t", r"([א-ת])[^א-ת]*\z", 1)
    would = known.withColumn("w", F.concat(F.expr("substring(t, 1, length(t) - 1)"), F.translate(z, _PLAIN, _FINAL))).filter(z.isin(*_PLAIN)).join(small(l), _c("w") == _c("word"), "left_semi").select("t", F.lit(True).alias("fw"))
    f = known.join(pre, "t", "left").join(twin, "t", "left").join(would, "t", "left").fillna(False, ["pre", "twin", "fw"])
    lat, dig, ger, heb = (_c("t").rlike(p) for p in ("[A-Za-z]", "[0-9]", "[׳״\"']", "[א-ת]"))
    on = (lat, dig, lat | dig, ger, heb, heb & _c("lex"), heb & ~_c("lex"), heb & ~_c("lex") & _c("pre"), heb & _c("pre"), heb & _c("pre") & _c("lex"), heb & z.isin(*_FINAL), heb & z.isin(*_PLAIN), heb & z.isin(*_PLAIN) & _c("fw"), heb & _c("twin"))
    return w.join(f, "t").groupBy("source").agg(F.sum("n").alias("tokens"), *(F.coalesce(F.sum(F.when(c, _c("n"))), F.lit(0)).alias(a) for a, c in zip(COUNTERS, on, strict=True)))


LEVERS = ("prefixes", "double quotes", "titles", "latin", "emoji")


@query(f"""WITH t AS (SELECT unnest(string_split_regex(text, '[ \\t\\n\\r]+')) AS t FROM documents), w AS (SELECT t, count(*) AS n FROM t WHERE length(t) >= 3 GROUP BY 1), o AS (SELECT * FROM w ANTI JOIN lexicon ON word = t), tot AS (SELECT sum(n) AS n FROM w),
  {_PREFIX}, {_AB}, st AS (SELECT DISTINCT t FROM o JOIN prefixes ON starts_with(t, prefix) WHERE length(t) >= length(prefix) + 2 AND substr(t, length(prefix) + 1) IN (SELECT word FROM lexicon)),
  hd AS (SELECT unnest(regexp_extract_all(text, '(?m)^== (.*) ==$', 1)) AS h FROM documents WHERE source = 'wiki_dump'), ti AS (SELECT DISTINCT unnest(regexp_extract_all(h, '[א-ת]+')) AS word FROM hd),
  k AS (SELECT n, regexp_full_match(t, '[א-ת]+') AS heb, t IN (SELECT t FROM st) AS pre, contains(t, '""') OR contains(t, '״') AS dbl, replace(t, '""', '״') IN (SELECT canonical FROM abbr) AS mark, t IN (SELECT word FROM ti WHERE length(word) >= 2) AS title, regexp_full_match(t, '[A-Za-z]+') AS lat, regexp_matches(t, '[{X.EMOJI}]') AS emo FROM o),
  g AS (SELECT unnest([{", ".join(f"'{x}'" for x in LEVERS)}]) AS lever, unnest([sum(n) FILTER (heb AND pre), sum(n) FILTER (dbl AND mark), sum(n) FILTER (heb AND NOT pre AND title), sum(n) FILTER (lat AND NOT emo), sum(n) FILTER (emo)]) AS mass FROM k)
  SELECT lever, coalesce(mass, 0)::BIGINT AS mass, round(coalesce(mass, 0) / tot.n, 6) AS share FROM g, tot""")
def q_agg12_levers(spark, d):
    """How much of all tokens each means would bring into the vocabulary: prefixes off, quotes made marks, words of headings, a
    Latin lexicon, pictures."""
    t = docs(spark, d).select(F.explode(F.split("text", r"[ \t\n\r]+", -1)).alias("t")).filter(F.length("t") >= 3).groupBy("t").agg(F.count("*").alias("n"))
    w = materialize(t, "words")
    l = lex(spark, d).select("word")
    o = materialize(w.join(small(l), _c("t") == _c("word"), "left_anti"), "unknown")
    options = F.array_compact(F.array(*(F.when(_c("t").startswith(x) & (F.length("t") >= len(x) + 2), F.expr(f"substring(t, {len(x) + 1})")) for x in HEBREW.prefixes)))
    pre = o.select("t", F.explode(options).alias("rest")).join(small(l.withColumnRenamed("word", "rest")), "rest", "left_semi").select("t").distinct().withColumn("pre", F.lit(True))
    h = docs(spark, d).filter("source = 'wiki_dump'").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^== (.*) ==$"), F.lit(1))).alias("h"))
    titles = h.select(F.explode(X.tokens(_c("h"))).alias("t")).filter(F.length("t") >= 2).distinct().withColumn("title", F.lit(True))
    forms = abbr_forms(spark, d).select(_c("canonical").alias("m")).distinct().withColumn("mark", F.lit(True))
    k = o.withColumn("m", F.replace(_c("t"), F.lit('""'), F.lit("״"))).join(pre, "t", "left").join(titles, "t", "left").join(forms, "m", "left").fillna(False, ["pre", "title", "mark"])
    heb, emo, dbl = _c("t").rlike(r"\A[א-ת]+\z"), _c("t").rlike(f"[{X.EMOJI}]"), _c("t").contains('""') | _c("t").contains("״")
    on = (heb & _c("pre"), dbl & _c("mark"), heb & ~_c("pre") & _c("title"), _c("t").rlike(r"\A[A-Za-z]+\z") & ~emo, emo)
    one = k.agg(*(F.coalesce(F.sum(F.when(c, _c("n"))), F.lit(0)).alias(a) for a, c in zip(LEVERS, on, strict=True))).join(F.broadcast(w.agg(F.sum("n").alias("total"))))
    rows = one.select("total", F.explode(F.array(*(F.struct(F.lit(a).alias("lever"), _c(a).alias("mass")) for a in LEVERS))).alias("x"))
    return rows.select("x.lever", "x.mass", F.round(_c("x.mass") / _c("total"), 6).alias("share"))


_PAIRED = f"""{_BUCKETS}, k2 AS (SELECT DISTINCT batch_id, id, typed, other FROM label_keys), j AS (SELECT b.*, typed, other, CASE WHEN length(typed) = length(other) THEN list_filter(list_zip(string_split(typed, ''), string_split(other, '')), lambda x: x[1] <> x[2])[1] END AS x, abs(coalesce(o.log_freq, 0) - coalesce(t.log_freq, 0)) AS adv
  FROM b JOIN k2 USING (batch_id, id) LEFT JOIN lexicon t ON t.word = typed LEFT JOIN lexicon o ON o.word = other WHERE stratum = 'real')"""
_TALLY = "count(*) AS n, count(*) FILTER (bucket = 'suggestion') AS agreed, count(*) FILTER (bucket = 'text') AS overruled, count(*) FILTER (bucket IN ('both', 'unclear')) AS abstained, round(count(*) FILTER (bucket = 'suggestion') / nullif(count(*) FILTER (bucket IN ('suggestion', 'text')), 0), 6) AS agreement"
_BAND = "CASE WHEN adv >= 64 THEN '64 and more' WHEN adv >= 40 THEN '40 to 63' WHEN adv >= 28 THEN '28 to 39' WHEN adv >= 21 THEN '21 to 27' ELSE 'less' END"


def _judged(spark, d):
    """Judgements of real items, with the letters that differ and, as evidence, the difference of the words' frequencies."""
    k = table(spark, d, "label_keys", "batch_id", "id", "typed", "other").distinct()
    b = buckets(spark, d).filter("stratum = 'real'").drop("path").distinct().join(k, ["batch_id", "id"])
    f = small(lex(spark, d).select("word", "log_freq"))
    for side in ("typed", "other"):
        b = b.join(f.select(_c("word").alias(f"_{side}"), _c("log_freq").alias(f"f_{side}")), _c(side) == _c(f"_{side}"), "left")
    return b.withColumn("x", X.difference(_c("typed"), _c("other"))).withColumn("adv", F.abs(F.coalesce("f_other", F.lit(0)) - F.coalesce("f_typed", F.lit(0))))


def _tally(df, by):
    n = lambda *x: F.count_if(_c("bucket").isin(*x))
    return df.groupBy(by).agg(F.count("*").alias("n"), n("suggestion").alias("agreed"), n("text").alias("overruled"), n("both", "unclear").alias("abstained"), F.round(F.try_divide(n("suggestion").cast("double"), n("suggestion", "text")), 6).alias("agreement"))


@query(f"WITH {_PAIRED} SELECT x[1] || x[2] AS pair, {_TALLY} FROM j GROUP BY 1")
def q_agg26_by_pair(spark, d):
    return _tally(_judged(spark, d), F.concat("x.a", "x.b").alias("pair"))


@query(f"WITH {_PAIRED} SELECT {_BAND} AS band, {_TALLY} FROM j GROUP BY 1")
def q_agg26_by_band(spark, d):
    return _tally(_judged(spark, d), F.expr(_BAND).alias("band"))


#: Costs of the query of the cost model, in hundredths: a neighbouring key, a swap, an insertion, a deletion.
COSTS = (40, 70, 90, 110)


@query()
def q_sim2_udf2_cost_model(spark, d):
    """Every price of the cost model other than one edit's: distances of the options that labellers chose between."""
    k = table(spark, d, "label_keys", _c("typed").alias("a"), _c("other").alias("b")).distinct()
    adjacent, swap, insert, delete = COSTS
    return k.select("a", "b", S.osa(_c("a"), _c("b"), S.adjacency_map(HEBREW), adjacent, swap, insert, delete).alias("cost"))


@query("SELECT p_partkey, (p_partkey % 20000 * 32 + 32 * p_size + (1 + p_size % 3) * (p_size * 32 + p_size * p_size + p_size))::BIGINT AS bytes FROM part")
def q_mth12_scorer_bytes(spark, d):
    p = table(spark, d, "part", "p_partkey", _c("p_size").cast("bigint").alias("h"))
    return p.select("p_partkey", N.scorer_bytes(_c("p_partkey") % 20000, 32, _c("h"), 1 + _c("h") % 3).alias("bytes"))


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'CHARACTER' WHEN 1 THEN 'SPACE' WHEN 2 THEN 'ENTER' WHEN 3 THEN 'SHIFT' WHEN 4 THEN 'SWITCH_LAYOUT' WHEN 5 THEN 'NEXT_INPUT_METHOD' WHEN 6 THEN 'BACKSPACE' ELSE 'NONE' END AS action, source, doc_id % 3 = 0 AS shifted, text FROM documents)
  SELECT doc_id, CASE action WHEN 'CHARACTER' THEN 'COMMIT' WHEN 'SPACE' THEN 'COMMIT' WHEN 'ENTER' THEN 'EDITOR_ACTION' WHEN 'SHIFT' THEN 'TOGGLE_SHIFT' WHEN 'BACKSPACE' THEN 'DELETE' WHEN 'NONE' THEN NULL ELSE action END AS command,
    CASE action WHEN 'CHARACTER' THEN CASE WHEN shifted THEN upper(source) ELSE source END WHEN 'SPACE' THEN ' ' WHEN 'SWITCH_LAYOUT' THEN source END AS text, CASE WHEN action = 'BACKSPACE' THEN greatest(1, coalesce(CASE WHEN ends_with(text, chr(13) || chr(10)) THEN 2 ELSE length(right_grapheme(text, 1)) END, 1))::INT END AS count FROM t""")
def q_stm5_key_plan(spark, d):
    """What each key asks the editor for; a backspace takes a whole character of the text before it."""
    actions = ("CHARACTER", "SPACE", "ENTER", "SHIFT", "SWITCH_LAYOUT", "NEXT_INPUT_METHOD", "BACKSPACE", "NONE")
    action = F.element_at(F.array(*map(F.lit, actions)), (_c("doc_id") % 8 + 1).cast("int"))
    return docs(spark, d).select("doc_id", X.key_plan(action, _c("source"), _c("doc_id") % 3 == 0, _c("text")).alias("p")).select("doc_id", "p.*")


@query("SELECT k::INT AS depth, count(DISTINCT substr(word, 1, k)) AS nodes, count(*) FILTER (length(word) = k) AS words, count(*) AS below FROM lexicon, range(1, 64) r(k) WHERE length(word) >= k GROUP BY 1")
def q_mod26_prefix_index(spark, d):
    """The prefix tree of the lexicon by depth: its nodes, the words that end there, and the words that pass."""
    return L.prefix_tree(lex(spark, d)).groupBy("depth").agg(F.count("*").alias("nodes"), F.count_if("ends").alias("words"), F.sum("words").alias("below"))
