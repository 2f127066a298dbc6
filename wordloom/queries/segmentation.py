"""Queries of segmentation: subword merges and units, prefix-lemma-feature units, a noun layer, its sweeps, lexeme ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.functions.numeric import log_unscale
from wordloom.functions.similarity import jaccard
from wordloom.operators import lookup as L
from wordloom.plans import segment as G
from wordloom.plans import tables as T
from wordloom.profiles import HEBREW
from wordloom.queries.common import TOK, lex, toks
from wordloom.session import materialize, small, table

QUERIES, SQL = {}, {}
_c = F.col
#: Merges of the queries that train on the corpus, and on what the layers leave over.
MERGES, REST_MERGES = 100, 60
#: The source whose paradigms play the nouns' and adjectives'; the others' are the verbs'.
NOUN_SOURCE = "field_notes"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def bpe_sql(vocab: str, merges: int) -> str:
    """bpe(step, l, r, c, ws): one row per merge over ``vocab`` (w, n), by the plain greedy procedure."""
    return f"""start AS (SELECT list({{'u': array_to_string(list_transform(string_split(w, ''), lambda x: '‹' || x || '›'), '') || '‹</w>›', 'n': n}}) AS ws FROM {vocab} WHERE w <> '' AND n > 0),
  bpe(step, l, r, c, ws) AS (SELECT 0, ''::VARCHAR, ''::VARCHAR, 0::BIGINT, ws FROM start
    UNION ALL SELECT step + 1, b.l, b.r, b.c, list_transform(ws, lambda x: {{'u': replace(x.u, '‹' || b.l || '›‹' || b.r || '›', '‹' || b.l || b.r || '›'), 'n': x.n}})
    FROM (SELECT * FROM bpe WHERE step < {merges}) s, LATERAL (SELECT a AS l, z AS r, sum(n)::BIGINT AS c FROM
      (SELECT unnest(p[1:len(p) - 1]) AS a, unnest(p[2:len(p)]) AS z, n FROM (SELECT string_split(x.u[2:-2], '›‹') AS p, x.n AS n FROM (SELECT unnest(s.ws) AS x))) GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 1) b),
  merges AS (SELECT step - 1 AS rank, l, r, c FROM bpe WHERE step > 0)"""


def units_sql(words: str) -> str:
    """units(word, u): the list of units of each word of ``words`` (word), merging the lowest rank's leftmost place again and again."""
    return f"""run(word, k, u) AS (SELECT word, 0, array_to_string(list_transform(string_split(word, ''), lambda x: '‹' || x || '›'), '') || '‹</w>›' FROM {words}
    UNION ALL SELECT word, k + 1, regexp_replace(u, '‹' || m.l || '›‹' || m.r || '›', '‹' || m.l || m.r || '›') FROM
      (SELECT word, k, u, min_by({{'l': m.l, 'r': m.r}}, m.rank) AS m FROM (SELECT word, k, u, unnest(p[1:len(p) - 1]) AS a, unnest(p[2:len(p)]) AS z FROM (SELECT *, string_split(u[2:-2], '›‹') AS p FROM run)) x JOIN merges m ON m.l = a AND m.r = z GROUP BY 1, 2, 3)),
  parts AS (SELECT word, list_filter(string_split(max_by(u, k)[2:-2], '›‹'), lambda x: x <> '</w>') AS s FROM run GROUP BY 1),
  units AS (SELECT word, CASE WHEN len(s) = 0 THEN [word] ELSE s END AS u FROM parts)"""


_VOCAB = f"{TOK}, vocab AS (SELECT token AS w, count(*) AS n FROM tok GROUP BY 1), words AS (SELECT w AS word FROM vocab)"


@query(f'WITH RECURSIVE {_VOCAB}, {bpe_sql("vocab", MERGES)} SELECT rank, l AS "left", r AS "right", c AS "count" FROM merges')
def q_mod20_bpe_merges(spark, d):
    return G.merge_table(spark, G.learn_merges(T.counted(toks(spark, d)), MERGES))


@query(f"WITH RECURSIVE {_VOCAB}, {bpe_sql('vocab', MERGES)}, {units_sql('words')} SELECT word, array_to_string(u, ' ') AS units, len(u)::INT AS n FROM units")
def q_mod21_agg30_units(spark, d):
    counts = materialize(T.counted(toks(spark, d)), "counts")
    return G.apply_bpe(counts.select("word"), G.learn_merges(counts, MERGES)).select("word", F.array_join("units", " ").alias("units"), F.size("units").alias("n"))


def paradigms(spark, d, nouns: bool | None = None):
    """(word, lemma, features) of the loaded paradigms without points, the first by form_id of each word; ``nouns``: only those
    of the nouns' source, or only the others'."""
    f = table(spark, d, "verb_forms", "form_id", "vocalized_inflection", "base_form", "morphology", "source_name")
    if nouns is not None:
        f = f.filter((F.coalesce("source_name", F.lit("")) == NOUN_SOURCE) == nouns)
    f = f.select("form_id", X.strip_points(_c("vocalized_inflection")).alias("word"), X.strip_points(_c("base_form")).alias("lemma"), F.coalesce("morphology", F.lit("")).alias("features"))
    return f.filter("word <> '' AND lemma <> ''").groupBy("word").agg(F.min_by(F.struct("lemma", "features"), F.struct("form_id", "lemma", "features")).alias("v")).select("word", "v.lemma", "v.features")


def counts_of(l):
    """(word, cnt) with the count that a word's scaled frequency stands for."""
    return l.select("word", log_unscale(_c("log_freq")).cast("bigint").alias("cnt"))


_BARE = "regexp_replace(nfc_normalize({}), '[\\x{{0591}}-\\x{{05C7}}]', '', 'g')"


def _given_sql(name: str, nouns: str) -> str:
    return f"""{name} AS (SELECT word, min_by({{'lemma': lemma, 'features': features}}, {{'f': form_id, 'lemma': lemma, 'features': features}}) AS v FROM
    (SELECT form_id, {_BARE.format('vocalized_inflection')} AS word, {_BARE.format('base_form')} AS lemma, coalesce(morphology, '') AS features FROM verb_forms WHERE {nouns}) WHERE word <> '' AND lemma <> '' GROUP BY 1)"""


_PREF = f"prefixes(prefix) AS (VALUES {', '.join(f'({chr(39)}{p}{chr(39)})' for p in HEBREW.prefixes)})"


def _peel_sql(name: str, words: str, known: str) -> str:
    """name(word, prefix, rest): the longest prefix off each of ``words`` whose rest of two letters or more is ``known`` (word)."""
    return f"""{name} AS (SELECT w.word, coalesce(h.prefix, '') AS prefix, coalesce(h.rest, w.word) AS rest FROM {words} w LEFT JOIN
    (SELECT word, max_by(prefix, length(prefix)) AS prefix, max_by(rest, length(prefix)) AS rest FROM (SELECT word, prefix, substr(word, length(prefix) + 1) AS rest FROM {words} JOIN prefixes ON starts_with(word, prefix)) c
      WHERE length(rest) >= 2 AND rest IN (SELECT word FROM {known}) GROUP BY 1) h USING (word))"""


def _layers_sql(verbs: str, nouns: str | None) -> str:
    """CTEs up to cut(word, prefix, rest) and units(word, u) over the corpus's words and what the layers leave of the lexicon."""
    given = "SELECT word FROM verbs" + (" UNION SELECT word FROM nouns" if nouns else "")
    tables = [_VOCAB, _PREF, _given_sql("verbs", verbs)] + ([_given_sql("nouns", nouns)] if nouns else [])
    return f"""{', '.join(tables)}, given AS ({given}), counts AS (SELECT word, greatest(1, floor(pow(2, log_freq / 8.0))::BIGINT - 1) AS cnt FROM lexicon),
  outside AS (SELECT word, cnt FROM counts ANTI JOIN given USING (word)), lexwords AS (SELECT word FROM outside), {_peel_sql('peel', 'lexwords', 'lexicon')},
  left_over AS (SELECT rest AS w, sum(cnt) AS n FROM peel JOIN outside USING (word) GROUP BY 1), resid AS (SELECT * FROM left_over WHERE w NOT IN (SELECT word FROM given)), {bpe_sql('resid', REST_MERGES)},
  known AS (SELECT word FROM lexicon UNION SELECT word FROM verbs), {_peel_sql('cut', 'words', 'known')}, rests AS (SELECT DISTINCT rest AS word FROM cut), {units_sql('rests')}"""


_P = "CASE WHEN prefix = '' THEN [] ELSE ['P:' || prefix] END"
_S = "list_transform(u.u, lambda x: 'S:' || x)"


@query(f"""WITH RECURSIVE {_layers_sql('true', None)} SELECT cut.word, array_to_string(list_concat({_P}, CASE WHEN v.word IS NOT NULL THEN ['L:' || v.v.lemma, 'F:' || v.v.features] ELSE {_S} END), ' ') AS units
  FROM cut LEFT JOIN verbs v ON v.word = rest JOIN units u ON u.word = rest""")
def q_mod22_segment(spark, d):
    """Words of the corpus as prefix, lemma and features, or subword units trained on what those leave of the lexicon."""
    verbs, l = materialize(paradigms(spark, d), "verbs"), lex(spark, d)
    learnt = G.learn_merges(G.residual(counts_of(l), verbs), REST_MERGES)
    words = toks(spark, d).select(_c("token").alias("word")).distinct()
    return G.segment(words, l, verbs, learnt).select("word", F.array_join("units", " ").alias("units"))


def _modes_sql(mode: str) -> str:
    noun = "['N:' || n.v.lemma, 'G:' || n.v.features]"
    return f"""SELECT '{mode}' AS mode, cut.word, array_to_string(list_concat({_P}, CASE WHEN v.word IS NOT NULL THEN ['L:' || v.v.lemma, 'F:' || v.v.features] WHEN n.word IS NOT NULL {"AND len(u.u) >= 2" if mode == "shortest" else ""} THEN {noun} ELSE {_S} END), ' ') AS units
  FROM cut LEFT JOIN verbs v ON v.word = rest LEFT JOIN nouns n ON n.word = rest JOIN units u ON u.word = rest"""


_IS_NOUN = f"coalesce(source_name, '') = '{NOUN_SOURCE}'"


@query(f"WITH RECURSIVE {_layers_sql(f'NOT {_IS_NOUN}', _IS_NOUN)} {_modes_sql('layered')} UNION ALL {_modes_sql('shortest')}")
def q_mod23_noun_layer(spark, d):
    """The same with a layer of nouns, in both modes: nouns first, or whichever is shorter."""
    verbs, nouns, l = materialize(paradigms(spark, d, False), "verbs"), materialize(paradigms(spark, d, True), "nouns"), lex(spark, d)
    learnt = G.learn_merges(G.residual(counts_of(l), verbs.select("word").union(nouns.select("word"))), REST_MERGES)
    words = materialize(toks(spark, d).select(_c("token").alias("word")).distinct(), "words")
    arms = [G.segment(words, l, verbs, learnt, nouns, m).select(F.lit(m).alias("mode"), "word", F.array_join("units", " ").alias("units")) for m in ("layered", "shortest")]
    return arms[0].unionByName(arms[1])


def lexemes(spark, d):
    """(lexeme, word) of all paradigms: a lexeme is its lemma without points."""
    f = table(spark, d, "verb_forms", "vocalized_inflection", "base_form").select(X.strip_points(_c("base_form")).alias("lexeme"), X.strip_points(_c("vocalized_inflection")).alias("word"))
    return f.filter("word <> '' AND lexeme <> ''")


@query(f"""WITH f AS (SELECT DISTINCT {_BARE.format('base_form')} AS lexeme, {_BARE.format('vocalized_inflection')} AS word FROM verb_forms),
  s AS (SELECT lexeme, coalesce(sum(greatest(1, floor(pow(2, log_freq / 8.0))::BIGINT - 1)) FILTER (log_freq IS NOT NULL), 0)::BIGINT AS mass, count(*) AS forms FROM f LEFT JOIN lexicon USING (word) WHERE f.word <> '' AND lexeme <> '' GROUP BY 1)
  SELECT lexeme, mass, forms, row_number() OVER (ORDER BY mass DESC, lexeme) AS rank, row_number() OVER (ORDER BY mass DESC, lexeme) <= 200 AS admitted FROM s""")
def q_agg24_top8_lexemes(spark, d):
    """Lexemes ranked by the summed frequency of their forms; the first 200 are admitted to a noun layer."""
    l = lex(spark, d).select("word", log_unscale(_c("log_freq")).cast("bigint").alias("log_freq"))
    return G.lexeme_ranks(lexemes(spark, d), l).withColumn("admitted", _c("rank") <= 200)


def _scores(spark, d, l, verbs, nouns, learnt, tokens, pairs, mode="layered"):
    """One row: mean units per token, words without units, and per family of pairs the mean Jaccard of units and the ideal."""
    words = materialize(tokens.select("word").union(pairs.select(_c("a").alias("word"))).union(pairs.select(_c("b").alias("word"))).union(l.select("word")).distinct(), "words")
    seg = materialize(G.segment(words, l, verbs, learnt, nouns, mode), "units")
    per = tokens.join(seg, "word", "left").agg((F.sum(F.col("cnt") * F.size("units")) / F.sum("cnt")).alias("mean_units"), F.count_if(F.coalesce(F.size("units"), F.lit(0)) < 1).alias("uncovered"))
    bare = verbs.select("word", F.array(F.concat(F.lit("L:"), "lemma"), F.concat(F.lit("F:"), "features")).alias("u"))
    if nouns is not None:
        bare = bare.unionByName(nouns.join(verbs.select("word"), "word", "left_anti").select("word", F.array(F.concat(F.lit("N:"), "lemma"), F.concat(F.lit("G:"), "features")).alias("u")))
    bare = materialize(bare, "bare")
    # A perfect analysis: the longest prefix whose rest has one, else the word's own.
    ideal = G.peeled(words, bare.select("word")).join(bare.withColumnRenamed("word", "rest"), "rest").select("word", F.when(_c("prefix") == "", _c("u")).otherwise(F.concat(F.array(F.concat(F.lit("P:"), "prefix")), "u")).alias("ideal"))
    both = seg.join(ideal, "word", "left")
    side = lambda x: both.select(_c("word").alias(x), _c("units").alias(f"u{x}"), _c("ideal").alias(f"i{x}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b").select("family", jaccard(_c("ua"), _c("ub")).alias("j"), F.when(_c("ia").isNotNull() & _c("ib").isNotNull(), jaccard(_c("ia"), _c("ib"))).alias("i"))
    fam = j.agg(*(F.avg(F.when(_c("family") == f, _c(x))).alias(f"{f}_{y}") for f in ("lexeme", "twin") for x, y in (("j", "jaccard"), ("i", "ideal"))))
    return per.join(F.broadcast(fam))  # one row each


def sweep(spark, d, arms, base_merges: int = 40):
    """One row per arm (name, slots, budget, mode): units under a budget that given units share with subwords.

    ``slots`` None admits every lexeme, 0 none. What given units take of an arm's ``budget`` (units beyond the layers without
    nouns) its subword merges lose. An arm is adopted if it covers all words, stays within its budget, needs no more units
    a token than the first arm, keeps four fifths of the ideal likeness within lexemes and the first arm's of vowel twins.
    """
    l, verbs = lex(spark, d), materialize(paradigms(spark, d, False), "verbs")
    tokens = materialize(T.counted(toks(spark, d)), "tokens")
    nouns_all = materialize(paradigms(spark, d, True), "nouns")
    forms = nouns_all.select(_c("lemma").alias("lexeme"), "word")
    ranks = materialize(G.lexeme_ranks(forms, l.select("word", log_unscale(_c("log_freq")).cast("bigint").alias("log_freq"))), "ranks")
    known = small(l.select("word"))
    inside = forms.join(known, "word", "left_semi").distinct()
    from pyspark.sql import Window

    nxt = inside.withColumn("b", F.lead("word").over(Window.partitionBy("lexeme").orderBy("word"))).filter("b IS NOT NULL").select(F.lit("lexeme").alias("family"), _c("word").alias("a"), "b")
    pairs = materialize(nxt.unionByName(L.dropped_twins(l).select(F.lit("twin").alias("family"), _c("word").alias("a"), _c("twin").alias("b"))), "pairs")
    rows = []
    trained: dict = {}  # arms that differ in their mode only share their merges
    for name, slots, budget, mode in arms:
        nouns = None
        fixed = 0
        if slots != 0:
            admitted = ranks.filter(_c("rank") <= slots) if slots is not None else ranks
            nouns = materialize(nouns_all.join(small(admitted.select(_c("lexeme").alias("lemma"))), "lemma", "left_semi").select("word", "lemma", "features"), "admitted")
            n = nouns.agg(F.countDistinct("lemma").alias("lemmas"), F.countDistinct("features").alias("features")).first()
            fixed = n.lemmas + n.features
        merges = max(0, base_merges + budget - fixed)
        given = verbs.select("word") if nouns is None else verbs.select("word").union(nouns.select("word"))
        if (slots, merges) not in trained:
            trained[slots, merges] = G.learn_merges(G.residual(counts_of(l), given), merges) if merges else []
        learnt = trained[slots, merges]
        s = _scores(spark, d, l, verbs, nouns, learnt, tokens, pairs, mode)
        rows.append(s.select(F.lit(name).alias("arm"), F.lit(-1 if slots is None else slots).alias("slots"), F.lit(budget).alias("budget"), F.lit(mode).alias("mode"), F.lit(fixed).alias("noun_units"), F.lit(len(learnt)).alias("merges"), F.lit(fixed + len(learnt) <= base_merges + budget).alias("within"), "*"))
    table_ = materialize(reduce(lambda a, b: a.unionByName(b), rows), "sweep")
    base = table_.filter(_c("arm") == arms[0][0]).select(_c("mean_units").alias("_u"), F.coalesce("twin_jaccard", F.lit(0.0)).alias("_t"))
    ok = (_c("uncovered") == 0) & _c("within") & (_c("mean_units") <= _c("_u") + 1e-9) & (F.coalesce(F.try_divide("lexeme_jaccard", "lexeme_ideal"), F.lit(0.0)) >= 0.8) & (F.coalesce("twin_jaccard", F.lit(0.0)) >= _c("_t") - 1e-9)
    r = lambda c: F.round(c, 6).alias(c)
    out = table_.join(F.broadcast(base)).withColumn("adopted", ok & (_c("arm") != arms[0][0]))
    return out.select("arm", "slots", "budget", "mode", "noun_units", "merges", "uncovered", r("mean_units"), r("lexeme_jaccard"), r("lexeme_ideal"), r("twin_jaccard"), "adopted")


@query()
def q_evl27_slot_sweep(spark, d):
    """A noun layer of no, few and more lexemes under one budget."""
    return sweep(spark, d, [("none", 0, 0, "layered"), ("few", 5, 0, "layered"), ("more", 20, 0, "layered")])


@query()
def q_evl27_budget_sweep(spark, d):
    """All lexemes under growing budgets, in both modes, against no noun layer."""
    return sweep(spark, d, [("none", 0, 0, "layered"), *((f"all-{b}-{m}", None, b, m) for b in (60, 100) for m in ("layered", "shortest"))])
