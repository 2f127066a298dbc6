"""Queries of corpus filters, error injection, accuracy cells, sweeps and label batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.operators import lookup as L
from wordloom.operators import windows as W
from wordloom.plans import evaluate as E
from wordloom.plans import rank as R
from wordloom.plans import tables as T
from wordloom.profiles import HEBREW
from wordloom.queries.aggs import blended
from wordloom.queries.common import BI, IDS, TOK, bi, docs, lex, log_sql, sents, toks
from wordloom.queries.joins import _BUCKETS, _PREFIX, _STEMS, _SWAP, buckets, two_sql
from wordloom.queries.models import _EVID, evidence
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


_LINES = "ln AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents), lt AS (SELECT *, regexp_extract_all(line, '[א-ת]+') AS a FROM ln)"


def _lines(spark, d):
    return docs(spark, d).select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("ln", "line")).withColumn("a", X.tokens(_c("line")))


@query(f"""WITH {_LINES}, u AS (SELECT doc_id, ln, unnest(a) AS t FROM lt WHERE source = 'subtitles' AND len(a) >= 4), g AS (SELECT doc_id, ln, count(*) AS n, max(length(t)) AS longest, count(*) FILTER (t IN (SELECT word FROM lexicon)) AS known FROM u GROUP BY 1, 2)
  SELECT doc_id, ln, n FROM g WHERE longest <= 12 AND known >= 0.75 * n""")
def q_evl1_line_filter(spark, d):
    """Lines of four or more tokens, none over 12 letters, three quarters of them known."""
    u = _lines(spark, d).filter("source = 'subtitles' AND size(a) >= 4").select("doc_id", "ln", F.explode("a").alias("t"))
    known = small(lex(spark, d).select(_c("word").alias("w")))
    g = u.join(known, _c("t") == _c("w"), "left").groupBy("doc_id", "ln").agg(F.count("*").alias("n"), F.max(F.length("t")).alias("longest"), F.count("w").alias("known"))
    return g.filter("longest <= 12 AND known >= 0.75 * n").select("doc_id", "ln", "n")


@query(f"WITH {_LINES} SELECT doc_id, ln, line AS raw, array_to_string(a, ' ') AS filtered FROM lt WHERE source = 'typed_comments' AND len(a) >= 4 AND list_max(list_transform(a, lambda t: length(t))) <= 12")
def q_evl2_evl3_arms(spark, d):
    """Two arms of the same rows: the text as typed and its tokens."""
    ok = _lines(spark, d).filter("source = 'typed_comments' AND size(a) >= 4").filter(F.array_max(F.transform("a", F.length)) <= 12)
    return ok.select("doc_id", "ln", _c("line").alias("raw"), F.array_join("a", " ").alias("filtered"))


def _h(n, *parts):
    return "(('0x' || substr(sha256('golden:' || " + " || ':' || ".join(parts) + f"), 1, 15))::BIGINT % {n})"


_TRY = f"""w AS (SELECT DISTINCT token AS word FROM tok SEMI JOIN lexicon ON word = token WHERE length(token) >= 4), t AS (SELECT word, k AS attempt, {_h(4, 'word', 'k', "'op'")} AS op, {_h('length(word)', 'word', 'k', "'at'")} AS i0, substr('{HEBREW.alphabet}', {_h(27, 'word', 'k', "'letter'")} + 1, 1) AS letter FROM w, range(1, 41) r(k)),
  c AS (SELECT word, attempt, CASE op WHEN 0 THEN substr(word, 1, i0) || letter || substr(word, i0 + 1) WHEN 1 THEN substr(word, 1, i0) || substr(word, i0 + 2) WHEN 2 THEN substr(word, 1, i0) || letter || substr(word, i0 + 2)
    ELSE substr(word, 1, least(i0, length(word) - 2)) || substr(word, least(i0, length(word) - 2) + 2, 1) || substr(word, least(i0, length(word) - 2) + 1, 1) || substr(word, least(i0, length(word) - 2) + 3) END AS typo FROM t),
  gold AS (SELECT min_by(typo, attempt) AS typo, word AS expected, min(attempt) AS attempts FROM c WHERE typo <> word AND typo NOT IN (SELECT word FROM lexicon) GROUP BY word)"""


def _known_words(spark, d):
    return toks(spark, d).select(_c("token").alias("word")).distinct().join(small(lex(spark, d).select("word")), "word", "left_semi")


@query(f"WITH {TOK}, {_TRY} SELECT * FROM gold")
def q_evl4_evl6_golden(spark, d):
    return E.golden(_known_words(spark, d), lex(spark, d), "golden")


@query()
def q_evl5_golden_adjacent(spark, d):
    return E.golden(_known_words(spark, d), lex(spark, d), "slips", E.slipped)


@query(f"""WITH {IDS} (SELECT 'known' AS control, token AS word FROM (SELECT DISTINCT token FROM ids WHERE id IS NOT NULL) ORDER BY sha256('controls:' || token), token LIMIT 400) UNION ALL (SELECT 'raw', token FROM (SELECT DISTINCT token FROM ids) ORDER BY sha256('controls:' || token), token LIMIT 400)""")
def q_evl7_controls(spark, d):
    """A sampling operator: the 400 least digests of known words and of all words."""
    from wordloom.functions.hashing import order_key

    w = toks(spark, d).select(_c("token").alias("word")).distinct()
    least = lambda df, name: df.orderBy(order_key("controls", _c("word")), "word").limit(400).select(F.lit(name).alias("control"), "word")
    return least(_known_words(spark, d), "known").unionByName(least(w, "raw"))


@query(f"""WITH {BI}, {_EVID} SELECT doc_id, sent_id, pos, token AS original, variant AS injected, variant_freq FROM ev WHERE context > 0""")
def q_evl8_injections(spark, d):
    return evidence(spark, d).filter("context > 0").select("doc_id", "sent_id", "pos", _c("token").alias("original"), _c("variant").alias("injected"), "variant_freq")


@query(f"WITH {IDS}, s AS (SELECT doc_id, sent_id, pos, id, lag(id) OVER w AS p, lead(id) OVER w AS n, length(token) AS l FROM ids WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY pos)) SELECT doc_id, sent_id, pos FROM s WHERE id IS NOT NULL AND l >= 2 AND p IS NOT NULL AND n IS NOT NULL")
def q_evl9_clean_sites(spark, d):
    return R.sites(sents(spark, d), lex(spark, d)).filter("prev IS NOT NULL AND next IS NOT NULL").select("doc_id", "sent_id", "pos")


#: bad1(t): golden typos that aren't valid by a prefix either; two(t, word, cost) their candidates.
_GOLD2 = f"""{_TRY}, {_PREFIX}, vt AS (SELECT DISTINCT typo FROM gold JOIN prefixes ON starts_with(typo, prefix) WHERE length(typo) >= length(prefix) + 4 AND substr(typo, length(prefix) + 1) IN (SELECT word FROM lexicon)),
  bad1 AS (SELECT DISTINCT typo AS t FROM gold WHERE length(typo) >= 3 AND typo NOT IN (SELECT typo FROM vt)), {two_sql('bad1')},
  rk AS (SELECT t, word, cost, log_freq, row_number() OVER w AS rank, lead(cost) OVER w AS nxt FROM two JOIN lexicon USING (word) WINDOW w AS (PARTITION BY t ORDER BY cost, log_freq DESC, word_id))"""


@query(f"""WITH {TOK}, {_GOLD2}, au AS (SELECT t, word FROM rk WHERE rank = 1 AND cost <= 100 AND log_freq > 0 AND (nxt IS NULL OR nxt > cost)), h AS (SELECT t, list(word) FILTER (rank <= 3) AS ws, max(word) FILTER (rank = 1) AS w1 FROM rk GROUP BY 1)
  SELECT count(*) AS attempts, count(*) FILTER (w1 = expected) AS top1, count(*) FILTER (list_contains(ws, expected)) AS top3, count(*) FILTER (h.t IS NULL) AS "none", count(h.t) AS offered, count(*) FILTER (au.word = expected) AS auto_right, count(*) FILTER (au.word <> expected) AS auto_wrong FROM gold LEFT JOIN h ON h.t = typo LEFT JOIN au ON au.t = typo""")
def q_evl10_agg16_correction(spark, d):
    """Accuracy of the corrections of injected typos, within two edits, offered and unasked."""
    g = materialize(E.golden(_known_words(spark, d), lex(spark, d), "golden"), "golden")
    cand = materialize(R.candidates(g.select(_c("typo").alias("typed")), lex(spark, d)), "candidates")
    return E.accuracy(g, R.suggestions(cand), R.auto_replaced(cand))


@query(f"""WITH {TOK}, {_STEMS}, oov AS (SELECT DISTINCT token AS t FROM tok ANTI JOIN lexicon ON word = token), bad0 AS (SELECT t FROM oov WHERE length(t) >= 3 AND t NOT IN (SELECT word FROM stems)), {two_sql('bad0')},
  rk AS (SELECT t, word, cost, log_freq, row_number() OVER w AS rank, lead(cost) OVER w AS nxt FROM two JOIN lexicon USING (word) WINDOW w AS (PARTITION BY t ORDER BY cost, log_freq DESC, word_id))
  SELECT (SELECT count(*) FROM oov) AS words, count(*) FILTER (rank = 1 AND cost <= 100 AND log_freq > 0 AND (nxt IS NULL OR nxt > cost)) AS replaced, count(DISTINCT t) AS offered FROM rk""")
def q_evl11_false_replacements(spark, d):
    """How many unknown words of the corpus would be replaced unasked, or offered anything."""
    oov = materialize(toks(spark, d).select(_c("token").alias("typed")).distinct().join(small(lex(spark, d).select(_c("word").alias("typed"))), "typed", "left_anti"), "unknown")
    cand = materialize(R.candidates(oov, lex(spark, d)), "oov")
    auto, any_ = R.auto_replaced(cand).select("typed", F.lit(True).alias("auto")), cand.select("typed").distinct().withColumn("any", F.lit(True))
    return oov.join(auto, "typed", "left").join(any_, "typed", "left").agg(F.count("*").alias("words"), F.count("auto").alias("replaced"), F.count("any").alias("offered"))


WEIGHTS = (0.0, 25.0, 50.0, 75.0, 100.0, 150.0, 300.0, 400.0, 600.0)
#: (adjacent substitution, transposition, weights of frequency) of the sweep of costs, in hundredths of an edit.
COSTS = ((80, 100, (0.0, 50.0, 100.0)), (60, 100, (0.0, 50.0, 100.0, 300.0, 400.0)), (40, 100, (0.0, 300.0, 400.0)), (60, 80, (100.0,)), (60, 60, (100.0,)))


def _swept(g, cand, arms):
    """Accuracy by arm of (typed, word, log_freq, word_id, arm, score): candidates are sought once, and only ordered anew."""
    top = R.top(cand, ["arm", "typed"], [_c("score"), F.desc("log_freq"), _c("word_id")], 3)
    j = top.join(g, _c("typed") == _c("typo"))
    hits = j.groupBy("arm").agg(F.count_if((_c("rank") == 1) & (_c("word") == _c("expected"))).alias("top1"), F.count_if(_c("word") == _c("expected")).alias("top3"))
    return small(arms).join(hits, "arm", "left").fillna(0, ["top1", "top3"]).join(F.broadcast(g.agg(F.count("*").alias("attempts"))))


@query(f"""WITH {TOK}, {_GOLD2}, s AS (SELECT w, t, word, row_number() OVER (PARTITION BY w, t ORDER BY cost - w * log_freq / 255.0::DOUBLE, log_freq DESC, word_id) AS rank FROM two JOIN lexicon USING (word), (VALUES {", ".join(f"({w}::DOUBLE)" for w in WEIGHTS)}) v(w) QUALIFY rank <= 3)
  SELECT w AS arm, count(*) FILTER (rank = 1 AND word = expected) AS top1, count(*) FILTER (word = expected) AS top3, (SELECT count(*) FROM gold) AS attempts FROM s JOIN gold ON typo = t GROUP BY 1""")
def q_evl12_weight_sweep(spark, d):
    """Accuracy by weight of frequency."""
    g = materialize(E.golden(_known_words(spark, d), lex(spark, d), "golden"), "golden")
    cand = R.candidates(g.select(_c("typo").alias("typed")), lex(spark, d)).select("*", F.explode(F.array(*map(F.lit, WEIGHTS))).alias("arm"))
    arms = spark.createDataFrame([(w,) for w in WEIGHTS], "arm double")
    return _swept(g, cand.withColumn("score", _c("cost") - _c("arm") * _c("log_freq") / 255.0), arms)


@query()
def q_evl12_cost_sweep(spark, d):
    """Accuracy by costs of neighbouring keys and swaps and weight of frequency, reordering what was found at neutral costs."""
    from wordloom.functions.similarity import adjacency_map, osa

    g = materialize(E.golden(_known_words(spark, d), lex(spark, d), "golden"), "golden")
    cand = R.candidates(g.select(_c("typo").alias("typed")), lex(spark, d))
    by = F.array(*(F.struct(osa(_c("typed"), _c("word"), adjacency_map(HEBREW), a, t).alias("cost"), F.array(*(F.struct(F.lit(f"adjacent {a}, swap {t}, frequency {w:g}").alias("arm"), F.lit(w).alias("w")) for w in ws)).alias("ws")) for a, t, ws in COSTS))
    rows = cand.drop("cost").select("*", F.explode(by).alias("m")).select("*", "m.cost", F.explode("m.ws").alias("x")).select("typed", "word", "word_id", "log_freq", "cost", "x.*")
    arms = spark.createDataFrame([(f"adjacent {a}, swap {t}, frequency {w:g}",) for a, t, ws in COSTS for w in ws], "arm string")
    return _swept(g, rows.withColumn("score", _c("cost") - _c("w") * _c("log_freq") / 255.0), arms)


_ATT = """tgt AS (SELECT doc_id, sent_id, pos, token, lag(id) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS prev FROM ids), t3 AS (SELECT * FROM tgt WHERE length(token) >= 3 AND pos >= 1),
  att AS (SELECT k, t3.*, substr(token, 1, k) AS prefix FROM t3, (VALUES (0), (1), (2), (3)) v(k) WHERE length(token) > k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, sent_id, pos) <= 20000),
  heads AS (SELECT k, substr(word, 1, k) AS prefix, word_id, word, log_freq FROM lexicon, (VALUES (1), (2), (3)) v(k) WHERE length(word) >= k QUALIFY row_number() OVER (PARTITION BY substr(word, 1, k) ORDER BY log_freq DESC, word_id) <= 24), asked AS (SELECT DISTINCT k, prefix, prev FROM att)"""


def _cells_sql(name: str, counts: str, weight: float) -> str:
    """name(k, attempts, offered, top1, top3) with the pair table ``counts`` (first_id, second_id, cnt, log_count)."""
    return f"""{name}_c AS (SELECT c.k, c.prefix, c.prev, word, row_number() OVER (PARTITION BY c.k, c.prefix, c.prev ORDER BY log_freq + {weight}::DOUBLE * coalesce(log_count, 0) DESC, log_freq DESC, h.word_id) AS rank FROM asked c JOIN heads h ON h.prefix = c.prefix AND h.word <> c.prefix LEFT JOIN {counts} b ON b.first_id = prev AND b.second_id = h.word_id WHERE c.k > 0 QUALIFY rank <= 3
    UNION ALL SELECT 0, '', first_id, word, row_number() OVER (PARTITION BY first_id ORDER BY log_count DESC, second_id) AS rank FROM (SELECT * FROM {counts} QUALIFY row_number() OVER (PARTITION BY first_id ORDER BY cnt DESC, second_id) <= 16) JOIN lexicon ON word_id = second_id QUALIFY rank <= 3),
  {name}_o AS (SELECT DISTINCT k, prefix, coalesce(prev, -1) AS p FROM {name}_c),
  {name} AS (SELECT a.k, count(*) AS attempts, count(o.k) AS offered, count(*) FILTER (rank = 1) AS top1, count(rank) AS top3 FROM att a LEFT JOIN {name}_c c ON c.k = a.k AND c.prefix = a.prefix AND c.prev IS NOT DISTINCT FROM a.prev AND c.word = a.token LEFT JOIN {name}_o o ON o.k = a.k AND o.prefix = a.prefix AND o.p = coalesce(a.prev, -1) GROUP BY 1)"""


def attempts(spark, d):
    """Targets of three or more letters after a first word, once per number of letters typed (none to three); the first 20,000 of
    each number in corpus order, which is how the cells are defined."""
    t = T.neighbours(sents(spark, d)).filter("length(token) >= 3 AND pos >= 1").select("doc_id", "sent_id", "pos", "token", "w-1", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    a = W.first_of_each(t.filter(F.length("token") > _c("k")), "k", ["doc_id", "sent_id", "pos"], 20_000)
    return L.ids(a.withColumn("w", _c("w-1")), lex(spark, d), "w", "prev").drop("w", "w-1").withColumn("prefix", F.expr("substring(token, 1, k)"))


def engine(spark, d, counts, weight=2.0):
    """A predictor: (prefix, prev, word, rank) of contexts (prefix, prev), by completions or, where nothing is typed, next words."""
    def predict(contexts):
        names = small(lex(spark, d).select(_c("word_id").alias("second_id"), "word"))
        nxt = R.next_words(counts).join(names, "second_id").select(F.lit("").alias("prefix"), _c("first_id").alias("prev"), "word", "rank")
        return R.completions(contexts.filter("prefix <> ''"), lex(spark, d), counts, (1, 2, 3), bigram_weight=weight).select("prefix", "prev", "word", "rank").unionByName(nxt)

    return predict


def cells(asked, predict):
    """(k, attempts, offered, top1, top3) of any predictor over attempts (k, prefix, prev, token)."""
    top = materialize(predict(asked.select("prefix", "prev")), "predicted")
    same = lambda a, b: (a["prefix"] == b["_x"]) & a["prev"].eqNullSafe(b["_y"])
    counts = asked.groupBy("k", "prefix", "prev", "token").agg(F.count("*").alias("n"))
    hits = top.select(_c("prefix").alias("_x"), _c("prev").alias("_y"), "word", "rank")
    j = counts.join(hits, same(counts, hits) & (_c("token") == _c("word")), "left").drop("_x", "_y")
    some = top.select(_c("prefix").alias("_x"), _c("prev").alias("_y"), F.lit(1).alias("some")).distinct()
    j = j.join(some, same(j, some), "left")
    n = lambda ok: F.coalesce(F.sum(F.when(ok, _c("n"))), F.lit(0)).cast("bigint")
    return j.groupBy("k").agg(F.sum("n").alias("attempts"), n(_c("some") == 1).alias("offered"), n(_c("rank") == 1).alias("top1"), n(_c("rank").isNotNull()).alias("top3"))


@query(f"WITH {BI}, {_ATT}, {_cells_sql('x', 'bi', 2.0)} SELECT * FROM x")
def q_evl13_udf4_cells(spark, d):
    return cells(materialize(attempts(spark, d), "attempts"), engine(spark, d, materialize(bi(spark, d), "bi")))


_BW = (0.0, 0.5, 1.0, 2.0, 4.0)


@query(f"WITH {BI}, {_ATT}, {', '.join(_cells_sql(f'x{i}', 'bi', w) for i, w in enumerate(_BW))} {' UNION ALL '.join(f'SELECT *, {w}::DOUBLE AS weight FROM x{i}' for i, w in enumerate(_BW))}")
def q_evl14_bigram_weight_sweep(spark, d):
    counts, asked = materialize(bi(spark, d), "bi"), materialize(attempts(spark, d), "attempts")
    out = None
    for w in _BW:
        cell = cells(asked, engine(spark, d, counts, w)).withColumn("weight", F.lit(w))
        out = cell if out is None else out.unionByName(cell)
    return out


#: Cuts of the pair table: name, least count, most continuations a word (None: all).
CUTS = (("all of 5", 5, None), ("32 of 3", 3, 32), ("8 of 2", 2, 8), ("64 of 5", 5, 64), ("64 of 4", 4, 64))


def _cut_sql(i, least, most):
    return f"cut{i} AS (SELECT first_id, second_id, cnt, {log_sql('cnt')} AS log_count FROM allbi WHERE cnt >= {least}" + (f" QUALIFY row_number() OVER (PARTITION BY first_id ORDER BY cnt DESC, second_id) <= {most})" if most else ")")


@query(f"WITH {BI}, {_ATT}, {', '.join(f'{_cut_sql(i, least, most)}, {_cells_sql(f'x{i}', f'cut{i}', 2.0)}' for i, (_, least, most) in enumerate(CUTS))} " + " UNION ALL ".join(f"SELECT *, '{n}' AS \"table\" FROM x{i}" for i, (n, _, _) in enumerate(CUTS)))
def q_evl16_allocation(spark, d):
    """Cells under five cuts of the pair table."""
    counts, asked = materialize(T.bigrams(sents(spark, d), lex(spark, d)), "all"), materialize(attempts(spark, d), "attempts")
    out = None
    for name, least, most in CUTS:
        kept = T.pruned(counts, least)
        kept = materialize(kept if most is None else T.capped(kept, most).drop("rank"), "cut")
        cell = cells(asked, engine(spark, d, kept)).withColumn("table", F.lit(name))
        out = cell if out is None else out.unionByName(cell)
    return out


MARGINS = (1, 8, 16, 20, 21, 22, 24, 29, 32, 48, 64)


@query(f"""WITH {BI}, {_EVID}, lft AS (SELECT s.doc_id, s.sent_id, s.pos, (prev IS NOT NULL)::INT AS context, coalesce(a.log_count, 0) AS typed_ev, coalesce(c.log_count, 0) AS variant_ev FROM site s JOIN conf USING (id) LEFT JOIN bi a ON a.first_id = prev AND a.second_id = id LEFT JOIN bi c ON c.first_id = prev AND c.second_id = variant_id WHERE length(token) >= 2),
  every AS (SELECT 'both' AS sides, doc_id, sent_id, pos, context, typed_ev, variant_ev FROM ev UNION ALL SELECT 'left', * FROM lft),
  g AS (SELECT sides, z AS zero, m AS margin, doc_id, sent_id, pos FROM every, (VALUES {", ".join(f"({m})" for m in MARGINS)}) v(m), (VALUES (true), (false)) y(z) WHERE context > 0 AND variant_ev - typed_ev >= m AND (NOT z OR typed_ev = 0) GROUP BY ALL)
  SELECT sides, zero, margin, count(*) AS findings, count(DISTINCT doc_id) AS texts FROM g GROUP BY ALL""")
def q_evl17_margin_sweep(spark, d):
    """Findings by margin, with the word before alone or both neighbours, and with or without requiring that nothing speaks for the
    typed word. One pass over the evidence: each site knows the largest margin that it clears."""
    s = R.sites(sents(spark, d), lex(spark, d))
    counts = materialize(bi(spark, d), "bi")
    out = None
    for sides, found in (("both", s), ("left", s.withColumn("next", F.lit(None).cast("int")))):
        ev = R.evidence(found, lex(spark, d), counts).filter("context > 0").groupBy(*R.SITE).agg(F.max(F.when(_c("typed_ev") == 0, _c("variant_ev"))).alias("b1"), F.max(_c("variant_ev") - _c("typed_ev")).alias("b0"))
        over = F.array_compact(F.array(*(F.when(_c(b) >= m, F.struct(F.lit(z).alias("zero"), F.lit(m).alias("margin"))) for b, z in (("b1", True), ("b0", False)) for m in MARGINS)))
        g = ev.select("doc_id", F.explode(over).alias("x")).groupBy("x.zero", "x.margin").agg(F.count("*").alias("findings"), F.countDistinct("doc_id").alias("texts")).withColumn("sides", F.lit(sides))
        out = g if out is None else out.unionByName(g)
    return out


@query()
def q_evl18_wide_configurations(spark, d):
    """Findings per register of five detectors: adjacent words alone, with those at distance two, with frequency, with both, and with
    both and the second next word, which isn't there yet while one types."""
    l, s = lex(spark, d), sents(spark, d)
    counts, skips = materialize(bi(spark, d), "bi"), materialize(T.pruned(T.skipgrams(s, l), 5), "skips")
    sites = R.sites(s, l)
    typed = materialize(R.evidence(sites.withColumn("next2", F.lit(None).cast("int")), l, counts, skips), "typed")
    whole = materialize(R.evidence(sites, l, counts, skips), "whole")
    arms = (("adjacent", typed, 0, 0), ("and distance two", typed, 21, 0), ("and frequency", typed, 0, 104), ("both", typed, 21, 104), ("both, next two known", whole, 21, 104))
    out = None
    for name, ev, skip, prior in arms:
        g = R.detected_wide(ev, skip_margin=skip, prior_margin=prior).groupBy("source").agg(F.count("*").alias("findings")).withColumn("detector", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return out


@query(f"""WITH {BI}, {_EVID}, inj AS (SELECT s.doc_id, s.sent_id, s.pos, v.a || v.b AS pair, variant_id, variant FROM (SELECT DISTINCT doc_id, sent_id, pos, token, variant, variant_id FROM ev WHERE context > 0) s, LATERAL (SELECT x[1] AS a, x[2] AS b FROM (SELECT list_filter(list_zip(string_split(token, ''), string_split(variant, '')), lambda x: x[1] <> x[2])[1] AS x)) v),
  rec AS (SELECT i.pair, (coalesce(a.log_count, 0) + coalesce(b.log_count, 0) = 0 AND coalesce(c.log_count, 0) + coalesce(e.log_count, 0) >= 21) AS flagged FROM inj i JOIN site s USING (doc_id, sent_id, pos) LEFT JOIN bi a ON a.first_id = s.prev AND a.second_id = i.variant_id LEFT JOIN bi b ON b.first_id = i.variant_id AND b.second_id = s.next LEFT JOIN bi c ON c.first_id = s.prev AND c.second_id = s.id LEFT JOIN bi e ON e.first_id = s.id AND e.second_id = s.next)
  SELECT pair, count(*) AS injected, count(*) FILTER (flagged) AS recalled FROM rec GROUP BY ROLLUP (pair)""")
def q_agg17_recall(spark, d):
    """Recall of injected confusions, by letter pair and in all: the roles of typed word and variant are exchanged."""
    ev = evidence(spark, d).filter("context > 0").withColumn("x", X.difference(_c("token"), _c("variant")))
    flagged = (_c("variant_ev") == 0) & (_c("typed_ev") >= 21)
    return ev.withColumn("pair", F.concat("x.a", "x.b")).rollup("pair").agg(F.count("*").alias("injected"), F.count_if(flagged).alias("recalled"))


@query(f"WITH {BI}, {_EVID}, p AS (SELECT doc_id, sent_id, pos, max(typed_ev) AS t, max(variant_ev) AS v FROM ev GROUP BY 1, 2, 3) SELECT count(*) AS positions, count(*) FILTER (t = 0 AND v = 0) AS blind, count(*) FILTER (t = 0) AS unseen FROM p")
def q_agg18_agg19_blindness(spark, d):
    p = evidence(spark, d).groupBy(*R.SITE).agg(F.max("typed_ev").alias("t"), F.max("variant_ev").alias("v"))
    return p.agg(F.count("*").alias("positions"), F.count_if((_c("t") == 0) & (_c("v") == 0)).alias("blind"), F.count_if(_c("t") == 0).alias("unseen"))


@query()
def q_evl18_evl29_blend_verdict(spark, d):
    """Findings per register with the pair table of the other registers alone and with the subtitles blended in."""
    l, s = lex(spark, d), sents(spark, d)
    alone = materialize(T.pruned(T.bigrams(s.filter("source <> 'subtitles'"), l), 2), "alone")
    mixed = materialize(T.pruned(blended(spark, d), 2), "mixed")
    out = None
    for name, counts in (("alone", alone), ("blended", mixed)):
        found = R.detected_wide(evidence(spark, d, counts)).groupBy("source", "path").agg(F.count("*").alias("findings")).withColumn("table", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


@query()
def q_evl19_rnd6_bootstrap(spark, d):
    """Share of unknown tokens with an interval over resampled texts."""
    ids = L.ids(toks(spark, d), lex(spark, d))
    return E.bootstrap(ids, "doc_id", _c("id").isNull())


@query(f"""WITH {BI}, {_EVID}, f AS (SELECT doc_id, sent_id, pos FROM ev WHERE context > 0 AND typed_ev = 0 AND variant_ev >= 21 GROUP BY ALL), s AS (SELECT DISTINCT doc_id, sent_id, pos FROM ev)
  SELECT doc_id, sent_id, pos, 'firing' AS kind FROM f UNION ALL SELECT doc_id, sent_id, pos, 'clean' FROM s ANTI JOIN f USING (doc_id, sent_id, pos) WHERE ('0x' || substr(sha256('harvest:' || doc_id || ':' || sent_id || ':' || pos), 1, 15))::BIGINT % 97 = 0""")
def q_evl23_harvest(spark, d):
    """Firings, and of the other sites one in 97 by hash: a sampling operator that doesn't depend on row order."""
    from wordloom.functions.hashing import below

    ev = materialize(evidence(spark, d).select(*R.SITE, "context", "typed_ev", "variant_ev"), "evidence")
    f = ev.filter("context > 0 AND typed_ev = 0 AND variant_ev >= 21").select(*R.SITE).distinct()
    clean = ev.select(*R.SITE).distinct().join(f, R.SITE, "left_anti").filter(below(97, "harvest", *map(_c, R.SITE)) == 0)
    return f.withColumn("kind", F.lit("firing")).unionByName(clean.withColumn("kind", F.lit("clean")))


@query("""WITH p AS (SELECT source_id, min(lower(trim(split_part(stratum, ':', 1)))) AS stratum FROM label_keys WHERE source_id IS NOT NULL AND stratum IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('next:' || source_id), source_id) AS k FROM p WHERE stratum IN ('real', 'injected', 'clean')),
  q AS (SELECT *, row_number() OVER (ORDER BY sha256('next-deal:' || source_id), source_id) AS seq FROM r WHERE k <= CASE stratum WHEN 'real' THEN 80 ELSE 10 END) SELECT 'next-' || lpad(seq::VARCHAR, 3, '0') AS id, source_id, stratum, seq, ('0x' || substr(sha256('next-flip:' || source_id), 1, 15))::BIGINT % 2 = 0 AS flipped FROM q""")
def q_evl24_snk6_batch(spark, d):
    p = table(spark, d, "label_keys", "source_id", "stratum").filter("source_id IS NOT NULL AND stratum IS NOT NULL").groupBy("source_id").agg(F.min(F.lower(F.trim(F.substring_index("stratum", ":", 1)))).alias("stratum"))
    return E.batch(p, {"real": 80, "injected": 10, "clean": 10}, "next")


_SCORE = """g AS (SELECT batch_id, count(*) FILTER (stratum IN ('injected', 'clean')) AS controls, count(*) FILTER ((stratum = 'injected' AND choice = other_option) OR (stratum = 'clean' AND (choice = text_option OR choice = 3))) AS "right", count(*) FILTER (stratum = 'real') AS real, count(*) FILTER (stratum = 'real' AND bucket = 'suggestion') AS suggestion, count(*) FILTER (stratum = 'real' AND bucket IN ('both', 'unclear')) AS abstained FROM b GROUP BY 1),
  w AS (SELECT *, real - abstained AS n, suggestion / nullif(real - abstained, 0) AS p FROM g), x AS (SELECT *, coalesce(greatest(0, ((p + 1.9208 / n) - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n::DOUBLE * n))) / (1 + 3.8416 / n)), 0) AS lo, coalesce(least(1, ((p + 1.9208 / n) + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n::DOUBLE * n))) / (1 + 3.8416 / n)), 0) AS hi FROM w)
  SELECT batch_id, controls, "right", real, suggestion, abstained, CASE WHEN controls > 0 AND "right" < ceil(controls * 0.9) THEN 'VOID' WHEN real = 0 THEN 'NOT-MEASURED' WHEN abstained > real * 0.3 THEN 'NOT-DECIDABLE' WHEN lo >= 0.6 THEN 'SHIP' WHEN hi < 0.4 THEN 'WITHDRAW' ELSE 'NOISE' END AS verdict FROM x"""


@query(f"WITH {_BUCKETS.replace('SELECT k.*, CASE', 'SELECT k.*, choice, CASE')}, {_SCORE}")
def q_evl25_verdict(spark, d):
    return E.scored(buckets(spark, d))


@query("SELECT * FROM (VALUES ('agrees', 'SHIP'), ('disagrees', 'WITHDRAW'), ('unsure', 'NOT-DECIDABLE'), ('random', 'VOID')) v(labeller, verdict)")
def q_evl26_synthetic_labellers(spark, d):
    """Control: four kinds of labellers on all items must come out as they are."""
    items = buckets(spark, d).filter("stratum IN ('real', 'injected', 'clean')").drop("choice", "bucket", "batch_id")
    out = None
    for kind in ("agrees", "disagrees", "unsure", "random"):
        a = E.labeller(items, kind)
        bucket = F.when(_c("choice") == _c("other_option"), "suggestion").when(_c("choice") == _c("text_option"), "text").when(_c("choice") == 3, "both").otherwise("unclear")
        s = E.scored(a.withColumn("batch_id", F.lit(kind)).withColumn("bucket", bucket)).select(_c("batch_id").alias("labeller"), "verdict")
        out = s if out is None else out.unionByName(s)
    return out


@query(f"""WITH {_SWAP}, tw AS (SELECT word, substr(word, 1, i - 1) || substr(word, i + 1) AS twin FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM lexicon) WHERE substr(word, i, 1) IN ('ו', 'י')),
  p AS (SELECT DISTINCT tw.word, twin FROM tw JOIN lexicon l ON l.word = twin), j AS (SELECT list_distinct(string_split(word, '')) AS x, list_distinct(string_split(twin, '')) AS y FROM p) SELECT count(*) AS pairs, round(avg(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))), 6) AS mean FROM j""")
def q_agg29_twin_jaccard(spark, d):
    from wordloom.functions.similarity import jaccard

    t = L.dropped_twins(lex(spark, d))
    return t.agg(F.count("*").alias("pairs"), F.round(F.avg(jaccard(F.array_distinct(F.split("word", "")), F.array_distinct(F.split("twin", "")))), 6).alias("mean"))


@query()
def q_agg35_evl28_str22_bidi(spark, d):
    """Per category of line: how often the two paragraph directions show it differently, and what isolating foreign runs fixes."""
    from wordloom.functions.bidi import visual

    lines = docs(spark, d).select("source", F.explode(F.split("text", "\n", -1)).alias("line")).filter("line <> ''")
    iso = X.isolate_runs(_c("line"))
    v = lines.select("source", visual(_c("line"), F.lit(0)).alias("l"), visual(_c("line"), F.lit(1)).alias("r"), visual(iso, F.lit(0)).alias("il"), visual(iso, F.lit(1)).alias("ir"))
    plain, arm = _c("l") != _c("r"), _c("il") != _c("ir")
    return v.groupBy("source").agg(F.count("*").alias("lines"), F.count_if(plain).alias("diverge"), F.count_if(plain & ~arm).alias("fixed"), F.count_if(~plain & arm).alias("broken"))
