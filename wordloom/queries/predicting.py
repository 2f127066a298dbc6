"""Queries of whole predictions and of simulated users."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.operators import lookup as L
from wordloom.plans import evaluate as E
from wordloom.plans import learning as Y
from wordloom.plans import rank as R
from wordloom.plans import tables as T
from wordloom.queries.common import IDS, bi, lex, log_sql, sents
from wordloom.queries.evals import _known_words, attempts
from wordloom.queries.joins import abbr
from wordloom.session import materialize, small, table

QUERIES, SQL = {}, {}
_c = F.col
AT = ["doc_id", "sent_id", "pos"]


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def q_mod9_top5_predict(spark, d):
    """What would have been offered at each word of the corpus after its first no, one, two or three letters (its place's
    remainder), the findings of real-word errors included."""
    t = T.neighbours(sents(spark, d), 4).filter("pos >= 1")
    asked = t.select(*AT, F.expr("substring(token, 1, pos % 4)").alias("current"), *(_c(f"w-{k}").alias(f"c{k}") for k in (1, 2, 3, 4)))
    return R.predicted(asked, AT, lex(spark, d), materialize(bi(spark, d), "bi"), abbr(spark, d))


@query()
def q_mod7_known_form(spark, d):
    """A whole abbreviation offers the next words; its letters offer it; each after every word that pairs begin with."""
    a, counts = materialize(abbr(spark, d), "abbr"), materialize(bi(spark, d), "bi")
    first = counts.select(_c("first_id").alias("prev")).distinct()
    typed = a.select(_c("canonical").alias("current")).union(a.select("bare"))
    asked = first.join(small(typed))  # abbreviations are few, and each is asked after each word
    return R.ordinary(asked, lex(spark, d), counts, a)


@query()
def q_evl15_orderings(spark, d):
    """Each order of completions and corrections on two corpora: texts, after one to three letters of a word, and typos, which
    have no word before them."""
    l, counts, a = lex(spark, d), materialize(bi(spark, d), "bi"), materialize(abbr(spark, d), "abbr")
    asked = materialize(attempts(spark, d), "attempts")
    gold = materialize(E.golden(_known_words(spark, d), l, "golden"), "golden")
    asked = asked.filter("k > 0")
    ctx = asked.select(_c("prefix").alias("current"), "prev").union(gold.select("typo", F.lit(None).cast("int")))
    offers = materialize(R.offered(ctx, l, counts, a), "offers")
    out = None
    for mix in ("CORRECTIONS_FIRST", "COMPLETIONS_FIRST", "INTERLEAVED"):
        top = materialize(R.arranged(offers, mix), "ordered").select(_c("current").alias("x"), _c("prev").alias("y"), "word", "rank")
        hit = asked.join(top, (_c("prefix") == _c("x")) & _c("prev").eqNullSafe(_c("y")) & (_c("token") == _c("word")), "left")
        texts = hit.groupBy(F.concat(F.lit("after "), "k").alias("cell")).agg(F.count("*").alias("attempts"), F.count_if(_c("rank") == 1).alias("top1"), F.count("rank").alias("top3"))
        hit = gold.join(top.filter("y IS NULL"), (_c("typo") == _c("x")) & (_c("expected") == _c("word")), "left")
        typos = hit.agg(F.count("*").alias("attempts"), F.count_if(_c("rank") == 1).alias("top1"), F.count("rank").alias("top3")).withColumn("cell", F.lit("typos"))
        both = texts.unionByName(typos).withColumn("policy", F.lit(mix))
        out = both if out is None else out.unionByName(both)
    return out


_USERS = f"""{IDS}, el AS (SELECT doc_id, sent_id, row_number() OVER (ORDER BY doc_id, sent_id) - 1 AS rn FROM toks WHERE len(a) BETWEEN 4 AND 40),
  bl AS (SELECT *, rn // 80 AS block, rn % 80 AS "at", count(*) OVER (PARTITION BY rn // 80) AS size FROM el), us AS (SELECT doc_id, sent_id, block, "at" FROM bl WHERE size = 80 AND block % 2 = 1),
  nb AS (SELECT doc_id, sent_id, pos, id AS f, lead(id) OVER w AS s, lead(pos) OVER w AS np FROM ids WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY pos)),
  pr AS (SELECT block, "at", coalesce(f, -1) AS f, coalesce(s, -1) AS s FROM nb JOIN us USING (doc_id, sent_id) WHERE np IS NOT NULL),
  st0 AS (SELECT f, s, count(*) AS cnt FROM nb ANTI JOIN us USING (doc_id, sent_id) WHERE f IS NOT NULL AND s IS NOT NULL GROUP BY 1, 2), st AS (SELECT *, {log_sql('cnt')} AS lc FROM st0 WHERE cnt >= 5),
  st16 AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY f ORDER BY cnt DESC, s) <= 16)"""


def _arms_sql(arms):
    rows = ", ".join(f"('{a}', {h}, {s}, {w}::DOUBLE)" for a, h, s, w in arms)
    return f"""WITH {_USERS}, arms(arm, history, sessions, weight) AS (VALUES {rows}), rw AS (SELECT * FROM arms, pr),
  ln AS (SELECT arm, block, f, s, weight, count(*) AS cnt FROM rw WHERE "at" < history AND weight > 0 AND f >= 0 GROUP BY arm, block, f, s, weight, sessions HAVING count(DISTINCT "at") >= sessions),
  l16 AS (SELECT *, weight * least({log_sql('cnt')}, 32) AS term FROM ln QUALIFY row_number() OVER (PARTITION BY arm, block, f ORDER BY cnt DESC, s) <= 16),
  ask AS (SELECT * FROM rw WHERE "at" >= history), q AS (SELECT DISTINCT arm, block, f FROM ask WHERE f >= 0),
  cd AS (SELECT arm, block, f, s, sum(x) AS x FROM (SELECT arm, block, q.f, s, lc::DOUBLE AS x FROM q JOIN st16 ON st16.f = q.f UNION ALL SELECT l.arm, l.block, l.f, s, term FROM l16 l SEMI JOIN q ON q.arm = l.arm AND q.block = l.block AND q.f = l.f) WHERE s >= 0 GROUP BY 1, 2, 3, 4),
  rk AS (SELECT arm, block, f, s, row_number() OVER (PARTITION BY arm, block, f ORDER BY x DESC, s) AS rank FROM cd QUALIFY rank <= 3), off AS (SELECT DISTINCT arm, block, f FROM rk)
  SELECT ask.arm, count(*) AS attempts, count(off.f) AS offered, count(*) FILTER (rank = 1) AS top1, count(rank) AS top3 FROM ask LEFT JOIN rk USING (arm, block, f, s) LEFT JOIN off ON off.arm = ask.arm AND off.block = ask.block AND off.f = ask.f GROUP BY 1"""


def _split(spark, d):
    """(positions of the users, pair table of all other sentences)."""
    l, texts = lex(spark, d), table(spark, d, "documents", "doc_id", "source", "text")
    users = Y.user_blocks(T.sentence_tokens(texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id")))
    pairs = materialize(Y.positions(users, l), "users")
    return pairs, materialize(Y.static_table(sents(spark, d), l, pairs), "static")


def _evaluated(spark, d, arms):
    pairs, static = _split(spark, d)
    return Y.evaluated(pairs, spark.createDataFrame(arms, "arm string, history int, sessions int, weight double"), static)


_PLAIN = [("static", 60, 2, 0.0), ("adaptive", 60, 2, 2.0)]


@query(_arms_sql(_PLAIN))
def q_evl20_simulated_users(spark, d):
    """Users of 80 sentences, 60 to learn from: next words by the pair table of all other texts, with and without what was learnt."""
    return _evaluated(spark, d, _PLAIN)


_SWEEP = [
    *((f"weight {w}", 40, 2, w) for w in (0.0, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0)), *((f"sessions {s}", 40, s, 4.0) for s in (1, 2, 3, 5)),
    *((f"history {h}, {n}", h, 2, w) for h in (0, 5, 10, 20, 40, 60) for n, w in (("adaptive", 4.0), ("static", 0.0))),
]


@query(_arms_sql(_SWEEP))
def q_evl21_learning_sweeps(spark, d):
    """By weight of what was learnt, by least number of sessions, and by length of history against the static table."""
    return _evaluated(spark, d, _SWEEP)


_DIR = f"""WITH {_USERS}, tt AS (SELECT * FROM pr WHERE "at" < 40), ask AS (SELECT * FROM pr WHERE "at" >= 40), q AS (SELECT DISTINCT block, f FROM ask),
  g AS (SELECT block, tt.f, tt.s, count(*) AS c1, sum(CASE WHEN lc > 40 THEN 4 ELSE 1 END)::BIGINT AS c4, count(*) FILTER ("at" % 2 = 0) AS cb FROM tt LEFT JOIN st ON st.f = tt.f AND st.s = tt.s GROUP BY 1, 2, 3 HAVING count(DISTINCT "at") >= 2),
  w AS (SELECT block, s, count(*) AS c FROM tt GROUP BY 1, 2 HAVING count(DISTINCT "at") >= 2),
  mine AS (SELECT dir, block, f, s, CASE dir WHEN 'endorsed' THEN c4 ELSE c1 END AS cnt FROM g, (VALUES ('current'), ('word'), ('bucket'), ('endorsed')) v(dir)),
  m16 AS (SELECT *, 2.0::DOUBLE * least({log_sql('cnt')}, 32) AS x FROM mine QUALIFY row_number() OVER (PARTITION BY dir, block, f ORDER BY cnt DESC, s) <= 16),
  cd AS (SELECT dir, block, f, s, sum(x) AS x FROM (SELECT dir, block, q.f, s, lc::DOUBLE AS x FROM q JOIN st16 ON st16.f = q.f, (VALUES ('current'), ('word'), ('bucket'), ('endorsed')) v(dir) UNION ALL SELECT dir, m.block, m.f, s, x FROM m16 m SEMI JOIN q ON q.block = m.block AND q.f = m.f) WHERE s >= 0 GROUP BY 1, 2, 3, 4),
  sc AS (SELECT cd.dir, cd.block, cd.f, cd.s, x + CASE dir WHEN 'word' THEN coalesce(2.0::DOUBLE * least({log_sql('w.c')}, 32), 0) WHEN 'bucket' THEN coalesce(CASE WHEN g.cb > 0 THEN 2.0::DOUBLE * least({log_sql('g.cb')}, 32) END, 0) ELSE 0 END AS x
    FROM cd LEFT JOIN w ON w.block = cd.block AND w.s = cd.s LEFT JOIN g ON g.block = cd.block AND g.f = cd.f AND g.s = cd.s),
  rk AS (SELECT dir, block, f, s, row_number() OVER (PARTITION BY dir, block, f ORDER BY x DESC, s) AS rank FROM sc QUALIFY rank <= 3), off AS (SELECT DISTINCT dir, block, f FROM rk), every AS (SELECT dir, ask.* FROM ask, (VALUES ('current'), ('word'), ('bucket'), ('endorsed')) v(dir))
  SELECT e.dir AS direction, count(*) AS attempts, count(off.f) AS offered, count(*) FILTER (rank = 1) AS top1, count(rank) AS top3 FROM every e LEFT JOIN rk USING (dir, block, f, s) LEFT JOIN off ON off.dir = e.dir AND off.block = e.block AND off.f = e.f GROUP BY 1"""


@query(_DIR)
def q_evl22_learning_directions(spark, d):
    """Four ways to learn, each against the same pairs alone."""
    pairs, static = _split(spark, d)
    return Y.directions(pairs, static)


@query(f"WITH {_USERS}, h AS (SELECT t.token, t.id FROM us JOIN ids t USING (doc_id, sent_id) WHERE \"at\" < 40) SELECT count(*) AS occurrences, count(DISTINCT token) AS forms FROM h WHERE id IS NULL")
def q_evl22_unknown_words(spark, d):
    """What keying unknown words one by one would add: their occurrences and forms in the histories."""
    users, _ = Y.split_blocks(sents(spark, d))
    t = users.filter("at < 40").select(F.explode("tokens").alias("token"))
    return t.join(small(lex(spark, d).select(_c("word").alias("token"))), "token", "left_anti").agg(F.count("*").alias("occurrences"), F.countDistinct("token").alias("forms"))
