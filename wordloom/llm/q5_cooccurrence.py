"""p5 queries: words seen together."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.llm import cooccurrence as C
from wordloom.session import table


def _log(spark, d):
    return table(spark, d, "pair_log", "obs_id", "session_id", "first_id", "second_id", "cnt")


def p5_found(spark, d):
    return C.above_chance(C.associations(_log(spark, d), min_sessions=5), 20).select("first_id", "second_id")


def p5_pairs(spark, d):
    """Pairs of five or more sessions that are together significantly (p < 0.001) more often than chance."""
    found = C.associations(_log(spark, d), min_sessions=5).filter("lift > 1 AND llr >= 10.83")
    return found.select("first_id", "second_id", "t", "s", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"))


def p5_associations(spark, d):
    """Every pair seen together, however rarely: its count, sessions, lift and log-likelihood ratio, and whether it is
    significantly (p < 0.001) more or less often than chance."""
    found = C.associations(_log(spark, d))
    return found.select("first_id", "second_id", "t", "s", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"), (F.col("llr") >= 10.83).alias("significant"))


QUERIES = {"p5_found": p5_found, "p5_pairs": p5_pairs, "p5_associations": p5_associations}
_SQL = """WITH rows AS (SELECT DISTINCT obs_id, session_id, least(first_id, second_id) AS a, greatest(first_id, second_id) AS b, cnt FROM pair_log
    WHERE first_id >= 0 AND second_id >= 0 AND first_id <> second_id AND cnt > 0),
  pairs AS (SELECT a, b, sum(cnt)::BIGINT AS t, count(DISTINCT session_id) AS s FROM rows GROUP BY 1, 2),
  w AS (SELECT id, sum(t)::BIGINT AS w FROM (SELECT a AS id, t FROM pairs UNION ALL SELECT b, t FROM pairs) GROUP BY 1),
  tot AS (SELECT sum(t)::BIGINT AS n FROM pairs),
  full_ AS (SELECT a AS first_id, b AS second_id, t, s, x.w AS wa, y.w AS wb, n FROM pairs JOIN w x ON x.id = a JOIN w y ON y.id = b, tot WHERE s >= 5)"""
_X = lambda e: f"(CASE WHEN {e} > 0 THEN ({e})::DOUBLE * ln(({e})::DOUBLE) ELSE 0 END)"
_K = ("t", "(wa - t)", "(wb - t)", "greatest(n - wa - wb + t, 0)")
_SUMS = (f"({_K[0]} + {_K[1]})", f"({_K[2]} + {_K[3]})", f"({_K[0]} + {_K[2]})", f"({_K[1]} + {_K[3]})")
_G = f"2 * ({' + '.join(map(_X, _K))} + {_X(' + '.join(_K))} - {' - '.join(map(_X, _SUMS))})"
SQL = {
    "p5_found": f"{_SQL} SELECT first_id, second_id FROM full_ WHERE t::HUGEINT * n >= 20::HUGEINT * wa * wb",
    "p5_associations": f"""{_SQL.replace(" WHERE s >= 5", "")}, g AS (SELECT *, t::DOUBLE * n / (wa::DOUBLE * wb) AS lift, {_G} AS llr FROM full_)
      SELECT first_id, second_id, t, s, round(lift, 6) AS lift, round(greatest(llr, 0), 4) AS llr, greatest(llr, 0) >= 10.83 AS significant FROM g""",
    "p5_pairs": f"""{_SQL}, g AS (SELECT *, t::DOUBLE * n / (wa::DOUBLE * wb) AS lift, {_G} AS llr FROM full_)
      SELECT first_id, second_id, t, s, round(lift, 6) AS lift, round(greatest(llr, 0), 4) AS llr FROM g WHERE lift > 1 AND llr >= 10.83""",
}
