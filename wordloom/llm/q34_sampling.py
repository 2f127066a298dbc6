"""p3 and p4 queries: draws over campaigns, and picks for batches that stay."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.llm import sampling as S
from wordloom.session import table

#: Expected share picked of records of weight 1.
PICK_SHARE = 0.1


def _keys(spark, d):
    return table(spark, d, "label_keys", "campaign", "stratum", "source_id", "path")


def _targets(spark, d):
    return table(spark, d, "sample_targets", "draw_id", "campaign", "sample_size", "stratum", "target_share", "min_rows")


def p3_found(spark, d):
    """Categories that the repaired sample leaves short; those whose records are there, but shared, are told apart by a count."""
    return S.report(_keys(spark, d), _targets(spark, d)).filter("residual_gap > 0").filter("gap > 0").select("draw_id", "stratum")


def p3_report(spark, d):
    return S.report(_keys(spark, d), _targets(spark, d)).drop("share_taken", "share")


def p3_sample(spark, d):
    return S.draw(_keys(spark, d), _targets(spark, d)).withColumnRenamed("id", "source_id")


def p3_margins(spark, d):
    """Shares of each draw's sample over both margins, against the targets: of the categories those of the table, of the paths
    those of the pool."""
    from pyspark.sql import Window

    draws = S.Draws(_keys(spark, d), _targets(spark, d))
    picked = draws.sample().join(draws.draws.select("draw_id", "grp"), "draw_id").join(draws.pool.select("grp", "id", "m0"), ["grp", "id"])
    w = Window.partitionBy("draw_id", "margin")
    both = picked.select("draw_id", F.explode(F.array(F.struct(F.lit("stratum").alias("margin"), F.col("stratum").alias("value")), F.struct(F.lit("path").alias("margin"), F.col("m0").alias("value")))).alias("x")).select("draw_id", "x.*")
    return both.groupBy("draw_id", "margin", "value").agg(F.count("*").alias("taken")).withColumn("share", F.round(F.col("taken") / F.sum("taken").over(w), 6))


def p4_picks(spark, d):
    """For every batch and seed the picked source_ids of its campaign, with the first wave that they are picked in.

    A source's weight in a wave is the number of its distinct items in that wave.
    """
    keys = table(spark, d, "label_keys", "campaign", "batch_id", "seed", "source_id", "wave", "id")
    rows = keys.filter("source_id IS NOT NULL AND campaign IS NOT NULL").groupBy("campaign", "source_id", "wave").agg(F.countDistinct("id").alias("items"))
    weighted = S.running_weights(rows.withColumn("k", F.struct("campaign", "source_id")), "k", "wave", F.col("items"))
    weighted = weighted.select(F.col("id.campaign").alias("campaign"), F.col("id.source_id").alias("id"), "wave", "weight")
    batches = keys.select("campaign", "batch_id", "seed").filter("seed IS NOT NULL").distinct()
    picked = S.poisson(batches.join(weighted, "campaign"), F.col("seed"), PICK_SHARE)
    return picked.groupBy("batch_id", "seed", F.col("id").alias("source_id")).agg(F.min("wave").alias("wave"), F.max("weight").alias("weight"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_sample": p3_sample, "p3_margins": p3_margins, "p4_picks": p4_picks}
_STRATUM = "lower(regexp_replace(split_part({}, ':', 1), '^\\s+|\\s+$', '', 'g'))"
SQL = {
    "p3_found": f"""WITH have AS (SELECT campaign, {_STRATUM.format('stratum')} AS s, count(DISTINCT source_id) AS n FROM label_keys GROUP BY 1, 2)
      SELECT DISTINCT draw_id, t.stratum FROM sample_targets t LEFT JOIN have h ON h.campaign = t.campaign AND h.s = {_STRATUM.format('t.stratum')}
      WHERE coalesce(n, 0) < greatest(min_rows, round(target_share * sample_size))""",
    # What the first k categories of a draw, the scarcest first, can have together is the least cut over the sets of them.
    "p3_report": f"""WITH g AS (SELECT DISTINCT draw_id, campaign, stratum, {_STRATUM.format('stratum')} AS s, coalesce(min_rows, 0) AS min_rows, greatest(coalesce(min_rows, 0), round(coalesce(target_share, 0) * coalesce(sample_size, 0)))::BIGINT AS wanted FROM sample_targets),
      rec AS (SELECT campaign, source_id, list(DISTINCT {_STRATUM.format('stratum')}) AS ss FROM label_keys WHERE source_id IS NOT NULL AND stratum IS NOT NULL GROUP BY 1, 2),
      have AS (SELECT campaign, unnest(ss) AS s, count(*) AS n FROM rec GROUP BY 1, 2),
      k AS (SELECT g.*, coalesce(n, 0) AS available, (row_number() OVER (PARTITION BY draw_id ORDER BY coalesce(n, 0), g.s) - 1)::INT AS i FROM g LEFT JOIN have h ON h.campaign = g.campaign AND h.s = g.s),
      sig AS (SELECT draw_id, mask, count(*) AS n FROM (SELECT draw_id, r.source_id, sum(1 << i)::BIGINT AS mask FROM k JOIN rec r ON r.campaign = k.campaign AND list_contains(r.ss, k.s) GROUP BY 1, 2) GROUP BY 1, 2),
      most AS (SELECT draw_id, max(i) AS top FROM k GROUP BY 1), cuts AS (SELECT draw_id, top, unnest(range(0, 1 << (top + 1))) AS t FROM most),
      cover AS (SELECT c.draw_id, t, coalesce((SELECT sum(n) FROM sig s WHERE s.draw_id = c.draw_id AND s.mask & t <> 0), 0) AS n FROM cuts c),
      flow AS (SELECT k.draw_id, k.i, (SELECT min(c.n + coalesce((SELECT sum(wanted) FROM k x WHERE x.draw_id = k.draw_id AND x.i <= k.i AND c.t & (1 << x.i) = 0), 0)) FROM cover c WHERE c.draw_id = k.draw_id AND c.t < 1 << (k.i + 1)) AS f FROM k),
      took AS (SELECT draw_id, i, f - lag(f, 1, 0) OVER (PARTITION BY draw_id ORDER BY i) AS taken FROM flow)
      SELECT draw_id, stratum, min_rows, wanted, available, taken::BIGINT AS taken, greatest(wanted - available, 0) AS gap, greatest(wanted - taken, 0)::BIGINT AS residual_gap FROM k JOIN took USING (draw_id, i)""",
    "p4_picks": f"""WITH waves AS (SELECT campaign, source_id, wave, count(DISTINCT id) AS items FROM label_keys WHERE source_id IS NOT NULL AND campaign IS NOT NULL AND wave IS NOT NULL GROUP BY ALL),
      weighted AS (SELECT campaign, source_id, wave, max(items) OVER (PARTITION BY campaign, source_id ORDER BY wave) AS weight FROM waves),
      batches AS (SELECT DISTINCT campaign, batch_id, seed FROM label_keys WHERE seed IS NOT NULL),
      hashed AS (SELECT batch_id, seed, source_id, wave, weight, ('0x' || substr(md5(seed || ':' || source_id), 1, 13))::BIGINT::DOUBLE / {16**13}.0::DOUBLE AS u FROM batches JOIN weighted USING (campaign))
      SELECT batch_id, seed, source_id, min(wave) AS wave, max(weight)::DOUBLE AS weight FROM hashed WHERE u < weight * 0.1::DOUBLE GROUP BY ALL""",
}
