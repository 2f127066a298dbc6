"""Positional operators over ordered rows that don't gather all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import materialize


def numbered(df: DataFrame, order: list[str], name: str = "rn", start: int = 0, amount: Column | None = None, running: str = "before") -> DataFrame:
    """``df`` with each row's place from ``start`` in a global order, and with the sum of ``amount`` over the rows before it.

    The rows are split into ranges of the order, numbered within, and shifted by the totals of the ranges before: a
    global ``row_number`` without a single-task window. ``order`` must be unique for the result to be determined.
    """
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_p").orderBy(*order)
    sums = [F.count("*").alias("_n")] + ([F.sum(amount).alias("_a")] if amount is not None else [])
    per = ranged.groupBy("_p").agg(*sums)
    prior = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: the window and the broadcast are over those.
    before = per.select("_p", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_n0"), *([F.coalesce(F.sum("_a").over(prior), F.lit(0)).alias("_a0")] if amount is not None else []))
    out = ranged.withColumn("_k", F.row_number().over(w))
    if amount is not None:
        out = out.withColumn("_s", F.coalesce(F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(F.broadcast(before), "_p")
    cols = [*df.columns, (F.col("_n0") + F.col("_k") - 1 + start).alias(name)]
    if amount is not None:
        cols.append((F.col("_a0") + F.col("_s")).alias(running))
    return out.select(*cols)


def strided(rows: DataFrame, offset: int, stride: int, most: int, rn: str = "rn") -> DataFrame:
    """Every ``stride``-th row from ``offset``, at most ``most``; ``rn`` counts from 0."""
    k = F.col(rn) - offset
    return rows.filter((k >= 0) & (k % stride == 0) & (k / stride < most))


def held_out(rows: DataFrame, every: int = 20, rn: str = "rn") -> DataFrame:
    """Rows with whether they are held out: every ``every``-th one, counted from 0."""
    return rows.withColumn("held_out", F.col(rn) % every == 0)


def blocks(rows: DataFrame, size: int, most: int, rn: str = "rn") -> DataFrame:
    """Rows with their block of ``size`` consecutive ones; a partial last block and blocks beyond ``most`` are left out. Even
    blocks are for development, odd ones for test."""
    out = rows.withColumn("block", F.floor(F.col(rn) / size).cast("int")).filter(F.col("block") < most)
    whole = out.groupBy("block").agg(F.count("*").alias("_n")).filter(F.col("_n") == size).select("block")
    return out.join(whole, "block", "left_semi").withColumn("split", F.when(F.col("block") % 2 == 0, "dev").otherwise("test"))


def first_of_each(df: DataFrame, cell: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each cell in a global order, however many rows a cell has: rows are put into ranges of the
    order, each range keeps its first ``most`` of a cell, and those are cut again by how many the ranges before hold."""
    ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    k = F.row_number().over(Window.partitionBy("_p", cell).orderBy(*order))
    kept = materialize(ranged.withColumn("_k", k).filter(F.col("_k") <= most), "first")
    per = kept.groupBy(cell, "_p").agg(F.count("*").alias("_n"))
    # One row per range and cell, each of at most ``most`` rows.
    before = per.withColumn("_b", F.coalesce(F.sum("_n").over(Window.partitionBy(cell).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("_b") < most)
    both = kept.join(before.select(F.col(cell).alias("_c"), F.col("_p").alias("_q"), "_b"), kept[cell].eqNullSafe(F.col("_c")) & (F.col("_p") == F.col("_q")))
    return both.filter(F.col("_b") + F.col("_k") <= most).select(*df.columns)


def at_rank(df: DataFrame, group: str, value: str, rank, name: str = "value") -> DataFrame:
    """(group, value): of each group the value at a place from 1 in ascending order; ``rank`` makes the place from a column of
    the group's count. Equal values are counted first, so repeats aren't sorted; the values are put into ranges, counted,
    and only the range that holds the place is looked into. Null values are none."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c")).repartitionByRange(group, value)
    counts = materialize(counts.withColumn("_p", F.spark_partition_id()), "ranks")
    per = counts.groupBy(group, "_p").agg(F.sum("_c").alias("_n"))
    w = Window.partitionBy(group)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_at", rank(F.sum("_n").over(w)))
    hit = per.filter((F.col("_before") < F.col("_at")) & (F.col("_at") <= F.col("_before") + F.col("_n")))
    hit = hit.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), (F.col("_at") - F.col("_before")).alias("_need"))
    inside = counts.join(hit, counts[group].eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    upto = F.sum("_c").over(w.orderBy(value))
    found = inside.withColumn("_u", upto).filter((F.col("_u") >= F.col("_need")) & (F.col("_u") - F.col("_c") < F.col("_need")))
    return found.select(group, F.col(value).alias(name))
