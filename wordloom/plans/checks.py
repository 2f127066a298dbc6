"""Data-quality checks. Each comes with a planted defect that must turn it red before its green counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.hashing import content_hash


@dataclass(frozen=True)
class Check:
    """``found`` returns one row (denominator, findings) for a table; ``defect`` returns the table with a planted defect."""

    name: str
    unit: str
    found: Callable[[DataFrame], DataFrame]
    defect: Callable[[DataFrame], DataFrame]


def _row(df: DataFrame, bad) -> DataFrame:
    return df.agg(F.count("*").alias("denominator"), F.count_if(bad).alias("findings"))


def ascending(key: str) -> Check:
    """Neighbours in id order ascend strictly by their key: each row meets its successor by an equi-join."""
    def found(df: DataFrame) -> DataFrame:
        nxt = df.select((F.col("word_id") - 1).alias("word_id"), F.col(key).alias("_next"))
        return _row(df.select("word_id", key).join(nxt, "word_id", "left"), F.coalesce(F.col(key) >= F.col("_next"), F.lit(False)))

    return Check(f"{key} ascends", "word", found, lambda df: df.withColumn(key, F.when(F.col("word_id") == 5, F.lit("￿")).otherwise(F.col(key))))


def at_least(n: int) -> Check:
    return Check("denominator", "row", lambda df: df.agg(F.count("*").alias("denominator"), (F.count("*") < n).cast("bigint").alias("findings")), lambda df: df.limit(n - 1))


def unique(*key: str) -> Check:
    def found(df: DataFrame) -> DataFrame:
        return _row(df.groupBy(*key).count(), F.col("count") > 1)

    return Check(f"{'+'.join(key)} is unique", "key", found, lambda df: df.union(df.limit(1)))


def matches(column: str, pattern: str, planted: str) -> Check:
    return Check(f"{column} matches", "value", lambda df: _row(df, ~F.coalesce(F.col(column).rlike(pattern), F.lit(False))), lambda df: df.union(df.limit(1).withColumn(column, F.lit(planted))))


def same_content(expected: str, line: str) -> Check:
    return Check("content", "table", lambda df: df.agg(F.count("*").alias("denominator"), (content_hash(F.col(line)) != expected).cast("bigint").alias("findings")), lambda df: df.filter("word_id <> 3"))


def floor_is(column: str, least: int) -> Check:
    return Check(f"least {column}", "row", lambda df: _row(df, F.col(column) < least), lambda df: df.union(df.limit(1).withColumn(column, F.lit(least - 1).cast(df.schema[column].dataType))))


def only_integers() -> Check:
    """A learnt table holds ids and counts, never text."""
    def found(df: DataFrame) -> DataFrame:
        texts = [f.name for f in df.schema.fields if f.dataType.simpleString() not in ("int", "bigint", "smallint", "tinyint")]
        return df.limit(1).agg(F.lit(len(df.columns)).cast("bigint").alias("denominator"), F.lit(len(texts)).cast("bigint").alias("findings"))

    return Check("integers only", "column", found, lambda df: df.withColumn("word", F.lit("x")))


def disjoint(other: DataFrame, key: str) -> Check:
    def found(df: DataFrame) -> DataFrame:
        hit = df.select(key).distinct().join(other.select(F.col(key).alias("_o")).distinct(), F.col(key) == F.col("_o"), "left")
        return _row(hit, F.col("_o").isNotNull())

    return Check(f"{key} is disjoint", "record", found, lambda df: df.union(other.select(*df.columns).limit(1)))


def close_to(expected: int, tolerance: float = 0.01) -> Check:
    return Check("count within tolerance", "row", lambda df: df.agg(F.count("*").alias("denominator"), (F.abs(F.count("*") - expected) > expected * tolerance).cast("bigint").alias("findings")), lambda df: df.limit(expected // 2))


def run(table: DataFrame, checks: list[Check]) -> DataFrame:
    """(name, unit, denominator, findings, control_findings, status): NOT-A-GATE if the planted defect isn't found,
    NOT-MEASURED without a denominator, else FAIL or PASS. The control is read before the real table."""
    out = None
    for c in checks:
        control = c.found(c.defect(table)).select(F.col("findings").alias("control_findings"))
        row = c.found(table).join(F.broadcast(control)).select(F.lit(c.name).alias("name"), F.lit(c.unit).alias("unit"), "denominator", "findings", "control_findings")
        out = row if out is None else out.unionByName(row)
    status = F.when(F.col("control_findings") == 0, "NOT-A-GATE").when(F.col("denominator") == 0, "NOT-MEASURED").when(F.col("findings") > 0, "FAIL").otherwise("PASS")
    return out.withColumn("status", status)


def summary(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("checks"))


def strictly_by_group(df: DataFrame, group: str, key: str) -> DataFrame:
    """(denominator, findings): keys within a group that don't ascend strictly as stored by rank."""
    w = Window.partitionBy(group).orderBy("rank")
    return _row(df.withColumn("_p", F.lag(key).over(w)), F.coalesce(F.col("_p") >= F.col(key), F.lit(False)))


def against_stated(parsed: DataFrame, stats: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(src_file, read, rejected): whether each file's records read lie within a tolerance of the stated figure, and its records
    rejected are exactly as many; NOT-MEASURED where none is stated."""
    by = parsed.groupBy("src_file").agg(F.count("*").alias("r"), F.count("reason").alias("x"))
    said = stats.groupBy("src_file").agg(F.max("rows_read").alias("sr"), F.max("rows_rejected").alias("sx"))
    both = said.join(by, "src_file", "left").fillna(0, ["r", "x"])
    verdict = lambda said, ok: F.when(said.isNull(), "NOT-MEASURED").when(ok, "PASS").otherwise("FAIL")
    near = F.abs(F.col("r") - F.col("sr")) <= F.col("sr") * tolerance
    return both.select("src_file", verdict(F.col("sr"), near).alias("read"), verdict(F.col("sx"), F.col("x") == F.col("sx")).alias("rejected"))
