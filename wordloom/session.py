"""Session helpers: table loading, shared-folder materialisation, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its files hold at most so many bytes and rows.
BROADCAST_BYTES, BROADCAST_ROWS = 8 << 20, 500_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of a data directory, projected to ``columns`` if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets a
    temporary folder; on a cluster it is an error, as no machine's own folder will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "wordloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, under this application's own folder, which is deleted when the application ends
    (or by ``release``)."""
    base = f"{shared_dir(spark)}/wordloom/{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession, path: str | None = None) -> None:
    """Deletes ``path``, or all that this application wrote to the shared folder; no result that reads it may be in use."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path or f"{shared_dir(spark)}/wordloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a plan used twice is computed once.

    The table lies in shared storage, hence it survives the loss of any executor, and its columns are pruned
    by each of its readers.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt out to all of them: a small file is one split, however much work
    its rows are. A scan of as many splits or more is passed on without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _is_scan(plan) -> bool:
    """Whether an optimised plan only reads, filters and projects files."""
    kind = plan.getClass().getSimpleName()
    if kind == "LogicalRelation":
        return True
    return kind in ("Project", "Filter") and _is_scan(plan.children().head())


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its files prove it to be small, else as it is: the planner then picks a shuffled join.

    A computed ``df`` is written out first, so that it is computed once and its size is known from its files. Both their
    bytes and (by a count that stops after ``rows`` + 1) their rows are bounded.
    """
    if not _is_scan(df._jdf.queryExecution().optimizedPlan()):
        df = materialize(df, "side")
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= most and df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df
