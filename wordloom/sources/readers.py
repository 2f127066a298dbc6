"""Readers of the corpus formats, each with a fixed schema: nothing is inferred."""

from __future__ import annotations

import bz2
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def word_counts(spark: SparkSession, path: str, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """(word, cnt) with the largest count of each word, and one row of what was read, malformed or below the least, from
    lines of a word and a count."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).select(F.when(F.size("p") == 2, F.col("p")[0]).alias("word"), F.when(F.size("p") == 2, F.expr("try_cast(p[1] AS BIGINT)")).alias("cnt"))
    bad = F.col("word").isNull() | F.col("cnt").isNull()
    stats = rows.agg(F.count("*").alias("read"), F.count_if(bad).alias("malformed"), F.count_if(~bad & (F.col("cnt") < least)).alias("below"))
    return rows.filter(~bad & (F.col("cnt") >= least)).groupBy("word").agg(F.max("cnt").alias("cnt")), stats


def json_array_lines(spark: SparkSession, path: str, schema: str, needle: str) -> DataFrame:
    """Objects of a huge array that has one per line: lines without ``needle`` are dropped before anything is parsed."""
    lines = spark.read.text(path).filter(F.col("value").contains(needle)).select(F.regexp_replace("value", r",\s*\z", "").alias("v"))
    return lines.select(F.from_json("v", schema).alias("o")).filter("o IS NOT NULL").select("o.*")


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """Distinct block offsets of an index of ``offset:id:title`` lines."""
    return spark.read.text(path).select(F.expr("try_cast(split(value, ':', 3)[0] AS BIGINT)").alias("offset")).filter("offset IS NOT NULL").distinct()


def unpacked(packed: DataFrame, *keys: str) -> DataFrame:
    """(keys, ok, text) of independently compressed blocks (keys, content); a damaged one is kept as not ok."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for c in p["content"]:
                try:
                    out.append((True, bz2.decompress(c).decode("utf-8", "replace")))
                except (OSError, ValueError):
                    out.append((False, None))
            yield pd.DataFrame({**{k: p[k] for k in keys}, "ok": [x[0] for x in out], "text": [x[1] for x in out]})

    rows = packed.select(*keys, "content")
    return rows.mapInPandas(run, ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "ok boolean, text string"]))


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, ok, text) of independently compressed blocks, one file each; a damaged one is kept as not ok."""
    return unpacked(spark.read.format("binaryFile").load(path), "path")


def text_elements(xml: Column) -> Column:
    """Array of what the text elements of a page hold."""
    return F.regexp_extract_all(xml, F.lit(r"(?s)<text\b[^>]*>(.*?)</text>"), F.lit(1))


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """(tokens) of files of one sentence per line, packed or not."""
    return spark.read.text(path).filter("value <> ''").select(F.split("value", " ").alias("tokens"))


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows of a fixed number of columns; a row of another number fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, sep="\t", quote="", escape="")


def first_column(spark: SparkSession, *paths: str) -> DataFrame:
    """(text): the first column of tab-separated files, blanks collapsed, blank rows dropped."""
    return spark.read.text(list(paths)).select(F.trim(F.regexp_replace(F.substring_index("value", "\t", 1), r"\s+", " ")).alias("text")).filter("text <> ''")


def words_blob(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a newline-delimited list, packed or not."""
    return spark.read.text(path).filter("value <> ''").withColumnRenamed("value", "word")


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in an order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("v")).select(key, *(f"v.{c}" for c in rest))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in an order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(key, *(f"v.{c}" for c in rest))


def kinds(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    """Rows of one kind of a JSON-lines file of several."""
    return spark.read.schema(schema).json(path).filter(F.col("kind") == kind)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes) of a corpus directory."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def headers(records: DataFrame, required: tuple[str, ...], raw: str = "raw", file: str = "src_file", line: str = "line_no") -> DataFrame:
    """(file, columns, missing): the columns that each file's first record names, without a byte-order mark, blanks and quotes, and which
    of the ``required`` ones it lacks. A file without a first record, or with a null one, lacks all."""
    first = records.groupBy(file).agg(F.min(F.when(F.col(line) == 1, F.col(raw))).alias("_h"))
    names = F.transform(F.split(F.regexp_replace(F.coalesce("_h", F.lit("")), r"\A\x{FEFF}|\r\z", ""), ","), lambda c: F.regexp_replace(F.trim(c), r'\A"|"\z', ""))
    return first.select(file, names.alias("columns")).withColumn("missing", F.array_except(F.array(*map(F.lit, required)), "columns"))


def leading(df: DataFrame, order: list[str], most_bytes: int, text: str) -> DataFrame:
    """The first rows in an order, up to the one that reaches ``most_bytes`` of ``text``: a prefix, no random sample. Null texts take no
    bytes."""
    from wordloom.operators.windows import numbered

    return numbered(df, order, amount=F.coalesce(F.octet_length(text), F.lit(0))).filter(F.col("before") < most_bytes).select(*df.columns)


def optional(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, bool]:
    """(table, whether it is missing): a table that isn't there is an empty one, so that what doesn't need it goes on."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(schema).parquet(path), False
    return spark.createDataFrame([], schema), True
