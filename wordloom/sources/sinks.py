"""Writers. They write directories of parts: a single file would be a single task."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.hashing import content_hash
from wordloom.session import release


def sorted_lines(df: DataFrame, line: Column, path: str, *order: str) -> None:
    """Lines in a global order over the parts, packed; the same rows give the same lines."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def bucketed(df: DataFrame, table: str, path: str, buckets: int, by: str, order: str) -> None:
    """A table bucketed and sorted by a word's id, so that lookups by it need no shuffle; its files lie at ``path``, which must
    be in shared storage."""
    df.write.mode("overwrite").bucketBy(buckets, by).sortBy(by, order).option("path", path).format("parquet").saveAsTable(table)


def drop(spark: SparkSession, table: str) -> None:
    """Takes a table out of the catalogue and deletes its files."""
    at = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Location'").first().data_type
    spark.sql(f"DROP TABLE {table}")
    release(spark, at)


def manifest(df: DataFrame, line: Column, path: str, **said: str) -> DataFrame:
    """Writes one row of what an artefact is: its rows, its content's digest and what is said of it. Returns that row."""
    one = df.agg(F.count("*").alias("entries"), content_hash(line).alias("digest")).select("*", *(F.lit(v).alias(k) for k, v in said.items()))
    one.write.mode("overwrite").json(path)
    return one


def tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("quote", "\u0000").option("compression", "gzip").csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def sealed(value: Column, key: str) -> Column:
    """Encrypted with authentication under a 16, 24 or 32 byte key; a fresh nonce each time."""
    return F.aes_encrypt(value.cast("binary"), F.lit(key), F.lit("GCM"))


def opened(value: Column, key: str) -> Column:
    """What was sealed; null under another key or if it was tampered with."""
    return F.try_aes_decrypt(value, F.lit(key), F.lit("GCM")).cast("string")


#: Fixed layout of a packed user model: mark, version and number of pairs, then 16 bytes a pair (first, second, count, sessions).
MODEL_MARK, MODEL_VERSION = b"UNGM", 2
_HEAD, _PAIR = "<4sii", np.dtype([("first", "<i4"), ("second", "<i4"), ("count", "<i4"), ("sessions", "<i4")])


def packed_models(pairs: DataFrame) -> DataFrame:
    """(user_id, content) of user models (user_id, first_id, second_id, cnt, sessions): one block of bytes each, pairs in order of
    their ids. A model is what eviction leaves, so a user's rows are bounded by its capacity."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["first_id", "second_id"])
        body = np.empty(len(rows), _PAIR)
        for name, column in zip(_PAIR.names, ("first_id", "second_id", "cnt", "sessions"), strict=True):
            body[name] = np.minimum(rows[column].to_numpy(), 2**31 - 1)
        return pd.DataFrame({"user_id": [key[0]], "content": [struct.pack(_HEAD, MODEL_MARK, MODEL_VERSION, len(rows)) + body.tobytes()]})

    return pairs.filter("user_id IS NOT NULL").select("user_id", "first_id", "second_id", "cnt", "sessions").groupBy("user_id").applyInPandas(run, "user_id bigint, content binary")


def unpacked_models(packed: DataFrame) -> DataFrame:
    """(user_id, status, first_id, second_id, cnt, sessions): the pairs of packed models; one that can't be read has one row with
    nulls and why: ``null``, ``short``, ``mark``, ``version`` or ``length``, which must be exact. An empty model has no rows."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for user, content in zip(p["user_id"], p["content"], strict=True):
                head = struct.unpack_from(_HEAD, content) if content is not None and len(content) >= struct.calcsize(_HEAD) else None
                if head is None:
                    why = "null" if content is None else "short"
                elif head[0] != MODEL_MARK:
                    why = "mark"
                elif head[1] != MODEL_VERSION:
                    why = "version"
                else:
                    why = "ok" if head[2] >= 0 and len(content) == struct.calcsize(_HEAD) + head[2] * _PAIR.itemsize else "length"
                body = np.frombuffer(content, _PAIR, offset=struct.calcsize(_HEAD)) if why == "ok" else None
                cols = {c: pd.array([None] if body is None else body[n], dtype="Int64") for c, n in zip(("first_id", "second_id", "cnt", "sessions"), _PAIR.names, strict=True)}
                yield pd.DataFrame({"user_id": user, "status": why, **cols}, columns=["user_id", "status", *cols])

    return packed.select("user_id", "content").mapInPandas(run, "user_id bigint, status string, first_id int, second_id int, cnt bigint, sessions bigint")


def replaced(df: DataFrame, path: str) -> None:
    """Writes a table beside its place and moves it there as a whole: readers find the old one or the new one, never a part."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.rename(at(path), at(f"{path}.old"))
    if not fs.rename(at(f"{path}.new"), at(path)):
        raise OSError(f"{path} can't be replaced")
    fs.delete(at(f"{path}.old"), True)
