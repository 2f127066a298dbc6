"""Deterministic randomness from values, never from row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def below(n: int | Column, seed: str, *key: Column) -> Column:
    """A number in [0, n) drawn by the key under a seed: 15 hexadecimal digits of a digest, modulo n."""
    text = F.concat_ws(":", F.lit(seed), *(k.cast("string") for k in key))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint") % n


def order_key(seed: str, *key: Column) -> Column:
    """What to sort by for a seeded shuffle."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *(k.cast("string") for k in key)), 256)


def pick(items: tuple[str, ...] | str, index: Column) -> Column:
    """The item at an index from 0."""
    return F.element_at(F.array(*(F.lit(x) for x in items)), (index + 1).cast("int"))


def content_hash(line: Column) -> Column:
    """Aggregate: a digest of a set of lines in any order, duplicates counted. Only digests of lines are gathered, sixteen
    counters wide, so that no group is collected."""
    parts = [F.sum(F.conv(F.substring(F.md5(line), 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    return F.sha2(F.concat_ws(",", F.count(line).cast("string"), *(F.coalesce(p, F.lit(0)).cast("decimal(38,0)").cast("string") for p in parts)), 256)
