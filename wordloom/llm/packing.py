"""p8: items of varying length into containers of fixed capacity by vector best fit.

An item takes part of three capacities of a container: tokens, number of documents, and attention cost, the sum of
squared lengths. Where that is half the square of the tokens, two items of half a container's tokens take all of its
attention, and a longer and a shorter one, which cost more, don't share a container. An item that alone costs more than
there is opens a container with a small attention capacity for what is put beside it. Items come longest first; among the
open containers that can take an item under every capacity the one of the largest weighted dot product of demand and relative fill is chosen (equivalently the one whose weighted
residual fits tightest), ties by the earliest. An item longer than a container is split: all its full containers' worth
of tokens stand alone, only the rest is packed with others; no other item is ever split.

Items are dealt to packing groups by a hash of their key. A group holds a bounded share of all tokens, so its packing
is one task's work whatever the size of the corpus, and it leaves at most a few containers part-filled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.session import materialize


@dataclass(frozen=True)
class Limits:
    """Capacities of a container. ``attention`` None: the square of the token capacity, which no items exceed; ``beside``, for what
    stands beside an item that alone costs more, None: a sixteenth of that square."""

    tokens: int
    documents: int = 256
    attention: float | None = None
    beside: float | None = None
    #: Weights of tokens, documents and attention in the choice of a container.
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    #: Containers' worth of tokens in a packing group.
    group: int = 2000

    @property
    def attention_limit(self) -> float:
        return float(self.tokens) ** 2 if self.attention is None else self.attention

    @property
    def beside_limit(self) -> float:
        return float(self.tokens) ** 2 / 16 if self.beside is None else self.beside


def best_fit(sizes: np.ndarray, limits: Limits) -> np.ndarray:
    """Container number of each item; ``sizes`` come in descending order and are at most the token capacity.

    Sizes of 0 take a document's place but no tokens. Containers without room for the shortest item left are closed,
    so an item is compared with open containers only.
    """
    cap = np.array([limits.tokens, limits.documents, limits.attention_limit], float)
    weights = np.asarray(limits.weights, float)
    left = np.zeros((1024, 3))  # relative residuals of the open containers
    number = np.zeros(1024, np.int64)
    n_open = made = 0
    out = np.empty(len(sizes), np.int64)
    least = float(sizes[-1]) if len(sizes) else 0.0
    eps = 1e-12
    for i, size in enumerate(sizes.tolist()):
        need = np.array([size, 1.0, float(size) ** 2]) / cap
        best = -1
        if n_open:
            room = left[:n_open]
            fits = np.flatnonzero((room[:, 0] >= need[0] - eps) & (room[:, 1] >= need[1] - eps) & (room[:, 2] >= need[2] - eps))
            if len(fits):
                best = fits[np.argmin(room[fits] @ (weights * (need + 1e-6)))]
        if best < 0:
            if n_open == len(left):
                left, number = np.concatenate([left, np.zeros_like(left)]), np.concatenate([number, np.zeros_like(number)])
            left[n_open], number[n_open] = 1.0, made
            best, n_open, made = n_open, n_open + 1, made + 1
            if need[2] > 1.0:  # it has attention of its own, and leaves what may stand beside it
                left[best, 2] = need[2] + limits.beside_limit / limits.attention_limit
        left[best] -= need
        out[i] = number[best]
        if (left[best] < np.array([least, 1.0, least * least]) / cap - eps).any():
            n_open -= 1
            left[best:n_open], number[best:n_open] = left[best + 1 : n_open + 1].copy(), number[best + 1 : n_open + 1].copy()
    return out


def pieces(sizes: DataFrame, limits: Limits, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, piece, n_pieces, start, length): an item of at most the capacity is one piece, a longer one is cut at multiples
    of it. Null and negative sizes count as 0."""
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("bigint"), F.lit(0))
    count = F.greatest(F.ceil(n / limits.tokens).cast("int"), F.lit(1))
    df = sizes.select(F.col(key).alias("key"), n.alias("n"), count.alias("n_pieces"))
    df = df.select("key", "n", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    start = F.col("piece").cast("bigint") * limits.tokens
    return df.select("key", "piece", "n_pieces", start.alias("start"), F.least(F.lit(limits.tokens), F.col("n") - start).alias("length"))


def pack(sizes: DataFrame, limits: Limits, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(container, key, piece, n_pieces, start, length) of every piece of every item.

    ``container`` is unique over all groups. Every row of ``sizes`` is an item of its own, equal keys too. Empty
    items are packed like others (they fill no tokens but count as documents). The result doesn't depend on how the
    input is partitioned.
    """
    cut = materialize(pieces(sizes, limits, key, size), "p8-pieces")
    total = cut.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    groups = max(1, -(-total.t // (limits.tokens * limits.group)), -(-total.n // (limits.documents * limits.group)))
    kind = sizes.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "key", "piece"], ascending=[False, True, True], kind="stable")
        length = group["length"].to_numpy()
        full = length == limits.tokens
        at = np.empty(len(group), np.int64)
        at[full] = np.arange(full.sum())
        at[~full] = full.sum() + best_fit(length[~full], limits)
        out = group[["key", "piece", "n_pieces", "start", "length"]].copy()
        out.insert(0, "container", at * groups + int(group["g"].iloc[0]))
        return out

    # The rows are few bytes but much work: their number of tasks mustn't be coalesced by size.
    dealt = cut.withColumn("g", F.pmod(F.xxhash64("key", "piece"), F.lit(groups))).repartition(min(groups, 20_000), "g")
    packed = dealt.groupBy("g").applyInPandas(run, f"container bigint, key {kind}, piece int, n_pieces int, start bigint, length bigint")
    return packed.withColumnRenamed("key", key)


def fill_report(packed: DataFrame, limits: Limits) -> DataFrame:
    """One row: containers, tokens, the least number of containers that could hold them, the share of room left over, and the
    most of each capacity that a container uses (attention without an item that alone exceeds it); ``bound`` counts
    containers with room for a hundredth of the tokens and for a document, whose attention is used up to a hundredth."""
    longest = F.max("length")
    over = longest * longest > limits.attention_limit
    per = packed.groupBy("container").agg(F.sum("length").alias("t"), F.count("*").alias("n"), (F.sum(F.col("length") * F.col("length")) - F.when(over, longest * longest).otherwise(0)).alias("a"), over.alias("over"))
    limit = F.when(F.col("over"), limits.beside_limit).otherwise(limits.attention_limit)
    out = per.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.max("n").alias("most_documents"), F.max("t").alias("most_tokens"),
        F.max(F.when(~F.col("over"), F.col("a"))).alias("most_attention"), F.max(F.when(F.col("over"), F.col("a"))).alias("most_beside"),
        F.count_if((F.col("a") >= 0.99 * limit) & (F.col("t") < 0.99 * limits.tokens) & (F.col("n") < limits.documents)).alias("bound"),
    )
    room = 1 - F.try_divide(F.col("tokens").cast("double"), F.col("containers") * limits.tokens)
    return out.select("containers", "tokens", F.ceil(F.col("tokens") / limits.tokens).alias("least_containers"), room.alias("room_left"), "most_documents", "most_tokens", "most_attention", "most_beside", "bound")
