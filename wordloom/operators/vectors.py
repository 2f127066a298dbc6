"""Best matches of a stated query set by dot product."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries per block, and rows per part.
BLOCK, PART_ROWS = 512, 20_000


def top_dot(queries: DataFrame, rows: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score): of each query the ``k`` rows of the largest dot product, itself left out, ties by id.

    Blocks of queries meet parts of the rows in a grouped map, where one matrix product scores both; a part passes on
    k rows per query. There are as many parts as the rows need, so a part's memory doesn't grow with them. Rows with a
    null vector match nothing. Vectors are of one length.
    """
    n = max(1, -(-queries.count() // BLOCK))
    parts_ = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))
    q = queries.filter(F.col(vector).isNotNull()).select(F.pmod(F.hash(id_), F.lit(n)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts_ - 1))).alias("part"), F.col(id_).alias("id"), F.col(vector).alias("v"))
    r = rows.filter(F.col(vector).isNotNull()).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.pmod(F.xxhash64(id_), F.lit(parts_)).cast("int").alias("part"), F.col(id_).alias("id"), F.col(vector).alias("v"))

    def best(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        a, b = np.stack(left["v"].to_numpy()).astype(np.float64), np.stack(right["v"].to_numpy()).astype(np.float64)
        ids = right["id"].to_numpy()
        score = a @ b.T
        score[left["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
        out = []
        for i, query in enumerate(left["id"].to_numpy()):
            order = np.lexsort((ids, -score[i]))[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[order], "score": score[i][order]}))
        found = pd.concat(out)
        return found[found["score"] > -np.inf]

    parts = q.groupBy("block", "part").cogroup(r.groupBy("block", "part")).applyInPandas(best, "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k).drop("k")


#: Bits that a sum of products of 8-bit numbers is shifted down by.
SHIFT = 7


def weights8(rows: int, cols: int, seed: int) -> list[list[int]]:
    """A matrix of 8-bit numbers that depends on its seed alone, by a linear congruence."""
    x, out = seed, []
    for _ in range(rows):
        row = []
        for _ in range(cols):
            x = (x * 1103515245 + 12345) % 2**31
            row.append((x >> 16) % 255 - 127)
        out.append(row)
    return out


def matvec8(matrix: list[list[int]], x: Column) -> Column:
    """Sums of products of each row with an array of 8-bit numbers, as whole numbers."""
    m = F.array(*(F.array(*map(F.lit, row)) for row in matrix))
    return F.transform(m, lambda row: F.aggregate(F.zip_with(row, x, lambda a, b: a * b), F.lit(0), lambda s, v: s + v))


def requantised(sums: Column, shift: int = SHIFT) -> Column:
    """Sums shifted down and clamped to 0 to 127."""
    return F.transform(sums, lambda v: F.greatest(F.lit(0), F.least(F.lit(127), F.shiftright(v, shift))))


def recurrent8(x: Column, h: Column, w_in: list[list[int]], w_state: list[list[int]], bias: list[int]) -> Column:
    """The next state of one layer of 8-bit numbers from its input and state."""
    both = F.zip_with(matvec8(w_in, x), matvec8(w_state, h), lambda a, b: a + b)
    return requantised(F.zip_with(both, F.array(*map(F.lit, bias)), lambda a, b: a + b))
