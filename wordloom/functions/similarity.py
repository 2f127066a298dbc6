"""Distances between strings, sets and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.profiles import UNIT, Profile


def osa(a: Column, b: Column, adjacent: Column | None = None, adjacent_cost: int = UNIT, transpose: int = UNIT, insert: int = UNIT, delete: int = UNIT) -> Column:
    """Optimal-string-alignment distance from ``a`` (typed) to ``b`` in hundredths of an edit, inside the JVM.

    Two folds keep the last two rows of the table. ``adjacent`` is a map of two-letter strings to true: substitutions in
    it cost ``adjacent_cost``. Empty strings are as far as the other is long.
    """
    x, y = F.split(a, ""), F.split(b, "")
    n, m = F.length(a), F.length(b)
    cols = F.when(m > 0, F.sequence(F.lit(1), F.greatest(m, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    rows = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    first = F.transform(F.sequence(F.lit(0), m), lambda j: j * insert)

    def step(acc: Column, i: Column) -> Column:
        before, last = acc["p2"], acc["p1"]
        xi = F.element_at(x, i)

        def cell(row: Column, j: Column) -> Column:
            yj = F.element_at(y, j)
            price = F.lit(UNIT)
            if adjacent is not None:
                price = F.when(F.coalesce(F.try_element_at(adjacent, F.concat(xi, yj)), F.lit(False)), F.lit(adjacent_cost)).otherwise(price)
            swap = F.element_at(last, j) + F.when(xi == yj, F.lit(0)).otherwise(price)
            best = F.least(F.element_at(last, j + 1) + delete, F.element_at(row, j) + insert, swap)
            crossed = (i > 1) & (j > 1) & (xi == F.try_element_at(y, j - 1)) & (F.try_element_at(x, i - 1) == yj)
            return F.concat(row, F.array(F.when(crossed, F.least(best, F.try_element_at(before, j - 1) + transpose)).otherwise(best)))

        row = F.aggregate(cols, F.array((i * delete).cast("int")), cell)
        return F.struct(last.alias("p2"), row.alias("p1"))

    done = F.aggregate(rows, F.struct(first.alias("p2"), first.alias("p1")), step)
    return F.when(a.isNotNull() & b.isNotNull(), F.element_at(done["p1"], -1))


def keys(p: Profile, width: float = 1080.0, height: float = 720.0) -> list[tuple[str, int, float, float, float, float]]:
    """(letter, row, left, top, right, bottom) of a layout's letter keys: rows centred, the widest filling the width. A
    fourth row, of function keys, takes its share of the height."""
    weights = [len(r) + sum(e) for r, e in zip(p.rows, p.row_ends, strict=True)]
    unit, tall = width / max(weights), height / (len(p.rows) + 1)
    out = []
    for i, row in enumerate(p.rows):
        left = (width - weights[i] * unit) / 2 + p.row_ends[i][0] * unit
        out += [(c, i, left + k * unit, i * tall, left + (k + 1) * unit, (i + 1) * tall) for k, c in enumerate(row)]
    return out


def neighbours(p: Profile, overlap: float = 0.15) -> dict[str, set[str]]:
    """Letters whose keys touch in a row, or overlap by more than a share of their width in the next."""
    found: dict[str, set[str]] = {}
    laid = keys(p)
    for a, i, l1, _, r1, _ in laid:
        for b, j, l2, _, r2, _ in laid:
            if a == b or abs(i - j) > 1:
                continue
            near = (abs(r1 - l2) < 1 or abs(r2 - l1) < 1) if i == j else min(r1, r2) - max(l1, l2) > overlap * min(r1 - l1, r2 - l2)
            if near:
                found.setdefault(a, set()).add(b)
    return found


def adjacency_map(p: Profile) -> Column:
    """Map of two adjacent letters to true, as a literal."""
    pairs = sorted(a + b for a, bs in neighbours(p).items() for b in bs)
    return F.create_map(*(x for ab in pairs for x in (F.lit(ab), F.lit(True))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays taken as sets; 0 of two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def size_ceiling(a: Column, b: Column) -> Column:
    """Upper bound of ``jaccard`` from the numbers of distinct members alone: the smaller over the larger; 0 if either is empty."""
    m, n = F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    return F.coalesce(F.try_divide(F.least(m, n).cast("double"), F.greatest(m, n)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
