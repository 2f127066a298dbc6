"""Column functions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_scale(count: Column) -> Column:
    """Eighths of a doubling, 0 to 255; counts are rounded to 6 digits first, as blended counts are fractions."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.round(F.round(F.log2(count + 1) * 8, 6)).cast("int")))


def log_unscale(b: Column) -> Column:
    """A count of at least 1 that scales to about ``b``."""
    return F.greatest(F.lit(1), F.floor(F.pow(F.lit(2.0), b / 8.0)).cast("int") - 1)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of k of n; (0, 0) of none."""
    n_, p = n.cast("double"), F.try_divide(k.cast("double"), n.cast("double"))
    d = 1 + F.try_divide(F.lit(z * z), n_)
    centre = (p + F.try_divide(F.lit(z * z / 2), n_)) / d
    half = z * F.sqrt(F.try_divide(p * (1 - p), n_) + F.try_divide(F.lit(z * z / 4), n_ * n_)) / d
    return F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), centre + half), F.lit(0.0))


def entropy_of_counts(count: Column, total: Column) -> Column:
    """Aggregate: Shannon entropy in bits of a histogram's counts."""
    return -F.sum(count / total * F.log2(count / total))


def elias_fano_bits(universe: Column, n: Column) -> Column:
    """Estimated bits per entry of a sorted list of n numbers below ``universe``."""
    return F.ceil(F.log2(F.greatest(universe / n, F.lit(2.0)))) + 2


def table_bytes(groups: Column, pairs: Column) -> Column:
    return groups * 6 + pairs * 5


def luminance(argb: Column) -> Column:
    """Relative luminance of a colour."""
    def channel(shift: int) -> Column:
        s = F.shiftright(argb, shift).bitwiseAND(F.lit(255)) / 255.0
        return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(16) + 0.7152 * channel(8) + 0.0722 * channel(0)


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two opaque colours; null if either isn't."""
    x, y = luminance(a), luminance(b)
    opaque = (F.shiftrightunsigned(a, 24) == 255) & (F.shiftrightunsigned(b, 24) == 255)
    return F.when(opaque, (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05))


def fit(full: Column, measured: Column, available: Column) -> Column:
    """Size at which a text fits; as it is where it fits or nothing is known."""
    return F.when((full > 0) & (measured > 0) & (available > 0) & (measured > available), full * available / measured).otherwise(full)


def ratio_text(x: Column) -> Column:
    """Two decimals, cut rather than rounded."""
    scaled = (x * 100).cast("bigint")
    sign = F.when((scaled < 0) & (scaled > -100), F.lit("")).otherwise(F.lit(""))
    return F.concat(sign, (scaled.cast("double") / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((F.abs(scaled) % 100).cast("string"), 2, "0"))


def within(value: Column, expected: Column, tolerance: float = 0.01) -> Column:
    return F.abs(value - expected) <= expected * tolerance


def scorer_bytes(vocabulary: Column | int, embedding: Column | int, hidden: Column | int, layers: Column | int) -> Column:
    """Bytes of a recurrent scorer of 8-bit numbers with tied output: embeddings, projection, and per layer input, state and bias."""
    v, e, h, n = (x if isinstance(x, Column) else F.lit(x) for x in (vocabulary, embedding, hidden, layers))
    return v * e + e * h + n * (h * e + h * h + h)
