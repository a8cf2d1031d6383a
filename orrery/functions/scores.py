"""Similarity, band and interval expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two number arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null when either vector is zero."""
    size = l2_norm(a) * l2_norm(b)
    return F.when(size > 0, dot(a, b) / size)


def tanimoto(a: Column, b: Column) -> Column:
    """Of two packed bit sets; 0 when both are empty."""
    count = lambda op: F.aggregate(F.zip_with(a, b, op), F.lit(0), lambda s, x: s + F.bit_count(x))
    union = count(lambda x, y: x.bitwiseOR(y))
    return F.when(union > 0, count(lambda x, y: x.bitwiseAND(y)) / union).otherwise(0.0)


def popcount_band(a: Column, b: Column, threshold: float) -> Column:
    """What popcounts allow a similarity of at least ``threshold``."""
    return (b >= a * threshold) & (a >= b * threshold)


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.5, "HIGH").when(c >= 0.4, "MODERATE").when(c >= 0.3, "LOW").otherwise("NOVEL")


def support_bucket(c: Column) -> Column:
    return F.when(c >= 8, "8+").when(c >= 4, "4-7").when(c >= 2, "2-3").when(c == 1, "1")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Low and high end of the Wilson interval."""
    p, zz = hits / n, z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return mid - half, mid + half
