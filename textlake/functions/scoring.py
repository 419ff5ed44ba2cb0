"""Scores over columns: vectors, normalisation, fusion, recency, weights."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x / size)).otherwise(a.cast("array<double>"))


def min_max(x: Column, over: WindowSpec | None = None, flat: float = 0.5) -> Column:
    """To [0, 1] within a window; `flat` where all values are equal."""
    over = over or Window.partitionBy()
    low, high = F.min(x).over(over), F.max(x).over(over)
    return F.when(x.isNull(), None).when(high > low, (x - low) / (high - low)).otherwise(F.lit(flat))


def reciprocal_rank(rank: Column, weight: float, k: int = 20) -> Column:
    return F.coalesce(F.lit(weight) / (F.lit(k) + rank), F.lit(0.0))


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25_tf(tf: Column, length: Column, average: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.greatest(average, F.lit(1.0))))


def recency(days: Column, decay: Column) -> Column:
    """Halves every half decay period; one half where the time is unknown."""
    return F.coalesce(F.round(F.pow(F.lit(2.0), -days / (decay / 2)), 4), F.lit(0.5))


def days_between(then: Column, now: Column) -> Column:
    """Whole days, never negative."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))
    return F.greatest(F.lit(0), F.floor(seconds / 86400)).cast("bigint")


def memory_score(relevance: Column, importance: Column, fresh: Column) -> Column:
    return 0.5 * relevance + 0.3 * importance + 0.2 * fresh


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def offset_datum(lat: Column, lng: Column) -> tuple[Column, Column]:
    """WGS84 to the offset datum of Chinese maps: the public polynomial-and-sine approximation."""
    # The ellipsoid.
    axis, ecc = 6378245.0, 0.00669342162296594323
    x, y, pi = lng - 105.0, lat - 35.0, 3.141592653589793

    def waves(z: Column, *terms: tuple[float, float]) -> Column:
        out = F.lit(0.0)
        for size, period in terms:
            out = out + size * F.sin(z * (pi / period))
        return out * (2.0 / 3.0)

    common = waves(x, (20.0, 1 / 6), (20.0, 0.5))
    north = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + common
    north = north + waves(y, (20.0, 1.0), (40.0, 3.0)) + waves(y, (160.0, 12.0), (320.0, 30.0))
    east = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + common
    east = east + waves(x, (20.0, 1.0), (40.0, 3.0)) + waves(x, (150.0, 12.0), (300.0, 30.0))
    rad = lat / 180.0 * pi
    magic = 1 - ecc * F.sin(rad) * F.sin(rad)
    root = F.sqrt(magic)
    d_lat = north * 180.0 / ((axis * (1 - ecc)) / (magic * root) * pi)
    d_lng = east * 180.0 / (axis / root * F.cos(rad) * pi)
    return lat + d_lat, lng + d_lng
