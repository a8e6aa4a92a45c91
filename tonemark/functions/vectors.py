"""Numbers from arrays: cosine similarity, loudness, clipping. Built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """STAT3: cosine similarity, 0 when a vector has no length."""
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def rms(samples: Column) -> Column:
    """AQ3 feature: root mean square, null for an empty waveform."""
    return F.when(F.size(samples) > 0, F.sqrt(dot(samples, samples) / F.size(samples)))


def clip_ratio(samples: Column, peak: float = 0.999) -> Column:
    """AQ4 feature: share of samples at or beyond the peak, null for an empty waveform."""
    hot = F.size(F.filter(samples, lambda x: F.abs(x) >= F.lit(peak)))
    return F.when(F.size(samples) > 0, hot / F.size(samples))
