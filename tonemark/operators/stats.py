"""Bootstrap confidence intervals per group (bias-corrected and accelerated, Efron 1987).

A resample draws as many rows as the group has, with replacement. No group is gathered for it.

*Mean.* A statistic of sums, see ``resampling``.

*Median.* The middle of a resample is an order statistic of uniform draws, so its rank has a Beta
distribution. Only the values between the smallest and largest rank that came up are looked at.

Every draw is seeded by the seed, the group and the place in the tree, whatever the layout, so a
lost task repeats itself. The way is the same for groups of any size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemark.operators.resampling import bca_bounds, generator, mean, resampled
from tonemark.plans.melt import MEASURE, VALUE, melt, widen
from tonemark.plans.order_stats import order_statistics, usable

_BOUNDS = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
_RANKS = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])


def median_acceleration(before: float, middle: float, after: float, n: int) -> float:
    """Skewness of the medians that leave one row out; NaN when they are all equal.

    For an even number these are the two middle values, half of the times each. For an odd one they
    are the middles between neighbours of the median, and once the middle of both neighbours.
    """
    if n % 2 == 0:
        return 0.0 if after > before else float("nan")
    half = (n - 1) // 2
    left_out = np.array([(middle + after) / 2, (before + after) / 2, (before + middle) / 2])
    times = np.array([half, 1, half])
    deviation = (times @ left_out) / n - left_out
    spread = times @ deviation**2
    return float((times @ deviation**3) / (6 * spread**1.5)) if spread > 0 else float("nan")


def middle_ranks(seed: int, group: int, n: int, n_resamples: int) -> np.ndarray:
    """Ranks from 0 of the middle rows of each resample, two columns, equal for an odd number."""
    rng = generator(seed, group)
    k = (n + 1) // 2
    first = rng.beta(k, n - k + 1, n_resamples)
    second = first
    if n % 2 == 0:
        # the next one is the least of those above
        second = first + (1 - first) * (1 - rng.random(n_resamples) ** (1 / (n - k)))
    return np.minimum((np.stack([first, second], axis=1) * n).astype(np.int64), n - 1)


def _median_ends(clean: DataFrame, base: DataFrame, n_resamples: int, level: float, seed: int) -> DataFrame:
    """``_gid``, ``_point`` and ``_ends`` for groups with spread."""

    @F.pandas_udf(_RANKS)
    def reach(gid: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for g, k in zip(gid, n):
            ranks = middle_ranks(seed, g, k, n_resamples)
            # with the middle itself and its neighbours
            out.append((max(0, min(ranks.min(), k // 2 - 1)), min(k - 1, max(ranks.max(), k // 2 + 1))))
        return pd.DataFrame(out, columns=["first", "last"])

    varied = base.where((F.col("n") >= 2) & (F.col("_hi") > F.col("_lo")))
    wanted = varied.select("_gid", "n", reach("_gid", "n").alias("_r")).select("_gid", "n", "_r.first", "_r.last")
    rows = clean.join(wanted, "_gid")

    ends = order_statistics(
        rows, ["_gid", "n", "first", "last"], F.col("_v"),
        {"_from": lambda n: F.col("_g.first"), "_to": lambda n: F.col("_g.last")},
    )
    near = rows.select("_gid", "_v").join(ends, "_gid")
    counted = near.groupBy("_gid", "n", "_from", "_to").agg(F.count_if(F.col("_v") < F.col("_from")).alias("_before"))
    inside = near.where(F.col("_v").between(F.col("_from"), F.col("_to"))).groupBy("_gid", "_v")
    inside = inside.agg(F.count(F.lit(1)).alias("_c")).groupBy("_gid")
    inside = inside.agg(F.array_sort(F.collect_list(F.struct("_v", "_c"))).alias("_near"))
    schema = T.StructType([T.StructField("point", T.DoubleType()), *_BOUNDS.fields])

    @F.pandas_udf(schema)
    def solve(gid: pd.Series, n: pd.Series, before: pd.Series, values: pd.Series, times: pd.Series) -> pd.DataFrame:
        out = []
        for g, k, b, v, c in zip(gid, n, before, values, times):
            v, upto = np.asarray(v), b + np.cumsum(c)

            def at(ranks: np.ndarray) -> np.ndarray:
                return v[np.searchsorted(upto, ranks, "right")]

            medians = at(middle_ranks(seed, g, k, n_resamples)).mean(axis=1)
            low, mid, high = at(np.clip(np.array([(k - 1) // 2 - (k % 2), k // 2, k // 2 + (k % 2)]), 0, k - 1))
            point = mid if k % 2 else (low + mid) / 2
            speed = median_acceleration(low, mid, high, k)
            out.append((point, *bca_bounds(medians, point, speed, level)))
        return pd.DataFrame(out, columns=["point", "low", "high"], dtype="float64")

    solved = counted.join(inside, "_gid").select(
        "_gid", solve("_gid", "n", "_before", F.col("_near._v"), F.col("_near._c")).alias("_s")
    )
    return solved.select("_gid", F.col("_s.point").alias("_point"), F.struct("_s.low", "_s.high").alias("_ends"))


def bca_ci(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    statistic: str = "mean",
    n_resamples: int = 10_000,
    level: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """STAT1, STAT2: point, low, high, cl, n, degenerate for every group.

    ``statistic`` is ``mean`` or ``median``. Null and NaN are dropped first.
    """
    if statistic not in ("mean", "median"):
        raise ValueError("the statistic is mean or median")
    if statistic == "mean":
        return resampled(df, keys, [value], mean(), n_resamples, level, seed)
    # one struct names the group: joins and groupings on it treat null keys as equal
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    clean = df.select(group.alias("_g"), value.cast("double").alias("_v")).where(usable(F.col("_v")))
    clean = clean.withColumn("_gid", F.xxhash64(F.lit(seed), "_g"))
    base = clean.groupBy("_gid", "_g").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    solved = _median_ends(clean.select("_gid", "_v"), base, n_resamples, level, seed)
    # groups without spread have no draws; their point is the one value
    joined = base.join(solved, "_gid", "left")
    point = F.when(F.col("_hi") == F.col("_lo"), F.col("_lo")).otherwise(F.col("_point"))
    low, high = F.col("_ends.low"), F.col("_ends.high")
    finite = usable(low) & usable(high)
    result = joined.select(
        "_g",
        point.alias("point"),
        F.when(finite, low).otherwise(point).alias("low"),
        F.when(finite, high).otherwise(point).alias("high"),
        F.lit(level).alias("cl"),
        "n",
        (~finite).alias("degenerate"),
    )
    names = ["point", "low", "high", "cl", "n", "degenerate"]
    return result.select("_g.*", *names) if keys else result.select(*names)


def intervals(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], **options
) -> DataFrame:
    """STAT4: mean and interval of every value as a struct, all in one pass.

    Nulls are left out; a struct is null as a whole where a group has no value. A group without any
    of the values has no row, so the result belongs on the right of a left join.
    """
    long = melt(df, keys, values).where(F.col(VALUE).isNotNull())
    flat = bca_ci(long, [*keys, MEASURE], F.col(VALUE), **options)
    block = F.struct("point", "low", "high", "cl", "n", "degenerate")
    return widen(flat, keys, list(values), block)
