"""Latency: real-time factor, four quantile definitions, totals, layers.

The four definitions give different numbers and are kept apart: linear interpolation for reports,
half-even nearest rank for service evaluation, floor rank for gates and model tables, textbook
median for repeated runs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark.plans.melt import MEASURE, VALUE, melt, widen
from tonemark.plans.order_stats import FACTS, order_statistics, ordered_facts


def rtf(total_s: Column, media_s: Column) -> Column:
    """LAT1: processing time per second of media, NaN without media."""
    return F.when(media_s > 0, total_s / media_s).otherwise(F.lit(float("nan")))


def latency_struct(
    total_s: Column,
    media_s: Column,
    load_s: Column | None = None,
    ttfa_s: Column | None = None,
    first_token_s: Column | None = None,
) -> Column:
    """The latency block of a sample record, real-time factor included."""
    empty = F.lit(None).cast("double")
    return F.struct(
        total_s.alias("total_s"),
        media_s.alias("media_dur_s"),
        (F.lit(0.0) if load_s is None else load_s).alias("model_load_s"),
        (empty if ttfa_s is None else ttfa_s).alias("ttfa_s"),
        (empty if first_token_s is None else first_token_s).alias("first_token_s"),
        rtf(total_s, media_s).alias("rtf"),
    )


def _at(q: float):
    return lambda n: (n - 1) * F.lit(q)


def interpolated(
    df: DataFrame, keys: Sequence[str], value: Column, quantiles: dict[str, float]
) -> DataFrame:
    """Quantiles with linear interpolation between the two closest ranks, plus ``n``, ``n_present``,
    ``mean``, ``min`` and ``max``."""
    ranks = {}
    for name, q in quantiles.items():
        ranks[f"_lo_{name}"] = lambda n, q=q: F.floor(_at(q)(n))
        ranks[f"_hi_{name}"] = lambda n, q=q: F.ceil(_at(q)(n))
    stats = ordered_facts(df, keys, value, ranks)
    position = {name: _at(q)(F.col(FACTS)["n"]) for name, q in quantiles.items()}
    return stats.select(
        *keys,
        f"{FACTS}.*",
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
                * (position[name] - F.floor(position[name]))
            ).alias(name)
            for name in quantiles
        ],
    )


SUMMARY = ["n", "median_s", "p90_s", "p99_s", "mean_s", "min_s", "max_s"]


def summarize(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """LAT2: n, median, p90, p99, mean, min, max. NaN is dropped; no values leave only ``n = 0``."""
    found = interpolated(df, keys, value, {"median_s": 0.5, "p90_s": 0.9, "p99_s": 0.99})
    found = found.withColumnsRenamed({name: f"{name}_s" for name in ("mean", "min", "max")})
    return found.select(*keys, *SUMMARY, "n_present")


def summaries(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], optional: Sequence[str] = ()
) -> DataFrame:
    """LAT2, LAT6: one summary struct per value, all in one pass.

    The struct of an optional value is null as a whole where a group has nothing but nulls.
    """
    long = summarize(melt(df, keys, values), [*keys, MEASURE], F.col(VALUE))
    shown = ~F.col(MEASURE).isin(*optional) | (F.col("n_present") > 0) if optional else F.lit(True)
    return widen(long, keys, list(values), F.when(shown, F.struct(*SUMMARY)))


def nearest_rank(
    df: DataFrame, keys: Sequence[str], value: Column, quantiles: dict[str, float]
) -> DataFrame:
    """LAT3: the value at rank ``q (n - 1)`` rounded half to even."""

    def rank(q: float):
        return lambda n: F.greatest(F.lit(0), F.least(n - 1, F.bround(_at(q)(n)).cast("bigint")))

    return order_statistics(df, keys, value, {name: rank(q) for name, q in quantiles.items()})


def floor_rank(
    df: DataFrame, keys: Sequence[str], value: Column, p50: str = "p50_s", p90: str = "p90_s"
) -> DataFrame:
    """LAT4: upper median, and the value at rank ``0.9 (n - 1)`` rounded down."""
    return order_statistics(
        df, keys, value, {p50: lambda n: F.floor(n / 2), p90: lambda n: F.floor(_at(0.9)(n))}
    )


def run_medians(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """LAT5: textbook median of every latency field over the runs of a group."""
    long = melt(df, keys, {field: F.col(field) for field in fields})
    medians = interpolated(long, [*keys, MEASURE], F.col(VALUE), {"_median": 0.5})
    return widen(medians, keys, fields, F.col("_median"))


def totals(
    df: DataFrame, keys: Sequence[str], speech_s: Column, infer_s: Column
) -> DataFrame:
    """LAT7: seconds of speech and of inference."""
    return df.groupBy(*keys).agg(
        F.sum(speech_s).alias("speech_s"), F.sum(infer_s).alias("infer_s")
    )


def layers(
    decode_s: Column, infer_s: Column, server_s: Column, client_s: Column, load_s: Column
) -> Column:
    """LAT8: the layers of one request side by side, with the time spent outside the server."""
    return F.struct(
        decode_s.alias("decode_s"),
        infer_s.alias("infer_total_s"),
        server_s.alias("server_total_s"),
        client_s.alias("client_total_s"),
        load_s.alias("model_load_s"),
        (client_s - server_s).alias("overhead_s"),
    )
