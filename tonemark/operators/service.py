"""Reports over requests to a recognition service: latency, totals and accuracy side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark.operators.accuracy import View, pooled_parts, pooled_rate, with_edits
from tonemark.plans.blocks import null_safe_join
from tonemark.plans.melt import MEASURE, VALUE, melt, widen
from tonemark.plans.order_stats import order_statistics, usable


def _quantiles(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """One struct ``p50, p90`` for each value: the textbook median, and the value at rank
    ``0.9 (n - 1)`` rounded half to even. All values share one search for ranks."""
    ranks = {
        "_low": lambda n: F.floor((n - 1) / 2),
        "_high": lambda n: F.floor(n / 2),
        "_p90": lambda n: F.least(n - 1, F.bround((n - 1) * F.lit(0.9)).cast("bigint")),
    }
    found = order_statistics(melt(df, keys, values), [*keys, MEASURE], F.col(VALUE), ranks)
    block = F.struct(((F.col("_low") + F.col("_high")) / 2).alias("p50"), F.col("_p90").alias("p90"))
    return widen(found, keys, list(values), block)


def request_report(
    requests: DataFrame,
    keys: Sequence[str],
    ref: Column,
    hyp: Column,
    latencies: Mapping[str, Column],
    speech_s: Column,
    infer_s: Column,
) -> DataFrame:
    """One row per group of one-request-per-clip runs: number of clips, seconds of speech and of
    inference, median and 90th percentile of every latency, and accuracy with and without tones.

    Null and NaN latencies are left out; a latency without values has a null struct. The pairs behind a
    report stay rows of ``requests``.
    """
    targets = {
        f"_{unit}{tone}": (hyp, View(unit, keep_tone=not tone, parts=unit == "word"))
        for unit in ("word", "char")
        for tone in ("", "_no_tone")
    }
    timed = requests.withColumns({"_speech": speech_s, "_infer": infer_s})
    scored = with_edits(timed, ref, targets)
    totals = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_clips"),
        F.sum("_speech").alias("speech_s"),
        F.sum("_infer").alias("infer_s"),
        *pooled_parts(F.col("_word")),
        pooled_rate(F.col("_char")).alias("cer"),
        *pooled_parts(F.col("_word_no_tone"), prefix="no_tone_"),
        pooled_rate(F.col("_char_no_tone")).alias("no_tone_cer"),
    )
    return null_safe_join(totals, _quantiles(requests, keys, latencies), keys, "left")


def repeat_report(
    runs: DataFrame, keys: Sequence[str], latencies: Mapping[str, Column], spread: str
) -> DataFrame:
    """One row per file that was sent several times: number of runs, the median of every latency, and
    the smallest and largest of the one named ``spread``."""
    kept = F.when(usable(latencies[spread]), latencies[spread])
    plain = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"), F.min(kept).alias(f"{spread}_min"), F.max(kept).alias(f"{spread}_max")
    )
    medians = _quantiles(runs, keys, latencies)
    medians = medians.select(*keys, *[F.col(f"{name}.p50").alias(name) for name in latencies])
    return null_safe_join(plain, medians, keys, "left")
