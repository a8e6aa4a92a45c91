"""Gates: measured values against thresholds held as rows; model and setting comparisons."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonemark.functions.text import normalize
from tonemark.operators.accuracy import (
    CHAR_RATE,
    RATE_ONLY,
    View,
    bad_row_pct,
    empty_count,
    pooled_parts,
    pooled_rate,
    row_rate,
    with_edits,
)
from tonemark.operators.latency import floor_rank
from tonemark.operators.quality import AUDIO_RULES, TEXT_RULES
from tonemark.plans.blocks import null_safe_join
from tonemark.schemas import THRESHOLDS

# The gate profiles as (group, name, comparison, threshold).
ASR_GATES = [
    ("per_utterance", "wer_max", "<=", 0.070),
    ("per_utterance", "cer_max", "<=", 0.040),
    ("per_utterance", "infer_p50_max_s", "<=", 1.9),
    ("per_utterance", "infer_p90_max_s", "<=", 2.4),
    ("per_utterance", "empty_hyp_max", "<=", 0.0),
    ("longform", "wer_max", "<=", 0.105),
    ("longform", "rtf_max", "<=", 0.20),
    ("determinism", "mismatches_max", "<=", 0.0),
]
TTS_GATES = [
    ("tts", "min_dur_s", ">=", 3.0),
    ("tts", "min_rms", ">=", 0.01),
    ("tts", "rtf_max", "<=", 1.6),
    ("tts", "roundtrip_wer_max", "<=", 0.35),
]
DATA_GATES = [
    *[("text", rule, "<=", limit) for rule, (_, limit) in TEXT_RULES.items()],
    *[("audio", rule, "<=", limit) for rule, (_, limit) in AUDIO_RULES.items()],
    ("integrity", "INT-dup-text", "<=", 2.0),
    ("integrity", "INT-rep-text", "<=", 5.0),
    ("integrity", "INT-dup-audio", "<=", 0.0),
    ("integrity", "INT-eval-contam", "<=", 0.0),
    ("qc", "DST-qc-n", ">=", 300.0),
    ("qc", "DST-qc-wer", "<=", 0.10),
    ("qc", "DST-qc-badrows", "<=", 1.5),
]
QC_MIN_ROWS = 300


def threshold_table(spark: SparkSession, rules: Iterable[tuple]) -> DataFrame:
    """SRC5: thresholds as rows. The list is written by hand and has a few dozen entries."""
    return spark.createDataFrame(list(rules), THRESHOLDS)


def measures(df: DataFrame, keys: Sequence[str], group: str, columns: Sequence[str]) -> DataFrame:
    """Metric columns as rows of (grp, name, measured)."""
    casted = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    long = casted.unpivot(list(keys), list(columns), "name", "measured")
    return long.select(*keys, F.lit(group).alias("grp"), "name", "measured")


def gate(measured: DataFrame, thresholds: DataFrame, absent_fails: bool = True) -> DataFrame:
    """GATE1, GATE3: one row per threshold of each group that was measured; limits are inclusive.

    A threshold whose value is absent from a measured group fails, unless the measurement decides
    by itself which rules apply. A group of which nothing was measured has no rows.
    """
    keys = [c for c in measured.columns if c not in ("grp", "name", "measured")]
    # a group has a few measurements; gathered in one row they are read, and made, only once
    groups = measured.groupBy(*keys, "grp").agg(F.collect_list(F.struct("name", "measured")).alias("_all"))
    joined = groups.join(thresholds, "grp")
    named = F.filter("_all", lambda m: m["name"] == F.col("name"))["measured"]
    unfold = F.explode_outer if absent_fails else F.explode
    joined = joined.select(
        *keys, "grp", "name", unfold(named).alias("measured"),
        *[c for c in thresholds.columns if c not in ("grp", "name")],
    )
    value, limit = F.col("measured"), F.col("threshold")
    passed = F.when(F.col("op") == "<=", value <= limit).otherwise(value >= limit)
    # NaN sorts above every number in Spark but fails every comparison as a measurement
    passed = F.coalesce(passed & ~F.isnan(value), F.lit(False))
    return joined.withColumn("passed", passed)


def verdict(gates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """GATE2: gates passed, gates in total, and the verdict."""
    counts = gates.groupBy(*keys).agg(
        F.count_if("passed").alias("n_pass"), F.count(F.lit(1)).alias("n_gates")
    )
    failed = (F.col("n_gates") - F.col("n_pass")).cast("string")
    text = F.when(F.col("n_pass") == F.col("n_gates"), F.lit("PASS")).otherwise(
        F.concat(F.lit("FAIL ("), failed, F.lit(" gate)"))
    )
    return counts.withColumn("verdict", text)


def benchmark_measures(
    results: DataFrame, keys: Sequence[str], ref: Column, hyp: Column, infer_s: Column
) -> DataFrame:
    """GATE4: the per-utterance measurements, named like their gates."""
    scored = with_edits(results, ref, {"_w": (hyp, RATE_ONLY), "_c": (hyp, CHAR_RATE)})
    rates = scored.groupBy(*keys).agg(
        pooled_rate(F.col("_w")).alias("wer_max"),
        pooled_rate(F.col("_c")).alias("cer_max"),
        empty_count(hyp).alias("empty_hyp_max"),
    )
    speed = floor_rank(results, keys, infer_s, "infer_p50_max_s", "infer_p90_max_s")
    return null_safe_join(rates, speed, keys, "left")


def longform_measures(
    results: DataFrame, keys: Sequence[str], ref: Column, hyp: Column, rtf: Column
) -> DataFrame:
    """GATE4: WER and real-time factor of long recordings."""
    scored = with_edits(results, ref, {"_w": (hyp, RATE_ONLY)})
    return scored.groupBy(*keys).agg(
        pooled_rate(F.col("_w")).alias("wer_max"), F.max(rtf).alias("rtf_max")
    )


def product_measures(
    results: DataFrame, keys: Sequence[str], ref: Column, hyp: Column, infer_s: Column, is_long: Column, rtf: Column
) -> DataFrame:
    """GATE4 over one table of short and long recordings, scored once: rows of (grp, name, measured)."""
    scored = with_edits(results.withColumn("_long", is_long), ref, {"_w": (hyp, RATE_ONLY), "_c": (hyp, CHAR_RATE)})
    long, short = F.col("_long"), ~F.col("_long")
    rates = scored.groupBy(*keys).agg(
        pooled_rate(F.when(short, F.col("_w"))).alias("wer_max"),
        pooled_rate(F.when(short, F.col("_c"))).alias("cer_max"),
        empty_count(F.when(short, F.coalesce(hyp, F.lit(""))).otherwise("-")).alias("empty_hyp_max"),
        pooled_rate(F.when(long, F.col("_w"))).alias("long_wer"),
        F.max(F.when(long, rtf)).alias("rtf_max"),
    )
    speed = floor_rank(results.where(~is_long), keys, infer_s, "infer_p50_max_s", "infer_p90_max_s")
    both = null_safe_join(rates, speed, keys, "left")
    found = [("per_utterance", c, c) for c in ("wer_max", "cer_max", "infer_p50_max_s", "infer_p90_max_s", "empty_hyp_max")]
    found += [("longform", "wer_max", "long_wer"), ("longform", "rtf_max", "rtf_max")]
    rows = [
        F.struct(F.lit(g).alias("grp"), F.lit(n).alias("name"), F.col(c).cast("double").alias("measured"))
        for g, n, c in found
    ]
    # in one go, so that both groups come from one scoring
    return both.select(*keys, F.inline(F.array(*rows)))


def roundtrip_measure(results: DataFrame, keys: Sequence[str], ref: Column, heard: Column) -> DataFrame:
    """GATE4: WER of the transcript of synthesised speech against the text it was made from."""
    scored = with_edits(results, ref, {"_w": (heard, RATE_ONLY)})
    flat = scored.groupBy(*keys).agg(pooled_rate(F.col("_w")).alias("roundtrip_wer_max"))
    return measures(flat, keys, "tts", ["roundtrip_wer_max"])


def rerun_mismatches(first: DataFrame, second: DataFrame, key: str, text: str) -> DataFrame:
    """GATE5: ids whose second run differs from the first in scoring form, or is missing."""
    left = first.select(key, F.col(text).alias("run1"))
    right = second.select(key, F.col(text).alias("run2"), F.lit(True).alias("_rerun"))
    both = left.join(right, key, "left")
    both = both.withColumn("_n1", normalize(F.col("run1"))).withColumn("_n2", normalize(F.col("run2")))
    differs = F.col("_rerun").isNull() | (F.col("_n1") != F.col("_n2"))
    return both.where(differs).drop("_n1", "_n2", "_rerun")


def determinism_measure(
    first: DataFrame, second: DataFrame, key: str, text: str, repeat_n: int | None = None
) -> DataFrame:
    """GATE5: the number of mismatches as a gate's measurement, over the first ``repeat_n`` ids."""
    if repeat_n is not None:
        first = first.orderBy(key).limit(repeat_n)
    flat = rerun_mismatches(first, second, key, text).agg(F.count(F.lit(1)).alias("mismatches_max"))
    return measures(flat, [], "determinism", ["mismatches_max"])


def unstable_runs(runs: DataFrame, key: str, run: str, text: str) -> DataFrame:
    """GATE6: runs whose raw text is not that of the input's first run."""
    first = runs.groupBy(key).agg(F.min_by(text, run).alias("_first"))
    joined = runs.join(first, key)
    return joined.where(~F.col(text).eqNullSafe(F.col("_first"))).drop("_first")


def qc_measures(checked: DataFrame, keys: Sequence[str], ref: Column, hyp: Column) -> DataFrame:
    """GATE7: rows checked, pooled WER and bad rows; too few rows leave only the row count."""
    scored = with_edits(checked, ref, {"_w": (hyp, RATE_ONLY)})
    flat = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("DST-qc-n"),
        pooled_rate(F.col("_w")).alias("DST-qc-wer"),
        bad_row_pct(F.col("_w")).alias("DST-qc-badrows"),
    )
    long = measures(flat, [*keys, "DST-qc-n"], "qc", ["DST-qc-wer", "DST-qc-badrows"])
    rows = F.col("DST-qc-n")
    enough = long.where(rows >= QC_MIN_ROWS).drop("DST-qc-n")
    count = measures(flat.where(rows < QC_MIN_ROWS), keys, "qc", ["DST-qc-n"])
    return enough.unionByName(count)


def compare_models(
    results: DataFrame,
    model: str,
    ref: Column,
    hyp: Column,
    infer_s: Column,
    media_s: Column,
    long_s: float = 30.0,
) -> DataFrame:
    """CMP1: accuracy, folded accuracy, edit breakdown, speed and blanks per model, and for recordings
    of at least ``long_s`` seconds their WER, deletions, seconds and real-time factor."""
    scored = with_edits(
        results.withColumn("_long", media_s >= long_s),
        ref,
        {"_w": (hyp, View()), "_f": (hyp, RATE_ONLY._replace(fold=True)), "_c": (hyp, CHAR_RATE)},
    )
    long = F.col("_long")
    table = scored.groupBy(model).agg(
        *pooled_parts(F.col("_w")),
        pooled_rate(F.col("_f")).alias("wer_folded"),
        pooled_rate(F.col("_c")).alias("cer"),
        empty_count(hyp).alias("empty_hyps"),
        pooled_rate(F.when(long, F.col("_w"))).alias("long_wer"),
        F.sum(F.when(long, F.col("_w.dels"))).alias("long_deletions"),
        F.sum(F.when(long, infer_s)).alias("long_infer_s"),
        (F.sum(F.when(long, infer_s)) / F.sum(F.when(long, media_s))).alias("long_rtf"),
    )
    speed = floor_rank(results, [model], infer_s, "infer_p50_s", "infer_p90_s")
    return null_safe_join(table, speed, [model], "left")


def compare_settings(table: DataFrame, setting: str, order: str) -> DataFrame:
    """CMP2: each setting with its distance to the first one, and whether it is the best.

    The best has the lowest WER, then the lowest time. The table has one row per setting.
    """
    # one row per setting, so one window over all of them is small; the table is scored once
    everything = Window.partitionBy()
    joined = table.select(
        "*",
        F.min_by(setting, F.struct("wer", "infer_s", order)).over(everything).alias("_best"),
        F.min_by("wer", order).over(everything).alias("_base_wer"),
        F.min_by("infer_s", order).over(everything).alias("_base_s"),
    )
    return joined.select(
        *table.columns,
        (F.col("wer") - F.col("_base_wer")).alias("wer_vs_first"),
        (F.col("infer_s") - F.col("_base_s")).alias("infer_s_vs_first"),
        (F.col(setting) == F.col("_best")).alias("is_best"),
    )


def flag_rows(results: DataFrame, ref: Column, hyp: Column, out: str = "wer") -> DataFrame:
    """Row-level WER next to the pair, as the quality check of a set keeps it."""
    scored = with_edits(results, ref, {"_w": (hyp, RATE_ONLY)})
    return scored.withColumn(out, row_rate(F.col("_w"))).drop("_w")
