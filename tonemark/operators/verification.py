"""Verification of a data set: text, audio, integrity and check-transcript gates in one result."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemark.operators.gates import gate, measures, qc_measures
from tonemark.operators.integrity import contamination_count, copies_report, copy_counts, text_digest
from tonemark.operators.quality import (
    AUDIO_RULES,
    TEXT_RULES,
    audio_flags,
    audio_percentages,
    text_percentages,
)

INTEGRITY_GATES = ["INT-dup-text", "INT-rep-text", "INT-dup-audio", "INT-eval-contam"]


def integrity_measures(
    rows: DataFrame, keys: Sequence[str], text: Column, content_digest: Column, eval_keys: DataFrame
) -> DataFrame:
    """INT1-INT4 as gate measurements; copies are counted before anything is joined."""
    texts = copies_report(copy_counts(rows, keys, text_digest(text)), keys)
    audio = copies_report(copy_counts(rows, keys, content_digest), keys)
    seen = contamination_count(rows, keys, eval_keys, text)
    parts = [
        texts.select(*keys, F.col("dup_pct").alias("INT-dup-text"), F.col("max_repeat").alias("INT-rep-text")),
        audio.select(*keys, F.col("extra_copies").alias("INT-dup-audio")),
        seen.select(*keys, F.col("n_contaminated").alias("INT-eval-contam")),
    ]
    long = [measures(p, keys, "integrity", [c for c in p.columns if c not in keys]) for p in parts]
    return reduce(DataFrame.unionByName, long)


def verify(
    rows: DataFrame,
    keys: Sequence[str],
    thresholds: DataFrame,
    text: Column,
    sample_rate: Column,
    duration_s: Column,
    rms: Column,
    clip_ratio: Column,
    content_digest: Column,
    eval_keys: DataFrame,
    checked: DataFrame,
    ref: Column,
    hyp: Column,
) -> DataFrame:
    """Every gate of every set with its verdict over all of them.

    ``checked`` holds the rows that have a check transcript; with too few of them the count itself
    is the gate that fails.
    """
    flagged = audio_flags(rows, sample_rate, duration_s, rms, clip_ratio, text)
    measured = measures(text_percentages(rows, keys, text), keys, "text", list(TEXT_RULES))
    measured = measured.unionByName(measures(audio_percentages(flagged, keys), keys, "audio", list(AUDIO_RULES)))
    measured = measured.unionByName(integrity_measures(rows, keys, text, content_digest, eval_keys))
    gates = gate(measured, thresholds)
    quality = gate(qc_measures(checked, keys, ref, hyp), thresholds, absent_fails=False)
    gates = gates.unionByName(quality)
    whole = Window.partitionBy(*keys)
    n_pass, n_gates = F.count_if("passed").over(whole), F.count(F.lit(1)).over(whole)
    return gates.withColumns({"n_pass": n_pass, "n_gates": n_gates, "set_ok": n_pass == n_gates})
