"""Sample records from stage tables, failures, and the full report of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark.functions.text import normalize
from tonemark.functions.vectors import cosine
from tonemark.operators.accuracy import CHAR_RATE, View, pooled_rate, with_edits
from tonemark.operators.latency import summaries
from tonemark.operators.stats import intervals
from tonemark.plans.blocks import null_safe_join


def synthesis_input(source: Column, ref: Column, first_pass: Column) -> Column:
    """REC2: what is synthesised, the reference text or the first transcript."""
    return F.when(source == "ref_text", ref).otherwise(first_pass)


def voice_similarity(supports_cloning: Column, a: Column, b: Column) -> Column:
    """REC3: cosine of the voice vectors, null for an engine that cannot clone a voice."""
    return F.when(supports_cloning, cosine(a, b))


def assemble(
    manifest: DataFrame,
    first_pass: DataFrame,
    synthesis: DataFrame,
    second_pass: DataFrame,
    key: str = "id",
    source: Column | None = None,
    scores: Sequence[str] = ("speaker_sim", "mos"),
) -> DataFrame:
    """REC1: one record per sample that passed all stages.

    The stage tables hold ``asr_text, asr_latency``; ``tts_latency`` and optional scores; and
    ``roundtrip_text``. All joins are on the id, so the tables may be bucketed by it.
    """
    rows = manifest.join(first_pass, key).join(synthesis, key).join(second_pass, key)
    source = F.lit("ref_text") if source is None else source
    empty = F.lit(None).cast("double")
    return rows.select(
        F.col(key).cast("string").alias("sample_id"),
        F.col("text").alias("ref_text"),
        "asr_text",
        "roundtrip_text",
        "asr_latency",
        "tts_latency",
        *[(F.col(s) if s in rows.columns else empty).alias(s) for s in scores],
        F.create_map(F.lit("tts_input_source"), source).alias("extra"),
    )


def failures(manifest: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """REC4: manifest rows without a record."""
    done = records.select(F.col("sample_id").alias("_done"))
    return manifest.join(done, F.col(key).cast("string") == F.col("_done"), "left_anti")


def run_counts(manifest: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """REC4: rows in the manifest, rows with a record, rows that failed."""
    done = records.select(F.col("sample_id").alias("_done")).withColumn("_ok", F.lit(True))
    joined = manifest.join(done, F.col(key).cast("string") == F.col("_done"), "left")
    return joined.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if("_ok").alias("n_results"),
        F.count_if(F.col("_ok").isNull()).alias("n_failed"),
    )


def report(
    records: DataFrame, keys: Sequence[str], keep_tone: bool | Column = True, **ci_options
) -> DataFrame:
    """REC5: accuracy, latency and fidelity of each run, one row per key.

    ``keep_tone`` may be a column, the setting of each record's run (SRC6); the keys should not mix
    runs of both kinds.
    """
    setting = F.lit(keep_tone) if isinstance(keep_tone, bool) else keep_tone
    if not isinstance(keep_tone, bool):
        # texts of runs without tone lose it here, so that all runs are scored together
        texts = ("ref_text", "asr_text", "roundtrip_text")
        forms = {t: F.when(setting, normalize(F.col(t))).otherwise(normalize(F.col(t), keep_tone=False)) for t in texts}
        records = records.withColumn("_keep", setting).withColumns(forms)
        setting, keep_tone = F.col("_keep"), True
    else:
        records = records.withColumn("_keep", setting)
    ref = F.col("ref_text")
    asr, rt = F.col("asr_text"), F.col("roundtrip_text")
    word = View(keep_tone=keep_tone)
    rate, char = word._replace(parts=False), CHAR_RATE._replace(keep_tone=keep_tone)
    scored = with_edits(
        records.select(*keys, "_keep", "ref_text", "asr_text", "roundtrip_text"),
        ref,
        {"_aw": (asr, word), "_ac": (asr, char), "_rw": (rt, rate), "_rc": (rt, char)},
    )
    table = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        pooled_rate(F.col("_aw")).alias("asr_wer"),
        pooled_rate(F.col("_ac")).alias("asr_cer"),
        pooled_rate(F.col("_rw")).alias("rt_wer"),
        pooled_rate(F.col("_rc")).alias("rt_cer"),
        F.sum("_aw.subs").alias("substitutions"),
        F.sum("_aw.dels").alias("deletions"),
        F.sum("_aw.ins").alias("insertions"),
        F.bool_and("_keep").alias("keep_tone"),
    )
    table = table.withColumn("delta_wer", F.col("rt_wer") - F.col("asr_wer"))
    speed = summaries(
        records,
        keys,
        {
            "asr_latency": F.col("asr_latency.total_s"),
            "asr_rtf": F.col("asr_latency.rtf"),
            "tts_latency": F.col("tts_latency.total_s"),
            "tts_rtf": F.col("tts_latency.rtf"),
            "tts_ttfa": F.col("tts_latency.ttfa_s"),
        },
        optional=["tts_ttfa"],
    )
    scores = {name: F.col(name) for name in ("speaker_sim", "mos")}
    fidelity = intervals(records, keys, scores, **ci_options)
    table = null_safe_join(table, speed, keys, "left")
    return null_safe_join(table, fidelity, keys, "left")


def report_rows(aggregate: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SNK3: the report as rows of (section, metric, stat, value); absent blocks give no row."""
    cells = [
        ("accuracy", "asr", "wer", "asr_wer"),
        ("accuracy", "asr", "cer", "asr_cer"),
        ("accuracy", "roundtrip", "wer", "rt_wer"),
        ("accuracy", "roundtrip", "cer", "rt_cer"),
        ("accuracy", "delta", "wer", "delta_wer"),
        ("accuracy", "asr", "substitutions", "substitutions"),
        ("accuracy", "asr", "deletions", "deletions"),
        ("accuracy", "asr", "insertions", "insertions"),
        ("latency", "asr", "median_s", "asr_latency.median_s"),
        ("latency", "asr", "p90_s", "asr_latency.p90_s"),
        ("latency", "asr", "rtf_median", "asr_rtf.median_s"),
        ("latency", "tts", "median_s", "tts_latency.median_s"),
        ("latency", "tts", "p90_s", "tts_latency.p90_s"),
        ("latency", "tts", "rtf_median", "tts_rtf.median_s"),
        ("latency", "ttfa", "median_s", "tts_ttfa.median_s"),
        ("latency", "ttfa", "p90_s", "tts_ttfa.p90_s"),
        *[
            ("fidelity", score, stat, f"{score}.{stat}")
            for score in ("speaker_sim", "mos")
            for stat in ("point", "low", "high", "n")
        ],
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(section).alias("section"),
                F.lit(metric).alias("metric"),
                F.lit(stat).alias("stat"),
                F.col(column).cast("double").alias("value"),
            )
            for section, metric, stat, column in cells
        ]
    )
    return (
        aggregate.select(*keys, F.inline(rows))
        .where(F.col("value").isNotNull())
    )
