"""Schemas of the tables that go in and out. Files are never read with inferred types."""

from __future__ import annotations

from pyspark.sql import types as T

_LATENCY = (
    "struct<total_s: double, media_dur_s: double, model_load_s: double, "
    "ttfa_s: double, first_token_s: double, rtf: double>"
)

MANIFEST = "id string, audio string, text string"
STANDARD_MANIFEST = (
    "id string, audio string, text string, source string, license string, duration_s double, "
    "bucket string, tags array<string>, gender int"
)
RAW_MANIFEST = "id string, audio string, text string, text_raw string"
GATE_SET = "id string, audio string, dur_s double, text string"
OOD_SET = "id string, audio string, text string, duration double, accent string, role string"
UNNAMED_SET = "audio string, text string"
SAMPLE_RECORD = (
    "sample_id string, ref_text string, asr_text string, roundtrip_text string, "
    f"asr_latency {_LATENCY}, tts_latency {_LATENCY}, speaker_sim double, mos double, "
    "extra map<string, string>"
)
RUN_META = "config struct<keep_tone: boolean>, n_samples bigint"
THRESHOLDS = "grp string, name string, op string, threshold double"
SEGMENT = (
    "audio_id string, win_idx int, win_start bigint, win_end bigint, seg_idx int, start double, "
    "end double, text string, avg_logprob double, no_speech_prob double, compression_ratio double"
)
AUDIO_FEATURES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("rms", T.DoubleType()),
        T.StructField("clip_ratio", T.DoubleType()),
        T.StructField("sha1", T.StringType()),
    ]
)
