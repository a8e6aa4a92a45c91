"""SEG1-SEG5: conversation turns as segments, events as stretches of speech."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonemark.functions.text import SPACE
from tonemark.operators import segments as sg
from tonemark.queries.base import Check, table

_RATE = sg.SAMPLE_RATE


def local_segments(spark, sf):
    """Two turns per window of ten seconds; every third recording has overlapping windows."""
    win = F.floor(F.col("turn") / 2)
    overlap = F.when(F.col("conv_id") % 3 == 0, win * 2 * _RATE).otherwise(0)
    begin = win * 10 * _RATE - overlap
    start = F.length("text") % 97 / 10
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("audio_id"),
        win.alias("win_idx"),
        begin.alias("win_start"),
        (begin + 10 * _RATE).alias("win_end"),
        F.col("turn").alias("seg_idx"),
        start.alias("start"),
        (start + 0.02).alias("end"),
        F.when(F.col("role") == "system", F.lit(" \t")).otherwise(F.col("text")).alias("text"),
        F.lit(-0.1).alias("avg_logprob"),
        F.lit(0.0).alias("no_speech_prob"),
        (F.length("text") % 40 / 10).alias("compression_ratio"),
    )


SQL_SEGMENTS = f"""
segments AS (
  SELECT conv_id AS audio_id, turn // 2 AS win_idx, turn AS seg_idx,
         (turn // 2 * 10 - CASE WHEN conv_id % 3 = 0 THEN turn // 2 * 2 ELSE 0 END)::DOUBLE AS w0,
         (turn // 2 * 10 - CASE WHEN conv_id % 3 = 0 THEN turn // 2 * 2 ELSE 0 END)::DOUBLE + 10 AS w1,
         length(text) % 97 / 10.0::DOUBLE AS start, length(text) % 40 / 10.0::DOUBLE AS ratio,
         CASE WHEN role = 'system' THEN '' ELSE regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') END AS text
  FROM conversations
)"""


def _seg1(spark, sf):
    rows = sg.absolute_segments(local_segments(spark, sf))
    return rows.select(
        "audio_id", "seg_idx", "text", F.round("start", 6).alias("start"), F.round("end", 6).alias("end")
    )


_SQL_SEG1 = f"""
WITH {SQL_SEGMENTS},
kept AS (SELECT * FROM segments WHERE text <> ''),
wins AS (
  SELECT audio_id, win_idx, coalesce(lag(any_value(w1)) OVER (PARTITION BY audio_id ORDER BY win_idx), 0) AS floor
  FROM kept GROUP BY audio_id, win_idx
),
placed AS (
  SELECT k.*, least(greatest(max(w0 + start) OVER (PARTITION BY audio_id, win_idx ORDER BY seg_idx), w0, floor), w1) AS s
  FROM kept k JOIN wins USING (audio_id, win_idx)
)
SELECT audio_id, seg_idx, text, round(s, 6) AS start,
       round(greatest(coalesce(lead(s) OVER (PARTITION BY audio_id, win_idx ORDER BY seg_idx), w1), s), 6) AS end
FROM placed
"""


def _seg2(spark, sf):
    return sg.without_repeats(local_segments(spark, sf)).select("audio_id", "seg_idx", "compression_ratio")


def _seg3(spark, sf):
    return sg.transcripts(sg.absolute_segments(sg.without_repeats(local_segments(spark, sf))))


_SQL_SEG3 = f"""
WITH {SQL_SEGMENTS}
SELECT audio_id, string_agg(text, ' ' ORDER BY seg_idx) AS transcript
FROM segments WHERE text <> '' AND ratio <= 2.4 GROUP BY audio_id
"""


def _seg4(spark, sf):
    seconds = F.col("n_chars") / 100
    profile = sg.route(seconds)
    beam = {"beam_size": "5", "vad_filter": "true", "condition_on_previous_text": "true"}
    params = sg.profile_params(profile, beam, {"condition_on_previous_text": "false"})
    return table(spark, sf, "documents").select(
        "doc_id",
        profile.alias("profile"),
        sg.route(seconds, None).alias("without_long"),
        sg.route(seconds, windowed=True, windowed_from_s=60.0).alias("with_windows"),
        params["beam_size"].alias("beam_size"),
        params["condition_on_previous_text"].alias("condition"),
    )


_SQL_SEG4 = """
SELECT doc_id, CASE WHEN n_chars >= 3000 THEN 'long' ELSE 'short' END AS profile, 'short' AS without_long,
       CASE WHEN n_chars >= 6000 THEN 'windowed' WHEN n_chars >= 3000 THEN 'long' ELSE 'short' END AS with_windows,
       '5' AS beam_size, CASE WHEN n_chars >= 3000 THEN 'false' ELSE 'true' END AS condition
FROM documents
"""


def _seg5(spark, sf):
    # seconds since the first day of the events; the difference does not depend on the time zone
    first = F.lit("2024-01-01").cast("timestamp_ntz").cast("timestamp")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(first)) / 1_000_000
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("audio_id"),
        start.alias("start"),
        (start + F.col("value")).alias("end"),
    )
    windows = sg.speech_windows(rows)
    return windows.select(
        "audio_id", F.round("win_start_s", 7).alias("win_start_s"), F.round("win_end_s", 7).alias("win_end_s")
    )


_SQL_SEG5 = """
WITH speech AS (
  SELECT DISTINCT event_type AS audio_id, (epoch_us(ts) - 1704067200000000) / 1000000::DOUBLE AS s,
         (epoch_us(ts) - 1704067200000000) / 1000000::DOUBLE + value AS e
  FROM events
),
reach AS (
  SELECT *, max(e) OVER (PARTITION BY audio_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
  FROM speech
),
numbered AS (
  SELECT *, sum(CASE WHEN r IS NULL OR s - r >= 0.5 THEN 1 ELSE 0 END)
            OVER (PARTITION BY audio_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
  FROM reach
),
islands AS (SELECT audio_id, min(s) AS s, max(e) AS e FROM numbered GROUP BY audio_id, island),
around AS (
  SELECT *, lag(e) OVER w AS p, lead(s) OVER w AS n FROM islands WINDOW w AS (PARTITION BY audio_id ORDER BY s)
),
padded AS (
  SELECT audio_id, s - least(0.2, coalesce((s - p) / 2, s)) AS a, e + least(0.2, coalesce((n - e) / 2, 0.2)) AS b
  FROM around
),
cut AS (
  SELECT *, unnest(range(greatest(1, ceil((b - a) / 28.0)::BIGINT))) AS piece FROM padded
)
SELECT audio_id, round(a + piece * 28.0::DOUBLE, 7) AS win_start_s,
       round(least(a + piece * 28.0::DOUBLE + 28, b), 7) AS win_end_s
FROM cut
"""

QUERIES = {
    "SEG1": Check(_seg1, _SQL_SEG1),
    "SEG2": Check(
        _seg2,
        f"WITH {SQL_SEGMENTS} SELECT audio_id, seg_idx, ratio AS compression_ratio FROM segments WHERE ratio <= 2.4",
    ),
    "SEG3": Check(_seg3, _SQL_SEG3),
    "SEG4": Check(_seg4, _SQL_SEG4),
    "SEG5": Check(_seg5, _SQL_SEG5),
}
