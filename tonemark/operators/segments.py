"""Segment timelines: absolute times, filters, transcripts, routing, speech windows.

A recording of any length is cut into blocks of windows or of time, so no task holds one recording.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemark.functions.text import strip
from tonemark.plans.blocks import neighbour, null_safe_join, running_max
from tonemark.operators.sampling import joined_text

SAMPLE_RATE = 16_000
MAX_COMPRESSION = 2.4
WINDOW_BLOCK = 4096
TIME_BLOCK_S = 3600.0


def absolute_segments(
    segments: DataFrame, audio: str = "audio_id", rate: int = SAMPLE_RATE
) -> DataFrame:
    """SEG1: local to absolute times that never run backwards and never leave their window.

    Blank texts are dropped. A segment starts no earlier than its window, the end of the last window
    with text, and the segment before it; it ends where the next one starts, the last at the end of
    its window.
    """
    kept = segments.withColumn("text", strip(F.coalesce("text", F.lit("")))).where("text <> ''")
    kept = kept.withColumn("_w0", F.col("win_start") / rate).withColumn("_w1", F.col("win_end") / rate)
    windows = kept.groupBy(audio, "win_idx").agg(F.first("_w1").alias("_end"))
    windows = neighbour(
        windows,
        [audio],
        ["win_idx"],
        F.col("_end"),
        "_floor",
        block=F.floor(F.col("win_idx") / WINDOW_BLOCK),
    )
    rows = null_safe_join(kept, windows.drop("_end"), [audio, "win_idx"], "left")
    inside = Window.partitionBy(audio, "win_idx").orderBy("seg_idx")
    latest = F.max(F.col("_w0") + F.col("start")).over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    start = F.least(F.greatest(latest, F.col("_w0"), F.coalesce("_floor", F.lit(0.0))), F.col("_w1"))
    rows = rows.withColumn("start", start)
    following = F.coalesce(F.lead("start").over(inside), F.col("_w1"))
    rows = rows.withColumn("end", F.greatest(following, F.col("start")))
    return rows.drop("_w0", "_w1", "_floor")


def without_repeats(segments: DataFrame, limit: float = MAX_COMPRESSION) -> DataFrame:
    """SEG2: drop segments whose text compresses too well."""
    return segments.where(F.col("compression_ratio") <= limit)


def transcripts(segments: DataFrame, audio: str = "audio_id") -> DataFrame:
    """SEG3: the text of each recording in time order."""
    by_window = segments.groupBy(audio, "win_idx").agg(joined_text("seg_idx", "text").alias("_text"))
    whole = by_window.groupBy(audio).agg(joined_text("win_idx", "_text").alias("transcript"))
    return whole.withColumn("transcript", strip(F.col("transcript")))


def route(
    duration_s: Column,
    long_from_s: float | None = 30.0,
    windowed: bool = False,
    windowed_from_s: float = 30.0,
) -> Column:
    """SEG4: short, long or windowed decoding, by duration. None turns the long profile off."""
    is_long = F.lit(False) if long_from_s is None else duration_s >= long_from_s
    in_windows = F.lit(windowed) & (duration_s >= windowed_from_s)
    return F.when(in_windows, "windowed").when(is_long, "long").otherwise("short")


def profile_params(
    profile: Column, defaults: Mapping[str, str], long_overrides: Mapping[str, str]
) -> Column:
    """SEG4: decode parameters of a profile; a key without an override is inherited."""
    base = F.create_map(*[F.lit(x) for item in defaults.items() for x in item])
    merged = {**defaults, **long_overrides}
    long = F.create_map(*[F.lit(x) for item in merged.items() for x in item])
    return F.when(profile == "short", base).otherwise(long)


def speech_windows(
    intervals: DataFrame,
    audio: str = "audio_id",
    min_silence_s: float = 0.5,
    pad_s: float = 0.2,
    max_s: float = 28.0,
) -> DataFrame:
    """SEG5: merge speech over short silences, pad, and cut what is too long.

    Intervals are ``start`` and ``end`` in seconds. Padding never crosses the middle of a silence
    nor the start of the recording, so the windows are sorted and do not overlap.
    """
    block = F.floor(F.col("start") / TIME_BLOCK_S)
    order = ["start", "end"]
    rows = intervals.select(audio, "start", "end").distinct()
    rows = running_max(rows, [audio], order, F.col("end"), "_reach", block)
    opens = F.col("_reach").isNull() | (F.col("start") - F.col("_reach") >= min_silence_s)
    # an island is named by the start of its first interval, the last opening seen so far
    rows = rows.withColumn("_open", F.when(opens, F.col("start")))
    rows = running_max(rows, [audio], order, F.col("_open"), "_last", block)
    rows = rows.withColumn("_island", F.coalesce("_open", "_last"))
    islands = rows.groupBy(audio, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    islands = neighbour(islands, [audio], ["start"], F.col("end"), "_prev", block)
    islands = neighbour(islands, [audio], ["start"], F.col("start"), "_next", block, ahead=True)
    left = F.least(F.lit(pad_s), F.coalesce((F.col("start") - F.col("_prev")) / 2, F.col("start")))
    right = F.least(F.lit(pad_s), F.coalesce((F.col("_next") - F.col("end")) / 2, F.lit(pad_s)))
    padded = islands.select(
        audio, (F.col("start") - left).alias("_from"), (F.col("end") + right).alias("_to")
    )
    pieces = F.greatest(F.lit(1), F.ceil((F.col("_to") - F.col("_from")) / max_s)).cast("int")
    cut = padded.select("*", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("_piece"))
    begin = F.col("_from") + F.col("_piece") * max_s
    return cut.select(
        audio, begin.alias("win_start_s"), F.least(begin + max_s, F.col("_to")).alias("win_end_s")
    )
