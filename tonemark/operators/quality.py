"""Quality flags of transcripts and of audio features, as row flags, percentages and counts.

All flags of a row come from one scan; percentages are over all rows, blank ones included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark.functions.text import (
    ODD_SPACE_CLASS,
    PUNCT_CLASS,
    is_blank,
    match_key,
    nfc,
    outside_alphabet,
    repair_for_training,
    word_count,
)
from tonemark.plans.session import made_once

# Rule names in report order, the flag each one reads, and its limit in percent.
TEXT_RULES = {
    "TXT-empty": ("is_empty", 0.0),
    "TXT-uppercase": ("has_upper", 0.0),
    "TXT-punct": ("has_punct", 0.5),
    "TXT-digit": ("has_digit", 0.5),
    "TXT-nfc": ("not_composed", 0.0),
    "TXT-whitespace": ("has_odd_space", 0.5),
    "TXT-charset": ("outside_alphabet", 0.5),
    "TXT-minwords": ("too_short", 0.5),
}
AUDIO_RULES = {
    "AUD-samplerate": ("wrong_rate", 0.0),
    "AUD-dur": ("odd_duration", 1.0),
    "AUD-rms": ("quiet", 1.0),
    "AUD-clip": ("clipped", 1.5),
    "AUD-wps": ("odd_speed", 2.0),
}
MIN_WORDS = 2
SAMPLE_RATE = 16_000
DURATION_S = (0.8, 30.0)
MIN_RMS = 0.005
MAX_CLIP_RATIO = 0.01
WORDS_PER_S = (0.5, 6.5)
LONG_CLIP_S = 10.0
MIX_LONG_PCT = 10.0
MAX_DROP_PCT = 5.0


def text_flags(df: DataFrame, text: Column, min_words: int = MIN_WORDS) -> DataFrame:
    """TQ1-TQ8: one boolean column per text rule. Null counts as blank; blank rows raise one flag."""
    df = made_once(df, {"_text": F.coalesce(text, F.lit(""))})
    df = made_once(df, {"_composed": nfc(F.col("_text"))})
    raw, composed = F.col("_text"), F.col("_composed")
    blank = is_blank(raw)
    flags = {
        "has_upper": raw.rlike("\\p{Lu}"),
        "has_punct": raw.rlike(PUNCT_CLASS),
        "has_digit": raw.rlike("[0-9]"),
        "not_composed": raw != composed,
        "has_odd_space": raw.rlike(ODD_SPACE_CLASS),
        "outside_alphabet": F.lower(composed).rlike(outside_alphabet()),
        "too_short": word_count(composed) < min_words,
    }
    columns = {"is_empty": blank, **{name: ~blank & flag for name, flag in flags.items()}}
    return df.withColumns(columns).drop("_text", "_composed")


def percentage(flag: Column) -> Column:
    """Share of all rows with the flag, in percent; an aggregate column. No rows are an error."""
    empty = F.raise_error(F.lit("a quality check needs at least one row")).cast("double")
    return F.when(F.count(F.lit(1)) == 0, empty).otherwise(
        F.count_if(flag) * F.lit(100.0) / F.count(F.lit(1))
    )


def text_percentages(
    df: DataFrame, keys: Sequence[str], text: Column, min_words: int = MIN_WORDS
) -> DataFrame:
    """TQ1-TQ8: percentage of flagged rows per rule, in one pass."""
    flagged = text_flags(df.select(*keys, text.alias("_raw")), F.col("_raw"), min_words)
    return flagged.groupBy(*keys).agg(
        *[percentage(F.col(flag)).alias(rule) for rule, (flag, _) in TEXT_RULES.items()]
    )


def offending_characters(df: DataFrame, text: Column, top: int = 5) -> DataFrame:
    """TQ7: the most frequent characters outside the alphabet, each counted once per row."""
    lowered = F.lower(nfc(text))
    found = F.regexp_extract_all(lowered, F.lit(outside_alphabet()), F.lit(0))
    rows = df.where(~is_blank(text)).select(F.explode(F.array_distinct(found)).alias("char"))
    counts = rows.groupBy("char").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), "char").limit(top)


def training_text(
    df: DataFrame, text: str, min_words: int = MIN_WORDS, out: str = "train_text"
) -> DataFrame:
    """TXT11: the repaired text and whether the row may stay; other faults are never repaired."""
    df = made_once(df, {"_given": F.coalesce(F.col(text), F.lit(""))})
    df = made_once(df, {out: repair_for_training(F.col("_given"))}).drop("_given")
    flagged = text_flags(df, F.col(out), min_words)
    names = [flag for flag, _ in TEXT_RULES.values()]
    bad = F.lit(False)
    for name in names:
        bad = bad | F.col(name)
    return flagged.withColumn("kept", ~bad).drop(*names)


def drop_rate(
    flagged: DataFrame, keys: Sequence[str] = (), max_pct: float = MAX_DROP_PCT
) -> DataFrame:
    """TXT11: rows, rows kept, percentage dropped, and whether the build has to stop."""
    rates = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("kept").alias("n_kept"),
        percentage(~F.col("kept")).alias("drop_pct"),
    )
    return rates.withColumn("must_stop", F.col("drop_pct") > max_pct)


def audio_flags(
    df: DataFrame,
    rate: Column,
    duration_s: Column,
    rms: Column,
    clip_ratio: Column,
    text: Column | None = None,
) -> DataFrame:
    """AQ1-AQ6: one boolean column per audio rule, from feature rows; no waveform is needed."""
    flags = {
        "wrong_rate": rate != SAMPLE_RATE,
        "odd_duration": (duration_s < DURATION_S[0]) | (duration_s > DURATION_S[1]),
        "quiet": F.coalesce(rms < MIN_RMS, F.lit(False)),
        "clipped": F.coalesce(clip_ratio > MAX_CLIP_RATIO, F.lit(False)),
        "long_clip": duration_s >= LONG_CLIP_S,
    }
    if text is not None:
        words = word_count(match_key(text))
        speed = F.when(duration_s > 0, words / duration_s).otherwise(0.0)
        flags["odd_speed"] = ~speed.between(*WORDS_PER_S)
    return df.withColumns(flags)


def audio_percentages(flagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AQ1-AQ6: percentages of flagged rows; the share of long clips carries no verdict."""
    rules = {rule: flag for rule, (flag, _) in AUDIO_RULES.items() if flag in flagged.columns}
    return flagged.groupBy(*keys).agg(
        *[percentage(F.col(flag)).alias(rule) for rule, flag in rules.items()],
        percentage(F.col("long_clip")).alias("AUD-durdist"),
    )
