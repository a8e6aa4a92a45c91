"""Deterministic sampling and stratified set building.

Every order is an explicit column. Quotas are rank limits, which Spark applies before the shuffle;
positions in unbounded groups come from ``plans.blocks``, so a bucket of any size stays spread out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemark.functions.text import is_blank
from tonemark.plans.blocks import null_safe_join, number_rows, running_total

# Frozen-set quotas per bucket, and spare rows for those that quality control drops.
V1_TARGET = {"short": 135, "medium": 135, "long": 130}
DEV_TARGET = {"short": 10, "medium": 10, "long": 10}
SPARE = 12
QC_WER_DROP = 0.6


def _by_bucket(values: Mapping[str, int], bucket: str = "bucket") -> Column:
    return F.coalesce(*[F.when(F.col(bucket) == b, F.lit(n)) for b, n in values.items()])


def full_quota() -> dict[str, int]:
    return {b: V1_TARGET[b] + DEV_TARGET[b] + SPARE for b in V1_TARGET}


def stride_sample(
    df: DataFrame,
    offset: str,
    total: int,
    n: int,
    text: Column,
    duration_s: Column,
    min_s: float = 1.0,
    max_s: float = 29.0,
) -> DataFrame:
    """SET1: up to ``n`` valid rows from ``2n`` evenly spaced offsets; ``pick`` is the draw number.

    Offsets wrap around and may come up twice; such rows are kept twice.
    """
    stride = total // n
    draws = df.sparkSession.range(2 * n).select(
        F.col("id").alias("pick"), (F.col("id") * stride % total).alias("_offset")
    )
    rows = df.join(draws, df[offset] == draws["_offset"]).drop("_offset")
    valid = rows.where(duration_s.between(min_s, max_s) & (F.trim(text) != ""))
    return valid.orderBy("pick").limit(n)


def draw_order(seed: int, key: Column) -> Column:
    """A reproducible random order: digest of the seed and the row's key."""
    return F.md5(F.concat_ws("-", F.lit(seed), key.cast("string")))


def block_sample(
    df: DataFrame, index: str, seed: int = 42, block_rows: int = 100, per_block: int = 8
) -> DataFrame:
    """SET2: the same number of random rows from each block of consecutive rows.

    Rows that cannot be used are passed over afterwards, with ``usable_rows``, and not drawn anew.
    """
    drawn = df.withColumn("_block", F.floor(F.col(index) / block_rows))
    order = Window.partitionBy("_block").orderBy(draw_order(seed, F.col(index)))
    ranked = drawn.withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_rank") <= per_block).drop("_block", "_rank")


def usable_rows(df: DataFrame, text: Column, sample_rate: Column, wanted_rate: int = 16_000) -> DataFrame:
    """SET2: drawn rows with text and the wanted rate; others add no seconds."""
    return df.where(~is_blank(text) & (sample_rate == wanted_rate))


def until_seconds(
    df: DataFrame, index: str, duration_s: Column, target_s: float, keys: Sequence[str] = ()
) -> DataFrame:
    """SET2: rows in order until their seconds reach the target; the row that reaches it stays."""
    timed = running_total(df, keys, index, duration_s, "_so_far")
    return timed.where(F.col("_so_far") < target_s).drop("_so_far")


def assembly_offsets(
    df: DataFrame, keys: Sequence[str], index: str, duration_s: Column, gap_s: float = 0.35
) -> DataFrame:
    """SET3: start of each clip in the joined audio."""
    return running_total(df, keys, index, duration_s + F.lit(gap_s), "start_s")


def assembled(
    offsets: DataFrame, keys: Sequence[str], index: str, text: str, duration_s: Column
) -> DataFrame:
    """SET3: length and transcript of each joined audio; there is no gap after the last clip."""
    return offsets.groupBy(*keys).agg(
        F.max(F.col("start_s") + duration_s).alias("total_s"),
        joined_text(index, text).alias("transcript"),
        F.count(F.lit(1)).alias("n_clips"),
    )


def joined_text(order: str, text: str) -> Column:
    """Texts of a group joined by a space in the given order; an aggregate column.

    The result is one string per group, so its size is that of the group's text whatever the plan.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("_t"))))
    return F.array_join(F.transform(pairs, lambda p: p["_t"]), " ")


def first_come(
    df: DataFrame, order: str, quotas: Mapping[str, int], bucket: str = "bucket"
) -> DataFrame:
    """SET4: the first rows of each bucket up to its quota."""
    wanted = df.where(F.col(bucket).isin(*quotas))
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(order))
    ranked = wanted.withColumn("_place", place).where(F.col("_place") <= max(quotas.values()))
    return ranked.where(F.col("_place") <= _by_bucket(quotas, bucket)).drop("_place")


def remaining_quota(taken: DataFrame, quotas: Mapping[str, int], bucket: str = "bucket") -> DataFrame:
    """Quota left per bucket, never below 0; one row per bucket that has a quota."""
    names = taken.sparkSession.createDataFrame(list(quotas.items()), f"{bucket} string, _quota long")
    used = taken.groupBy(bucket).agg(F.count(F.lit(1)).alias("_used"))
    left = F.greatest(F.lit(0), F.col("_quota") - F.coalesce("_used", F.lit(0)))
    return names.join(used, bucket, "left").select(bucket, left.alias("remaining"))


def priority_fill(
    df: DataFrame,
    order: str,
    has_digits: str,
    remaining: DataFrame,
    buckets: Sequence[str] = ("long", "medium"),
    extra_bucket: str = "medium",
    extra: int = 8,
    bucket: str = "bucket",
) -> DataFrame:
    """SET5: fill what is left of each quota, rows with digits first.

    The extra bucket also takes its next few rows with digits. As those come first in the order,
    both slices are one rank limit: that of the largest quota left, so that ranking stops early in
    every task. The quotas are one row per bucket and are read once.
    """
    wanted = df.where(F.col(bucket).isin(*buckets))
    most = remaining.where(F.col(bucket).isin(*buckets)).agg(F.max("remaining")).first()[0] or 0
    late = F.when(F.col(has_digits), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(late, order))
    ranked = wanted.withColumn("_place", place).where(F.col("_place") <= most + extra)
    joined = ranked.join(remaining, bucket)
    within = F.col("_place") <= F.col("remaining")
    spare = (
        (F.col(bucket) == extra_bucket)
        & F.col(has_digits)
        & (F.col("_place") <= F.col("remaining") + extra)
    )
    return joined.where(within | spare).drop("_place", "remaining")


def drop_mismatched(
    df: DataFrame, qc: DataFrame, key: str, has_digits: str, max_wer: float = QC_WER_DROP
) -> DataFrame:
    """SET6: drop rows whose check transcript is far off; rows with digits are only flagged.

    A row without a check result is an error.
    """
    checked = df.join(qc.withColumn("_checked", F.lit(True)), key, "left")
    message = F.concat(F.lit("no check result for "), F.col(key).cast("string"))
    # a filter is never pruned, whatever columns are read
    checked = checked.where(F.when(F.col("_checked"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    checked = checked.drop("_checked")
    off = F.col("qc_wer") >= max_wer
    kept = checked.where(~(~F.col(has_digits) & off))
    return kept.withColumn("qc_flagged", off)


def split_dev(
    df: DataFrame,
    order: str,
    has_digits: str,
    dev: Mapping[str, int] = DEV_TARGET,
    target: Mapping[str, int] = V1_TARGET,
    bucket: str = "bucket",
) -> DataFrame:
    """SET7: ``part`` is dev for an even stride through each bucket, v1 for the rest up to a target.

    Rows with digits come first in a bucket, so the trim never reaches them before other rows.
    """
    rows = df.where(F.col(bucket).isin(*dev))
    rows = rows.withColumn("_late", F.when(F.col(has_digits), 0).otherwise(1))
    rows = number_rows(rows, [bucket], order, "_i", lead=["_late"], total="_n")
    rows = rows.withColumn("_n_dev", F.least(_by_bucket(dev, bucket), F.col("_n")))
    rows = rows.withColumn("_step", F.greatest(F.lit(1), F.floor(F.col("_n") / F.nullif("_n_dev", F.lit(0)))))
    i, step, n_dev = F.col("_i"), F.col("_step"), F.col("_n_dev")
    in_dev = (i % step == 0) & (i / step < n_dev)
    dev_before = F.least(n_dev, F.ceil(i / step))
    part = F.when(in_dev, "dev").when(i - dev_before < _by_bucket(target, bucket), "v1")
    chosen = rows.withColumn("part", part).where(F.col("part").isNotNull())
    return chosen.drop("_late", "_i", "_n", "_n_dev", "_step")


def review_sample(df: DataFrame, order: str, n: int = 20) -> DataFrame:
    """SET8: an even stride of ``n`` rows for listening; ``pick`` counts them."""
    rows = number_rows(df, [], order, "_i", total="_n")
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / n))
    rows = rows.withColumn("pick", F.floor(F.col("_i") / step))
    return rows.where((F.col("_i") % step == 0) & (F.col("pick") < n)).drop("_i", "_n")


def acceptance(df: DataFrame, tags: str = "tags", bucket: str = "bucket") -> DataFrame:
    """SET9: rows and share per bucket, and the set's rows with digits and with names or loans."""
    named = F.arrays_overlap(F.col(tags), F.array(F.lit("proper_name"), F.lit("loanword")))
    counts = df.groupBy(bucket).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.array_contains(tags, "digits")).alias("_digits"),
        F.count_if(named).alias("_named"),
    )
    whole = Window.partitionBy()
    share = F.col("n_rows") / F.sum("n_rows").over(whole)
    return counts.select(
        bucket,
        "n_rows",
        share.alias("share"),
        share.between(0.25, 0.40).alias("share_ok"),
        F.sum("_digits").over(whole).alias("n_digits"),
        (F.sum("_digits").over(whole) >= 30).alias("digits_ok"),
        F.sum("_named").over(whole).alias("n_named"),
        (F.sum("_named").over(whole) >= 20).alias("named_ok"),
    )


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """SET10: the first rows of a manifest."""
    return df.orderBy(order).limit(n)


def validation_split(df: DataFrame, key: Column, share: float, seed: int = 42) -> DataFrame:
    """SET11: a validation flag that is the same for all rows of one speaker or source.

    Taken from the key's digest before any filter, so no later step can move a key across.
    """
    point = F.conv(F.substring(draw_order(seed, key), 1, 8), 16, 10).cast("double")
    return df.withColumn("is_validation", point / F.lit(float(1 << 32)) < share)
