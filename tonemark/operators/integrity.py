"""Duplicates, contamination by evaluation sets, disjoint and chosen row sets.

Texts are grouped and joined by a 256-bit digest of their match key, so no text is shuffled, and
equal keys are counted before the shuffle, so a text repeated in a third of all rows is one row per
task. Sides are never broadcast by hint: Spark broadcasts a side only when its size allows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark.functions.text import match_key
from tonemark.plans.bloom import bloom_filter, may_hold

MAX_DUP_PCT = 2.0
MAX_REPEAT = 5
#: Tasks over which the rows of one evaluation key are dealt.
SALTS = 32


def text_digest(text: Column) -> Column:
    """Digest of the match key: equal for texts that differ in case, punctuation or spacing."""
    # never null, so that joins add no filter that would compute the key a second time
    return F.coalesce(F.unhex(F.sha2(match_key(text), 256)), F.lit(b""))


def content_digest(content: Column) -> Column:
    return F.sha1(content)


def copy_counts(df: DataFrame, keys: Sequence[str], digest: Column) -> DataFrame:
    """Number of rows per group and digest."""
    rows = df.select(*keys, digest.alias("digest"))
    return rows.groupBy(*keys, "digest").agg(F.count(F.lit(1)).alias("copies"))


def copies_report(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """INT1-INT3: extra copies, their percentage of all rows, and the longest repeat."""
    rows, extra = F.sum("copies"), F.sum(F.col("copies") - 1)
    return counts.groupBy(*keys).agg(
        rows.alias("n_rows"),
        extra.alias("extra_copies"),
        (extra * F.lit(100.0) / rows).alias("dup_pct"),
        F.max("copies").alias("max_repeat"),
    )


def most_repeated(df: DataFrame, text: Column) -> DataFrame:
    """INT2: the text repeated most often; ties go to the smallest digest.

    The digests are counted first; only the winner's text is looked up.
    """
    counts = copy_counts(df, [], text_digest(text))
    top = counts.orderBy(F.desc("copies"), "digest").limit(1)
    keyed = df.select(match_key(text).alias("match_text"), text_digest(text).alias("digest"))
    return keyed.join(top, "digest").groupBy("copies").agg(F.min("match_text").alias("match_text"))


def evaluation_keys(eval_sets: Sequence[DataFrame], text: str = "text") -> DataFrame:
    """Distinct match keys of all evaluation sets, as digests."""
    keyed = [d.select(text_digest(F.col(text)).alias("digest")) for d in eval_sets]
    return reduce(DataFrame.unionByName, keyed).distinct()


def contaminated_rows(train: DataFrame, eval_keys: DataFrame, text: Column, salts: int = SALTS) -> DataFrame:
    """INT4: the training rows whose match key is in an evaluation set.

    A Bloom filter of the evaluation keys holds back most other rows before the shuffle. One text may
    make up a large part of what is left, so each evaluation key stands on several tasks and rows are
    dealt over them.
    """
    keyed = train.withColumn("_digest", text_digest(text))
    near = keyed.where(may_hold(bloom_filter(eval_keys, "digest"), F.col("_digest")))
    near = near.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_number")
    copies = eval_keys.select("digest", numbers)
    same = (F.col("_digest") == F.col("digest")) & (F.col("_salt") == F.col("_number"))
    return near.join(copies, same, "left_semi").drop("_digest", "_salt")


def contamination_count(
    train: DataFrame, keys: Sequence[str], eval_keys: DataFrame, text: Column
) -> DataFrame:
    """INT4: rows, and rows found in an evaluation set, per group. Counts copies before the join."""
    counts = copy_counts(train, keys, text_digest(text))
    seen = eval_keys.withColumn("_seen", F.lit(True))
    joined = counts.join(seen, "digest", "left")
    return joined.groupBy(*keys).agg(
        F.sum("copies").alias("n_rows"),
        F.sum(F.when(F.col("_seen"), F.col("copies")).otherwise(0)).alias("n_contaminated"),
    )


def without(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """INT5: rows whose key is not in the other set."""
    return df.join(taken.select(key), key, "left_anti")


def refresh_cache(
    entries: DataFrame, cache: DataFrame, key: str, score: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """INT6: the cached results plus fresh ones for entries without any."""
    return cache.unionByName(score(without(entries, cache, key)))


def only_chosen(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """INT7: rows whose key was chosen."""
    return df.join(chosen.select(key), key, "left_semi")
