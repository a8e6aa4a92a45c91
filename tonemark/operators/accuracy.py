"""Word and character error rates of (reference, hypothesis) pairs, by row and pooled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark.functions.edits import edits
from tonemark.functions.text import is_blank, normalize, refine
from tonemark.plans.session import made_once

RATE = {"word": "wer", "char": "cer"}
UNITS = {"word": "ref_words", "char": "ref_chars"}


class View(NamedTuple):
    """How pairs are scored: by word or character, with or without tones, folded or not.

    ``parts`` asks for substitutions, deletions, insertions and hits; a rate alone is cheaper.
    """

    unit: str = "word"
    keep_tone: bool = True
    fold: bool = False
    parts: bool = True


RATE_ONLY = View(parts=False)
CHAR_RATE = View("char", parts=False)


def pair_up(refs: DataFrame, hyps: DataFrame, key: str, ref: str, hyp: str) -> DataFrame:
    """ACC6: references and hypotheses by id; an id on one side only is an error."""
    left = refs.select(F.col(key), F.col(ref))
    right = hyps.select(F.col(key).alias("_id"), F.col(hyp), F.lit(True).alias("_hyp"))
    left = left.withColumn("_ref", F.lit(True))
    joined = left.join(right, left[key] == right["_id"], "full_outer")
    lost = F.col("_ref").isNull() | F.col("_hyp").isNull()
    message = F.concat(
        F.lit("reference and hypothesis do not pair up for id "),
        F.coalesce(F.col(key), F.col("_id")).cast("string"),
    )
    # in a filter, which stays whatever columns are read
    checked = joined.where(F.when(lost, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return checked.select(F.coalesce(key, "_id").alias(key), ref, hyp)


def pairing_counts(refs: DataFrame, hyps: DataFrame, key: str) -> DataFrame:
    """ACC6 as a report: ids on both sides, only with a reference, only with a hypothesis."""
    left = refs.select(F.col(key), F.lit(True).alias("_ref"))
    right = hyps.select(F.col(key), F.lit(True).alias("_hyp"))
    joined = left.join(right, key, "full_outer")
    return joined.agg(
        F.count_if(F.col("_ref") & F.col("_hyp")).alias("n_pairs"),
        F.count_if(F.col("_hyp").isNull()).alias("n_ref_only"),
        F.count_if(F.col("_ref").isNull()).alias("n_hyp_only"),
    )


def with_edits(
    pairs: DataFrame, ref: Column, targets: Mapping[str, tuple[Column, View]]
) -> DataFrame:
    """One struct of edit counts per target, a hypothesis and how to score it.

    Every normal form is computed once per row, those without tones or in one spelling from the plain
    one, and dropped after scoring.
    """
    forms: dict[tuple, str] = {}
    given, plain, refined, scored = {}, {}, {}, {}

    def form(text: Column, view: View) -> Column:
        base = forms.setdefault((str(text), True, False), f"_form{len(forms)}")
        given.setdefault(f"_given{base}", text)
        plain.setdefault(base, normalize(F.col(f"_given{base}")))
        if view.keep_tone and not view.fold:
            return F.col(base)
        name = forms.setdefault((str(text), view.keep_tone, view.fold), f"_form{len(forms)}")
        refined.setdefault(name, refine(F.col(base), view.keep_tone, view.fold))
        return F.col(name)

    for name, (hyp, view) in targets.items():
        scored[name] = edits(form(ref, view), form(hyp, view), view.unit, view.parts)
    made = made_once(made_once(pairs, given), plain).drop(*given)
    if refined:
        made = made_once(made, refined)
    return made.withColumns(scored).drop(*plain, *refined)


def row_rate(counts: Column) -> Column:
    """ACC1, ACC2: rate of one pair. Without reference units it is 0 or, with a hypothesis, 1."""
    errors, units = counts["errors"], counts["units"]
    return F.when(units == 0, F.when(errors > 0, 1.0).otherwise(0.0)).otherwise(errors / units)


def pooled_rate(counts: Column) -> Column:
    """ACC3-ACC5: all edits over all reference units of a group; an aggregate column.

    Without reference units every edit is an insertion, which makes the group an error.
    """
    units, errors = F.sum(counts["units"]), F.sum(counts["errors"])
    broken = F.raise_error(F.lit("no reference units, but the hypotheses hold some")).cast("double")
    return (
        F.when((units == 0) & (errors > 0), broken)
        .when(units == 0, F.lit(0.0))
        .otherwise(errors / units)
    )


def pooled_parts(counts: Column, unit: str = "word", prefix: str = "") -> list[Column]:
    """The pooled rate with its breakdown, as aggregate columns."""
    return [
        pooled_rate(counts).alias(prefix + RATE[unit]),
        F.sum(counts["subs"]).alias(prefix + "substitutions"),
        F.sum(counts["dels"]).alias(prefix + "deletions"),
        F.sum(counts["ins"]).alias(prefix + "insertions"),
        F.sum(counts["hits"]).alias(prefix + "hits"),
        F.sum(counts["units"]).alias(prefix + UNITS[unit]),
    ]


def corpus_rate(
    pairs: DataFrame, keys: Sequence[str], ref: Column, hyp: Column, view: View = View()
) -> DataFrame:
    """ACC3, ACC4, ACC7, ACC9: pooled rate and breakdown of every group."""
    scored = with_edits(pairs, ref, {"_edits": (hyp, view)})
    return scored.groupBy(*keys).agg(*pooled_parts(F.col("_edits"), view.unit))


def tone_report(pairs: DataFrame, keys: Sequence[str], ref: Column, hyp: Column) -> DataFrame:
    """ACC8: rates with and without tones in one pass, and the share of the WER due to tones."""
    targets = {
        "_w": (hyp, View("word")),
        "_c": (hyp, CHAR_RATE),
        "_wn": (hyp, RATE_ONLY._replace(keep_tone=False)),
        "_cn": (hyp, CHAR_RATE._replace(keep_tone=False)),
    }
    scored = with_edits(pairs, ref, targets)
    rates = scored.groupBy(*keys).agg(
        *pooled_parts(F.col("_w")),
        pooled_rate(F.col("_c")).alias("cer"),
        pooled_rate(F.col("_wn")).alias("wer_no_tone"),
        pooled_rate(F.col("_cn")).alias("cer_no_tone"),
    )
    return rates.withColumn("tone_wer", F.col("wer") - F.col("wer_no_tone"))


def folded_report(pairs: DataFrame, keys: Sequence[str], ref: Column, hyp: Column) -> DataFrame:
    """ACC9: the main WER with the folded WER next to it."""
    scored = with_edits(pairs, ref, {"_w": (hyp, RATE_ONLY), "_f": (hyp, RATE_ONLY._replace(fold=True))})
    return scored.groupBy(*keys).agg(
        pooled_rate(F.col("_w")).alias("wer"), pooled_rate(F.col("_f")).alias("wer_folded")
    )


def synthesis_delta(
    triples: DataFrame, keys: Sequence[str], ref: Column, first: Column, second: Column
) -> DataFrame:
    """ACC10: WER of the first pass and of the round trip, and their difference."""
    scored = with_edits(triples, ref, {"_first": (first, RATE_ONLY), "_second": (second, RATE_ONLY)})
    rates = scored.groupBy(*keys).agg(
        pooled_rate(F.col("_first")).alias("asr_wer"), pooled_rate(F.col("_second")).alias("rt_wer")
    )
    return rates.withColumn("delta_wer", F.col("rt_wer") - F.col("asr_wer"))


def bad_row_pct(counts: Column, limit: float = 0.5) -> Column:
    """ACC11: percentage of rows with a rate above the limit; an aggregate column."""
    return F.avg(F.when(row_rate(counts) > limit, 100.0).otherwise(0.0))


def empty_count(hyp: Column) -> Column:
    """ACC12: hypotheses that are blank; an aggregate column."""
    return F.count_if(is_blank(hyp))
