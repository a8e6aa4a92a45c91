"""Exact order statistics of groups of any size.

The built-in ``percentile`` merges all distinct values of a group into one map in one task. Here
equal values are counted first. A histogram over fixed logarithmic cells shows which cell of the
group holds each wanted rank; the values of that cell alone are cut once more into equal-width
cells, and only the values of the last cell are sorted. The answer is exact whatever the
distribution; the cells decide only how few values are left to sort.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS_PER_OCTAVE = 256
SMALLEST = 2.0**20
WIDTHS = 4096
#: The cell of null and NaN, before all others.
_NO_VALUE = -(2**31)
#: The column of what else is known of a group: ``n``, ``n_present``, ``mean``, ``min``, ``max``.
FACTS = "_facts"


def usable(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def _log_cell(value: Column) -> Column:
    """A whole number that never falls while the value rises, fine near zero."""
    octave = F.least(F.log2(F.abs(value) * SMALLEST + 1), F.lit(2000.0))
    return (F.signum(value) * F.floor(octave * CELLS_PER_OCTAVE)).cast("int")


def _width_cell(value: Column, lo: Column, hi: Column) -> Column:
    share = F.nanvl((value - lo) / (hi - lo), F.lit(1.0))
    inside = F.least(F.floor(share * WIDTHS), F.lit(WIDTHS - 1))
    return F.when(hi > lo, inside).otherwise(0).cast("int")


def _running(keys: Sequence[str], order: str) -> Column:
    window = Window.partitionBy(*keys).orderBy(order)
    before = F.sum("_c").over(window.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(before, F.lit(0))


def _held(wants: Column) -> Column:
    """The wanted ranks that fall on this row, counted from its first copy."""
    before = F.col("_before")
    here = F.filter(wants, lambda w: (w["at"] >= before) & (w["at"] < before + F.col("_c")))
    return F.transform(here, lambda w: F.struct(w["name"].alias("name"), (w["at"] - before).alias("at")))


def ordered_facts(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    ranks: Mapping[str, Callable[[Column], Column]],
) -> DataFrame:
    """One row per group with the values at the wanted ranks and the struct ``FACTS``.

    ``ranks`` maps an output name to a function from the number of usable values to a rank counted
    from 0. Null and NaN are dropped first, NaN counts as present. A group without other values has
    ``n = 0`` and nulls; without keys there is always one row.
    """
    # one struct names the group: joins and groupings on it treat null keys as equal
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    given = value.cast("double")
    counts = (
        df.select(group.alias("_g"), F.when(usable(given), given).alias("_v"), given.isNotNull().alias("_here"))
        .groupBy("_g", "_v")
        .agg(F.count(F.lit(1)).alias("_c"), F.count_if("_here").alias("_present"))
        .withColumn("_cell", F.coalesce(_log_cell(F.col("_v")), F.lit(_NO_VALUE)))
    )

    coarse = counts.groupBy("_g", "_cell").agg(
        F.sum(F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(0)).alias("_c"),
        F.sum("_present").alias("_present"),
        F.sum(F.col("_v") * F.col("_c")).alias("_sum"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
    )
    whole = Window.partitionBy("_g")
    coarse = coarse.withColumn("_before", _running(["_g"], "_cell"))
    coarse = coarse.withColumn("_n", F.sum("_c").over(whole))
    facts = [
        F.col("_n").alias("n"),
        F.sum("_present").over(whole).alias("n_present"),
        (F.sum("_sum").over(whole) / F.nullif("_n", F.lit(0))).alias("mean"),
        F.min("_lo").over(whole).alias("min"),
        F.max("_hi").over(whole).alias("max"),
    ]
    coarse = coarse.withColumn(FACTS, F.struct(*facts))

    def want(name: str, at: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), at.cast("bigint").alias("at"))

    wants = F.array(*[want(name, rank(F.col("_n"))) for name, rank in ranks.items()])
    # a group without values is carried along by a rank that nobody asks for
    held = F.when(F.col("_n") > 0, _held(wants)).otherwise(F.array(want("", F.lit(0))))
    coarse = coarse.withColumn("_w", held).where(F.size("_w") > 0)

    parts = ["_g", "_cell"]
    near = counts.join(coarse.select(*parts, "_lo", "_hi", "_w", FACTS), parts)
    sub = _width_cell(F.col("_v"), F.col("_lo"), F.col("_hi"))
    kept = [F.first(c).alias(c) for c in ("_lo", "_hi", "_w", FACTS)]
    fine = near.groupBy(*parts, sub.alias("_sub")).agg(F.sum("_c").alias("_c"), *kept)
    fine = fine.withColumn("_before", _running(parts, "_sub"))
    fine = fine.withColumn("_w", _held(F.col("_w"))).where(F.size("_w") > 0)

    last = counts.select(*parts, "_v", "_c").join(fine.drop("_c", "_before"), parts).where(sub == F.col("_sub"))
    last = last.withColumn("_before", _running([*parts, "_sub"], "_v"))
    found = last.select("_g", "_v", FACTS, F.explode(_held(F.col("_w"))).alias("_hit"))
    result = (found.groupBy("_g") if keys else found).agg(
        *[F.max(F.when(F.col("_hit.name") == name, F.col("_v"))).alias(name) for name in ranks],
        F.max(FACTS).alias(FACTS),
    )
    if keys:
        return result.select("_g.*", *ranks, FACTS)
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("double")
    nothing = [zero.alias("n"), zero.alias("n_present"), *[none.alias(name) for name in ("mean", "min", "max")]]
    return result.withColumn(FACTS, F.coalesce(FACTS, F.struct(*nothing)))


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    ranks: Mapping[str, Callable[[Column], Column]],
) -> DataFrame:
    """One row per group with the values at the wanted ranks, as in ``ordered_facts``; a group without
    values has no row."""
    return ordered_facts(df, keys, value, ranks).where(F.col(FACTS)["n"] > 0).select(*keys, *ranks)
