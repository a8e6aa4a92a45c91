"""Ordered scans over groups of any size.

A window partitioned by a group puts the whole group into one task. The functions here cut each
group into blocks of its order column, scan inside the blocks in parallel, and add what the earlier
blocks of the group carry over. The carry table has one row per block, not per row. Order columns
are whole numbers, unique within a group. Blocks lie between quantiles of the order, about as many as
the number of rows asks for, so ids may be dense, far apart, hashed or have outliers; for other orders
pass the block column yourself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 18
#: Sampled values for each block.
SAMPLED = 16
_BLOCK = "_block"
_PART = "_part"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on keys where null equals null; keeps the key columns of the left side."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    same = [left[key].eqNullSafe(renamed[f"_right_{key}"]) for key in keys]
    joined = left.join(renamed, reduce(lambda a, b: a & b, same), how)
    return joined.drop(*[f"_right_{key}" for key in keys])


def block_of(df: DataFrame, order: str, block_rows: int) -> Column:
    """The block of an order column, between quantiles of a sample of its values.

    The sample is what a digest picks, some ``SAMPLED`` values for each block, so it is the same
    whenever it is looked up; the quantiles, one for each block, are part of the plan.
    """
    picked = F.pmod(F.xxhash64(order), F.lit(max(1, block_rows // SAMPLED))) == 0
    rows = df.where(picked).select(order).distinct().toArrow()
    edges = np.sort(rows.column(0).drop_null().to_numpy())[SAMPLED - 1 :: SAMPLED].tolist()
    if not edges:
        return F.lit(0).cast("long")
    ladder, steps = F.lit(edges), [1 << k for k in reversed(range(len(edges).bit_length()))]

    def climb(at: Column, step: Column) -> Column:
        return F.when(F.get(ladder, (at + step - 1).cast("int")) <= F.col(order), at + step).otherwise(at)

    return F.aggregate(F.lit(steps).cast("array<long>"), F.lit(0).cast("long"), climb)


def _before(keys: Sequence[str], order: Sequence[str]) -> Window:
    window = Window.partitionBy(*keys).orderBy(*order)
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _with_part(df: DataFrame, keys: Sequence[str], block: Column, lead: Sequence[str] = ()) -> DataFrame:
    """Add the block and one struct that names group and block.

    Grouping, join and window all use the struct, so rows are shuffled once. A struct is never null
    and treats null fields as equal, so groups with a null key take part like any other.
    """
    df = df.withColumn(_BLOCK, block)
    return df.withColumn(_PART, F.struct(*keys, *lead, _BLOCK))


def _carry(
    df: DataFrame,
    keys: Sequence[str],
    summary: Column,
    combined: Mapping[str, Column],
    lead: Sequence[str] = (),
) -> DataFrame:
    """Add to every row columns made of the summaries of all blocks of its group.

    ``combined`` holds window expressions over ``_summary``; one row per block is all they see.
    """
    blocks = df.groupBy(_PART, *keys, *lead, _BLOCK).agg(summary.alias("_summary"))
    return df.join(blocks.select(_PART, *[c.alias(n) for n, c in combined.items()]), _PART)


def _restore(df: DataFrame, columns: Sequence[str], out: Mapping[str, Column]) -> DataFrame:
    return df.select(*columns, *[c.alias(name) for name, c in out.items()])


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    out: str = "row_no",
    lead: Sequence[str] = (),
    total: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Row numbers from 0 within each group, and on request the group's row count.

    ``lead`` names columns with few values that sort before ``order``.
    """
    blocked = _with_part(df, keys, block_of(df, order, block_rows), lead)
    earlier = F.sum("_summary").over(_before(keys, [*lead, _BLOCK]))
    combined = {"_carry": F.coalesce(earlier, F.lit(0))}
    if total:
        combined["_total"] = F.sum("_summary").over(Window.partitionBy(*keys))
    carried = _carry(blocked, keys, F.count(F.lit(1)), combined, lead)
    inside = F.row_number().over(Window.partitionBy(_PART).orderBy(order))
    made = {out: F.col("_carry") + inside - 1}
    if total:
        made[total] = F.col("_total")
    return _restore(carried, df.columns, made)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    out: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Sum of ``value`` over the rows of the group before this one, 0 for the first."""
    blocked = _with_part(df.withColumn("_value", value), keys, block_of(df, order, block_rows))
    earlier = F.sum("_summary").over(_before(keys, [_BLOCK]))
    carried = _carry(blocked, keys, F.sum("_value"), {"_carry": earlier})
    inside = F.sum("_value").over(_before([_PART], [order]))
    zero = F.lit(0)
    return _restore(
        carried, df.columns, {out: F.coalesce("_carry", zero) + F.coalesce(inside, zero)}
    )


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    block: Column,
) -> DataFrame:
    """Largest ``value`` over the rows of the group before this one, null for the first."""
    blocked = _with_part(df.withColumn("_value", value), keys, block)
    earlier = F.max("_summary").over(_before(keys, [_BLOCK]))
    carried = _carry(blocked, keys, F.max("_value"), {"_carry": earlier})
    inside = F.max("_value").over(_before([_PART], order))
    return _restore(carried, df.columns, {out: F.greatest("_carry", inside)})


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    block: Column,
    ahead: bool = False,
) -> DataFrame:
    """``value`` of the row before this one in the group, or after it with ``ahead``."""
    blocked = _with_part(df.withColumn("_value", value), keys, block)
    shift = F.lead if ahead else F.lag
    edge = (F.min_by if ahead else F.max_by)("_value", F.struct(*order))
    across = shift("_summary").over(Window.partitionBy(*keys).orderBy(_BLOCK))
    carried = _carry(blocked, keys, edge, {"_carry": across})
    rows = Window.partitionBy(_PART).orderBy(*order)
    at_edge = shift(F.lit(1)).over(rows).isNull()
    inside = shift(F.col("_value")).over(rows)
    return _restore(carried, df.columns, {out: F.when(at_edge, F.col("_carry")).otherwise(inside)})
