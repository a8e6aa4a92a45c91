"""Several measures of one table in one pass: one row per measure, then one struct per measure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURE = "_measure"
VALUE = "_value"


def melt(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    cells = [
        F.struct(F.lit(name).alias(MEASURE), value.cast("double").alias(VALUE))
        for name, value in values.items()
    ]
    return df.select(*keys, F.inline(F.array(*cells)))


def widen(
    long: DataFrame, keys: Sequence[str], names: Sequence[str], block: Column
) -> DataFrame:
    """``block`` of each measure as a column; null where the measure has no row or a null block."""
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col(MEASURE) == name, block)).alias(name) for name in names]
    )
