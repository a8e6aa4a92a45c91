"""A Bloom filter of fixed size as part of a plan: no action, no code outside the JVM.

The bits are set by the built-in bitmap aggregates in blocks of 4 KB, and reach the rows to test as a
scalar subquery. A row that passes need not be in the set; one that does not pass is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter (1 MB) and bits of each key. A million keys let one row in twenty pass by chance.
BITS = 1 << 23
HASHES = 2
_BLOCK = 1 << 15


def _spots(key: Column) -> list[Column]:
    """Bits of a key, counted from 0."""
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(BITS)) for k in range(HASHES)]


def bloom_filter(keys: DataFrame, key: str) -> Column:
    """The filter of all keys, for ``may_hold``; null keys set bits like any other value."""
    # the functions number bits and blocks from 1
    bits = keys.select(F.explode(F.array(*_spots(F.col(key)))).alias("_bit")).select((F.col("_bit") + 1).alias("_bit"))
    blocks = bits.groupBy(F.bitmap_bucket_number("_bit").cast("int").alias("_block"))
    blocks = blocks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits"))
    by_block = F.map_from_entries(F.collect_list(F.struct("_block", "_bits")))
    whole = blocks.agg(by_block.alias("_map"))
    numbers = F.sequence(F.lit(1), F.lit(BITS // _BLOCK))
    return whole.select(F.transform(numbers, lambda b: F.element_at("_map", b)).alias("_filter")).scalar()


def may_hold(bloom: Column, key: Column) -> Column:
    """Whether a key may be in the filter; false only if it is not."""

    def is_set(spot: Column) -> Column:
        bits = F.get(bloom, F.floor(spot / _BLOCK).cast("int"))
        byte = F.substring(bits, F.floor(spot % _BLOCK / 8).cast("int") + 1, F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        return F.coalesce(F.floor(value / F.pow(F.lit(2), spot % 8)).cast("int") % 2 == 1, F.lit(False))

    first, *rest = map(is_set, _spots(key))
    for other in rest:
        first = first & other
    return first
