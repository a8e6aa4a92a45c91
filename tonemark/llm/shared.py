"""What the operators of this folder share: scratch tables, Arrow maps, sorted groups, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tonemark.plans.session import scratch_path, spread

#: Characters that part words: the six ASCII ones. Bytes.split() takes the same six.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
_ROWS_AT_ONCE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns, dealt to all cores where the files have too few splits for text work."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back, so that what follows depends on
    files and not on the tasks that made them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_arrow(
    df: DataFrame, columns: Sequence[str], make: Callable[..., list], fields: list[T.StructField]
) -> DataFrame:
    """Add columns made by ``make`` from Python lists of ``columns``, a few hundred rows at a time.

    Columns of the same name are replaced; all others are passed through untouched.
    """
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new]
    names = [f.name for f in kept]
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(start, _ROWS_AT_ONCE)
                made = make(*[part.column(part.schema.get_field_index(c)).to_pylist() for c in columns])
                arrays = [part.column(part.schema.get_field_index(c)) for c in names]
                arrays += [pa.array(values, type=kind) for values, kind in zip(made, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *[f.name for f in fields]])

    return df.mapInArrow(run, T.StructType([*kept, *fields]))


def sorted_groups(frames: Iterator[pd.DataFrame], *keys: str, least: int = 1) -> Iterator[pd.DataFrame]:
    """Groups of a partition that is sorted by ``keys``; a group may run over several frames.

    Groups with fewer than ``least`` rows are passed over.
    """
    rest: list[pd.DataFrame] = []

    def joined() -> Iterator[pd.DataFrame]:
        if sum(map(len, rest)) >= least:
            yield pd.concat(rest, ignore_index=True)
        rest.clear()

    for frame in frames:
        if not len(frame):
            continue
        values = [frame[k].to_numpy() for k in keys]
        if rest and any(rest[-1][k].iloc[-1] != v[0] for k, v in zip(keys, values)):
            yield from joined()
        new = np.zeros(len(frame) - 1, bool)
        for v in values:
            new |= v[1:] != v[:-1]
        starts = [0, *(np.flatnonzero(new) + 1).tolist(), len(frame)]
        for a, b in zip(starts[:-2], starts[1:-1]):
            if rest:
                rest.append(frame.iloc[a:b])
                yield from joined()
            elif b - a >= least:
                yield frame.iloc[a:b]
        rest.append(frame.iloc[starts[-2] :])
    if rest:
        yield from joined()


def join_spread(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner", salts: int = 32) -> DataFrame:
    """Join rows with what is known of their group, over several keys for each group.

    A group may hold a large part of all rows; its rows stay on many tasks, and sums that follow
    start before the next shuffle. ``groups`` has one row per group.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c != key]), F.lit(salts))
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    copies = groups.withColumn("_salt", F.explode(numbers))
    return rows.withColumn("_salt", salt).join(copies, [key, "_salt"], how).drop("_salt")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour instead."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.min("b").alias("_m"))
    least = least.select("a", F.least("a", "_m").alias("_m"))
    moved = both.where(F.col("b") > F.col("a")).join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("_m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    rows = moved.where(F.col("a") != F.col("b")).unionAll(least.select("a", F.col("_m").alias("b")))
    return rows.distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links ``(a, b)``: rows ``(node, root)`` for every linked node but
    the roots, a root being the smallest node of its component.

    Alternates large and small stars (Kiveris et al., 2014) until a round changes nothing. A node's
    neighbours are never gathered: each step is a minimum per node and a join. Rounds are cut off
    from their past in the shared scratch folder.
    """
    links = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    links = cut(links.distinct(), "links")
    seen = None
    while True:
        mark = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == seen or not mark["n"]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        links = cut(_small_star(_large_star(links)), "links")
