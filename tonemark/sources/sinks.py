"""Writers of sample records, aggregates, raw pairs, and checksum lists."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from tonemark.plans.session import listed_in_bunches


def append_records(records: DataFrame, path: str, run: str = "run_id", form: str = "parquet") -> None:
    """SNK1: add sample records below one folder per run."""
    records.write.mode("append").partitionBy(run).format(form).save(path)


def write_aggregate(aggregate: DataFrame, path: str) -> None:
    """SNK2: the aggregate as JSON; an absent block stays in the file as null."""
    aggregate.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_pairs(pairs: DataFrame, path: str, run: str = "run_id") -> None:
    """SNK5: the raw pairs next to the aggregates, so that they can be scored again."""
    pairs.write.mode("append").partitionBy(run).parquet(path)


def checksums(
    spark: SparkSession, root: str, manifests: Sequence[str], clips: str, glob: str = "*.wav"
) -> DataFrame:
    """SNK4: ``sha256  path`` lines, manifests in the given order, then clips by path.

    ``manifests`` and ``clips`` are relative to the set's root, and so are the listed paths.
    """
    base = root.rstrip("/")

    def hashed(reader: DataFrameReader, path: str) -> DataFrame:
        with listed_in_bunches(spark):
            content = reader.format("binaryFile").load(f"{base}/{path}")
        # what follows the root, wherever the file system's own prefix ends
        relative = F.substring_index("path", f"{urlsplit(base).path}/", -1)
        return content.select(relative.alias("path"), F.sha2("content", 256).alias("sha256"))

    below = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    rows = hashed(below, clips).withColumn("ord", F.lit(len(manifests)))
    for i, name in enumerate(manifests):
        rows = rows.unionByName(hashed(spark.read, name).withColumn("ord", F.lit(i)))
    return rows.orderBy("ord", "path").select("ord", "path", "sha256", F.concat_ws("  ", "sha256", "path").alias("line"))
