"""Session settings, scratch space and input spreading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from functools import lru_cache

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "tonemark", cpus: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster use the session you are given."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package() -> None:
    """Send this package's functions along with each task, so executors need no copy of it."""
    import tonemark

    cloudpickle.register_pickle_by_value(tonemark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder of ``spark.checkpoint.dir``.

    A session on one machine that names none, as in tests, gets a temporary folder that goes with
    the process; on a cluster its absence is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not str(spark.conf.get("spark.master", "local")).startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        shared = _own_folder()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@lru_cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def spread(scan: DataFrame) -> DataFrame:
    """Give a file scan at least one partition per core before CPU-heavy work.

    A scan with enough splits, the normal case on large tables, is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def spread_by(df: DataFrame, *columns: str) -> DataFrame:
    """Shuffle few but costly rows over all cores; adaptive execution would merge them again
    because they are small, unless the number of partitions is given."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), *columns)


@contextmanager
def listed_in_bunches(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by a few tasks per core while a reader is made, where Spark would start a
    task for each folder."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def made_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that are worked out once per row, however often later ones look at them.

    Around a Python function the optimizer repeats an expression wherever its column is used, so a text
    would be normalised many times over; it does not do so across a generator, here of one row.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(row)))
