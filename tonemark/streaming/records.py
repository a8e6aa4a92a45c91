"""Sample records as they are written: the run appends JSON lines, the table follows."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tonemark import schemas


def follow_records(
    spark: SparkSession, landing: str, table: str, checkpoint: str
) -> StreamingQuery:
    """SNK1: append every new record file to the table, exactly once, then stop.

    ``checkpoint`` is a folder that all nodes share; starting again goes on where it stopped.
    """
    arriving = spark.readStream.schema(schemas.SAMPLE_RECORD).json(landing)
    return (
        arriving.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
