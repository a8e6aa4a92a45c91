"""Readers of manifests, sample records, transcripts, run settings and threshold rows."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from tonemark import schemas
from tonemark.functions.text import strip
from tonemark.operators.gates import threshold_table
from tonemark.plans.session import listed_in_bunches

__all__ = [
    "read_manifest",
    "read_any_manifest",
    "read_gate_set",
    "read_ood_set",
    "read_unnamed_set",
    "read_sample_records",
    "read_transcripts",
    "read_keep_tone",
    "keep_tone_of",
    "existing",
    "threshold_table",
]


def _strict(spark: SparkSession) -> DataFrameReader:
    return spark.read.option("mode", "FAILFAST")


def read_manifest(spark: SparkSession, path: str, schema: str = schemas.MANIFEST) -> DataFrame:
    """SRC1: one JSON object per line; blank lines are skipped, a broken line is an error."""
    return _strict(spark).schema(schema).json(path)


def read_any_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: a JSON array or one object per line, told apart by each file's first character.

    ``text_raw`` stands in for a missing ``text``. A folder may hold files of both forms; broken
    JSON is an error.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    # an array starts in a file's first line, and no row of a file of rows starts with a bracket
    starts = F.max(F.ltrim("value").startswith("["))
    forms = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(starts.alias("is_array")).collect()
    rows = spark.createDataFrame([], schemas.RAW_MANIFEST)
    for is_array in (True, False):
        files = [unquote(r["file"]) for r in forms if r["is_array"] == is_array]
        if files:
            reader = _strict(spark).schema(schemas.RAW_MANIFEST).option("multiLine", is_array)
            rows = rows.unionByName(reader.json(files))
    return rows.select("id", "audio", F.coalesce("text", "text_raw").alias("text"))


def read_gate_set(spark: SparkSession, path: str) -> DataFrame:
    return read_manifest(spark, path, schemas.GATE_SET).withColumnRenamed("dur_s", "duration_s")


def read_ood_set(spark: SparkSession, path: str) -> DataFrame:
    return read_manifest(spark, path, schemas.OOD_SET).withColumnRenamed("duration", "duration_s")


def read_unnamed_set(spark: SparkSession, path: str) -> DataFrame:
    """A manifest without ids: the id is the stem of the audio file."""
    rows = read_manifest(spark, path, schemas.UNNAMED_SET)
    stem = F.regexp_extract("audio", "([^/]+?)(\\.[^./]*)?$", 1)
    return rows.select(stem.alias("id"), "audio", "text")


def read_sample_records(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: sample records with their latency structs; NaN tokens become NaN, broken lines fail."""
    return _strict(spark).schema(schemas.SAMPLE_RECORD).json(path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: one trimmed text per file."""
    with listed_in_bunches(spark):
        files = spark.read.text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), strip(F.col("value")).alias("text"))


def read_keep_tone(spark: SparkSession, run_dir: str) -> DataFrame:
    """SRC6: the run's tone setting, true when the file, the key or valid JSON is missing."""
    meta = (
        spark.read.schema(schemas.RUN_META)
        .option("multiLine", True)
        .option("pathGlobFilter", "run_meta.json")
        .json(run_dir)
    )
    # an aggregate without keys has one row even when no file was found
    setting = F.coalesce(F.first("config.keep_tone", ignorenulls=True), F.lit(True))
    return meta.agg(setting.alias("keep_tone"))


def keep_tone_of(meta: Column) -> Column:
    """SRC6 for run settings held as a JSON column: true for a missing key, null or broken JSON."""
    parsed = F.from_json(meta, schemas.RUN_META)
    return F.coalesce(parsed["config"]["keep_tone"], F.lit(True))


def existing(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """The paths that exist; missing evaluation manifests are skipped, not an error."""
    found = []
    for path in paths:
        try:
            spark.read.text(path).schema  # noqa: B018
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            found.append(path)
    return found
