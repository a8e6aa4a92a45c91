"""The corpus pipeline: documents in, encoded documents out.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of documents. Rows
with null or repeated ids, null texts and null sources pass through the stages like others; each
stage says below what it does with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonemark.llm import bpe, mixing, quality_rules, secrets, simhash
from tonemark.llm.queries import VOCABULARY
from tonemark.llm.shared import cut
from tonemark.plans.session import scratch_path, ship_package, spread

ship_package()

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a fixed rule or the outlier rule rejects go; a null text has no words, so goes."""
    return quality_rules.rate(spread(docs)).where("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays, one row of it; null is
    the largest id. Groups are told apart by their texts, so rows that share an id, or have none, go
    only where their texts are near copies."""
    digest = F.xxhash64("text").alias("_text")
    found = simhash.near_duplicates(spread(docs.select("doc_id", "text", digest)), carry=["_text"])
    place = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_text")
    first = found.groupBy("component_root").agg(F.min(place).alias("_first"))
    first = first.select(F.struct("_first.doc_id", "_first._text").alias("_key"))
    keyed = docs.withColumn("_key", F.struct("doc_id", digest))
    return keyed.join(first, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are taken out of the texts; every document stays."""
    return secrets.redact(spread(docs)).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those it does not take go."""
    sized = docs.withColumn("_size", mixing.word_count(F.col("text"))).withColumn("_key", F.struct("doc_id"))
    # stored, as it is read for the sums and for the mix, and counting words takes the whole texts
    slim = cut(sized.select("doc_id", "_key", "source", "_size"), "sizes")
    sums = slim.groupBy("source").agg(F.sum("_size").alias("source_size"))
    taken = mixing.mix(slim, mixing.targets(sums), "doc_id", "_size", F.array("source"))
    times = taken.where("taken > 0").select("_key", "_size", (F.col("taken") / F.col("_size")).cast("int").alias("_times"))
    # rows with equal id and size are told apart by number, the most taken first
    alike = Window.partitionBy("_key", "_size")
    times = times.withColumn("_nth", F.row_number().over(alike.orderBy(F.desc("_times"))))
    rows = sized.withColumn("_nth", F.row_number().over(alike.orderBy(F.xxhash64("text", "source"))))
    used = rows.join(times, ["_key", "_size", "_nth"])
    return used.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document as little-endian unsigned 32-bit integers, and whether they decode
    to its text."""
    coded = bpe.encode_decode(spread(docs), VOCABULARY)
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", exact.alias("exact"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_copies),
    ("secret_scan", secret_scan),
    ("source_mixing", mix),
    ("bpe", encode),
]

#: Outliers, ball hashing, the flow and the merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
