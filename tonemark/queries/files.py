"""SRC1-SRC7 and SNK1-SNK5: tables written to the shared scratch folder and read back."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemark.operators.accuracy import corpus_rate
from tonemark.operators.latency import latency_struct
from tonemark.plans.session import scratch_path, spread_by
from tonemark.queries.accuracy import _WORDS
from tonemark.queries.base import (
    SQL_LATENCY,
    Check,
    documents,
    latency,
    pairs,
    sql_pooled,
    sql_strip,
    table,
)
from tonemark.sources import manifests as mf
from tonemark.sources import sinks
from tonemark.sources.audio import read_audio_features
from tonemark.streaming.records import follow_records


def _manifest_rows(spark, sf, text: str = "text"):
    return documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("clips/"), "doc_id", F.lit(".wav")).alias("audio"),
        F.col("text").alias(text),
    )


_SQL_MANIFEST = "SELECT doc_id::VARCHAR AS id, 'clips/' || doc_id || '.wav' AS audio, text FROM documents"


def _src1(spark, sf):
    path = scratch_path(spark, "manifest")
    # a blank line behind every row
    lines = _manifest_rows(spark, sf).select(F.concat(F.to_json(F.struct("*")), F.lit("\n  ")))
    lines.write.text(path)
    return mf.read_manifest(spark, path)


def _src2(spark, sf):
    """One folder with files of both forms: arrays of 500 documents, and a row per line."""
    path = scratch_path(spark, "raw-manifest")
    rows = _manifest_rows(spark, sf, "text_raw").withColumn("_n", F.col("id").cast("bigint"))
    even = F.col("_n") % 2 == 0
    fields = F.struct("id", "audio", "text_raw")
    arrays = rows.where(even).groupBy(F.floor(F.col("_n") / 1000).alias("part")).agg(F.collect_list(fields).alias("r"))
    arrays = arrays.select("part", F.lit("array").alias("form"), F.to_json("r").alias("value"))
    arrays.write.partitionBy("form", "part").text(path)
    lines = rows.where(~even).select(F.lit(0).alias("part"), F.lit("lines").alias("form"), F.to_json(fields).alias("value"))
    lines.write.mode("append").partitionBy("form", "part").text(path)
    return mf.read_any_manifest(spark, path)


def record_rows(spark, sf):
    """Events as sample records; factors are NaN where media has no length."""
    block = latency_struct(F.col("total_s"), F.col("media_s"))
    return latency(spark, sf).select(
        F.col("event_id").cast("string").alias("sample_id"),
        F.col("model").alias("ref_text"),
        F.concat("model", F.lit("?")).alias("asr_text"),
        F.col("model").alias("roundtrip_text"),
        block.alias("asr_latency"),
        block.alias("tts_latency"),
        F.when(F.col("user_id") % 2 == 0, F.col("user_id") / 100).alias("speaker_sim"),
        F.lit(None).cast("double").alias("mos"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("extra"),
    )


def _seen(records):
    return records.select(
        "sample_id",
        "asr_text",
        F.col("asr_latency.total_s").alias("total_s"),
        F.nanvl("asr_latency.rtf", F.lit(-1.0)).alias("rtf"),
        F.isnan("tts_latency.rtf").alias("no_media"),
        F.col("asr_latency.ttfa_s").isNull().alias("no_ttfa"),
        "speaker_sim",
        F.element_at("extra", "user").alias("user"),
    )


_SQL_RECORDS = f"""
WITH {SQL_LATENCY}
SELECT event_id::VARCHAR AS sample_id, model || '?' AS asr_text, total_s, coalesce(rtf, -1) AS rtf,
       rtf IS NULL AS no_media, true AS no_ttfa,
       CASE WHEN user_id % 2 = 0 THEN user_id / 100::DOUBLE END AS speaker_sim, user_id::VARCHAR AS user
FROM latency
"""


def _write_bare_nan(records, path):
    """Records with bare NaN tokens, as other writers of JSON leave them."""
    line = F.replace(F.to_json(F.struct("*")), F.lit('"NaN"'), F.lit("NaN"))
    records.select(line).write.text(path)


def _src3(spark, sf):
    path = scratch_path(spark, "records")
    _write_bare_nan(record_rows(spark, sf), path)
    return _seen(mf.read_sample_records(spark, path))


def _write_transcripts(spark, sf) -> str:
    """One text file per conversation, a line per turn; the folder they are in is ``transcripts``.

    Each task opens the files of its conversations itself: a writer that sets up, moves and commits a
    folder for each of them takes many times as long as the texts.
    """
    path = f"{scratch_path(spark, 'set')}/transcripts"
    system, base = fs.FileSystem.from_uri(path)
    system.create_dir(base, recursive=True)
    rows = spread_by(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id")
    ordered = rows.sortWithinPartitions("conv_id", "turn").select("conv_id", "text")

    def run(batches):
        system, base = fs.FileSystem.from_uri(path)
        last, out, n = None, None, 0
        for batch in batches:
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist()):
                if out is None or conv != last:
                    if out is not None:
                        out.close()
                    folder = f"{base}/conv_id={'__HIVE_DEFAULT_PARTITION__' if conv is None else conv}"
                    system.create_dir(folder)
                    last, out, n = conv, system.open_output_stream(f"{folder}/part.txt"), n + 1
                out.write(((text or "") + "\n").encode())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    ordered.mapInArrow(run, "n long").agg(F.sum("n")).first()
    return path


def _src4(spark, sf):
    files = mf.read_transcripts(spark, _write_transcripts(spark, sf))
    conv = F.regexp_extract("path", "conv_id=(\\d+)", 1).cast("bigint")
    return files.select(conv.alias("conv_id"), "text")


def _snk4(spark, sf):
    """Transcripts as clips, and the regions' names as the manifest before them."""
    root = _write_transcripts(spark, sf).removesuffix("/transcripts")
    names = table(spark, sf, "region").orderBy("r_regionkey").select("r_name")
    names.coalesce(1).write.text(f"{root}/manifest")
    listed = sinks.checksums(spark, root, ["manifest"], "transcripts", glob="*.txt")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    digest = F.substring_index("line", "  ", 1)
    return listed.select("ord", folder.alias("folder"), digest.alias("sha256"))


def _src6(spark, sf):
    """Run settings with the key, without it, and broken, by the event's number."""
    k = F.get_json_object("props", "$.k").cast("int")
    meta = (
        F.when(k < 30, F.lit('{"config": {"keep_tone": false}}'))
        .when(k < 60, F.lit('{"config": {"other": 1}}'))
        .when(k < 80, F.lit('{"config": {"keep_tone": true}}'))
        .otherwise(F.lit('{"config": '))
    )
    rows = table(spark, sf, "events").select("event_type", mf.keep_tone_of(meta).alias("keep_tone"))
    return rows.groupBy("event_type", "keep_tone").agg(F.count(F.lit(1)).alias("n"))


@F.pandas_udf(T.BinaryType())
def _wav_bytes(samples: pd.Series) -> pd.Series:
    def encode(values: np.ndarray) -> bytes:
        out = io.BytesIO()
        with wave.open(out, "wb") as clip:
            clip.setparams((1, 2, 16000, 0, "NONE", ""))
            clip.writeframes(np.rint(np.asarray(values, np.float64) * 32767).astype("<i2").tobytes())
        return out.getvalue()

    return samples.map(encode)


def _write_clips(clips, folder: str):
    """One file per clip below a shared folder; the number of files written comes back."""

    def run(frames):
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"]):
                with system.open_output_stream(f"{base}/{name}.wav") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(frame)]})

    return clips.mapInPandas(run, "n long").agg(F.sum("n")).first()[0]


def _src7(spark, sf):
    """Clips written as files and scanned."""
    clips = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("name"), _wav_bytes("embedding").alias("content")
    )
    folder = scratch_path(spark, "clips")
    _write_clips(clips, folder)
    return read_audio_features(spark, folder).select(
        F.regexp_extract("path", "([^/]+)\\.wav$", 1).alias("path"),
        F.col("sample_rate").cast("bigint").alias("sample_rate"),
        "n_samples",
        "duration_s",
        F.round("rms", 7).alias("rms"),
        F.round("clip_ratio", 7).alias("clip_ratio"),
    )


_SQL_SRC7 = """
WITH s AS (
  SELECT vec_id, list_transform(embedding, lambda x: round_even(x::DOUBLE * 32767, 0) / 32768) AS v FROM embeddings
)
SELECT vec_id::VARCHAR AS path, 16000::BIGINT AS sample_rate, len(v)::BIGINT AS n_samples,
       len(v) / 16000::DOUBLE AS duration_s,
       round(sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v)), 7) AS rms,
       round(len(list_filter(v, lambda x: abs(x) >= 0.999)) / len(v)::DOUBLE, 7) AS clip_ratio
FROM s
"""


def _snk1(spark, sf):
    """Two appends to one table, then the table."""
    path = scratch_path(spark, "record-table")
    rows = record_rows(spark, sf)
    for run in ("a", "b"):
        sinks.append_records(rows.withColumn("run_id", F.lit(run)), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("asr_latency.total_s"), 4).alias("total_s")
    )


def _snk1_stream(spark, sf):
    """Two batches of record files, followed by one table that reads each file once."""
    landing, store, state = (scratch_path(spark, n) for n in ("landing", "followed", "state"))
    rows = record_rows(spark, sf)
    for even in (True, False):
        part = rows.where((F.col("sample_id").cast("bigint") % 2 == 0) == even)
        part.write.mode("append").json(landing)
        follow_records(spark, landing, store, state).awaitTermination()
    return _seen(spark.read.parquet(store))


def _snk2(spark, sf):
    path = scratch_path(spark, "aggregate")
    sums = latency(spark, sf).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.max("total_s").alias("max_s"), F.lit(None).cast("double").alias("mos")
    )
    sinks.write_aggregate(sums, path)
    back = spark.read.schema("model string, n bigint, max_s double, mos double").json(path)
    kept = spark.read.text(path).select(F.get_json_object("value", "$.model").alias("model"),
                                        F.contains("value", F.lit('"mos":null')).alias("keeps_null"))
    return back.join(kept, "model").select("model", "n", "max_s", "keeps_null")


def _snk5(spark, sf):
    """Pairs kept next to the aggregates give the same rates when scored again."""
    path = scratch_path(spark, "pairs")
    rows = pairs(spark, sf).select("doc_id", "lang", "ref", "hyp", F.col("model").alias("run_id"))
    sinks.write_pairs(rows, path)
    stored = spark.read.parquet(path).withColumnRenamed("run_id", "model")
    return corpus_rate(stored, ["lang", "model"], F.col("ref"), F.col("hyp"))


QUERIES = {
    "SRC1": Check(_src1, _SQL_MANIFEST),
    "SRC2": Check(_src2, _SQL_MANIFEST),
    "SRC3": Check(_src3, _SQL_RECORDS),
    "SRC4": Check(
        _src4,
        f"SELECT conv_id, {sql_strip('string_agg(text, chr(10) ORDER BY turn)')} AS text "
        "FROM conversations GROUP BY conv_id",
    ),
    "SRC6": Check(
        _src6,
        "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) >= 30 AS keep_tone, "
        "count(*) AS n FROM events GROUP BY 1, 2",
    ),
    "SRC7": Check(_src7, _SQL_SRC7),
    "SNK1": Check(
        _snk1,
        f"WITH {SQL_LATENCY} SELECT run_id, count(*) AS n, round(sum(total_s), 4) AS total_s "
        "FROM latency, (VALUES ('a'), ('b')) r(run_id) GROUP BY run_id",
    ),
    "SNK1_stream": Check(_snk1_stream, _SQL_RECORDS),
    "SNK2": Check(
        _snk2,
        f"WITH {SQL_LATENCY} SELECT model, count(*) AS n, max(total_s) AS max_s, true AS keeps_null "
        "FROM latency GROUP BY model",
    ),
    "SNK4": Check(
        _snk4,
        "SELECT 1::INTEGER AS ord, 'transcripts/conv_id=' || conv_id AS folder, "
        "sha256(string_agg(text, chr(10) ORDER BY turn) || chr(10)) AS sha256 FROM conversations GROUP BY conv_id "
        "UNION ALL SELECT 0, 'manifest', sha256(string_agg(r_name, chr(10) ORDER BY r_regionkey) || chr(10)) FROM region",
    ),
    "SNK5": Check(_snk5, sql_pooled("lang, model", _WORDS)),
}
