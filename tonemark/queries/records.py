"""REC1-REC5, SNK3."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonemark.operators import records as rc
from tonemark.operators.latency import latency_struct
from tonemark.queries.base import SQL_PAIRS, Check, shown_ends, spread_of, sql_ends, table, triples
from tonemark.queries.latency import SQL_COSINE, neighbours
from tonemark.sources.manifests import keep_tone_of


def _stage_tables(spark, sf, blank=False):
    """Manifest and stage tables from documents; synthesis failed for unlabelled documents. Documents
    without words are left out but with ``blank``."""
    rows = triples(spark, sf, blank).withColumn("id", F.col("doc_id"))
    seconds = F.col("n_chars") / 100
    manifest = rows.select("id", "lang", F.col("ref").alias("text"))
    first = rows.select("id", F.col("drop").alias("asr_text"), latency_struct(seconds / 8, seconds).alias("asr_latency"))
    made = rows.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    ttfa = F.when(F.col("lang") != "de", seconds / 16)
    synthesis = made.select(
        "id",
        latency_struct(seconds / 4, seconds / 2, ttfa_s=ttfa).alias("tts_latency"),
        (F.col("n_chars") % 100 / 100).alias("speaker_sim"),
    )
    second = rows.select("id", F.col("fill").alias("roundtrip_text"))
    return manifest, first, synthesis, second


def _records(spark, sf, blank=False):
    return rc.assemble(*_stage_tables(spark, sf, blank))


def _rec1(spark, sf):
    return _records(spark, sf).select(
        "sample_id",
        F.length("ref_text").cast("bigint").alias("ref_chars"),
        F.col("asr_latency.rtf").alias("asr_rtf"),
        F.col("tts_latency.total_s").alias("tts_s"),
        "speaker_sim",
        F.col("mos").isNull().alias("no_mos"),
        F.element_at("extra", "tts_input_source").alias("tts_input"),
    )


_SQL_REC1 = f"""
WITH {SQL_PAIRS}
SELECT doc_id::VARCHAR AS sample_id, chars::BIGINT AS ref_chars,
       (n_chars / 100.0::DOUBLE / 8) / (n_chars / 100.0::DOUBLE) AS asr_rtf,
       n_chars / 100.0::DOUBLE / 4 AS tts_s,
       n_chars % 100 / 100.0::DOUBLE AS speaker_sim, true AS no_mos, 'ref_text' AS tts_input
FROM scored WHERE model = 'drop' AND doc_id IN (SELECT doc_id FROM labels)
"""


def _rec2(spark, sf):
    source = F.when(F.col("role") == "user", "ref_text").otherwise("asr_text")
    rows = table(spark, sf, "conversations")
    chosen = rc.synthesis_input(source, F.col("text"), F.concat(F.lit("heard: "), "text"))
    return rows.select("conv_id", "turn", chosen.alias("tts_text"))


def _rec3(spark, sf):
    rows = neighbours(spark, sf)
    similar = rc.voice_similarity(F.col("label") % 2 == 0, F.col("embedding"), F.col("other"))
    return rows.select("vec_id", F.round(similar, 9).alias("speaker_sim"))


def _rec4(spark, sf):
    manifest, *_ = _stage_tables(spark, sf, blank=True)
    return rc.failures(manifest, _records(spark, sf, blank=True)).select("id", "lang")


def _rec4_counts(spark, sf):
    manifest, *_ = _stage_tables(spark, sf, blank=True)
    return rc.run_counts(manifest, _records(spark, sf, blank=True))


def reported(spark, sf, **options):
    """One report per language."""
    manifest, *_ = _stage_tables(spark, sf)
    langs = manifest.select(F.col("id").cast("string").alias("sample_id"), "lang")
    rows = _records(spark, sf).join(langs, "sample_id")
    made = rc.report(rows, ["lang"], **options)
    # the ends of the similarity's interval in the form that SQL can compare
    spread = rows.groupBy("lang").agg(*spread_of(F.col("speaker_sim")))
    low, high = shown_ends(F.col("speaker_sim.low"), F.col("speaker_sim.high"), F.col("speaker_sim.n"))
    ends = F.struct(*[low if n == "low" else high if n == "high" else F.col(f"speaker_sim.{n}") for n in
                      ("point", "low", "high", "cl", "n", "degenerate")])
    return made.join(spread, "lang").withColumn("speaker_sim", ends).drop("_m", "_sd", "_g")


def _rec5(spark, sf):
    table_ = reported(spark, sf)
    return table_.select(
        "lang",
        "n",
        "keep_tone",
        "asr_wer",
        "asr_cer",
        "rt_wer",
        "rt_cer",
        F.round("delta_wer", 12).alias("delta_wer"),
        "substitutions",
        "deletions",
        "insertions",
        F.round("asr_latency.median_s", 9).alias("asr_median_s"),
        F.round("asr_latency.p90_s", 9).alias("asr_p90_s"),
        F.round("asr_rtf.median_s", 9).alias("asr_rtf_median"),
        F.round("tts_latency.p99_s", 9).alias("tts_p99_s"),
        F.round("tts_rtf.mean_s", 9).alias("tts_rtf_mean"),
        F.col("tts_ttfa").isNotNull().alias("has_ttfa"),
        F.round(F.coalesce("tts_ttfa.median_s", F.lit(-1.0)), 9).alias("ttfa_median_s"),
        F.round("speaker_sim.point", 9).alias("sim_point"),
        F.col("speaker_sim.n").alias("sim_n"),
        F.col("speaker_sim.low").alias("sim_low"),
        F.col("speaker_sim.high").alias("sim_high"),
        F.col("mos").isNull().alias("no_mos"),
    )


SQL_REPORT = f"""
{SQL_PAIRS},
lab AS (SELECT * FROM scored WHERE doc_id IN (SELECT doc_id FROM labels)),
rates AS (
  SELECT lang, count(*) FILTER (model = 'drop') AS n,
         sum(s + d + i) FILTER (model = 'drop') / (sum(n) FILTER (model = 'drop'))::DOUBLE AS asr_wer,
         sum(cs + cd + ci) FILTER (model = 'drop') / (sum(chars) FILTER (model = 'drop'))::DOUBLE AS asr_cer,
         sum(s + d + i) FILTER (model = 'fill') / (sum(n) FILTER (model = 'fill'))::DOUBLE AS rt_wer,
         sum(cs + cd + ci) FILTER (model = 'fill') / (sum(chars) FILTER (model = 'fill'))::DOUBLE AS rt_cer,
         (sum(s) FILTER (model = 'drop'))::BIGINT AS substitutions,
         (sum(d) FILTER (model = 'drop'))::BIGINT AS deletions, 0::BIGINT AS insertions
  FROM lab GROUP BY lang
),
times AS (
  SELECT lang, n_chars / 100.0::DOUBLE AS sec, (n_chars / 100.0::DOUBLE / 8) / (n_chars / 100.0::DOUBLE) AS artf,
         (n_chars / 100.0::DOUBLE / 4) / (n_chars / 100.0::DOUBLE / 2) AS trtf,
         n_chars % 100 / 100.0::DOUBLE AS sim
  FROM lab WHERE model = 'drop'
),
speed AS (
  SELECT lang, round(quantile_cont(sec / 8, 0.5), 9) AS asr_median_s, round(quantile_cont(sec / 8, 0.9), 9) AS asr_p90_s,
         round(quantile_cont(artf, 0.5), 9) AS asr_rtf_median, round(quantile_cont(sec / 4, 0.5), 9) AS tts_median_s,
         round(quantile_cont(sec / 4, 0.9), 9) AS tts_p90_s, round(quantile_cont(sec / 4, 0.99), 9) AS tts_p99_s,
         round(avg(trtf), 9) AS tts_rtf_mean, round(quantile_cont(trtf, 0.5), 9) AS tts_rtf_median,
         lang <> 'de' AS has_ttfa, round(quantile_cont(sec / 16, 0.5), 9) AS ttfa_median,
         round(quantile_cont(sec / 16, 0.9), 9) AS ttfa_p90,
         round(avg(sim), 9) AS sim_point, count(*) AS sim_n, {sql_ends('sim')}
  FROM times GROUP BY lang
)"""
_SQL_REC5 = f"""
WITH {SQL_REPORT}
SELECT lang, n, true AS keep_tone, asr_wer, asr_cer, rt_wer, rt_cer, round(rt_wer - asr_wer, 12) AS delta_wer,
       substitutions, deletions, insertions, asr_median_s, asr_p90_s, asr_rtf_median, tts_p99_s, tts_rtf_mean,
       has_ttfa, CASE WHEN has_ttfa THEN ttfa_median ELSE -1 END AS ttfa_median_s, sim_point, sim_n,
       low AS sim_low, high AS sim_high, true AS no_mos
FROM rates JOIN speed USING (lang)
"""


def _rec5_runs(spark, sf):
    """Each language is a run with settings of its own: without tone, without the key, broken."""
    manifest, *_ = _stage_tables(spark, sf)
    langs = manifest.select(F.col("id").cast("string").alias("sample_id"), "lang")
    meta = (
        F.when(F.col("lang") == "de", '{"config": {"keep_tone": false}}')
        .when(F.col("lang") == "fr", '{"config": {}}')
        .when(F.col("lang") == "es", '{"config": ')
        .otherwise('{"config": {"keep_tone": true}}')
    )
    rows = _records(spark, sf).join(langs, "sample_id")
    made = rc.report(rows, ["lang"], keep_tone_of(meta), n_resamples=200)
    return made.select("lang", "keep_tone", "asr_wer", "asr_cer", "rt_wer", "rt_cer", "substitutions")


_SQL_REC5_RUNS = f"""
WITH {SQL_PAIRS},
lab AS (
  SELECT *, lang <> 'de' AS keep, CASE WHEN lang = 'de' THEN s_nt ELSE s END AS ws, CASE WHEN lang = 'de' THEN s_nt ELSE cs END AS cc
  FROM scored WHERE doc_id IN (SELECT doc_id FROM labels)
)
SELECT lang, bool_and(keep) AS keep_tone,
       sum(ws + d + i) FILTER (model = 'drop') / (sum(n) FILTER (model = 'drop'))::DOUBLE AS asr_wer,
       sum(cc + cd + ci) FILTER (model = 'drop') / (sum(chars) FILTER (model = 'drop'))::DOUBLE AS asr_cer,
       sum(ws + d + i) FILTER (model = 'fill') / (sum(n) FILTER (model = 'fill'))::DOUBLE AS rt_wer,
       sum(cc + cd + ci) FILTER (model = 'fill') / (sum(chars) FILTER (model = 'fill'))::DOUBLE AS rt_cer,
       (sum(ws) FILTER (model = 'drop'))::BIGINT AS substitutions
FROM lab GROUP BY lang
"""


def _snk3(spark, sf):
    """All rows of the report."""
    return rc.report_rows(reported(spark, sf), ["lang"]).withColumn("value", F.round("value", 7))


_SNK3_CELLS = [
    ("accuracy", "asr", "wer", "asr_wer"),
    ("accuracy", "asr", "cer", "asr_cer"),
    ("accuracy", "roundtrip", "wer", "rt_wer"),
    ("accuracy", "roundtrip", "cer", "rt_cer"),
    ("accuracy", "delta", "wer", "rt_wer - asr_wer"),
    ("accuracy", "asr", "substitutions", "substitutions"),
    ("accuracy", "asr", "deletions", "deletions"),
    ("accuracy", "asr", "insertions", "insertions"),
    ("latency", "asr", "median_s", "asr_median_s"),
    ("latency", "asr", "p90_s", "asr_p90_s"),
    ("latency", "asr", "rtf_median", "asr_rtf_median"),
    ("latency", "tts", "median_s", "tts_median_s"),
    ("latency", "tts", "p90_s", "tts_p90_s"),
    ("latency", "tts", "rtf_median", "tts_rtf_median"),
    ("latency", "ttfa", "median_s", "CASE WHEN has_ttfa THEN ttfa_median END"),
    ("latency", "ttfa", "p90_s", "CASE WHEN has_ttfa THEN ttfa_p90 END"),
    ("fidelity", "speaker_sim", "point", "sim_point"),
    ("fidelity", "speaker_sim", "low", "low"),
    ("fidelity", "speaker_sim", "high", "high"),
    ("fidelity", "speaker_sim", "n", "sim_n"),
]
_SQL_SNK3 = f"WITH {SQL_REPORT}, w AS (SELECT * FROM rates JOIN speed USING (lang)) SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT lang, '{section}' AS section, '{metric}' AS metric, '{stat}' AS stat, round(({value})::DOUBLE, 7) AS value FROM w"
    for section, metric, stat, value in _SNK3_CELLS
) + ") WHERE value IS NOT NULL"

QUERIES = {
    "REC1": Check(_rec1, _SQL_REC1),
    "REC2": Check(
        _rec2,
        "SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE 'heard: ' || text END AS tts_text "
        "FROM conversations",
    ),
    "REC3": Check(
        _rec3,
        f"SELECT a.vec_id, round(CASE WHEN a.label % 2 = 0 THEN {SQL_COSINE} END, 9) AS speaker_sim "
        "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    ),
    "REC4": Check(
        _rec4,
        "SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "REC4_counts": Check(
        _rec4_counts,
        "SELECT count(*) AS n_samples, count(l.doc_id) AS n_results, count(*) - count(l.doc_id) AS n_failed "
        "FROM documents d LEFT JOIN labels l USING (doc_id)",
    ),
    "REC5": Check(_rec5, _SQL_REC5),
    "REC5_runs": Check(_rec5_runs, _SQL_REC5_RUNS),
    "SNK3": Check(_snk3, _SQL_SNK3),
}
