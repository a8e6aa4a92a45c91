"""TQ1-TQ8, AQ1-AQ7, INT1-INT7."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonemark.functions import text as tx
from tonemark.functions.vectors import clip_ratio, rms
from tonemark.operators import integrity as integ
from tonemark.operators.gates import TTS_GATES, gate, measures, threshold_table
from tonemark.operators.quality import (
    AUDIO_RULES,
    TEXT_RULES,
    audio_flags,
    audio_percentages,
    offending_characters,
    percentage,
    text_flags,
    text_percentages,
)
from tonemark.queries.base import (
    SQL_NOISY,
    Check,
    documents,
    noisy,
    sql_key,
    sql_strip,
    sql_word_count,
    table,
)

_SQL_FLAGS = {
    "is_empty": "false",
    "has_upper": "regexp_matches(text, '\\p{Lu}')",
    "has_punct": f"regexp_matches(text, '{tx.PUNCT_CLASS}')",
    "has_digit": "regexp_matches(text, '[0-9]')",
    "not_composed": "text <> nfc_normalize(text)",
    "has_odd_space": f"regexp_matches(text, '{tx.ODD_SPACE_CLASS}')",
    "outside_alphabet": f"regexp_matches(lower(nfc_normalize(text)), '{tx.outside_alphabet_class()}')",
    "too_short": f"{sql_word_count('nfc_normalize(text)')} < 2",
}
_BLANK = f"{sql_strip('text')} = ''"


def _sql_flag(flag: str) -> str:
    return _BLANK if flag == "is_empty" else f"(NOT ({_BLANK}) AND {_SQL_FLAGS[flag]})"


def _sql_pct(condition: str) -> str:
    return f"count(*) FILTER ({condition}) * 100.0::DOUBLE / count(*)"


def _text_rule(rule: str) -> Check:
    flag, _ = TEXT_RULES[rule]

    def run(spark, sf):
        flagged = text_flags(noisy(spark, sf), F.col("text"))
        return flagged.groupBy("lang").agg(percentage(F.col(flag)).alias("pct"))

    sql = f"WITH {SQL_NOISY} SELECT lang, {_sql_pct(_sql_flag(flag))} AS pct FROM noisy GROUP BY lang"
    return Check(run, sql)


def sql_text_percentages(keys: str) -> str:
    """All text rules in one pass, as the columns of ``text_percentages``."""
    columns = ", ".join(
        f'{_sql_pct(_sql_flag(flag))} AS "{rule}"' for rule, (flag, _) in TEXT_RULES.items()
    )
    return f"SELECT {keys}, {columns} FROM noisy GROUP BY {keys}"


_SQL_TQ7_CHARS = f"""
WITH {SQL_NOISY},
found AS (
  SELECT unnest(list_distinct(regexp_extract_all(lower(nfc_normalize(text)),
                '{tx.outside_alphabet_class()}'))) AS char
  FROM noisy WHERE NOT ({_BLANK})
)
SELECT char, count(*) AS n_rows FROM found GROUP BY char ORDER BY n_rows DESC, char LIMIT 5
"""


def clips(spark, sf):
    """Embeddings as short waveforms with documents as their transcripts, faults by label."""
    gain = F.when(F.col("label") == 5, 0.01).when(F.col("label") == 7, 10.0).otherwise(1.0)
    waves = table(spark, sf, "embeddings").select(
        "vec_id",
        "label",
        F.transform("embedding", lambda x: x.cast("double") * gain).alias("samples"),
        F.when(F.col("label") == 3, 8000).otherwise(16000).alias("sample_rate"),
        (F.col("vec_id") % 400 / 10).alias("duration_s"),
    )
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return waves.join(texts, "vec_id").select(
        "vec_id",
        "label",
        "sample_rate",
        "duration_s",
        rms(F.col("samples")).alias("rms"),
        clip_ratio(F.col("samples")).alias("clip_ratio"),
        "text",
    )


SQL_CLIPS = f"""
waves AS (
  SELECT vec_id, label, vec_id % 400 / 10.0::DOUBLE AS duration_s,
         CASE WHEN label = 3 THEN 8000 ELSE 16000 END AS sample_rate,
         list_transform(embedding, lambda x: x::DOUBLE *
           CASE label WHEN 5 THEN 0.01::DOUBLE WHEN 7 THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END) AS samples
  FROM embeddings
),
clips AS (
  SELECT vec_id, label, sample_rate, duration_s,
         sqrt(list_sum(list_transform(samples, lambda x: x * x)) / len(samples)) AS rms,
         len(list_filter(samples, lambda x: abs(x) >= 0.999)) / len(samples)::DOUBLE AS clip_ratio,
         CASE WHEN duration_s > 0 THEN {sql_word_count(sql_key('text'))} / duration_s ELSE 0 END AS wps
  FROM waves JOIN documents ON doc_id = vec_id
)"""
_SQL_AUDIO = {
    "AUD-samplerate": "sample_rate <> 16000",
    "AUD-dur": "duration_s < 0.8 OR duration_s > 30",
    "AUD-rms": "rms < 0.005",
    "AUD-clip": "clip_ratio > 0.01",
    "AUD-wps": "NOT (wps BETWEEN 0.5 AND 6.5)",
    "AUD-durdist": "duration_s >= 10",
}


def _flagged_clips(spark, sf):
    return audio_flags(
        clips(spark, sf),
        F.col("sample_rate"),
        F.col("duration_s"),
        F.col("rms"),
        F.col("clip_ratio"),
        F.col("text"),
    )


def _audio_rule(rule: str) -> Check:
    flag = "long_clip" if rule == "AUD-durdist" else AUDIO_RULES[rule][0]

    def run(spark, sf):
        return _flagged_clips(spark, sf).groupBy("label").agg(percentage(F.col(flag)).alias("pct"))

    sql = f"WITH {SQL_CLIPS} SELECT label, {_sql_pct(_SQL_AUDIO[rule])} AS pct FROM clips GROUP BY label"
    return Check(run, sql)


def _all_audio(spark, sf):
    return audio_percentages(_flagged_clips(spark, sf), ["label"])


_SQL_ALL_AUDIO = (
    f"WITH {SQL_CLIPS} SELECT label, "
    + ", ".join(f'{_sql_pct(c)} AS "{rule}"' for rule, c in _SQL_AUDIO.items())
    + " FROM clips GROUP BY label"
)


def _features(spark, sf):
    rows = clips(spark, sf)
    return rows.select("vec_id", F.round("rms", 9).alias("rms"), F.round("clip_ratio", 9).alias("clip_ratio"))


def _aq7(spark, sf):
    made = clips(spark, sf).select(
        "vec_id",
        F.col("duration_s").alias("min_dur_s"),
        F.col("rms").alias("min_rms"),
        F.coalesce(1 / F.nullif("duration_s", F.lit(0.0)), F.lit(float("nan"))).alias("rtf_max"),
    )
    measured = measures(made, ["vec_id"], "tts", ["min_dur_s", "min_rms", "rtf_max"])
    # the round trip is measured elsewhere
    gates = gate(measured, threshold_table(spark, TTS_GATES), absent_fails=False)
    return gates.groupBy("name").agg(
        F.count_if("passed").alias("n_pass"), F.count(F.lit(1)).alias("n_clips")
    )


_SQL_AQ7 = f"""
WITH {SQL_CLIPS}
SELECT 'min_dur_s' AS name, count(*) FILTER (duration_s >= 3) AS n_pass, count(*) AS n_clips FROM clips
UNION ALL SELECT 'min_rms', count(*) FILTER (rms >= 0.01), count(*) FROM clips
UNION ALL SELECT 'rtf_max', count(*) FILTER (duration_s > 0 AND 1 / duration_s <= 1.6), count(*) FROM clips
"""


def _int1(spark, sf):
    counts = integ.copy_counts(documents(spark, sf), ["lang"], integ.text_digest(F.col("text")))
    return integ.copies_report(counts, ["lang"])


def _sql_copies(keys: str, digest: str, source: str) -> str:
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
WITH c AS (SELECT {lead}{digest} AS digest, count(*) AS copies FROM {source} GROUP BY ALL)
SELECT {lead}sum(copies)::BIGINT AS n_rows, sum(copies - 1)::BIGINT AS extra_copies,
       sum(copies - 1) * 100.0::DOUBLE / sum(copies) AS dup_pct, max(copies) AS max_repeat
FROM c {group}
"""


def _int2(spark, sf):
    return integ.most_repeated(documents(spark, sf), F.col("text"))


_SQL_INT2 = f"""
SELECT count(*) AS copies, {sql_key('text')} AS match_text
FROM documents GROUP BY match_text ORDER BY copies DESC, sha256(match_text) LIMIT 1
"""


def _int3(spark, sf):
    files = table(spark, sf, "pages")
    digest = integ.content_digest(F.col("html").cast("binary"))
    return integ.copies_report(integ.copy_counts(files, [], digest))


def train_rows(spark, sf):
    """Documents, and every fifth benchmark text in capitals with a mark behind it."""
    docs = documents(spark, sf).select(F.lit("documents").alias("origin"), "text")
    leaked = table(spark, sf, "benchmark").where("item_id % 5 = 0")
    changed = F.concat(F.upper("text"), F.lit("!"))
    return docs.unionByName(leaked.select(F.lit("leaked").alias("origin"), changed.alias("text")))


SQL_TRAIN = """
train AS (
  SELECT 'documents' AS origin, text FROM documents
  UNION ALL SELECT 'leaked', upper(text) || '!' FROM benchmark WHERE item_id % 5 = 0
)"""


def _int4(spark, sf):
    keys = integ.evaluation_keys([table(spark, sf, "benchmark")])
    return integ.contamination_count(train_rows(spark, sf), ["origin"], keys, F.col("text"))


_SQL_INT4 = f"""
WITH {SQL_TRAIN}, e AS (SELECT DISTINCT {sql_key('text')} AS k FROM benchmark),
t AS (SELECT origin, {sql_key('text')} AS k FROM train)
SELECT origin, count(*) AS n_rows, count(*) FILTER (k IN (SELECT k FROM e)) AS n_contaminated
FROM t GROUP BY origin
"""


def _int4_rows(spark, sf):
    keys = integ.evaluation_keys([table(spark, sf, "benchmark")])
    return integ.contaminated_rows(train_rows(spark, sf), keys, F.col("text"))


_SQL_INT4_ROWS = f"""
WITH {SQL_TRAIN}, e AS (SELECT DISTINCT {sql_key('text')} AS k FROM benchmark)
SELECT origin, text FROM train WHERE {sql_key('text')} IN (SELECT k FROM e)
"""


def _int5(spark, sf):
    name = F.concat(F.lit("clips/vivos-test-r"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".wav"))
    taken = table(spark, sf, "labels").select(tx.clip_offset(name).alias("doc_id"))
    return integ.without(table(spark, sf, "documents").select("doc_id", "lang"), taken, "doc_id")


def _int6(spark, sf):
    entries = table(spark, sf, "documents").select("doc_id", "n_chars")
    cache = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("score"))
    return integ.refresh_cache(
        entries, cache, "doc_id", lambda todo: todo.select("doc_id", (F.col("n_chars") + 10).alias("score"))
    )


def _int7(spark, sf):
    kept = integ.only_chosen(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")
    return kept.select("doc_id", "lang", "n_chars")


QUERIES = {
    **{f"TQ{i}": _text_rule(rule) for i, rule in enumerate(TEXT_RULES, 1)},
    "TQ_all": Check(
        lambda spark, sf: text_percentages(noisy(spark, sf), ["lang"], F.col("text")),
        f"WITH {SQL_NOISY} {sql_text_percentages('lang')}",
    ),
    "TQ7_chars": Check(
        lambda spark, sf: offending_characters(noisy(spark, sf), F.col("text")), _SQL_TQ7_CHARS
    ),
    **{f"AQ{i}": _audio_rule(rule) for i, rule in enumerate(_SQL_AUDIO, 1)},
    "AQ7": Check(_aq7, _SQL_AQ7),
    "AQ_all": Check(_all_audio, _SQL_ALL_AUDIO),
    "AQ_features": Check(
        _features,
        f"WITH {SQL_CLIPS} SELECT vec_id, round(rms, 9) AS rms, round(clip_ratio, 9) AS clip_ratio FROM clips",
    ),
    "INT1": Check(_int1, _sql_copies("lang", sql_key("text"), "documents")),
    "INT2": Check(_int2, _SQL_INT2),
    "INT3": Check(_int3, _sql_copies("", "sha1(html)", "pages")),
    "INT4": Check(_int4, _SQL_INT4),
    "INT4_rows": Check(_int4_rows, _SQL_INT4_ROWS),
    "INT5": Check(
        _int5, "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
    ),
    "INT6": Check(
        _int6,
        "SELECT doc_id, quality::BIGINT AS score FROM labels UNION ALL SELECT doc_id, n_chars + 10 "
        "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "INT7": Check(
        _int7,
        "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    ),
}
