"""TXT1-TXT12 over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonemark.functions import text as tx
from tonemark.operators.quality import drop_rate, training_text
from tonemark.queries.base import (
    SQL_LATENCY,
    Check,
    documents,
    latency,
    sql_key,
    sql_norm,
    sql_strip,
    sql_word_count,
    table,
)

# Spelling variants planted at every 13th word, so that the fold has work in any language.
_PLANTED = ["hóa", "khỏe", "thúy", "kỳ", "mỹ", "quý", "ngày", "ý", "thuở", "tỵ"]
_CARRIERS, _PLAIN = tx.tone_table()


def _per_document(column):
    return lambda spark, sf: documents(spark, sf).select("doc_id", column().alias("out"))


def _sql_per_document(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS out FROM documents"


def _sql_drop_tones(column: str) -> str:
    return f"translate({column}, '{_CARRIERS + tx.TONE_MARKS}', '{_PLAIN}')"


def _planted(spark, sf):
    listed = F.array(*[F.lit(w) for w in _PLANTED])

    def plant(word, i):
        pick = F.element_at(listed, (F.floor(i / 13) % len(_PLANTED) + 1).cast("int"))
        return F.when(i % 13 == 5, pick).otherwise(word)

    words = F.split(tx.normalize(F.col("text")), " ")
    return documents(spark, sf).select("doc_id", F.array_join(F.transform(words, plant), " ").alias("t"))


def _txt3(spark, sf):
    return _planted(spark, sf).select("doc_id", tx.fold_spelling(F.col("t")).alias("out"))


def _sql_fold_word() -> str:
    """The fold of one word, so that RE2 needs no look-around."""
    word = "w"
    for first, second in (("o", "a"), ("o", "e"), ("u", "y")):
        for mark in tx.TONE_MARKS:
            old, new = tx._with_tone(first, mark) + second, first + tx._with_tone(second, mark)
            word = f"replace({word}, '{old}', '{new}')"
    for mark in ("", *tx.TONE_MARKS):
        y, i = tx._with_tone("y", mark), tx._with_tone("i", mark)
        word = f"regexp_replace({word}, '^(qu|[hklmst]){y}$', '\\1{i}')"
    return word


_SQL_TXT3 = f"""
WITH w AS (SELECT doc_id, string_split({sql_norm('text')}, ' ') AS ws FROM documents),
p AS (
  SELECT doc_id, list_transform(ws, lambda w, i: CASE WHEN (i - 1) % 13 = 5
    THEN {_PLANTED!r}[((i - 1) // 13) % {len(_PLANTED)} + 1] ELSE w END) AS ws
  FROM w
)
SELECT doc_id, array_to_string(list_transform(ws, lambda w: {_sql_fold_word()}), ' ') AS out FROM p
"""


def _txt6(spark, sf):
    tags = tx.content_tags(F.col("text"))
    return documents(spark, sf).select("doc_id", F.array_join(tags, ",").alias("out"))


_SQL_TXT6 = f"""
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN regexp_matches(text, '\\p{{Nd}}') THEN 'digits' END,
  CASE WHEN regexp_matches(text, '(^|[^.!?])[{tx.SPACE}][A-ZĐÂĂÊÔƠƯ][a-zà-ỹđ]+')
         OR regexp_matches(text, '[^\\p{{L}}\\p{{N}}_{tx.SPACE}][A-ZĐÂĂÊÔƠƯ][a-zà-ỹđ]+')
       THEN 'proper_name' END,
  CASE WHEN regexp_matches(text, '{tx.LOAN_LETTERS}') THEN 'loanword' END],
  lambda t: t IS NOT NULL), ',') AS out
FROM documents
"""


def _txt7(spark, sf):
    bucket = tx.duration_bucket(F.col("n_chars") / 100)
    rows = table(spark, sf, "documents").select(F.coalesce(bucket, F.lit("none")).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


_SQL_TXT7 = """
SELECT CASE WHEN n_chars < 300 THEN 'short' WHEN n_chars < 1000 THEN 'medium'
            WHEN n_chars < 3000 THEN 'long' ELSE 'none' END AS bucket, count(*) AS n
FROM documents GROUP BY 1
"""


def _txt9(spark, sf):
    clip = tx.clip_id("vivos", F.col("doc_id"))
    path = F.concat(F.lit("clips/"), clip, F.lit(".wav"))
    return table(spark, sf, "documents").select(
        "doc_id", clip.alias("clip"), tx.clip_offset(path).alias("back")
    )


def _txt11(spark, sf):
    candidates = documents(spark, sf).select("lang", tx.normalize(F.col("text")).alias("text"))
    return drop_rate(training_text(candidates, "text"), ["lang"])


_SQL_TXT11 = f"""
WITH t AS (SELECT lang, {sql_norm('text')} AS t FROM documents),
f AS (
  SELECT lang, t <> '' AND NOT regexp_matches(t, '[0-9]') AND len(string_split(t, ' ')) >= 2
    AND NOT regexp_matches(t, '{tx.outside_alphabet_class()}')
    AND NOT regexp_matches(t, '{tx.PUNCT_CLASS}') AS kept
  FROM t
)
SELECT lang, count(*) AS n_rows, count(*) FILTER (kept) AS n_kept,
       count(*) FILTER (NOT kept) * 100.0::DOUBLE / count(*) AS drop_pct,
       count(*) FILTER (NOT kept) * 100.0::DOUBLE / count(*) > 5 AS must_stop
FROM f GROUP BY lang
"""


def _txt11_repair(spark, sf):
    spaced = F.concat(F.lit("\t"), F.replace("text", F.lit(" "), F.lit(" ​")))
    return documents(spark, sf).select("doc_id", tx.repair_for_training(spaced).alias("out"))


def _txt12(spark, sf):
    return latency(spark, sf).select("event_id", tx.shown(F.col("total_s") / 7).alias("out"))


QUERIES = {
    "TXT1": Check(
        _per_document(lambda: tx.normalize(F.col("text"))), _sql_per_document(sql_norm("text"))
    ),
    "TXT2": Check(
        _per_document(lambda: tx.strip_tone(F.col("text"))),
        _sql_per_document(f"nfc_normalize({_sql_drop_tones('nfc_normalize(text)')})"),
    ),
    "TXT2_scoring": Check(
        _per_document(lambda: tx.normalize(F.col("text"), keep_tone=False)),
        _sql_per_document(_sql_drop_tones(sql_norm("text"))),
    ),
    "TXT3": Check(_txt3, _SQL_TXT3),
    "TXT4": Check(
        _per_document(lambda: tx.match_key(F.col("text"))), _sql_per_document(sql_key("text"))
    ),
    "TXT5": Check(
        _per_document(lambda: tx.ingest_form(F.concat(F.lit("\t "), "text", F.lit(" \n")))),
        _sql_per_document(f"nfc_normalize({sql_strip('text')})"),
    ),
    "TXT6": Check(_txt6, _SQL_TXT6),
    "TXT7": Check(_txt7, _SQL_TXT7),
    "TXT8": Check(
        _per_document(lambda: tx.word_count(F.col("text"))),
        _sql_per_document(sql_word_count("text")),
    ),
    "TXT9": Check(
        _txt9,
        "SELECT doc_id, format('vivos-r{:04d}', doc_id) AS clip, doc_id AS back FROM documents",
    ),
    "TXT10": Check(
        _per_document(lambda: tx.preview(F.col("text"))), _sql_per_document("substr(text, 1, 60)")
    ),
    "TXT11": Check(_txt11, _SQL_TXT11),
    "TXT11_repair": Check(
        _txt11_repair,
        _sql_per_document(
            f"trim(regexp_replace(lower(nfc_normalize(text)), '[{tx.SPACE}]+', ' ', 'g'))"
        ),
    ),
    "TXT12": Check(
        _txt12,
        f"WITH {SQL_LATENCY} SELECT event_id, round_even(total_s / 7, 4)::DOUBLE AS out FROM latency",
    ),
}
