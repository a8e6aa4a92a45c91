"""SET1-SET11 on documents (length as duration) and conversations (turns as clips)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonemark.functions import text as tx
from tonemark.operators import integrity as integ
from tonemark.operators import sampling as st
from tonemark.queries.base import SQL_NOISY, Check, documents, noisy, table


def timed(spark, sf):
    """Documents as manifest rows: the id is the file order, 100 characters are a second."""
    return table(spark, sf, "documents").select(
        "doc_id", "lang", "source", "text", (F.col("n_chars") / 100).alias("duration_s")
    )


def bucketed(spark, sf):
    rows = timed(spark, sf).withColumn("bucket", tx.duration_bucket(F.col("duration_s")))
    return rows.withColumn("has_digits", F.col("text").rlike("\\p{Nd}"))


SQL_BUCKETED = """
bucketed AS (
  SELECT doc_id, lang, source, text, n_chars / 100.0::DOUBLE AS duration_s,
         CASE WHEN n_chars < 300 THEN 'short' WHEN n_chars < 1000 THEN 'medium'
              WHEN n_chars < 3000 THEN 'long' END AS bucket,
         regexp_matches(text, '\\p{Nd}') AS has_digits
  FROM documents
)"""


def _set1(spark, sf):
    rows = noisy(spark, sf).withColumn("duration_s", F.col("n_chars") / 100)
    total = table(spark, sf, "documents").count()
    picked = st.stride_sample(rows, "doc_id", total, 50, tx.strip(F.col("text")), F.col("duration_s"))
    return picked.select("pick", "doc_id", "duration_s")


_SQL_SET1 = f"""
WITH {SQL_NOISY}, t AS (SELECT count(*) AS total FROM documents),
d AS (SELECT range AS pick, range * (total // 50) % total AS doc_id FROM range(100), t)
SELECT pick, doc_id, n_chars / 100.0::DOUBLE AS duration_s FROM d JOIN noisy USING (doc_id)
WHERE n_chars BETWEEN 100 AND 2900 AND source <> 'src3' ORDER BY pick LIMIT 50
"""


def _set2(spark, sf):
    """Source 3 is blank, every ninth document has another rate."""
    rows = noisy(spark, sf).withColumn("duration_s", F.col("n_chars") / 100)
    rows = rows.withColumn("rate", F.when(F.col("doc_id") % 9 == 4, 8000).otherwise(16000))
    drawn = st.usable_rows(st.block_sample(rows, "doc_id"), F.col("text"), F.col("rate"))
    return st.until_seconds(drawn, "doc_id", F.col("duration_s"), 1500.0).select("doc_id", "duration_s")


_SQL_SET2 = """
WITH r AS (
  SELECT doc_id, n_chars, source, row_number() OVER (PARTITION BY doc_id // 100
         ORDER BY md5('42-' || doc_id)) AS rank FROM documents
),
s AS (
  SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM r
  WHERE rank <= 8 AND source <> 'src3' AND doc_id % 9 <> 4
)
SELECT doc_id, n_chars / 100.0::DOUBLE AS duration_s FROM s WHERE so_far < 150000
"""


def turns(spark, sf):
    """Turns as clips of a sixteenth of a second per character."""
    rows = table(spark, sf, "conversations")
    return rows.withColumn("duration_s", F.length("text") / 16)


def _set3(spark, sf):
    starts = st.assembly_offsets(turns(spark, sf), ["conv_id"], "turn", F.col("duration_s"))
    return starts.select("conv_id", "turn", F.round("start_s", 6).alias("start_s"))


def _set3_joined(spark, sf):
    starts = st.assembly_offsets(turns(spark, sf), ["conv_id"], "turn", F.col("duration_s"))
    whole = st.assembled(starts, ["conv_id"], "turn", "text", F.col("duration_s"))
    return whole.withColumn("total_s", F.round("total_s", 6))


_SQL_STARTS = """
starts AS (
  SELECT conv_id, turn, text, length(text) / 16.0::DOUBLE AS duration_s,
         coalesce(sum(length(text) / 16.0::DOUBLE + 0.35::DOUBLE) OVER (PARTITION BY conv_id
           ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_s
  FROM conversations
)"""


def candidates(spark, sf):
    """Documents outside the gate set, which the labelled ones stand for."""
    return integ.without(bucketed(spark, sf), table(spark, sf, "labels"), "doc_id")


_FIRST_SOURCE = {b: q for b, q in st.full_quota().items() if b != "long"}


def first_source(spark, sf):
    return st.first_come(candidates(spark, sf), "doc_id", _FIRST_SOURCE)


def _set4(spark, sf):
    return first_source(spark, sf).select("doc_id", "bucket", "duration_s")


SQL_SET4 = f"""
{SQL_BUCKETED},
first_source AS (
  SELECT doc_id, bucket, duration_s FROM (
    SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS place FROM bucketed
    WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND bucket IN ('short', 'medium'))
  WHERE place <= 157
)"""


def _set5(spark, sf):
    left = st.remaining_quota(first_source(spark, sf), st.full_quota())
    second = integ.only_chosen(bucketed(spark, sf), table(spark, sf, "labels"), "doc_id")
    filled = st.priority_fill(second, "doc_id", "has_digits", left)
    return filled.select("doc_id", "bucket", "has_digits")


_SQL_SET5 = f"""
WITH {SQL_SET4},
quota AS (SELECT * FROM (VALUES ('short', 157), ('medium', 157), ('long', 152)) q(bucket, quota)),
rest AS (
  SELECT bucket, greatest(0, quota - (SELECT count(*) FROM first_source f WHERE f.bucket = q.bucket)) AS remaining
  FROM quota q
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY CASE WHEN has_digits THEN 0 ELSE 1 END, doc_id) AS place
  FROM bucketed WHERE doc_id IN (SELECT doc_id FROM labels) AND bucket IN ('long', 'medium')
),
taken AS (SELECT r.*, r.place <= remaining AS main FROM ranked r JOIN rest USING (bucket)),
extra AS (
  SELECT *, row_number() OVER (ORDER BY place) AS e FROM taken
  WHERE bucket = 'medium' AND NOT main AND has_digits
)
SELECT doc_id, bucket, has_digits FROM taken WHERE main
UNION ALL SELECT doc_id, bucket, has_digits FROM extra WHERE e <= 8
"""


def _set6(spark, sf):
    rows = bucketed(spark, sf)
    qc = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 100 / 100).alias("qc_wer"))
    kept = st.drop_mismatched(rows, qc, "doc_id", "has_digits")
    return kept.select("doc_id", "has_digits", "qc_wer", "qc_flagged")


def split(spark, sf):
    return st.split_dev(bucketed(spark, sf), "doc_id", "has_digits")


SQL_SPLIT = f"""
{SQL_BUCKETED},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY bucket
           ORDER BY CASE WHEN has_digits THEN 0 ELSE 1 END, doc_id) - 1 AS i,
         count(*) OVER (PARTITION BY bucket) AS n
  FROM bucketed WHERE bucket IS NOT NULL
),
dev_rows AS (
  SELECT *, i % (n // least(10, n)) = 0 AND i // (n // least(10, n)) < least(10, n) AS is_dev
  FROM numbered
),
rest AS (
  SELECT *, row_number() OVER (PARTITION BY bucket, is_dev ORDER BY i) AS place FROM dev_rows
),
split AS (
  SELECT doc_id, bucket, duration_s, text, CASE WHEN is_dev THEN 'dev' ELSE 'v1' END AS part FROM rest
  WHERE is_dev OR place <= CASE WHEN bucket = 'long' THEN 130 ELSE 135 END
)"""


def _set8(spark, sf):
    frozen = split(spark, sf).where("part = 'v1'")
    qc = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("quality"))
    picked = st.review_sample(frozen, "doc_id").join(qc, "doc_id", "left")
    return picked.select(
        "pick", "doc_id", tx.preview(F.col("text")).alias("preview"),
        F.coalesce("quality", F.lit(-1)).alias("quality"),
    )


_SQL_SET8 = f"""
WITH {SQL_SPLIT},
f AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, greatest(1, count(*) OVER () // 20) AS step
  FROM split WHERE part = 'v1'
)
SELECT i // step AS pick, doc_id, substr(text, 1, 60) AS preview, coalesce(quality, -1)::BIGINT AS quality
FROM f LEFT JOIN labels USING (doc_id) WHERE i % step = 0 AND i // step < 20
"""


def _set9(spark, sf):
    frozen = split(spark, sf).where("part = 'v1'")
    return st.acceptance(frozen.withColumn("tags", tx.content_tags(F.col("text"))))


_SQL_SET9 = f"""
WITH {SQL_SPLIT},
t AS (
  SELECT bucket, regexp_matches(text, '\\p{{Nd}}') AS digits,
         regexp_matches(text, '{tx.LOAN_LETTERS}')
         OR regexp_matches(text, '(^|[^.!?])[{tx.SPACE}][A-ZĐÂĂÊÔƠƯ][a-zà-ỹđ]+')
         OR regexp_matches(text, '[^\\p{{L}}\\p{{N}}_{tx.SPACE}][A-ZĐÂĂÊÔƠƯ][a-zà-ỹđ]+') AS named
  FROM split WHERE part = 'v1'
),
g AS (
  SELECT bucket, count(*) AS n_rows, count(*) FILTER (digits) AS d, count(*) FILTER (named) AS m
  FROM t GROUP BY bucket
)
SELECT bucket, n_rows, n_rows / (sum(n_rows) OVER ())::DOUBLE AS share,
       n_rows / (sum(n_rows) OVER ())::DOUBLE BETWEEN 0.25 AND 0.40 AS share_ok,
       (sum(d) OVER ())::BIGINT AS n_digits, sum(d) OVER () >= 30 AS digits_ok,
       (sum(m) OVER ())::BIGINT AS n_named, sum(m) OVER () >= 20 AS named_ok
FROM g
"""


def _set11(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source")
    return st.validation_split(rows, F.col("source"), 0.2)


QUERIES = {
    "SET1": Check(_set1, _SQL_SET1),
    "SET2": Check(_set2, _SQL_SET2),
    "SET3": Check(
        _set3, f"WITH {_SQL_STARTS} SELECT conv_id, turn, round(start_s, 6) AS start_s FROM starts"
    ),
    "SET3_joined": Check(
        _set3_joined,
        f"WITH {_SQL_STARTS} SELECT conv_id, round(max(start_s + duration_s), 6) AS total_s, "
        "string_agg(text, ' ' ORDER BY turn) AS transcript, count(*) AS n_clips "
        "FROM starts GROUP BY conv_id",
    ),
    "SET4": Check(_set4, f"WITH {SQL_SET4} SELECT * FROM first_source"),
    "SET5": Check(_set5, _SQL_SET5),
    "SET6": Check(
        _set6,
        f"WITH {SQL_BUCKETED} SELECT doc_id, has_digits, n_chars % 100 / 100.0::DOUBLE AS qc_wer, "
        "n_chars % 100 / 100.0::DOUBLE >= 0.6 AS qc_flagged FROM bucketed JOIN documents USING (doc_id) "
        "WHERE has_digits OR n_chars % 100 < 60",
    ),
    "SET7": Check(
        lambda spark, sf: split(spark, sf).select("doc_id", "bucket", "duration_s", "part"),
        f"WITH {SQL_SPLIT} SELECT doc_id, bucket, duration_s, part FROM split",
    ),
    "SET8": Check(_set8, _SQL_SET8),
    "SET9": Check(_set9, _SQL_SET9),
    "SET10": Check(
        lambda spark, sf: st.first_rows(timed(spark, sf), "doc_id", 25).select("doc_id", "duration_s"),
        "SELECT doc_id, n_chars / 100.0::DOUBLE AS duration_s FROM documents ORDER BY doc_id LIMIT 25",
    ),
    "SET11": Check(
        _set11,
        "SELECT doc_id, source, ('0x' || substr(md5('42-' || source), 1, 8))::BIGINT / 4294967296.0::DOUBLE "
        "< 0.2 AS is_validation FROM documents",
    ),
}
