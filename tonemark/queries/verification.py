"""VERIFY: two sets of clips through all data gates, the smaller one with too few check transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonemark.operators import gates as gt
from tonemark.operators import integrity as integ
from tonemark.operators.verification import verify
from tonemark.queries.accuracy import SQL_DAMAGED, damaged
from tonemark.queries.base import Check, sql_key, table
from tonemark.queries.gates import _sql_values
from tonemark.queries.quality import _SQL_AUDIO, SQL_CLIPS, _sql_pct, clips, sql_text_percentages


def _verify(spark, sf):
    part = F.when(F.col("label") < 7, "large").otherwise("small").alias("part")
    content = table(spark, sf, "embeddings").select("vec_id", F.sha1(F.to_json("embedding").cast("binary")).alias("content"))
    rows = clips(spark, sf).join(content, "vec_id").select("*", part)
    checked = damaged(spark, sf).join(rows.select(F.col("vec_id").alias("doc_id"), "part"), "doc_id")
    gates = verify(
        rows, ["part"], gt.threshold_table(spark, gt.DATA_GATES), F.col("text"), F.col("sample_rate"),
        F.col("duration_s"), F.col("rms"), F.col("clip_ratio"), F.col("content"),
        integ.evaluation_keys([table(spark, sf, "benchmark")]), checked, F.col("ref"), F.col("hyp"),
    )
    return gates.select("part", "grp", "name", F.round("measured", 9).alias("measured"), "passed", "n_pass", "n_gates", "set_ok")


_AUDIO = {rule: test for rule, test in _SQL_AUDIO.items() if rule != "AUD-durdist"}
_SQL = f"""
WITH {SQL_CLIPS}, {SQL_DAMAGED},
parts AS (
  SELECT vec_id, CASE WHEN label < 7 THEN 'large' ELSE 'small' END AS part, embedding, text
  FROM embeddings JOIN documents ON doc_id = vec_id
),
noisy AS (SELECT part, text FROM parts),
wide_text AS ({sql_text_percentages('part')}),
wide_audio AS (
  SELECT part, {', '.join(f'{_sql_pct(test)} AS "{rule}"' for rule, test in _AUDIO.items())}
  FROM clips JOIN parts USING (vec_id) GROUP BY part
),
copies AS (
  SELECT part, sum(c - 1) * 100.0::DOUBLE / sum(c) AS dup, max(c) AS rep
  FROM (SELECT part, count(*) AS c FROM parts GROUP BY part, {sql_key('text')}) GROUP BY part
),
qc AS (
  SELECT part, count(*) AS rows, sum(e) / sum(n)::DOUBLE AS wer,
         count(*) FILTER (e / n::DOUBLE > 0.5) * 100.0::DOUBLE / count(*) AS bad
  FROM damaged JOIN parts ON vec_id = doc_id GROUP BY part
),
m AS (
  SELECT part, 'text' AS grp, name, measured
  FROM (UNPIVOT wide_text ON COLUMNS(* EXCLUDE part) INTO NAME name VALUE measured)
  UNION ALL SELECT part, 'audio', name, measured
  FROM (UNPIVOT wide_audio ON COLUMNS(* EXCLUDE part) INTO NAME name VALUE measured)
  UNION ALL SELECT part, 'integrity', 'INT-dup-text', dup FROM copies
  UNION ALL SELECT part, 'integrity', 'INT-rep-text', rep FROM copies
  UNION ALL SELECT part, 'integrity', 'INT-dup-audio', count(*) - count(DISTINCT embedding) FROM parts GROUP BY part
  UNION ALL SELECT part, 'integrity', 'INT-eval-contam',
            count(*) FILTER ({sql_key('text')} IN (SELECT {sql_key('b.text')} FROM benchmark b)) FROM parts GROUP BY part
  UNION ALL SELECT part, 'qc', 'DST-qc-n', rows FROM qc WHERE rows < 300
  UNION ALL SELECT part, 'qc', 'DST-qc-wer', wer FROM qc WHERE rows >= 300
  UNION ALL SELECT part, 'qc', 'DST-qc-badrows', bad FROM qc WHERE rows >= 300
),
g AS (
  SELECT part, grp, name, measured::DOUBLE AS measured,
         CASE WHEN op = '<=' THEN measured <= threshold ELSE measured >= threshold END AS passed
  FROM m JOIN {_sql_values(gt.DATA_GATES)} USING (grp, name)
)
SELECT part, grp, name, round(measured, 9) AS measured, passed, count(*) FILTER (passed) OVER w AS n_pass,
       count(*) OVER w AS n_gates, bool_and(passed) OVER w AS set_ok
FROM g WINDOW w AS (PARTITION BY part)
"""

QUERIES = {"VERIFY": Check(_verify, _SQL)}
