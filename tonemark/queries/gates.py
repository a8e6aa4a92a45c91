"""GATE1-GATE7, CMP1, CMP2, SRC5."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonemark.operators import gates as gt
from tonemark.operators.accuracy import RATE_ONLY, pooled_rate, with_edits
from tonemark.operators.quality import TEXT_RULES, text_percentages
from tonemark.queries.accuracy import SQL_DAMAGED, damaged
from tonemark.queries.base import SQL_NOISY, SQL_PAIRS, Check, noisy, pairs, table
from tonemark.queries.quality import sql_text_percentages

_RULES = list(TEXT_RULES)


def _sql_values(rules) -> str:
    rows = ", ".join(f"('{g}', '{n}', '{op}', {t}::DOUBLE)" for g, n, op, t in rules)
    return f"(VALUES {rows}) t(grp, name, op, threshold)"


def measured_text(spark, sf):
    wide = text_percentages(noisy(spark, sf), ["lang"], F.col("text"))
    return gt.measures(wide, ["lang"], "text", _RULES)


SQL_MEASURED = f"""
{SQL_NOISY},
wide AS ({sql_text_percentages('lang')}),
measured AS (
  SELECT lang, 'text' AS grp, name, measured
  FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE lang) INTO NAME name VALUE measured)
),
thresholds AS (SELECT * FROM {_sql_values(gt.DATA_GATES)}),
gates AS (
  SELECT lang, grp, name, measured, op, threshold, coalesce(measured <= threshold, false) AS passed
  FROM (SELECT DISTINCT lang, grp FROM measured) JOIN thresholds USING (grp) LEFT JOIN measured USING (lang, grp, name)
)"""


def _gates(spark, sf):
    return gt.gate(measured_text(spark, sf), gt.threshold_table(spark, gt.DATA_GATES))


def _gate1(spark, sf):
    return _gates(spark, sf).select("lang", "grp", "name", "op", "measured", "threshold", "passed")


def _gate2(spark, sf):
    return gt.verdict(_gates(spark, sf), ["lang"])


def _gate3(spark, sf):
    """Measurements of two groups against thresholds that name only one of them."""
    text = measured_text(spark, sf)
    other = text.withColumn("grp", F.lit("undeclared"))
    gates = gt.gate(text.unionByName(other), gt.threshold_table(spark, gt.DATA_GATES))
    return gates.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def _src5(spark, sf):
    """How many measurements each declared threshold meets."""
    rules = gt.threshold_table(spark, gt.DATA_GATES)
    met = measured_text(spark, sf).groupBy("grp", "name").agg(F.count(F.lit(1)).alias("n"))
    joined = rules.join(met, ["grp", "name"], "left")
    return joined.select("grp", "name", "op", "threshold", F.coalesce("n", F.lit(0)).alias("n"))


def timed_pairs(spark, sf):
    return pairs(spark, sf).withColumn("infer_s", F.col("n_chars") / 1000)


SQL_SPEED = """
speed AS (
  SELECT model, max(v) FILTER (r = n // 2) AS p50, max(v) FILTER (r = floor(0.9::DOUBLE * (n - 1))) AS p90
  FROM (SELECT model, n_chars / 1000.0::DOUBLE AS v,
               row_number() OVER (PARTITION BY model ORDER BY n_chars) - 1 AS r,
               count(*) OVER (PARTITION BY model) AS n FROM scored) GROUP BY model
)"""


def _gate4(spark, sf):
    """Documents of half a minute and more, at 100 characters a second, are the long recordings."""
    rows = timed_pairs(spark, sf)
    rtf = (F.col("infer_s") + F.col("doc_id") % 7) / (F.col("n_chars") / 100)
    measured = gt.product_measures(
        rows, ["model"], F.col("ref"), F.col("hyp"), F.col("infer_s"), F.col("n_chars") >= 3000, rtf
    )
    gates = gt.gate(measured, gt.threshold_table(spark, gt.ASR_GATES))
    return gates.select("model", "grp", "name", F.round("measured", 12).alias("measured"), "passed")


def _gate4_roundtrip(spark, sf):
    measured = gt.roundtrip_measure(damaged(spark, sf), ["lang"], F.col("ref"), F.col("hyp"))
    gates = gt.gate(measured, gt.threshold_table(spark, gt.TTS_GATES), absent_fails=False)
    return gates.select("lang", "name", F.round("measured", 9).alias("measured"), "passed")


_SQL_GATE4 = f"""
WITH {SQL_PAIRS}, {SQL_SPEED.replace('FROM scored)', 'FROM scored WHERE n_chars < 3000)')},
rates AS (
  SELECT model, sum(s + d + i) / sum(n)::DOUBLE AS wer, sum(cs + cd + ci) / sum(chars)::DOUBLE AS cer
  FROM scored WHERE n_chars < 3000 GROUP BY model
),
m AS (
  SELECT model, 'per_utterance' AS grp, 'wer_max' AS name, wer AS measured FROM rates
  UNION ALL SELECT model, 'per_utterance', 'cer_max', cer FROM rates
  UNION ALL SELECT model, 'per_utterance', 'infer_p50_max_s', p50 FROM speed
  UNION ALL SELECT model, 'per_utterance', 'infer_p90_max_s', p90 FROM speed
  UNION ALL SELECT model, 'per_utterance', 'empty_hyp_max', 0 FROM rates
  UNION ALL SELECT model, 'longform', 'wer_max', sum(s + d + i) / sum(n)::DOUBLE FROM scored WHERE n_chars >= 3000 GROUP BY model
  UNION ALL SELECT model, 'longform', 'rtf_max', max((n_chars / 1000.0::DOUBLE + doc_id % 7) / (n_chars / 100.0::DOUBLE))
            FROM scored WHERE n_chars >= 3000 GROUP BY model
)
SELECT model, grp, name, round(measured::DOUBLE, 12) AS measured, measured <= threshold AS passed
FROM m JOIN {_sql_values(gt.ASR_GATES)} USING (grp, name)
"""


def runs(spark, sf):
    """Every turn three times: run 2 differs in marks only, run 3 in one word for some turns."""
    rows = table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "turn", "text"
    )
    second = F.concat(F.lit(" "), F.col("text"), F.lit(" !"))
    third = F.when(F.col("turn") % 7 == 3, F.concat("text", F.lit(" thêm"))).otherwise(F.col("text"))
    texts = F.explode(
        F.array(
            *[F.struct(F.lit(n).alias("run"), t.alias("text")) for n, t in ((1, F.col("text")), (2, second), (3, third))]
        )
    )
    return rows.select("id", texts.alias("_r")).select("id", "_r.run", "_r.text")


def _gate5(spark, sf):
    every = runs(spark, sf)
    first = every.where("run = 1")
    parts = []
    for run in (2, 3):
        # the second run loses the second turn of each conversation
        again = every.where((F.col("run") == run) & ((F.lit(run) == 3) | ~F.col("id").endswith("-2")))
        bad = gt.rerun_mismatches(first, again, "id", "text")
        parts.append(bad.select("id", F.lit(run).alias("run"), "run1", "run2"))
    return parts[0].unionByName(parts[1])


def _gate5_gate(spark, sf):
    """The determinism gate of both reruns, on the first hundred ids."""
    every = runs(spark, sf)
    first = every.where("run = 1")
    found = []
    for run in (2, 3):
        again = every.where((F.col("run") == run) & ((F.lit(run) == 3) | ~F.col("id").endswith("-2")))
        measured = gt.determinism_measure(first, again, "id", "text", 100)
        gates = gt.gate(measured, gt.threshold_table(spark, gt.ASR_GATES))
        found.append(gates.select(F.lit(run).alias("run"), "measured", "passed"))
    return found[0].unionByName(found[1])


def _gate6(spark, sf):
    return gt.unstable_runs(runs(spark, sf), "id", "run", "text").select("id", "run")


def _gate7(spark, sf):
    measured = gt.qc_measures(damaged(spark, sf), ["lang"], F.col("ref"), F.col("hyp"))
    gates = gt.gate(measured, gt.threshold_table(spark, gt.DATA_GATES), absent_fails=False)
    return gates.select("lang", "name", F.round("measured", 9).alias("measured"), "passed")


_SQL_GATE7 = f"""
WITH {SQL_DAMAGED},
q AS (
  SELECT lang, count(*) AS rows, sum(e) / sum(n)::DOUBLE AS wer,
         count(*) FILTER (e / n::DOUBLE > 0.5) * 100.0::DOUBLE / count(*) AS bad
  FROM damaged GROUP BY lang
)
SELECT lang, 'DST-qc-n' AS name, rows::DOUBLE AS measured, false AS passed FROM q WHERE rows < 300
UNION ALL SELECT lang, 'DST-qc-wer', round(wer, 9), wer <= 0.10 FROM q WHERE rows >= 300
UNION ALL SELECT lang, 'DST-qc-badrows', round(bad, 9), bad <= 1.5 FROM q WHERE rows >= 300
"""


def _cmp1(spark, sf):
    rows = timed_pairs(spark, sf)
    table_ = gt.compare_models(rows, "model", F.col("ref"), F.col("hyp"), F.col("infer_s"), F.col("n_chars") / 100)
    return table_.withColumns({c: F.round(c, 6) for c in ("long_infer_s", "long_rtf")})


_SQL_CMP1 = f"""
WITH {SQL_PAIRS}, {SQL_SPEED}
SELECT model, sum(s + d + i) / sum(n)::DOUBLE AS wer, sum(s)::BIGINT AS substitutions,
       sum(d)::BIGINT AS deletions, sum(i)::BIGINT AS insertions, sum(n - s - d)::BIGINT AS hits,
       sum(n)::BIGINT AS ref_words, sum(s + d + i) / sum(n)::DOUBLE AS wer_folded,
       sum(cs + cd + ci) / sum(chars)::DOUBLE AS cer, 0::BIGINT AS empty_hyps,
       sum(s + d + i) FILTER (n_chars >= 3000) / (sum(n) FILTER (n_chars >= 3000))::DOUBLE AS long_wer,
       (sum(d) FILTER (n_chars >= 3000))::BIGINT AS long_deletions,
       round(sum(n_chars / 1000.0::DOUBLE) FILTER (n_chars >= 3000), 6) AS long_infer_s,
       round(sum(n_chars / 1000.0::DOUBLE) FILTER (n_chars >= 3000) / sum(n_chars / 100.0::DOUBLE) FILTER (n_chars >= 3000), 6) AS long_rtf,
       any_value(p50) AS infer_p50_s, any_value(p90) AS infer_p90_s
FROM scored JOIN speed USING (model) GROUP BY model
"""


def _cmp2(spark, sf):
    """Every source stands for one setting; its number is the order in which it was tried."""
    rows = timed_pairs(spark, sf).withColumnRenamed("source", "setting")
    scored = with_edits(rows, F.col("ref"), {"_w": (F.col("hyp"), RATE_ONLY)})
    per_setting = scored.groupBy("setting").agg(
        pooled_rate(F.col("_w")).alias("wer"), (F.sum("n_chars") / 1000).alias("infer_s")
    )
    tried = per_setting.withColumn("tried", F.substring("setting", 4, 9).cast("bigint"))
    return gt.compare_settings(tried, "setting", "tried")


_SQL_CMP2 = f"""
WITH {SQL_PAIRS},
t AS (
  SELECT source AS setting, sum(s + d + i) / sum(n)::DOUBLE AS wer, sum(n_chars) / 1000.0::DOUBLE AS infer_s,
         substr(source, 4)::BIGINT AS tried FROM scored GROUP BY source
)
SELECT *, wer - first(wer) OVER (ORDER BY tried) AS wer_vs_first,
       infer_s - first(infer_s) OVER (ORDER BY tried) AS infer_s_vs_first,
       setting = first(setting) OVER (ORDER BY wer, infer_s, tried) AS is_best
FROM t
"""

QUERIES = {
    "GATE1": Check(
        _gate1,
        f"WITH {SQL_MEASURED} SELECT lang, grp, name, op, measured, threshold, passed FROM gates",
    ),
    "GATE2": Check(
        _gate2,
        f"WITH {SQL_MEASURED} SELECT lang, count(*) FILTER (passed) AS n_pass, count(*) AS n_gates, "
        "CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL (' || count(*) FILTER (NOT passed) || ' gate)' END AS verdict "
        "FROM gates GROUP BY lang",
    ),
    "GATE3": Check(_gate3, f"WITH {SQL_MEASURED} SELECT grp, count(*) AS n FROM gates GROUP BY grp"),
    "GATE4": Check(_gate4, _SQL_GATE4),
    "GATE4_roundtrip": Check(
        _gate4_roundtrip,
        f"WITH {SQL_DAMAGED} SELECT lang, 'roundtrip_wer_max' AS name, round(sum(e) / sum(n)::DOUBLE, 9) AS measured, "
        "sum(e) / sum(n)::DOUBLE <= 0.35 AS passed FROM damaged GROUP BY lang",
    ),
    "GATE5": Check(
        _gate5,
        "SELECT conv_id || '-' || turn AS id, 3::INTEGER AS run, text AS run1, text || ' thêm' AS run2 "
        "FROM conversations WHERE turn % 7 = 3 UNION ALL "
        "SELECT conv_id || '-' || turn, 2, text, NULL FROM conversations WHERE turn = 2",
    ),
    "GATE5_gate": Check(
        _gate5_gate,
        "WITH ids AS (SELECT conv_id || '-' || turn AS id, turn FROM conversations ORDER BY id LIMIT 100) "
        "SELECT run, count(*) FILTER (turn % 7 = 3 AND run = 3 OR turn = 2 AND run = 2)::DOUBLE AS measured, "
        "count(*) FILTER (turn % 7 = 3 AND run = 3 OR turn = 2 AND run = 2) = 0 AS passed "
        "FROM ids, (VALUES (2), (3)) r(run) GROUP BY run",
    ),
    "GATE6": Check(
        _gate6,
        "SELECT conv_id || '-' || turn AS id, 2::INTEGER AS run FROM conversations UNION ALL "
        "SELECT conv_id || '-' || turn, 3 FROM conversations WHERE turn % 7 = 3",
    ),
    "GATE7": Check(_gate7, _SQL_GATE7),
    "CMP1": Check(_cmp1, _SQL_CMP1),
    "CMP2": Check(_cmp2, _SQL_CMP2),
    "SRC5": Check(
        _src5,
        f"WITH {SQL_MEASURED} SELECT t.grp, t.name, t.op, t.threshold, count(m.name) AS n "
        "FROM thresholds t LEFT JOIN measured m ON t.grp = m.grp AND t.name = m.name GROUP BY ALL",
    ),
}
