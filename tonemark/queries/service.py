"""SERVICE: reports over requests, one clip each and one file several times."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonemark.operators.service import repeat_report, request_report
from tonemark.queries.base import SQL_LATENCY, SQL_PAIRS, Check, latency, pairs

_TIMES = ["infer_total_s", "server_total_s", "rtf"]


def _requests(spark, sf):
    """Pairs with made-up times; every seventh document has no server time."""
    infer, speech = F.col("n_chars") / 1000 + F.col("doc_id") % 7, F.col("n_chars") / 16
    return pairs(spark, sf).withColumns(
        {
            "infer_total_s": infer,
            "server_total_s": F.when(F.col("doc_id") % 7 > 0, infer + 0.25),
            "speech_s": speech,
            # no speech at all gives an infinite factor, as in SQL, where Spark's division is an error
            "rtf": F.when(speech == 0, infer * float("inf")).otherwise(infer / speech),
        }
    )


def _service(spark, sf):
    found = request_report(
        _requests(spark, sf), ["lang", "model"], F.col("ref"), F.col("hyp"),
        {name: F.col(name) for name in _TIMES}, F.col("speech_s"), F.col("infer_total_s"),
    )
    quantiles = [F.round(f"{name}.{q}", 9).alias(f"{name}_{q}") for name in _TIMES for q in ("p50", "p90")]
    plain = [c for c in found.columns if c not in (*_TIMES, "speech_s", "infer_s")]
    return found.select(*plain, *[F.round(c, 3).alias(c) for c in ("speech_s", "infer_s")], *quantiles)


def _sql_quantiles(name: str) -> str:
    values = f"list_sort(list(v.{name}) FILTER (v.{name} IS NOT NULL))"
    return (
        f"round(median(v.{name}), 9) AS {name}_p50, "
        f"round({values}[round_even(0.9::DOUBLE * (count(v.{name}) - 1), 0)::BIGINT + 1], 9) AS {name}_p90"
    )


_SQL_SERVICE = f"""
WITH {SQL_PAIRS},
v AS (
  SELECT *, n_chars / 1000 + doc_id % 7 AS infer_total_s, n_chars / 16 AS speech_s,
         CASE WHEN doc_id % 7 > 0 THEN n_chars / 1000 + doc_id % 7 + 0.25::DOUBLE END AS server_total_s,
         (n_chars / 1000 + doc_id % 7) / (n_chars / 16) AS rtf
  FROM scored
)
SELECT lang, model, count(*) AS n_clips, round(sum(speech_s), 3) AS speech_s, round(sum(infer_total_s), 3) AS infer_s,
       sum(s + d + i) / sum(n)::DOUBLE AS wer, sum(s)::BIGINT AS substitutions, sum(d)::BIGINT AS deletions,
       sum(i)::BIGINT AS insertions, sum(n - s - d)::BIGINT AS hits, sum(n)::BIGINT AS ref_words,
       sum(cs + cd + ci) / sum(chars)::DOUBLE AS cer,
       sum(s_nt + d + i) / sum(n)::DOUBLE AS no_tone_wer, sum(s_nt)::BIGINT AS no_tone_substitutions,
       sum(d)::BIGINT AS no_tone_deletions, sum(i)::BIGINT AS no_tone_insertions,
       sum(n - s_nt - d)::BIGINT AS no_tone_hits, sum(n)::BIGINT AS no_tone_ref_words,
       sum(s_nt + cd + ci) / sum(chars)::DOUBLE AS no_tone_cer,
       {", ".join(map(_sql_quantiles, _TIMES))}
FROM v GROUP BY lang, model
"""


def _repeats(spark, sf):
    """Events of a user and kind as runs of one file."""
    rows = latency(spark, sf)
    found = repeat_report(rows, ["user_id", "model"], {c: F.col(c) for c in ("total_s", "media_s", "rtf")}, "total_s")
    shown = [F.round(c, 9).alias(c) for c in ("total_s", "media_s", "rtf", "total_s_min", "total_s_max")]
    return found.select("user_id", "model", "n_runs", *shown)


QUERIES = {
    "SERVICE": Check(_service, _SQL_SERVICE),
    "SERVICE_repeats": Check(
        _repeats,
        f"WITH {SQL_LATENCY} SELECT user_id, model, count(*) AS n_runs, round(median(total_s), 9) AS total_s, "
        "round(median(media_s), 9) AS media_s, round(median(rtf), 9) AS rtf, round(min(total_s), 9) AS total_s_min, "
        "round(max(total_s), 9) AS total_s_max FROM latency GROUP BY user_id, model",
    ),
}
