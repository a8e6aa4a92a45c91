"""ACC1-ACC12 on whole documents. The SQL side knows the edits from how the pairs are made."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonemark.functions import text as tx
from tonemark.operators.accuracy import (
    CHAR_RATE,
    RATE_ONLY,
    View,
    bad_row_pct,
    corpus_rate,
    empty_count,
    folded_report,
    pair_up,
    pairing_counts,
    pooled_parts,
    pooled_rate,
    row_rate,
    synthesis_delta,
    tone_report,
    with_edits,
)
from tonemark.queries.base import (
    SQL_PAIRS,
    Check,
    documents,
    pairs,
    sql_norm,
    sql_pooled,
    sql_strip,
    table,
    triples,
)

_WORDS = (
    "sum(s + d + i) / sum(n)::DOUBLE AS wer, sum(s)::BIGINT AS substitutions, "
    "sum(d)::BIGINT AS deletions, sum(i)::BIGINT AS insertions, sum(n - s - d)::BIGINT AS hits, "
    "sum(n)::BIGINT AS ref_words"
)
_CHARS = (
    "sum(cs + cd + ci) / sum(chars)::DOUBLE AS cer, sum(cs)::BIGINT AS substitutions, "
    "sum(cd)::BIGINT AS deletions, sum(ci)::BIGINT AS insertions, "
    "sum(chars - cs - cd)::BIGINT AS hits, sum(chars)::BIGINT AS ref_chars"
)


def _row(unit: str, name: str):
    def run(spark, sf):
        view = View(unit, parts=False)
        scored = with_edits(pairs(spark, sf), F.col("ref"), {"_e": (F.col("hyp"), view)})
        return scored.select("doc_id", "model", row_rate(F.col("_e")).alias(name))

    return run


def _pooled(keys: list[str], view: View):
    return lambda spark, sf: corpus_rate(
        pairs(spark, sf), keys, F.col("ref"), F.col("hyp"), view
    )


def _marks_only(spark, sf):
    """Both sides without any letter or number: nothing to score, and nothing made up."""
    rows = documents(spark, sf)
    ref = F.regexp_replace("text", "[\\p{L}\\p{N}\\p{M}_]+", "")
    scored = corpus_rate(rows.withColumn("ref", ref), ["lang"], F.col("ref"), F.reverse("ref"))
    return scored.select("lang", "wer", "ref_words")


def _paired(spark, sf):
    rows = triples(spark, sf)
    both = pair_up(rows, rows.select("doc_id", "drop"), "doc_id", "ref", "drop")
    return both.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum(F.length("ref").cast("bigint")).alias("ref_chars"),
    )


def _variants(spark, sf):
    """Drop pairs in which every 13th word has one spelling in the reference, another after it."""
    old = F.array(*[F.lit(w) for w in ("hóa", "khỏe", "thúy", "kì")])
    new = F.array(*[F.lit(w) for w in ("hoá", "khoẻ", "thuý", "kỳ")])

    def spell(words):
        def one(word, i):
            pick = F.element_at(words, (F.floor(i / 13) % 4 + 1).cast("int"))
            return F.when(i % 13 == 5, pick).otherwise(word)

        return one

    def lose(word, i):
        return F.when(i % 11 == 4, F.lit(None)).otherwise(spell(new)(word, i))

    words = F.filter(F.split(tx.normalize(F.col("text")), " "), lambda w: w != "")
    rows = documents(spark, sf).withColumn("_words", words)
    return rows.select(
        "lang",
        F.array_join(F.transform("_words", spell(old)), " ").alias("ref"),
        F.array_join(F.transform("_words", lose), " ").alias("hyp"),
    )


def _acc9(spark, sf):
    return folded_report(_variants(spark, sf), ["lang"], F.col("ref"), F.col("hyp"))


def damaged(spark, sf):
    """Pairs in which every m-th word is replaced by a new one, m from 1 to 4 by document."""
    words = F.filter(F.split(tx.normalize(F.col("text")), " "), lambda w: w != "")
    rows = documents(spark, sf).withColumn("_words", words)
    step = F.col("n_chars") % 4 + 1
    new = F.transform("_words", lambda w, i: F.when(i % step == 0, F.lit("жщ")).otherwise(w))
    return rows.select(
        "doc_id", "lang", F.array_join("_words", " ").alias("ref"), F.array_join(new, " ").alias("hyp")
    )


SQL_DAMAGED = f"""
damaged AS (
  SELECT doc_id, lang, n, ceil(n / (n_chars % 4 + 1)::DOUBLE)::BIGINT AS e
  FROM (SELECT doc_id, lang, n_chars,
               len(list_filter(string_split({sql_norm('text')}, ' '), lambda w: w <> '')) AS n
        FROM documents)
)"""


def _acc11(spark, sf):
    scored = with_edits(damaged(spark, sf), F.col("ref"), {"_e": (F.col("hyp"), RATE_ONLY)})
    return scored.groupBy("lang").agg(F.round(bad_row_pct(F.col("_e")), 9).alias("bad_pct"))


def _unrelated(spark, sf):
    """Each turn against the next one of its conversation: real texts with nothing in common. Other
    characters than plain ones become x, as the SQL side measures bytes."""
    plain = F.regexp_replace(tx.normalize(F.col("text")), "[^a-z0-9_ ]", "x")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", plain.alias("ref"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ref").alias("hyp"))
    scored = with_edits(turns.join(after, ["conv_id", "turn"]), F.col("ref"), {"_c": (F.col("hyp"), CHAR_RATE)})
    return scored.groupBy("role").agg(pooled_rate(F.col("_c")).alias("cer"), F.sum("_c.errors").alias("errors"))


_SQL_UNRELATED = f"""
WITH t AS (
  SELECT conv_id, turn, role, regexp_replace({sql_norm('text')}, '[^a-z0-9_ ]', 'x', 'g') AS txt FROM conversations
)
SELECT a.role, sum(levenshtein(a.txt, b.txt)) / sum(length(a.txt))::DOUBLE AS cer, sum(levenshtein(a.txt, b.txt))::BIGINT AS errors
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 GROUP BY a.role
"""


def blanked(spark, sf):
    """Conversation turns whose system texts are white space only."""
    text = F.when(F.col("role") == "system", F.lit("  \t")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").withColumn("text", text)


def _acc12(spark, sf):
    return blanked(spark, sf).groupBy("role").agg(empty_count(F.col("text")).alias("n_empty"))


def flagship(spark, sf):
    """Pooled WER and CER of both hypotheses by language, with the word breakdown, in one pass."""
    rows = pairs(spark, sf).select("lang", "model", "ref", "hyp")
    hyp = F.col("hyp")
    scored = with_edits(rows, F.col("ref"), {"_w": (hyp, View()), "_c": (hyp, CHAR_RATE)})
    return scored.groupBy("lang", "model").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        *pooled_parts(F.col("_w")),
        pooled_rate(F.col("_c")).alias("cer"),
    )


QUERIES = {
    "flagship": Check(
        flagship,
        sql_pooled(
            "lang, model",
            f"count(*) AS n_pairs, {_WORDS}, sum(cs + cd + ci) / sum(chars)::DOUBLE AS cer",
        ),
    ),
    "ACC1": Check(
        _row("word", "wer"),
        f"WITH {SQL_PAIRS} SELECT doc_id, model, (s + d + i) / n::DOUBLE AS wer FROM scored",
    ),
    "ACC2": Check(
        _row("char", "cer"),
        f"WITH {SQL_PAIRS} SELECT doc_id, model, (cs + cd + ci) / chars::DOUBLE AS cer FROM scored",
    ),
    "ACC3": Check(_pooled(["lang", "model"], View()), sql_pooled("lang, model", _WORDS)),
    "ACC4": Check(_pooled(["lang", "model"], View("char")), sql_pooled("lang, model", _CHARS)),
    "ACC5": Check(
        _marks_only,
        "SELECT lang, 0.0::DOUBLE AS wer, 0::BIGINT AS ref_words FROM documents GROUP BY lang",
    ),
    "ACC6": Check(
        _paired,
        f"WITH {SQL_PAIRS} SELECT count(*) AS n_pairs, sum(chars)::BIGINT AS ref_chars "
        "FROM scored WHERE model = 'drop'",
    ),
    "ACC6_report": Check(
        lambda spark, sf: pairing_counts(
            table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id"
        ),
        "SELECT count(*) FILTER (d.doc_id = l.doc_id) AS n_pairs, "
        "count(*) FILTER (l.doc_id IS NULL) AS n_ref_only, "
        "count(*) FILTER (d.doc_id IS NULL) AS n_hyp_only "
        "FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "ACC7": Check(_pooled(["source", "model"], View()), sql_pooled("source, model", _WORDS)),
    "ACC8": Check(
        lambda spark, sf: tone_report(
            pairs(spark, sf), ["lang", "model"], F.col("ref"), F.col("hyp")
        ).withColumn("tone_wer", F.round("tone_wer", 12)),
        sql_pooled(
            "lang, model",
            f"{_WORDS}, sum(cs + cd + ci) / sum(chars)::DOUBLE AS cer, "
            "sum(s_nt + d + i) / sum(n)::DOUBLE AS wer_no_tone, "
            "sum(s_nt + cd + ci) / sum(chars)::DOUBLE AS cer_no_tone, "
            "round(sum(s - s_nt) / sum(n)::DOUBLE, 12) AS tone_wer",
        ),
    ),
    "ACC9": Check(
        _acc9,
        f"WITH {SQL_PAIRS} SELECT lang, sum(s + d) / sum(n)::DOUBLE AS wer, "
        "sum(d) / sum(n)::DOUBLE AS wer_folded FROM scored WHERE model = 'drop' GROUP BY lang",
    ),
    "ACC10": Check(
        lambda spark, sf: synthesis_delta(
            triples(spark, sf), ["lang"], F.col("ref"), F.col("drop"), F.col("fill")
        ),
        f"WITH {SQL_PAIRS}, r AS (SELECT lang, "
        "sum(s + d + i) FILTER (model = 'drop') / (sum(n) FILTER (model = 'drop'))::DOUBLE AS asr_wer, "
        "sum(s + d + i) FILTER (model = 'fill') / (sum(n) FILTER (model = 'fill'))::DOUBLE AS rt_wer "
        "FROM scored GROUP BY lang) SELECT *, rt_wer - asr_wer AS delta_wer FROM r",
    ),
    "ACC11": Check(
        _acc11,
        f"WITH {SQL_DAMAGED} SELECT lang, round(count(*) FILTER (e / n::DOUBLE > 0.5) * 100.0::DOUBLE "
        "/ count(*), 9) AS bad_pct FROM damaged GROUP BY lang",
    ),
    "ACC4_unrelated": Check(_unrelated, _SQL_UNRELATED),
    "ACC12": Check(
        _acc12,
        "WITH t AS (SELECT role, CASE WHEN role = 'system' THEN ' ' ELSE text END AS text "
        f"FROM conversations) SELECT role, count(*) FILTER ({sql_strip('text')} = '') AS n_empty "
        "FROM t GROUP BY role",
    ),
}
