"""LAT1-LAT8 on events, STAT1-STAT4 on events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonemark.functions.vectors import cosine
from tonemark.operators import latency as lat
from tonemark.operators.resampling import correlation, resampled, trimmed_mean
from tonemark.operators.stats import bca_ci, intervals
from tonemark.plans.order_stats import order_statistics
from tonemark.queries.base import SQL_LATENCY, Check, latency, shown_ends, spread_of, sql_ends, table

_STATS = ["median_s", "p90_s", "p99_s", "mean_s", "min_s", "max_s"]


def _rounded(df, names, places=9):
    return df.withColumns({name: F.round(name, places) for name in names})


def _lat1(spark, sf):
    rows = latency(spark, sf)
    known = ~F.isnan("rtf")
    return rows.select("event_id", F.when(known, F.col("rtf")).alias("rtf"), known.alias("known"))


def _lat2(spark, sf):
    return _rounded(lat.summarize(latency(spark, sf), ["model"], F.col("rtf")), _STATS).drop("n_present")


def _sql_summary(value: str) -> str:
    return (
        f"count({value}) AS n, round(quantile_cont({value}, 0.5), 9) AS median_s, "
        f"round(quantile_cont({value}, 0.9), 9) AS p90_s, "
        f"round(quantile_cont({value}, 0.99), 9) AS p99_s, round(avg({value}), 9) AS mean_s, "
        f"round(min({value}), 9) AS min_s, round(max({value}), 9) AS max_s"
    )


def _lat3(spark, sf):
    return lat.nearest_rank(
        latency(spark, sf), ["model"], F.col("total_s"), {"p50_s": 0.5, "p90_s": 0.9, "p99_s": 0.99}
    )


_SQL_RANKED = f"""
WITH {SQL_LATENCY}, ranked AS (
  SELECT model, total_s AS v, row_number() OVER (PARTITION BY model ORDER BY total_s) - 1 AS r,
         count(*) OVER (PARTITION BY model) AS n
  FROM latency
)"""
_SQL_LAT3 = _SQL_RANKED + """
SELECT model, max(v) FILTER (r = round_even(0.5::DOUBLE * (n - 1), 0)) AS p50_s,
       max(v) FILTER (r = round_even(0.9::DOUBLE * (n - 1), 0)) AS p90_s,
       max(v) FILTER (r = round_even(0.99::DOUBLE * (n - 1), 0)) AS p99_s
FROM ranked GROUP BY model
"""
_SQL_LAT4 = _SQL_RANKED + """
SELECT model, max(v) FILTER (r = n // 2) AS p50_s,
       max(v) FILTER (r = floor(0.9::DOUBLE * (n - 1))) AS p90_s
FROM ranked GROUP BY model
"""


def _lat5(spark, sf):
    medians = lat.run_medians(latency(spark, sf), ["user_id", "model"], ["total_s", "media_s", "rtf"])
    return _rounded(medians, ["total_s", "media_s", "rtf"])


def _lat6(spark, sf):
    first = F.when(F.col("model") != "view", F.col("total_s") / 8)
    rows = latency(spark, sf).withColumn("ttfa_s", first)
    blocks = lat.summaries(rows, ["model"], {"ttfa": F.col("ttfa_s")}, optional=["ttfa"])
    return blocks.select(
        "model",
        F.col("ttfa").isNotNull().alias("has_block"),
        F.coalesce("ttfa.n", F.lit(0)).alias("n"),
        F.round(F.coalesce("ttfa.median_s", F.lit(-1.0)), 9).alias("median_s"),
        F.round(F.coalesce("ttfa.p90_s", F.lit(-1.0)), 9).alias("p90_s"),
    )


def _lat7(spark, sf):
    sums = lat.totals(latency(spark, sf), ["model"], F.col("media_s"), F.col("total_s"))
    return _rounded(sums, ["speech_s", "infer_s"], 4)


def _lat8(spark, sf):
    infer = F.col("total_s")
    layered = lat.layers(infer / 8, infer, infer + F.col("media_s") / 4, infer + F.col("media_s"), F.lit(2.5))
    rows = latency(spark, sf).select("event_id", layered.alias("_layers"))
    return rows.select("event_id", "_layers.*").withColumn("overhead_s", F.round("overhead_s", 6))


def _stat1(keys: list[str]):
    def run(spark, sf):
        rows = latency(spark, sf).withColumn("every", F.lit("all"))
        ci = bca_ci(rows, keys, F.col("total_s"))
        spread = rows.groupBy(*keys).agg(*spread_of(F.col("total_s")))
        return ci.join(spread, keys).select(
            *keys, F.round("point", 9).alias("point"), "n", "degenerate", *shown_ends(F.col("low"), F.col("high"), F.col("n"))
        )

    return run


def _sql_stat1(key: str) -> str:
    return f"""
WITH {SQL_LATENCY}, v AS (SELECT *, 'all' AS every FROM latency)
SELECT {key}, round(avg(total_s), 9) AS point, count(*) AS n, false AS degenerate, {sql_ends('total_s')}
FROM v GROUP BY {key}
"""


def _stat1_median(spark, sf):
    """All components of each label's vectors. The ends are those of a binomial rank, within a share
    of its deviation."""
    rows = table(spark, sf, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("v"))
    ci = bca_ci(rows, ["label"], F.col("v"), statistic="median", n_resamples=2000)

    def rank(z: float):
        return lambda n: F.greatest(F.floor(n / 2 + z * F.sqrt(n) / 2), F.lit(0))

    bounds = {"a": rank(-2.31), "b": rank(-1.61), "c": rank(1.61), "d": rank(2.31)}
    ranks = order_statistics(rows, ["label"], F.col("v"), bounds)
    return ci.join(ranks, "label").select(
        "label", F.round("point", 9).alias("point"), "n", "degenerate",
        F.col("low").between(F.col("a"), F.col("b")).alias("low_ok"),
        F.col("high").between(F.col("c"), F.col("d")).alias("high_ok"),
    )


def _law(ci, law, share_of_error: float = 0.3):
    """Point and size of each group, and whether both ends lie near those of a known law."""
    slack = F.col("_error") * share_of_error
    near = [(F.abs(F.col(end) - F.col("_point") - z * F.col("_error")) <= slack).alias(f"{end}_ok") for end, z in (("low", -1.96), ("high", 1.96))]
    joined = ci.join(law, "model")
    return joined.select("model", F.round("point", 9).alias("point"), "n", "degenerate", *near)


def _stat1_trimmed(spark, sf):
    """A tenth trimmed at either end; the error is that of the winsorised values (Tukey and McLaughlin, 1963)."""
    rows = latency(spark, sf).select("model", "total_s")
    ci = resampled(rows, ["model"], [F.col("total_s")], trimmed_mean(0.1), n_resamples=2000)
    cuts = {"_a": lambda n: F.floor(n * 0.1), "_b": lambda n: n - 1 - F.floor(n * 0.1)}
    ends = order_statistics(rows, ["model"], F.col("total_s"), cuts)
    clipped = rows.join(ends, "model").withColumn("w", F.greatest("_a", F.least("_b", "total_s")))
    law = clipped.groupBy("model").agg((F.stddev_pop("w") / (0.8 * F.sqrt(F.count("w")))).alias("_error"))
    law = law.join(ci.select("model", F.col("point").alias("_point")), "model")
    return _law(ci, law)


_SQL_TRIMMED = f"""
WITH {SQL_LATENCY},
r AS (
  SELECT model, total_s, row_number() OVER (PARTITION BY model ORDER BY total_s) - 1 AS i, count(*) OVER (PARTITION BY model) AS n
  FROM latency WHERE total_s IS NOT NULL AND NOT isnan(total_s)
)
SELECT model, round(avg(total_s) FILTER (i >= floor(n * 0.1) AND i < n - floor(n * 0.1)), 9) AS point, count(*) AS n,
       false AS degenerate, true AS low_ok, true AS high_ok
FROM r GROUP BY model
"""


def _stat1_correlation(spark, sf):
    """Of total and media time; the error is that of a correlation under independence of the squares."""
    rows = latency(spark, sf).select("model", "total_s", "media_s")
    ci = resampled(rows, ["model"], [F.col("total_s"), F.col("media_s")], correlation(), n_resamples=2000)
    law = ci.select("model", F.col("point").alias("_point"), ((1 - F.col("point") ** 2) / F.sqrt("n")).alias("_error"))
    return _law(ci, law)


def _stat2(spark, sf):
    """Groups of one row, and groups without spread."""
    nations = table(spark, sf, "nation").select(
        F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("grp"),
        F.col("n_regionkey").cast("double").alias("v"),
    )
    labels = table(spark, sf, "labels").select(
        F.concat(F.lit("quality-"), F.col("quality").cast("string")).alias("grp"),
        F.col("quality").cast("double").alias("v"),
    )
    return bca_ci(nations.unionByName(labels), ["grp"], F.col("v")).drop("cl")


_SQL_STAT2 = """
WITH v AS (
  SELECT 'nation-' || n_nationkey AS grp, n_regionkey::DOUBLE AS v FROM nation
  UNION ALL SELECT 'quality-' || quality, quality::DOUBLE FROM labels
)
SELECT grp, avg(v) AS point, avg(v) AS low, avg(v) AS high, count(*) AS n, true AS degenerate
FROM v GROUP BY grp
"""


def neighbours(spark, sf):
    a = table(spark, sf, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id")


def _stat3(spark, sf):
    rows = neighbours(spark, sf)
    return rows.select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 9).alias("cos"))


SQL_COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _stat4(spark, sf):
    """Similarity is null for the engines under labels 3 and 6, so they have no block."""
    sim = F.when(~F.col("label").isin(3, 6), cosine(F.col("embedding"), F.col("other")))
    rows = neighbours(spark, sf).select("label", sim.alias("sim"))
    groups = rows.groupBy("label").agg(*spread_of(F.col("sim")))
    joined = groups.join(intervals(rows, ["label"], {"ci": F.col("sim")}), "label", "left")
    low, high = shown_ends(F.col("ci.low"), F.col("ci.high"), F.col("ci.n"), 0.35)
    return joined.select(
        "label",
        F.col("ci").isNotNull().alias("has_block"),
        F.round(F.coalesce("ci.point", F.lit(0.0)), 9).alias("point"),
        F.coalesce("ci.n", F.lit(0)).alias("n"),
        F.coalesce(low, F.lit(0.0)).alias("low"),
        F.coalesce(high, F.lit(0.0)).alias("high"),
    )


_SQL_STAT4 = f"""
WITH s AS (
  SELECT a.label, CASE WHEN a.label NOT IN (3, 6) THEN {SQL_COSINE} END AS sim
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
),
e AS (
  SELECT label, count(sim) > 0 AS has_block, round(coalesce(avg(sim), 0), 9) AS point, count(sim) AS n, {sql_ends('sim')}
  FROM s WHERE sim IS NOT NULL GROUP BY label
  UNION ALL SELECT label, false, 0, 0, 0, 0 FROM s GROUP BY label HAVING count(sim) = 0
)
SELECT * FROM e
"""

QUERIES = {
    "LAT1": Check(
        _lat1,
        f"WITH {SQL_LATENCY} SELECT event_id, rtf, rtf IS NOT NULL AS known FROM latency",
    ),
    "LAT2": Check(
        _lat2, f"WITH {SQL_LATENCY} SELECT model, {_sql_summary('rtf')} FROM latency GROUP BY model"
    ),
    "LAT3": Check(_lat3, _SQL_LAT3),
    "LAT4": Check(
        lambda spark, sf: lat.floor_rank(latency(spark, sf), ["model"], F.col("total_s")), _SQL_LAT4
    ),
    "LAT5": Check(
        _lat5,
        f"WITH {SQL_LATENCY} SELECT user_id, model, round(median(total_s), 9) AS total_s, "
        "round(median(media_s), 9) AS media_s, round(median(rtf), 9) AS rtf "
        "FROM latency GROUP BY user_id, model",
    ),
    "LAT6": Check(
        _lat6,
        f"WITH {SQL_LATENCY}, t AS (SELECT model, CASE WHEN model <> 'view' THEN total_s / 8 END AS v "
        "FROM latency) SELECT model, count(v) > 0 AS has_block, count(v) AS n, "
        "round(coalesce(quantile_cont(v, 0.5), -1), 9) AS median_s, "
        "round(coalesce(quantile_cont(v, 0.9), -1), 9) AS p90_s FROM t GROUP BY model",
    ),
    "LAT7": Check(
        _lat7,
        f"WITH {SQL_LATENCY} SELECT model, round(sum(media_s), 4) AS speech_s, "
        "round(sum(total_s), 4) AS infer_s FROM latency GROUP BY model",
    ),
    "LAT8": Check(
        _lat8,
        f"WITH {SQL_LATENCY} SELECT event_id, total_s / 8 AS decode_s, total_s AS infer_total_s, "
        "total_s + media_s / 4 AS server_total_s, total_s + media_s AS client_total_s, "
        "2.5::DOUBLE AS model_load_s, "
        "round((total_s + media_s) - (total_s + media_s / 4), 6) AS overhead_s FROM latency",
    ),
    "STAT1": Check(_stat1(["model"]), _sql_stat1("model")),
    "STAT1_large": Check(_stat1(["every"]), _sql_stat1("every")),
    "STAT1_median": Check(
        _stat1_median,
        "WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, round(median(v), 9) AS point, "
        "count(*) AS n, false AS degenerate, true AS low_ok, true AS high_ok FROM v GROUP BY label",
    ),
    "STAT1_trimmed": Check(_stat1_trimmed, _SQL_TRIMMED),
    "STAT1_correlation": Check(
        _stat1_correlation,
        f"WITH {SQL_LATENCY} SELECT model, round(corr(total_s, media_s), 9) AS point, count(*) AS n, false AS degenerate, "
        "true AS low_ok, true AS high_ok FROM latency WHERE total_s IS NOT NULL AND media_s IS NOT NULL GROUP BY model",
    ),
    "STAT2": Check(_stat2, _SQL_STAT2),
    "STAT3": Check(
        _stat3,
        f"SELECT a.vec_id, round({SQL_COSINE}, 9) AS cos FROM embeddings a "
        "JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    ),
    "STAT4": Check(_stat4, _SQL_STAT4),
}
