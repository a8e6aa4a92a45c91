"""Quality rules: fixed ones, then robust multivariate outliers per language and source.

All of it is column expressions, grouped sums and joins. Each document has a vector of transformed
statistics. For every language and source, the minimum covariance determinant is approached by
concentration steps: start from medians and deviations, keep the share of rows that lies closest,
take their mean and covariance, and repeat. A document is rejected when its Mahalanobis distance
from its group's centre is too large.

Groups with few rows are pooled, by language first, then all together; a pool that is still too
small rejects nothing. Null language or source is a value like any other. A null text has no words.
Rows keep all their columns; columns named like the statistics are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark.llm.shared import WORD, cut, join_spread, let

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Share of a group's rows that a step keeps, number of steps, and least rows of a group.
CORE = 0.75
STEPS = 3
LEAST_ROWS = 100
#: A coordinate's deviation is never taken below its floor, as most texts have no symbols at all.
FLOORS = {"log_words": 0.8, "word_length": 0.15, "symbols": 0.05, "repeats": 0.1, "lines": 0.1}
#: Largest distance of a kept document, in deviations.
CUT = 6.0

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VECTOR = list(FLOORS)
_D = len(VECTOR)
_PAIRS = [(i, j) for i in range(_D) for j in range(i + 1)]
_GROUP = "_group"


def _repeat_words(words: Column) -> Column:
    """Words that lie in an eight-word window found at least twice; windows are compared by digest."""

    def covered(windows: Column) -> Column:
        def from_sorted(order: Column) -> Column:
            def place(w: Column, j: Column) -> Column:
                back, ahead = F.get(order, j - 1), F.get(order, j + 1)
                same = F.coalesce(back["h"] == w["h"], F.lit(False)) | F.coalesce(ahead["h"] == w["h"], F.lit(False))
                return F.when(same, w["i"])

            repeated = F.array_sort(F.array_compact(F.transform(order, place)))
            return let(repeated, total)

        def total(places: Column) -> Column:
            gaps = F.transform(places, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        unlike = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(unlike, F.lit(0).cast("long")).otherwise(let(order, from_sorted))

    def from_hashes(hashes: Column) -> Column:
        def window(i: Column) -> Column:
            return F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])

        starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.when(F.size(hashes) < WINDOW, F.lit(0).cast("long")).otherwise(
            let(F.transform(starts, window), covered)
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the five counts of each whole text."""
    value = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(value, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(value, "\n", -1), lambda t: t.rlike(WORD))
    symbols = F.regexp_count(value, F.lit(f"[{SYMBOLS}]"))
    copies = let(lines, lambda t: F.size(t) - F.size(F.array_distinct(t)))

    def counts(w: Column) -> Column:
        made = [F.size(w), F.char_length(F.array_join(w, "")), symbols, copies, _repeat_words(w)]
        return F.struct(*[m.cast("long").alias(name) for m, name in zip(made, STATISTICS)])

    kept = [c for c in docs.columns if c not in STATISTICS]
    # a generated row: filters on the counts stay behind it and do not make it count again
    return docs.select(*kept, F.inline(F.transform(F.array(words), counts)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics of a document with words, in the order of ``VECTOR``."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log(n.cast("double")),
        F.log(chars / n),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_repeat_words") / n),
        F.sqrt(F.col("n_dup_lines") / n),
    ]


def _pooled(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """Add the group of each row: language and source, the rest of a language, or all other rest."""
    fine = F.struct(F.col(lang).alias("lang"), F.col(source).alias("source"), F.lit(0).alias("pool"))
    coarse = F.struct(F.col(lang).alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(1).alias("pool"))
    rest = F.struct(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(2).alias("pool"))
    used = rows.where(~base_failed())
    sizes = used.groupBy(lang, source).agg(F.count(F.lit(1)).alias("_n"))
    small = sizes.where(F.col("_n") < LEAST_ROWS)
    langs = small.groupBy(lang).agg(F.sum("_n").alias("_of"))
    joined = sizes.join(langs.withColumnRenamed(lang, "_lang"), F.col(lang).eqNullSafe(F.col("_lang")), "left")
    group = F.when(F.col("_n") >= LEAST_ROWS, fine).when(F.col("_of") >= LEAST_ROWS, coarse).otherwise(rest)
    return joined.select(F.struct(F.col(lang).alias("lang"), F.col(source).alias("source")).alias("_key"), group.alias(_GROUP))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor ``_l_i_j``."""
    done: list[Column] = []
    for i, x in enumerate(vector()):
        rest = x - F.col(f"_m_{i}")
        for j, z in enumerate(done):
            rest = rest - F.col(f"_l_{i}_{j}") * z
        done.append(rest / F.col(f"_l_{i}_{i}"))
    total = done[0] * done[0]
    for z in done[1:]:
        total = total + z * z
    return total


def _factored(moments: DataFrame) -> DataFrame:
    """Cholesky factor of each group's covariance, with the floors on its diagonal."""
    for i in range(_D):
        for j in range(i + 1):
            value = F.col(f"_s_{i}_{j}") - F.col(f"_m_{i}") * F.col(f"_m_{j}")
            if i == j:
                value = F.greatest(value, F.lit(0.0)) + F.lit(FLOORS[VECTOR[i]] ** 2)
            for k in range(j):
                value = value - F.col(f"_l_{i}_{k}") * F.col(f"_l_{j}_{k}")
            if i == j:
                value = F.sqrt(F.greatest(value, F.lit(FLOORS[VECTOR[i]] ** 2)))
            else:
                value = value / F.col(f"_l_{j}_{j}")
            moments = moments.withColumn(f"_l_{i}_{j}", value)
    return moments.select(_GROUP, *[f"_m_{i}" for i in range(_D)], *[f"_l_{i}_{j}" for i, j in _PAIRS])


def _start(used: DataFrame) -> DataFrame:
    """Medians and scaled median deviations as a first model."""
    values = used.select(_GROUP, *[x.alias(f"_x_{i}") for i, x in enumerate(vector())])
    middle = values.groupBy(_GROUP).agg(*[F.percentile_approx(f"_x_{i}", 0.5).alias(f"_m_{i}") for i in range(_D)])
    apart = join_spread(values, middle, _GROUP).select(
        _GROUP, *[f"_m_{i}" for i in range(_D)], *[F.abs(F.col(f"_x_{i}") - F.col(f"_m_{i}")).alias(f"_a_{i}") for i in range(_D)]
    )
    spread = apart.groupBy(_GROUP).agg(
        *[F.first(f"_m_{i}").alias(f"_m_{i}") for i in range(_D)],
        *[F.percentile_approx(f"_a_{i}", 0.5).alias(f"_a_{i}") for i in range(_D)],
    )
    factors = [
        (F.greatest(1.4826 * F.col(f"_a_{i}"), F.lit(FLOORS[VECTOR[i]])) if i == j else F.lit(0.0)).alias(f"_l_{i}_{j}")
        for i, j in _PAIRS
    ]
    return spread.select(_GROUP, *[f"_m_{i}" for i in range(_D)], *factors)


def _step(used: DataFrame, model: DataFrame) -> DataFrame:
    """Mean and covariance of the closest rows of each group under the model before."""
    near = join_spread(used, model, _GROUP)
    near = near.select(_GROUP, _distance().alias("_d"), *[x.alias(f"_x_{i}") for i, x in enumerate(vector())])
    limits = near.groupBy(_GROUP).agg(F.percentile_approx("_d", CORE).alias("_limit"))
    core = join_spread(near, limits, _GROUP).where(F.col("_d") <= F.col("_limit"))
    moments = core.groupBy(_GROUP).agg(
        *[F.avg(f"_x_{i}").alias(f"_m_{i}") for i in range(_D)],
        *[F.avg(F.col(f"_x_{i}") * F.col(f"_x_{j}")).alias(f"_s_{i}_{j}") for i, j in _PAIRS],
    )
    return _factored(moments)


def fit(statistics: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """A model per language and source: ``_key`` and the centre and factor of its group.

    ``statistics`` should be a stored table, as every step reads it again.
    """
    groups = cut(_pooled(statistics, lang, source), "groups")
    key = F.struct(F.col(lang).alias("lang"), F.col(source).alias("source"))
    used = statistics.where(~base_failed()).select(*STATISTICS, key.alias("_key"))
    used = used.join(groups, "_key").drop("_key")
    sizes = used.groupBy(_GROUP).agg(F.count(F.lit(1)).alias("_n"))
    model = cut(_start(used), "model")
    for _ in range(STEPS):
        model = cut(_step(used, model), "model")
    large = sizes.where(F.col("_n") >= LEAST_ROWS).select(_GROUP)
    return cut(groups.join(model.join(large, _GROUP, "left_semi"), _GROUP).drop(_GROUP), "model")


def judged(statistics: DataFrame, model: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Add ``base_failed``, ``distance`` (null without a model) and ``kept``."""
    key = F.struct(F.col(lang).alias("lang"), F.col(source).alias("source"))
    columns = [c for c in statistics.columns if c not in ("base_failed", "distance", "kept")]
    rows = statistics.select(*columns, key.alias("_key")).join(model, "_key", "left")
    failed = base_failed()
    return rows.select(*columns, failed.alias("base_failed"), F.sqrt(_distance()).alias("distance")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= CUT))
    )


def rate(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """All columns of ``docs`` with counts and verdict; texts are counted once, stored beside their counts
    and never shuffled."""
    stored = cut(with_statistics(docs, text), "statistics")
    return judged(stored, fit(stored, lang, source), lang, source)
