import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonemark.functions.vectors import clip_ratio, cosine, rms
from tonemark.operators import latency as lat
from tonemark.operators import resampling, stats
from tonemark.operators.stats import bca_bounds, bca_ci, intervals, median_acceleration
from tonemark.plans.order_stats import order_statistics

NAN = float("nan")


@pytest.fixture
def values(spark):
    def run(groups):
        rows = [(g, None if v is None else float(v)) for g, vs in groups.items() for v in vs]
        return spark.createDataFrame(rows, "g string, v double")

    return run


def by_group(df):
    return {r.g: r for r in df.collect()}


def test_summary(values):
    df = values({"a": [1.0, 2, 3, 4, 5], "b": [1.0, NAN, 3.0, None], "c": [NAN]})
    got = by_group(lat.summarize(df, ["g"], F.col("v")))
    assert (got["a"].n, got["a"].median_s, got["a"].min_s, got["a"].max_s) == (5, 3, 1, 5)
    assert got["a"].p90_s == pytest.approx(np.percentile([1, 2, 3, 4, 5], 90))
    assert (got["b"].n, got["b"].median_s) == (2, 2)
    assert (got["c"].n, got["c"].median_s, got["c"].mean_s) == (0, None, None)


def test_summary_without_keys(values):
    got = lat.summarize(values({"a": [4.0, 1.0]}), [], F.col("v")).first()
    assert (got.n, got.median_s) == (2, 2.5)


def test_summary_of_nothing_and_of_present_but_unusable_values(values):
    got = lat.summarize(values({}), [], F.col("v")).collect()
    assert [(r.n, r.n_present, r.median_s, r.mean_s) for r in got] == [(0, 0, None, None)]
    assert lat.summarize(values({}), ["g"], F.col("v")).count() == 0
    got = by_group(lat.summarize(values({"a": [NAN, None], "b": [None], None: [2.0, NAN, 4.0]}), ["g"], F.col("v")))
    assert {g: (r.n, r.n_present, r.mean_s, r.max_s) for g, r in got.items()} == {
        "a": (0, 1, None, None), "b": (0, 0, None, None), None: (2, 3, 3.0, 4.0),
    }


def test_all_ranks_and_facts_of_all_measures_take_three_scans(values, tmp_path):
    values({"a": [1.0, 2.0], "b": [3.0]}).write.parquet(f"{tmp_path}/v")
    df = values({}).sparkSession.read.parquet(f"{tmp_path}/v")
    measures = {"x": F.col("v"), "y": F.col("v") * 2}
    for made in (
        lat.summaries(df, ["g"], measures, ["y"]),
        lat.run_medians(df.withColumn("w", F.col("v") / 2), ["g"], ["v", "w"]),
        lat.nearest_rank(df, ["g"], F.col("v"), {"p50": 0.5, "p90": 0.9}),
        lat.floor_rank(df, ["g"], F.col("v")),
    ):
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert 1 <= plan.count("FileScan") <= 3


def test_optional_block_is_null_without_values(values):
    got = by_group(lat.summaries(values({"a": [1.0], "b": [None, None]}), ["g"], {"x": F.col("v")}, ["x"]))
    assert got["a"].x.median_s == 1 and got["b"].x is None


def test_order_statistics_equal_sorting(values):
    rng = random.Random(5)
    groups = {
        "even": [rng.uniform(0, 10) for _ in range(500)],
        "ties": [float(rng.randint(0, 3)) for _ in range(300)],
        "wild": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(400)],
        "close": [1e6 + i * 1e-9 for i in range(257)],
        "ends": [float("inf"), float("-inf"), 0.0, 1.0, -1.0],
        "one": [7.0],
        None: [3.0, 1.0, 2.0],
    }
    qs = [0, 0.25, 0.5, 0.9, 1]
    ranks = {f"q{i}": (lambda n, q=q: F.floor((n - 1) * F.lit(float(q)))) for i, q in enumerate(qs)}
    got = by_group(order_statistics(values(groups), ["g"], F.col("v"), ranks))
    for name, vs in groups.items():
        vs = sorted(vs)
        want = [vs[math.floor((len(vs) - 1) * q)] for q in qs]
        assert [got[name][f"q{i}"] for i in range(len(qs))] == want, name


def test_rank_definitions_differ(values):
    vs = [float(i) for i in range(1, 7)]
    df = values({"a": vs})
    nearest = lat.nearest_rank(df, ["g"], F.col("v"), {"p50": 0.5, "p90": 0.9}).first()
    assert (nearest.p50, nearest.p90) == (vs[round(0.5 * 5)], vs[round(0.9 * 5)])
    floor = lat.floor_rank(df, ["g"], F.col("v")).first()
    assert (floor.p50_s, floor.p90_s) == (vs[3], vs[4])
    assert lat.run_medians(df, ["g"], ["v"]).first().v == 3.5


def test_real_time_factor(spark):
    row = spark.range(1).select(
        lat.rtf(F.lit(2.0), F.lit(4.0)).alias("a"), lat.rtf(F.lit(2.0), F.lit(0.0)).alias("b"),
        lat.latency_struct(F.lit(1.0), F.lit(2.0)).alias("c"),
    ).first()
    assert row.a == 0.5 and math.isnan(row.b)
    assert row.c.rtf == 0.5 and row.c.ttfa_s is None and row.c.first_token_s is None


def test_interval_around_the_mean(values):
    rng = np.random.default_rng(0)
    drawn = rng.normal(10, 2, 200).tolist()
    df = values({"a": drawn, "b": [float(i) for i in range(1, 11)]})
    got = by_group(bca_ci(df, ["g"], F.col("v"), n_resamples=2000))
    assert got["b"].point == pytest.approx(5.5)
    a = got["a"]
    assert a.low < a.point < a.high and not a.degenerate and a.n == 200
    assert (a.high - a.low) / 2 == pytest.approx(1.96 * np.std(drawn) / math.sqrt(200), rel=0.1)


def plain_interval(vs, statistic, speed, n_resamples=20_000):
    vs = np.asarray(vs)
    drawn = vs[np.random.default_rng(11).integers(0, len(vs), (n_resamples, len(vs)))]
    return bca_bounds(statistic(drawn, axis=1), statistic(vs), speed, 0.95)


@pytest.mark.parametrize("n", [15, 300, 2001])
def test_interval_of_skewed_values_is_that_of_whole_resamples(values, monkeypatch, n):
    vs = np.random.default_rng(1).exponential(1, n)
    m = vs - vs.mean()
    speed = (m**3).sum() / (6 * (m**2).sum() ** 1.5)
    low, high = plain_interval(vs, np.mean, speed)
    error = vs.std() / math.sqrt(n)
    for part_rows in (100_000, 100):
        monkeypatch.setattr(resampling, "PART_ROWS", part_rows)
        ci = bca_ci(values({"a": vs.tolist()}), ["g"], F.col("v")).first()
        assert ci.high - ci.point > ci.point - ci.low
        assert abs(ci.low - low) < 0.15 * error and abs(ci.high - high) < 0.15 * error


@pytest.mark.parametrize("n", [14, 15, 600, 2001])
def test_interval_of_the_median_is_that_of_whole_resamples(values, n):
    vs = np.sort(np.random.default_rng(n).normal(0, 1, n))
    low, high = plain_interval(vs, np.median, stats.median_acceleration(*vs[[(n - 1) // 2 - n % 2, n // 2, n // 2 + n % 2]], n), 4000)
    ci = bca_ci(values({"a": vs.tolist(), "b": [1.0, 2.0]}), ["g"], F.col("v"), statistic="median").where("g = 'a'").first()
    assert ci.point == pytest.approx(np.median(vs)) and not ci.degenerate and ci.n == n
    near = 0.35 * math.sqrt(n) / 2 + 1
    for got, want in ((ci.low, low), (ci.high, high)):
        assert abs(np.searchsorted(vs, got) - np.searchsorted(vs, want)) <= near


def test_drawn_numbers_add_up_and_follow_the_sizes():
    sizes = np.array([10, 0, 1, 500, 89])
    drawn = [resampling.drawn_in_part(5, part, sizes, 4000) for part in range(5)]
    assert (sum(drawn) == 600).all() and not drawn[1].any()
    for n, got in zip(sizes, drawn):
        assert got.mean() == pytest.approx(n, rel=0.1)
    assert drawn[3].var() == pytest.approx(600 * (500 / 600) * (100 / 600), rel=0.1)


def test_both_ways_to_draw_a_chunk_have_one_distribution():
    values, counts = np.array([0.0, 1.0, 5.0]), np.array([4, 3, 2])
    drawn = np.full(40_000, 30)
    by_place = resampling.drawn_counts(np.random.default_rng(1), counts, drawn) @ values
    by_row = resampling.drawn_counts(np.random.default_rng(2), counts * 100, drawn) @ values
    for got in (by_place, by_row):
        assert got.mean() == pytest.approx(30 * 13 / 9, rel=0.01)
        assert got.var() == pytest.approx(30 * (53 / 9 - (13 / 9) ** 2), rel=0.04)
    none = resampling.drawn_counts(np.random.default_rng(1), counts, np.array([0, 2, 0]))
    assert none.sum(axis=1).tolist() == [0, 2, 0]


def trimmed(vs, share):
    cut = int(len(vs) * share)
    return np.sort(vs)[cut : len(vs) - cut].mean()


def by_hand(rows, statistic, n_resamples=4000):
    """The interval of whole resamples and of leaving each row out in turn."""
    rng, n = np.random.default_rng(3), len(rows)
    drawn = np.array([statistic(rows[rng.integers(0, n, n)]) for _ in range(n_resamples)])
    left = np.array([statistic(np.delete(rows, i, axis=0)) for i in range(n)])
    d = left.mean() - left
    return statistic(rows), *bca_bounds(drawn, statistic(rows), (d**3).sum() / (6 * (d**2).sum() ** 1.5), 0.95)


@pytest.mark.parametrize("part_rows", [40, 100_000])
def test_any_mergeable_statistic_has_the_interval_of_whole_resamples(spark, monkeypatch, part_rows):
    monkeypatch.setattr(resampling, "PART_ROWS", part_rows)
    rng = np.random.default_rng(4)
    x = np.round(rng.exponential(1, 240), 2)
    y = np.round(x + rng.normal(0, 1, 240), 2)
    rows = [("a", float(a), float(b)) for a, b in zip(x, y)] + [("a", None, 1.0), ("a", NAN, 1.0), (None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(3)
    both = np.stack([x, y], axis=1)
    cases = [
        ([F.col("x"), F.col("y")], resampling.correlation(), both, lambda r: np.corrcoef(r.T)[0, 1]),
        ([F.col("x")], resampling.trimmed_mean(0.15), x, lambda r: trimmed(r, 0.15)),
    ]
    for values, statistic, data, plain in cases:
        point, low, high = by_hand(data, plain)
        got = resampling.resampled(df, ["g"], values, statistic).collect()
        a = next(r for r in got if r["g"] == "a")
        slack = 0.08 * (high - low)
        assert a["point"] == pytest.approx(point) and not a["degenerate"]
        assert a["n"] == 240
        assert abs(a["low"] - low) < slack and abs(a["high"] - high) < slack
        lone = next(r for r in got if r["g"] is None)
        assert lone["degenerate"] and lone["n"] == 1
        assert lone["low"] == lone["high"] == lone["point"] == (None if len(values) == 2 else 1.0)


def test_a_group_of_ten_thousand_parts_adds_up():
    sizes = np.full(10_000, 3)
    picked = [resampling.drawn_in_part(9, part, sizes, 50) for part in (0, 1, 4999, 9999)]
    assert all(abs(p.mean() - 3) < 1.5 for p in picked)


def test_degenerate_groups(values):
    got = by_group(bca_ci(values({"a": [3.0, 3, 3], "b": [1.0], "c": [1.0, NAN]}), ["g"], F.col("v")))
    for g, point in (("a", 3.0), ("b", 1.0), ("c", 1.0)):
        assert got[g].degenerate and got[g].low == got[g].high == got[g].point == point


def test_degenerate_jackknife_of_the_median(values):
    df = values({"a": [0.0] * 6 + [1.0]})
    got = bca_ci(df, ["g"], F.col("v"), statistic="median", n_resamples=500).first()
    assert got.degenerate and got.low == got.high == got.point == 0


def test_same_seed_same_interval(values):
    df = values({"a": [1.0, 2.0, 3.5, 4.2, 5.9, 2.1, 3.3]})
    for statistic in ("mean", "median"):
        options = dict(seed=123, n_resamples=1000, statistic=statistic)
        one = bca_ci(df, ["g"], F.col("v"), **options).first()
        two = bca_ci(df.repartition(3), ["g"], F.col("v"), **options).first()
        assert (one.low, one.high) == pytest.approx((two.low, two.high), rel=1e-9)
    other = bca_ci(df, ["g"], F.col("v"), seed=7, n_resamples=1000).first()
    one = bca_ci(df, ["g"], F.col("v"), seed=123, n_resamples=1000).first()
    assert (one.low, one.high) != (other.low, other.high)
    with pytest.raises(ValueError):
        bca_ci(df, ["g"], F.col("v"), statistic="mode")


def test_acceleration_of_the_median_is_that_of_leaving_rows_out():
    for vs in ([1.0, 2.0, 4.0, 9.0, 10.0], [1.0, 2.0, 4.0, 9.0], [1.0, 1.0, 1.0, 5.0], [3.0, 4.0, 8.0]):
        n = len(vs)
        left = np.array([np.median(np.delete(vs, i)) for i in range(n)])
        d = left.mean() - left
        spread = (d**2).sum()
        want = (d**3).sum() / (6 * spread**1.5) if spread else math.nan
        got = median_acceleration(*[vs[i] for i in ((n - 1) // 2 - n % 2, n // 2, n // 2 + n % 2)], n)
        assert got == pytest.approx(want, nan_ok=True, abs=1e-12)
    assert all(map(math.isnan, bca_bounds(np.ones(10), 0.0, 0.1, 0.95)))


def test_missing_scores_have_no_block(values):
    got = by_group(intervals(values({"a": [1.0, 2.0], "b": [None]}), ["g"], {"x": F.col("v")}, n_resamples=200))
    assert got["a"].x.n == 2 and "b" not in got


def test_vectors(spark):
    row = spark.range(1).select(
        cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"),
        cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"),
        rms(F.array(F.lit(3.0), F.lit(4.0))).alias("r"),
        clip_ratio(F.array(F.lit(1.0), F.lit(-0.999), F.lit(0.5), F.lit(0.0))).alias("k"),
        rms(F.array().cast("array<double>")).alias("e"),
    ).first()
    assert row.c == pytest.approx(1 / math.sqrt(2)) and row.z == 0
    assert row.r == pytest.approx(math.sqrt(12.5)) and row.k == 0.5 and row.e is None


def test_large_groups_of_few_values_leave_parts_without_rows(spark):
    rows = spark.range(20_500).select(
        F.when(F.col("id") < 500, "few").when(F.col("id") < 8_500, "same").otherwise("two").alias("g"),
        F.when(F.col("id") < 8_500, F.lit(3.0)).otherwise(F.col("id") % 2).cast("double").alias("v"),
    )
    got = {r.g: r for r in bca_ci(rows, ["g"], F.col("v"), n_resamples=500).collect()}
    assert [(got[g].point, got[g].low, got[g].high, got[g].n, got[g].degenerate) for g in ("few", "same")] == [
        (3.0, 3.0, 3.0, 500, True), (3.0, 3.0, 3.0, 8_000, True)]
    two = got["two"]
    assert two.n == 12_000 and two.point == 0.5 and not two.degenerate
    assert abs(two.low - 0.49105) < 0.002 and abs(two.high - 0.50895) < 0.002


def test_states_of_a_block_are_added_in_bunches(spark, monkeypatch):
    monkeypatch.setattr(resampling, "PART_ROWS", 5)
    monkeypatch.setattr(resampling, "BUNCH", 3)
    rows = spark.range(100).select((F.col("id") % 10).cast("double").alias("v"), F.lit("g").alias("g"))
    found = resampling.resampled(rows, ["g"], [F.col("v")], resampling.mean(), n_resamples=600)
    got = found.first()
    assert got.n == 100 and got.point == pytest.approx(4.5) and got.low < 4.5 < got.high
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bunch_sum(" in plan


def test_bunches_add_up_to_the_same_sums():
    rng = np.random.default_rng(3)
    states, jacks = rng.integers(0, 99, (10, 4)).astype(float), rng.integers(0, 99, (10, 3)).astype(float)
    frame = pd.DataFrame({"_gid": 1, "_block": 0, "_state": [s.tobytes() for s in states], "_jack": jacks.tolist()})
    parts = pd.concat([resampling.bunch_sum(frame[k : k + 4]) for k in range(0, 10, 4)])
    whole = resampling.bunch_sum(parts)
    assert np.frombuffer(whole["_state"][0]).tolist() == states.sum(axis=0).tolist()
    assert whole["_jack"][0] == jacks.sum(axis=0).tolist()
