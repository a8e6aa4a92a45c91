import random

import pytest
from pyspark.sql import functions as F

from tonemark.operators import sampling as st
from tonemark.plans import blocks


@pytest.fixture
def entries(spark):
    """Places 1 to 12 in one bucket and 13 to 17 in another; every fifth place has digits."""
    rows = [(i, "medium" if i <= 12 else "long", i % 5 == 0) for i in range(1, 18)]
    return spark.createDataFrame(rows, "ord bigint, bucket string, digits boolean")


def parts_of(df):
    found = {}
    for r in df.collect():
        found.setdefault((r.bucket, r.part), set()).add(r.ord)
    return found


@pytest.mark.parametrize("size", [5, 1 << 18])
def test_dev_split_by_hand(entries, monkeypatch, size):
    monkeypatch.setattr(blocks.number_rows, "__defaults__", ("row_no", (), None, size))
    # medium in order: 5 10 1 2 3 4 6 7 8 9 11 12, a step of 4; long: 15 13 14 16 17, a step of 2
    split = st.split_dev(entries, "ord", "digits", dev={"medium": 3, "long": 2}, target={"medium": 4, "long": 9})
    assert parts_of(split) == {
        ("medium", "dev"): {5, 3, 8},
        ("medium", "v1"): {10, 1, 2, 4},
        ("long", "dev"): {15, 14},
        ("long", "v1"): {13, 16, 17},
    }


def test_dev_split_without_a_dev_quota(entries):
    split = st.split_dev(entries, "ord", "digits", dev={"medium": 0, "long": 9}, target={"medium": 2, "long": 2})
    assert parts_of(split) == {("medium", "v1"): {5, 10}, ("long", "dev"): {13, 14, 15, 16, 17}}


def test_quota_then_priority_fill_by_hand(entries):
    first = st.first_come(entries, "ord", {"medium": 4})
    assert {r.ord for r in first.collect()} == {1, 2, 3, 4}
    left = st.remaining_quota(first, {"medium": 5, "long": 3, "short": 2})
    assert {r.bucket: r.remaining for r in left.collect()} == {"medium": 1, "long": 3, "short": 2}
    # one of medium by quota, one more with digits; three of long, the one with digits first
    filled = {r.ord for r in st.priority_fill(entries, "ord", "digits", left).collect()}
    assert filled == {5, 10, 15, 13, 14}


def test_priority_fill_takes_all_that_is_left(spark):
    rows = spark.range(1000).select(F.col("id").alias("ord"), F.lit("long").alias("bucket"), F.lit(False).alias("digits"))
    left = spark.createDataFrame([("long", 400)], "bucket string, remaining long")
    assert st.priority_fill(rows, "ord", "digits", left).count() == 400


def test_stride_sample_by_hand(spark):
    # ten places, three wanted: a stride of 3 gives 0 3 6 9 2 5
    rows = [(0, "a", 5.0), (2, "b", 5.0), (3, "", 5.0), (5, "c", 5.0), (6, "d", 0.5), (9, "e", 29.0)]
    df = spark.createDataFrame(rows, "off bigint, text string, dur double")
    picked = st.stride_sample(df, "off", 10, 3, F.col("text"), F.col("dur")).orderBy("pick").collect()
    assert [(r.pick, r.off) for r in picked] == [(0, 0), (3, 9), (4, 2)]
    # two places, three draws of four: an offset that comes up again is taken again
    df = spark.createDataFrame([(0, "a", 5.0), (1, "b", 5.0)], "off bigint, text string, dur double")
    picked = st.stride_sample(df, "off", 2, 2, F.col("text"), F.col("dur")).orderBy("pick").collect()
    assert [r.off for r in picked] == [0, 1]


def test_block_sample_and_target(spark):
    df = spark.range(1000).select(F.col("id").alias("i"), F.lit(2.0).alias("dur"))
    drawn = st.block_sample(df, "i")
    per_block = [r["count"] for r in drawn.groupBy(F.floor(F.col("i") / 100)).count().collect()]
    assert per_block == [8] * 10
    again = {r.i for r in st.block_sample(df.repartition(5), "i").collect()}
    assert again == {r.i for r in drawn.collect()}
    assert st.until_seconds(drawn, "i", F.col("dur"), 99.0).count() == 50


def test_assembly(spark):
    df = spark.createDataFrame([("a", 2, 1.5, "z"), ("a", 1, 2.0, "x"), ("b", 1, 1.0, "q")], "k string, i bigint, d double, t string")
    starts = st.assembly_offsets(df, ["k"], "i", F.col("d"))
    got = {(r.k, r.i): r.start_s for r in starts.collect()}
    assert got == {("a", 1): 0, ("a", 2): pytest.approx(2.35), ("b", 1): 0}
    whole = {r.k: r for r in st.assembled(starts, ["k"], "i", "t", F.col("d")).collect()}
    assert whole["a"].transcript == "x z" and whole["a"].total_s == pytest.approx(3.85)


def test_review_drop_and_validation(spark):
    df = spark.range(90).withColumnRenamed("id", "ord")
    picked = [r.ord for r in st.review_sample(df, "ord").orderBy("pick").collect()]
    assert picked == list(range(0, 90, 4))[:20]
    rows = spark.createDataFrame([(1, True), (2, False), (3, False)], "id int, digits boolean")
    qc = spark.createDataFrame([(1, 0.9), (2, 0.6), (3, 0.59)], "id int, qc_wer double")
    kept = {r.id: r.qc_flagged for r in st.drop_mismatched(rows, qc, "id", "digits").collect()}
    assert kept == {1: True, 3: False}
    with pytest.raises(Exception, match="no check result for 3"):
        st.drop_mismatched(rows, qc.where("id < 3"), "id", "digits").count()
    split = st.validation_split(df, F.col("ord") % 10, 0.3)
    flags = split.groupBy(F.col("ord") % 10).agg(F.count_distinct("is_validation").alias("n")).collect()
    assert all(r.n == 1 for r in flags)
