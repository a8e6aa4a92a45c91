"""Blocked scans against plain loops, with blocks so small that every scan crosses many."""

import random

import pytest
from pyspark.sql import functions as F

from tonemark.plans import blocks


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for g in ("a", "b", None):
        for at in sorted(rng.sample(range(200), 60)):
            data.append((g, at, rng.random() < 0.3, float(rng.randint(0, 50))))
    rng.shuffle(data)
    return data


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, at bigint, late boolean, v double")


def groups(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("size", [1, 7, 1 << 18])
def test_row_numbers(frame, rows, size):
    got = blocks.number_rows(frame, ["g"], "at", "i", lead=["late"], total="n", block_rows=size).collect()
    assert len(got) == len(rows)
    for g, members in groups(rows).items():
        order = sorted(members, key=lambda r: (r[2], r[1]))
        want = {r[1]: i for i, r in enumerate(order)}
        assert {r.at: r.i for r in got if r.g == g} == want
        assert all(r.n == len(members) for r in got if r.g == g)


@pytest.mark.parametrize("size", [1, 7, 1 << 18])
def test_running_totals(frame, rows, size):
    got = blocks.running_total(frame, ["g"], "at", F.col("v"), "s", block_rows=size).collect()
    for g, members in groups(rows).items():
        total, want = 0.0, {}
        for r in members:
            want[r[1]] = total
            total += r[3]
        assert {r.at: r.s for r in got if r.g == g} == want


@pytest.mark.parametrize("size", [1, 7, 1 << 18])
def test_running_max_and_neighbours(frame, rows, size):
    block = F.floor(F.col("at") / size)
    df = blocks.running_max(frame, ["g"], ["at"], F.col("v"), "m", block)
    df = blocks.neighbour(df, ["g"], ["at"], F.col("v"), "before", block)
    df = blocks.neighbour(df, ["g"], ["at"], F.col("v"), "after", block, ahead=True)
    got = df.collect()
    assert len(got) == len(rows)
    for g, members in groups(rows).items():
        vs = [r[3] for r in members]
        want = {
            r[1]: (
                max(vs[:i], default=None),
                vs[i - 1] if i else None,
                vs[i + 1] if i + 1 < len(vs) else None,
            )
            for i, r in enumerate(members)
        }
        assert {r.at: (r.m, r.before, r.after) for r in got if r.g == g} == want


def test_groups_with_a_null_key_survive_a_shuffled_join(spark, frame, rows):
    """Nothing small enough to broadcast: the carry comes by a sort-merge join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        made = blocks.running_total(frame, ["g"], "at", F.col("v"), "s", block_rows=7)
        got = {(r.g, r.at): r.s for r in made.collect()}
        plan = made._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    for g, members in groups(rows).items():
        total = 0.0
        for r in members:
            assert got.pop((g, r[1])) == total
            total += r[3]
    assert not got


@pytest.mark.parametrize("spaced", ["dense", "far", "hashed", "outlier", "skewed"])
def test_blocks_are_few_and_small_for_ids_of_any_kind(spark, spaced):
    made = {
        "dense": F.col("id"),
        "far": F.col("id") * (1 << 40),
        "hashed": F.xxhash64("id"),
        "outlier": F.when(F.col("id") == 2999, F.lit((1 << 62) - 1)).otherwise(F.col("id") - 1500),
        "skewed": F.pow(F.col("id"), 4).cast("long"),
    }
    ids = spark.range(3000).select(made[spaced].alias("o"))
    sizes = [r["count"] for r in ids.groupBy(blocks.block_of(ids, "o", 100).alias("b")).count().collect()]
    assert 20 <= len(sizes) <= 45 and max(sizes) <= 220
    numbered = blocks.number_rows(ids, [], "o", block_rows=100).collect()
    assert [r["row_no"] for r in sorted(numbered, key=lambda r: r["o"])] == list(range(3000))
