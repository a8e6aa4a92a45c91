import random
import re

import pytest
from pyspark.sql import functions as F

from tonemark.llm import mixing as ops


def water(sizes):
    """Shares by weight, filled up round by round."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: float(ops.WEIGHTS[i % 3]) for i, n in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        rate = left / sum(weight[n] for n in free)
        over = {n for n in free if weight[n] * rate > 3 * sizes[n]}
        if not over:
            out |= {n: weight[n] * rate for n in free}
            break
        for n in over:
            out[n] = 3.0 * sizes[n]
            left -= out[n]
        free -= over
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 10, "c": 1000}, {"b": 5, None: 900, "a": 7}, {"x": 0, "y": 10}, {"one": 4}, {"a": 0},
    {f"s{i}": (i * 37) % 101 for i in range(23)},
])
def test_targets_fill_up_like_water(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in ops.targets(df).collect()}
    want = water(sizes)
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n], abs=1e-6) for n in want)


def test_flow_reaches_quotas_and_repeats_only_where_it_must():
    # a document set shared by both sources serves the one that has nothing else
    flow = ops.min_cost_flow([10, 10], [[0], [0, 1]], [10, 10])
    assert flow == [[(0, 10)], [(1, 10)]]
    # the second use of the lone pattern costs more than the first use of the shared one
    flow = ops.min_cost_flow([10, 30], [[0], [0, 1]], [25, 10])
    assert sum(w for s, w in flow[1] if s == 0) == 15 and flow[0] == [(0, 10)]
    # at most three uses
    assert ops.min_cost_flow([5], [[0]], [100]) == [[(0, 15)]]


def test_flow_is_as_cheap_as_the_best_of_all():
    rng = random.Random(5)
    for _ in range(30):
        size = [rng.randint(1, 3) for _ in range(2)]
        members = [sorted(rng.sample(range(2), rng.randint(1, 2))) for _ in size]
        quota = [rng.randint(0, 6) for _ in range(2)]
        best = None
        routes = [(p, s) for p, m in enumerate(members) for s in m]

        def price(p, words):
            return sum(ops.REPEAT_COSTS[k // size[p]] for k in range(words))

        def search(i, flow):
            nonlocal best
            if i == len(routes):
                into = [sum(f for (_, t), f in zip(routes, flow) if t == s) for s in range(2)]
                out = [sum(f for (q, _), f in zip(routes, flow) if q == p) for p in range(2)]
                if all(a <= b for a, b in zip(into, quota)) and all(o <= 3 * c for o, c in zip(out, size)):
                    best = min(best or (0, 0), (-sum(into), sum(map(price, range(2), out))))
                return
            for f in range(min(3 * size[routes[i][0]], quota[routes[i][1]]) + 1):
                search(i + 1, [*flow, f])

        search(0, [])
        got = ops.min_cost_flow(size, members, quota)
        out = [sum(w for _, w in f) for f in got]
        assert (-sum(out), sum(map(price, range(2), out))) == best


def mixed(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, source string, size long").repartition(3)
    wanted = ops.targets(df.groupBy("source").agg(F.sum("size").alias("source_size")))
    got = ops.mix(df, wanted, "doc_id", "size", F.array("source")).collect()
    return sorted((str(r["doc_id"]), r["source"] or "", r["size"], r["taken"]) for r in got)


def test_sources_come_near_their_targets(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice(["a", "b", "b", "c", None]), int(rng.lognormvariate(4, 1))) for i in range(800)]
    docs += [(900, "a", 0), (901, "a", 30), (901, "a", 30), (None, "b", 12)]
    got = mixed(spark, docs)
    assert len(got) == len(docs) and got == mixed(spark, docs)
    sizes, taken = {}, {}
    for _, source, size, words in got:
        sizes[source] = sizes.get(source, 0) + size
        taken[source] = taken.get(source, 0) + words
        assert words <= 3 * size and (words % size == 0 if size else words == 0)
    want = water({s or None: n for s, n in sizes.items()})
    for source, goal in want.items():
        assert abs(taken[source or ""] - goal) <= 10, (source, taken[source or ""], goal)


def test_overlapping_sources_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, 10, ["a", "b"] if i < 10 else ["a"]) for i in range(20)], "d long, n long, s array<string>")
    wanted = spark.createDataFrame([("a", 100.0), ("b", 100.0)], "source string, target double")
    assert [r["taken"] for r in ops.mix(docs, wanted, "d", "n", F.col("s")).collect()] == [10] * 20
    assert ops.mix(docs.limit(0), wanted, "d", "n", F.col("s")).count() == 0
    assert mixed(spark, [(1, "a", 0), (2, None, 0)]) == [("1", "a", 0, 0), ("2", "", 0, 0)]


def test_word_count(spark):
    texts = ["", None, " a  b\tc\n", "x\x1cy z", "é ü"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(ops.word_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_a_giant_at_the_edge_leaves_no_gap(spark):
    # the giant comes first in the order of digests, so the sum is reached on it
    rng = random.Random(7)
    docs = [(i, "a", rng.randint(20, 60)) for i in range(1500)] + [(10_000 + i, "b", 40) for i in range(500)]
    giant = sum(n for _, s, n in docs if s == "a") // 2
    places = spark.range(20_000, 30_000).select("id", F.xxhash64(F.lit(ops.SEED), "id", F.lit(giant).cast("long")).alias("u"))
    lone = places.orderBy(F.shiftrightunsigned("u", 64 - ops._BIN_BITS), "u").first()["id"]
    docs.append((lone, "a", giant))
    sizes = {s: sum(n for _, t, n in docs if t == s) for s in "ab"}
    df = spark.createDataFrame(docs, "doc_id long, source string, size long").repartition(3)
    goals = {"a": giant * 0.9, "b": 8_000.0}
    wanted = spark.createDataFrame(list(goals.items()), "source string, target double")
    got = ops.mix(df, wanted, "doc_id", "size", F.array("source")).collect()
    assert len(got) == len(docs) and sizes["a"] < 3.1 * giant
    for source, goal in goals.items():
        missing = goal - sum(r["taken"] for r in got if r["source"] == source)
        spare = [r["size"] for r in got if r["source"] == source and not r["taken"]]
        assert -1 <= missing < min(spare), source
