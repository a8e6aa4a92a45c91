"""Mix overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern, the set of sources they belong to. Words flow from a
pattern to the quotas of its sources; a second and third use of a pattern's words costs more each
time, so nothing is repeated while unused words would do. What flows out of a pattern says how often
each of its documents is taken: so many times all, and once more a seeded choice of documents.

The flow runs on the driver over one node per pattern and source, never over documents. Documents
are chosen by bins of a digest: whole bins first, then documents of the bin where the sum is reached.
While more than an average document is missing, the same is done again with the unused ones that
still fit; then the largest that fit follow, until no unused document of the pattern fits.

A null source is a source of its own. A document without words, or without any source, is never
taken. Rows with equal id and size are alike.
"""

from __future__ import annotations

import json
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemark.llm.shared import WORD, cut, join_spread

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Cost of a word's first, second and third use.
REPEAT_COSTS = (0, 1, 3)
SEED = 42
_BIN_BITS = 12
_KEY = ["_pattern", "_u", "_size", "_nth"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from ``(source, source_size)``, one row per source.

    Shares follow the weights; one that would pass three times its source's size stops there, and
    the excess is shared again by weight. In the order of size per weight, all sources before the
    first that stays below its limit are stopped, so one pass over the order settles it.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("_place", place).withColumn("_w", weight)
    rows = rows.withColumn("_most", (MOST_REPEATS * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("_most") / F.col("_w"), "_place")
    everything = Window.partitionBy()
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))
    rows = rows.withColumn("_rate", left / F.sum("_w").over(after))
    free = F.col("_rate") < F.col("_most") / F.col("_w")
    rows = rows.withColumn("_free", free)
    rate = F.first(F.when(F.col("_free"), F.col("_rate")), True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.when(F.col("_free"), F.col("_w") * rate).otherwise(F.col("_most"))
    return rows.withColumn("target", target).select("source", "source_size", "target")


def min_cost_flow(
    capacity: list[int], members: list[list[int]], quota: list[int]
) -> list[list[tuple[int, int]]]:
    """Words from each pattern to each of its sources, as much as fits at the least cost.

    Shortest augmenting paths with potentials; a pattern has one arc per use of its words.
    """
    n = len(capacity)
    source, sink = n + len(quota), n + len(quota) + 1
    arcs: list[list[int]] = [[] for _ in range(sink + 1)]
    head, room, cost = [], [], []

    def add(a: int, b: int, most: int, price: int) -> None:
        for tail, to, limit, c in ((a, b, most, price), (b, a, 0, -price)):
            arcs[tail].append(len(head))
            head.append(to)
            room.append(limit)
            cost.append(c)

    for p, size in enumerate(capacity):
        for price in REPEAT_COSTS:
            add(source, p, size, price)
    routes = []
    for p, names in enumerate(members):
        routes.append([(s, len(head) + 2 * k) for k, s in enumerate(names)])
        for s in names:
            add(p, n + s, MOST_REPEATS * capacity[p], 0)
    for s, wanted in enumerate(quota):
        add(n + s, sink, wanted, 0)

    potential = [0] * (sink + 1)
    while True:
        far: list[int | None] = [None] * (sink + 1)
        via = [-1] * (sink + 1)
        far[source], heap = 0, [(0, source)]
        while heap:
            d, a = heappop(heap)
            if d > far[a]:
                continue
            for e in arcs[a]:
                b = head[e]
                step = d + cost[e] + potential[a] - potential[b]
                if room[e] and (far[b] is None or step < far[b]):
                    far[b], via[b] = step, e
                    heappush(heap, (step, b))
        if far[sink] is None:
            break
        potential = [p + (far[sink] if f is None else min(f, far[sink])) for p, f in zip(potential, far)]
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = head[via[at] ^ 1]
        moved = min(room[e] for e in path)
        for e in path:
            room[e] -= moved
            room[e ^ 1] += moved
    return [[(s, room[e ^ 1]) for s, e in route if room[e ^ 1]] for route in routes]


def _whole(values: list[float]) -> list[int]:
    """Whole numbers near the values, with the rounded sum of all."""
    floors = [int(v) for v in values]
    order = sorted(range(len(values)), key=lambda i: (floors[i] - values[i], i))
    for i in order[: round(sum(values)) - sum(floors)]:
        floors[i] += 1
    return floors


def route(patterns: list[tuple[str, int]], wanted: list[tuple[str | None, float]]) -> list[tuple[str, int, int]]:
    """Per pattern: how often all its documents are taken, and the words to choose once more."""
    names = {name: i for i, (name, _) in enumerate(wanted)}
    members = [sorted({names[s] for s in json.loads(p) if s in names}) for p, _ in patterns]
    flow = min_cost_flow([size for _, size in patterns], members, _whole([t for _, t in wanted]))
    out = []
    for (pattern, size), parts in zip(patterns, flow):
        words = sum(part for _, part in parts)
        out.append((pattern, words // size if size else 0, words % size if size else 0))
    return out


def _fill(sizes: pd.DataFrame) -> pd.DataFrame:
    """How many spare documents of each size one pattern takes, largest first, as long as they fit."""
    sizes = sizes.sort_values("_size", ascending=False)
    left, many = int(sizes["_room"].iloc[0]), []
    for size, n in zip(sizes["_size"].tolist(), sizes["_n"].tolist()):
        many.append(min(n, left // size))
        left -= size * many[-1]
    return sizes.assign(_many=many)[["_pattern", "_size", "_many"]]


def _reach(rows: DataFrame) -> DataFrame:
    """Where the sum of sizes, in the order of digests, passes ``_room``: the bin ``_edge``, the last
    row ``_last`` of it that still fits, and what is then missing, ``_gap``. No row if all fits."""
    bins = rows.groupBy("_pattern", "_bin").agg(F.sum("_size").alias("_n"), F.first("_room").alias("_room"))
    upto = Window.partitionBy("_pattern").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("_upto", F.sum("_n").over(upto)).where(F.col("_upto") > F.col("_room"))
    edge = bins.groupBy("_pattern").agg(
        F.min("_bin").alias("_edge"), F.min_by(F.col("_room") - F.col("_upto") + F.col("_n"), "_bin").alias("_left")
    )
    edge = cut(edge, "edges")
    inside = join_spread(rows, edge, "_pattern").where(F.col("_bin") == F.col("_edge"))
    order = Window.partitionBy("_pattern").orderBy("_u", "_size", "_nth")
    running = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = inside.withColumn("_sum", running).where(F.col("_sum") <= F.col("_left"))
    reached = fits.groupBy("_pattern").agg(F.max("_sum").alias("_sum"), F.max(F.struct("_u", "_size", "_nth")).alias("_last"))
    gaps = edge.join(reached, "_pattern", "left").select(
        "_pattern", "_edge", "_last", (F.col("_left") - F.coalesce("_sum", F.lit(0))).alias("_gap")
    )
    return cut(gaps, "gaps")


def _within() -> Column:
    """Whether a row comes before the place that ``_reach`` found."""
    here = F.struct("_u", "_size", "_nth")
    return (
        F.col("_edge").isNull() | (F.col("_bin") < F.col("_edge"))
        | ((F.col("_bin") == F.col("_edge")) & F.coalesce(here <= F.col("_last"), F.lit(False)))
    )


def _fillers(spare: DataFrame) -> DataFrame:
    """The documents of ``spare`` that fill ``_room`` until none of a pattern's fits."""
    kept = [*_KEY, "_bin", "_mean", "_room"]
    wide = F.col("_room") > F.col("_mean")
    spare, parts = cut(spare.select(*kept), "spare"), []
    while not (rows := spare.where(wide)).isEmpty():
        met = join_spread(spare, _reach(rows), "_pattern", "left").withColumn("_in", wide & _within())
        parts.append(cut(met.where("_in").select(*_KEY), "fillers"))
        met = met.where(~F.col("_in")).withColumn("_room", F.when(wide, F.col("_gap")).otherwise(F.col("_room")))
        spare = cut(met.where(F.col("_size") <= F.col("_room")).select(*kept), "spare")
    sizes = spare.groupBy("_pattern", "_size").agg(F.count(F.lit(1)).alias("_n"), F.first("_room").alias("_room"))
    many = sizes.groupBy("_pattern").applyInPandas(_fill, "_pattern string, _size long, _many long")
    many = cut(many.where("_many > 0"), "many")
    alike = Window.partitionBy("_pattern", "_size").orderBy("_u", "_nth")
    last = spare.join(many, ["_pattern", "_size"]).withColumn("_rank", F.row_number().over(alike))
    out = cut(last.where(F.col("_rank") <= F.col("_many")).select(*_KEY), "fillers")
    for part in parts:
        out = out.unionByName(part)
    return out


def mix(docs: DataFrame, wanted: DataFrame, doc_id: str, size: str, sources: Column) -> DataFrame:
    """Add ``taken``, the words that the mix takes of each document.

    ``wanted`` has ``(source, target)``; ``sources`` is an array of the sources of a document.
    """
    pattern = F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))))
    rows = docs.withColumn("_pattern", pattern).withColumn("_u", F.xxhash64(F.lit(SEED), doc_id, size))
    rows = rows.withColumn("_size", F.col(size))
    # equal rows get a number, so that each is taken or left by itself
    alike = Window.partitionBy("_pattern", "_u", "_size").orderBy("_u")
    rows = cut(rows.withColumn("_nth", F.row_number().over(alike)), "mix")
    sums = rows.groupBy("_pattern").agg(
        F.sum("_size").alias("n"), F.avg(F.when(F.col("_size") > 0, F.col("_size"))).alias("mean")
    ).orderBy("_pattern").collect()
    goals = [(r["source"], r["target"]) for r in wanted.select("source", "target").orderBy("source").collect()]
    routed = route([(r["_pattern"], r["n"]) for r in sums], goals)
    spark = docs.sparkSession
    plan = [(*row, r["mean"]) for row, r in zip(routed, sums)]
    plan = spark.createDataFrame(plan, "_pattern string, _all long, _rest long, _mean double")
    rows = join_spread(rows, plan, "_pattern")
    used = rows.where((F.col("_size") > 0) & (F.col("_rest") > 0))

    # where the sum is reached: first among bins, then inside that bin
    bin_of = F.shiftrightunsigned("_u", 64 - _BIN_BITS)
    gaps = _reach(used.withColumn("_bin", bin_of).withColumn("_room", F.col("_rest")))
    joined = join_spread(rows.withColumn("_bin", bin_of), gaps, "_pattern", "left")
    joined = joined.withColumn("_chosen", (F.col("_rest") > 0) & _within())
    spare = joined.where(~F.col("_chosen") & (F.col("_size") > 0) & (F.col("_size") <= F.col("_gap")))
    fillers = _fillers(spare.withColumn("_room", F.col("_gap"))).withColumn("_filler", F.lit(True))
    joined = joined.join(fillers, ["_pattern", "_u", "_size", "_nth"], "left")
    times = F.col("_all") + (F.col("_chosen") | F.coalesce("_filler", F.lit(False))).cast("long")
    kept = [c for c in docs.columns if c != "taken"]
    return joined.select(*kept, (F.col("_size") * times).alias("taken"))
