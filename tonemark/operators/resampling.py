"""Bootstrap intervals of any mergeable statistic (bias-corrected and accelerated, Efron 1987).

A statistic is mergeable if it is a function of sums: ``lift`` turns rows into vectors, states are
weighted sums of these, and ``finish`` turns states into values. States of parts of a group add up, so
no group is gathered, and leaving one row out is one subtraction.

Equal rows are counted, and what is distinct is dealt to parts by its digest, as many as the group's
rows ask for. How many of a resample's rows fall into each part comes from splitting the number in
two, again and again, by binomial draws; each part takes its own way down this tree. Inside a part
rows are drawn a chunk at a time. The states of a part go on in blocks of resamples, which are added
bunch by bunch of parts and finished block by block, so no task sees all states of a large group. Work
grows with rows times resamples.

Draws are seeded by the seed, the group and the place in the tree, whatever the layout, so a lost task
repeats itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark.plans.order_stats import order_statistics, usable

#: Rows of a group for each part, distinct rows drawn from at once, and resamples of a block.
PART_ROWS = 5_000
CHUNK = 512
BLOCK = 500
#: Parts of a group whose states of a block are added at once; the sums of so many are added behind.
BUNCH = 32
#: A multinomial draw of a count costs about as much as this many draws of an index.
_COUNT_COST = 8
_MASK = (1 << 64) - 1


def bca_bounds(
    replicates: np.ndarray, point: float, acceleration: float, level: float
) -> tuple[float, float]:
    """Ends of the interval, NaN where the correction is not finite."""
    normal = NormalDist()
    # sums come in any order, so a replicate equal to the point may differ in its last digits
    slack = 1e-10 * np.ptp(replicates)
    below = np.count_nonzero(replicates < point - slack)
    below += np.count_nonzero(replicates <= point + slack)
    share = below / (2 * len(replicates))
    if not 0 < share < 1 or not np.isfinite(acceleration):
        return float("nan"), float("nan")
    bias = normal.inv_cdf(share)
    ends = []
    for tail in ((1 - level) / 2, (1 + level) / 2):
        shifted = bias + normal.inv_cdf(tail)
        scale = 1 - acceleration * shifted
        if scale == 0:
            return float("nan"), float("nan")
        ends.append(float(np.quantile(replicates, normal.cdf(bias + shifted / scale))))
    return ends[0], ends[1]


def _empty(*columns: str) -> pd.DataFrame:
    """No rows, of a type that Arrow takes for any column, lists included."""
    return pd.DataFrame({c: [] for c in columns}, dtype=object)


def generator(*seeds: int) -> np.random.Generator:
    return np.random.Generator(np.random.SFC64([s & _MASK for s in seeds]))


class Statistic(NamedTuple):
    """``lift(rows, context)`` gives one vector per row, ``finish(states, context)`` one value per state.

    ``context`` makes a table ``(_gid, _context array<double>)`` from the rows ``(_gid, _v0, _v1, ..)``
    of all groups, for what both need to know of a group beforehand; it need not exist.
    """

    lift: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray, np.ndarray], np.ndarray]
    context: Callable[[DataFrame], DataFrame] | None = None


def mean() -> Statistic:
    def lift(rows: np.ndarray, context: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(rows)), rows[:, 0]], axis=1)

    return Statistic(lift, lambda states, context: states[:, 1] / states[:, 0])


def correlation() -> Statistic:
    """Pearson's correlation of two values; sums are taken around the group's means."""

    def context(rows: DataFrame) -> DataFrame:
        return rows.groupBy("_gid").agg(F.array(F.avg("_v0"), F.avg("_v1")).alias("_context"))

    def lift(rows: np.ndarray, context: np.ndarray) -> np.ndarray:
        x, y = (rows - context).T
        return np.stack([np.ones(len(rows)), x, y, x * x, y * y, x * y], axis=1)

    def finish(states: np.ndarray, context: np.ndarray) -> np.ndarray:
        n, x, y, xx, yy, xy = states.T
        with np.errstate(divide="ignore", invalid="ignore"):
            return (xy - x * y / n) / np.sqrt((xx - x * x / n) * (yy - y * y / n))

    return Statistic(lift, finish, context)


def trimmed_mean(share: float) -> Statistic:
    """Mean without the lowest and the highest ``share`` of the rows, rounded down.

    A state counts and sums the rows of cells, whose edges are order statistics of the group close
    together where a resample's cuts fall. Every edge is a cell of its own, so the group's value is
    exact; a resample whose cut falls inside a cell takes part of it at the cell's mean.
    """
    if not 0 <= share < 0.5:
        raise ValueError("the share to trim lies between 0 and 0.5")
    steps = (-4.0, -3.0, -2.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0)

    def context(rows: DataFrame) -> DataFrame:
        def rank(step: float, upper: bool) -> Callable[[Column], Column]:
            def of(n: Column) -> Column:
                cut = F.floor(n * share)
                cut = n - 1 - cut if upper else cut
                moved = cut + F.round(step * F.sqrt(n * share * (1 - share)))
                return F.greatest(F.lit(0), F.least(n - 1, moved)).cast("long")

            return of

        ranks = {f"_r{int(upper)}_{i}": rank(s, upper) for upper in (False, True) for i, s in enumerate(steps)}
        found = order_statistics(rows, ["_gid"], F.col("_v0"), ranks)
        return found.select("_gid", F.array_sort(F.array_distinct(F.array(*ranks))).alias("_context"))

    def lift(rows: np.ndarray, context: np.ndarray) -> np.ndarray:
        x = rows[:, 0]
        at = np.searchsorted(context, x)
        on_edge = context[np.minimum(at, len(context) - 1)] == x
        out = np.zeros((len(x), 2, 2 * len(context) + 1))
        out[np.arange(len(x)), 0, 2 * at + on_edge] = 1
        out[np.arange(len(x)), 1, 2 * at + on_edge] = x
        return out.reshape(len(x), -1)

    def finish(states: np.ndarray, context: np.ndarray) -> np.ndarray:
        counts, sums = states.reshape(len(states), 2, -1).transpose(1, 0, 2)
        upto = np.cumsum(counts, axis=1)
        n = upto[:, -1:]
        cut = np.floor(n * share)
        inside = np.minimum(upto, n - cut) - np.maximum(upto - counts, cut)
        inside = np.clip(inside, 0, None)
        means = np.divide(sums, counts, out=np.zeros_like(sums), where=counts > 0)
        return (inside * means).sum(axis=1) / (n - 2 * cut)[:, 0]

    return Statistic(lift, finish, context)


def drawn_in_part(group: int, part: int, sizes: np.ndarray, n_resamples: int) -> np.ndarray:
    """How many rows of each resample fall into one part of a group with these sizes of parts."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    lo, hi, drawn = 0, len(sizes), np.full(n_resamples, upto[-1], np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left, both = upto[mid] - upto[lo], upto[hi] - upto[lo]
        first = generator(group, lo, hi).binomial(drawn, left / both if both else 0.0)
        lo, hi, drawn = (lo, mid, first) if part < mid else (mid, hi, drawn - first)
    return drawn


def drawn_counts(rng: np.random.Generator, counts: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """How often each distinct row comes up in each resample, ``drawn`` rows in all.

    Drawn by place or by distinct row, whichever is less work; the distribution is the same.
    """
    n, m = int(counts.sum()), len(counts)
    if n > _COUNT_COST * m:
        return rng.multinomial(drawn, counts / n).astype(float)
    row = np.repeat(np.arange(m), counts)
    owner = np.repeat(np.arange(len(drawn)) * m, drawn)
    places = owner + row[rng.integers(0, n, len(owner), dtype=np.uint32)]
    return np.bincount(places, minlength=m * len(drawn)).reshape(len(drawn), m).astype(float)


def part_states(
    statistic: Statistic, group: int, part: int, rows: np.ndarray, counts: np.ndarray, drawn: np.ndarray, context: np.ndarray
) -> np.ndarray:
    """States of all resamples over one part."""
    order = np.lexsort(rows.T)
    rows, counts = rows[order], counts[order]
    rng, left_rows, left = generator(group, part, -1), int(counts.sum()), drawn
    states = None
    for start in range(0, len(rows), CHUNK):
        some = counts[start : start + CHUNK]
        n = int(some.sum())
        here = left if n == left_rows else rng.binomial(left, n / left_rows)
        left_rows, left = left_rows - n, left - here
        lifted = statistic.lift(rows[start : start + CHUNK], context)
        added = [drawn_counts(rng, some, here[b : b + BLOCK]) @ lifted for b in range(0, len(here), BLOCK)]
        states = np.concatenate(added) if states is None else states + np.concatenate(added)
    return states


def _sums(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sum of states and sum of powers, added in a fixed order and one by one, so that the last digits
    do not depend on the layout."""
    states = None
    for state in sorted(frame["_state"]):
        states = np.frombuffer(state).copy() if states is None else np.add(states, np.frombuffer(state), out=states)
    return states, np.sum(np.sort(np.stack(frame["_jack"].to_list()), axis=0), axis=0)


def bunch_sum(frame: pd.DataFrame) -> pd.DataFrame:
    """One row for the states of a bunch of parts."""
    states, jack = _sums(frame)
    head = {c: [frame[c].iloc[0]] for c in ("_gid", "_block")}
    return pd.DataFrame({**head, "_state": [states.tobytes()], "_jack": [jack.tolist()]})


def resampled(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[Column],
    statistic: Statistic,
    n_resamples: int = 10_000,
    level: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """STAT1, STAT2: point, low, high, cl, n, degenerate of a statistic of one or more values.

    Rows with a null or NaN among the values are dropped first. A group of one row, without spread, or
    whose ends are not finite is degenerate: its ends are its point, null where that is not finite.
    """
    spark = df.sparkSession
    names = [f"_v{i}" for i in range(len(values))]
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    clean = df.select(group.alias("_g"), *[v.cast("double").alias(n) for n, v in zip(names, values)])
    for name in names:
        clean = clean.where(usable(F.col(name)))
    clean = clean.withColumn("_gid", F.xxhash64(F.lit(seed), "_g"))
    base = clean.groupBy("_gid", "_g").agg(F.count(F.lit(1)).alias("n"))
    known = base.select("_gid", "n", F.greatest(F.ceil(F.col("n") / PART_ROWS), F.lit(1)).cast("int").alias("_parts"))
    if statistic.context is None:
        known = known.withColumn("_context", F.array().cast("array<double>"))
    else:
        known = known.join(statistic.context(clean.select("_gid", *names)), "_gid")
    counted = clean.groupBy("_gid", *names).agg(F.count(F.lit(1)).alias("_c")).join(known, "_gid")
    counted = counted.withColumn("_part", F.pmod(F.xxhash64(*names), F.col("_parts")).cast("int"))
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = counted.select("_gid", "_part", *names, "_c", "_context").repartition(cores, "_gid", "_part")

    def totals(frame: pd.DataFrame) -> pd.DataFrame:
        context = np.array(frame["_context"].iloc[0], float)
        lifted = statistic.lift(frame[names].to_numpy(float), context)
        # a group of one row many times is that row
        state = frame["_c"].to_numpy(float) @ lifted if len(frame) > 1 else lifted[0]
        weight = int(frame["_c"].sum()) if len(frame) == 1 else 1
        head = {"_gid": [frame["_gid"].iloc[0]], "_part": [frame["_part"].iloc[0]], "_size": [int(frame["_c"].sum())]}
        return pd.DataFrame({**head, "_kinds": [len(frame)], "_weight": [weight], "_state": [state.tolist()]})

    by_part = rows.groupBy("_gid", "_part").applyInPandas(
        totals, "_gid long, _part int, _size long, _kinds long, _weight long, _state array<double>"
    )

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = np.zeros(int(frame["_part"].max()) + 1, np.int64)
        sizes[frame["_part"].to_numpy()] = frame["_size"].to_numpy()
        frame, kinds = frame.sort_values("_part"), int(frame["_kinds"].sum())
        weights = frame["_weight"] if kinds > 1 else [1]
        state = np.sum([np.array(s) * w for s, w in zip(frame["_state"], weights)], axis=0)
        made = {"_gid": [frame["_gid"].iloc[0]], "_kinds": [kinds], "_sizes": [sizes.tolist()], "_total": [state.tolist()]}
        return pd.DataFrame(made)

    # one row for each part of a group: its rows over PART_ROWS
    whole = by_part.groupBy("_gid").applyInPandas(merged, "_gid long, _kinds long, _sizes array<long>, _total array<double>")
    heads = whole.join(known, "_gid").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    heads = heads.select("_gid", "_part", "_sizes", "_total", "_context")

    def draw(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _empty("_gid", "_block", "_bunch", "_state", "_jack")
        head = right.iloc[0]
        gid, part = int(head["_gid"]), int(head["_part"])
        sizes, total, context = (np.array(head[c]) for c in ("_sizes", "_total", "_context"))
        values, counts = left[names].to_numpy(float), left["_c"].to_numpy()
        drawn = drawn_in_part(gid, part, sizes, n_resamples)
        states = part_states(statistic, gid, part, values, counts, drawn, context)
        point = statistic.finish(total[None], context)[0]
        power = np.zeros(3)
        for start in range(0, len(values), CHUNK):
            without = statistic.finish(total - statistic.lift(values[start : start + CHUNK], context), context) - point
            power += [float(counts[start : start + CHUNK] @ without**k) for k in (1, 2, 3)]
        blocks = range(0, n_resamples, BLOCK)
        made = {"_gid": [gid] * len(blocks), "_block": list(blocks), "_bunch": [part // BUNCH] * len(blocks)}
        return pd.DataFrame(
            {**made, "_state": [states[b : b + BLOCK].tobytes() for b in blocks], "_jack": [power.tolist()] * len(blocks)}
        )

    pairs = rows.groupBy("_gid", "_part").cogroup(heads.repartition(cores, "_gid", "_part").groupBy("_gid", "_part"))
    drawn = pairs.applyInPandas(draw, "_gid long, _block int, _bunch int, _state binary, _jack array<double>")
    # of a block, a task holds the states of a bunch of parts, then one sum for each bunch
    drawn = drawn.groupBy("_gid", "_block", "_bunch").applyInPandas(
        bunch_sum, "_gid long, _block int, _state binary, _jack array<double>"
    )

    def finished(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _empty("_gid", "_block", "_values", "_jack")
        context = np.array(right["_context"].iloc[0], float)
        states, jack = _sums(left)
        states = states.reshape(min(BLOCK, n_resamples - int(left["_block"].iloc[0])), -1)
        found = statistic.finish(states, context)
        made = {"_gid": [left["_gid"].iloc[0]], "_block": [left["_block"].iloc[0]], "_values": [found.tobytes()]}
        return pd.DataFrame({**made, "_jack": [jack.tolist()]})

    blocks = known.withColumn("_block", F.explode(F.array([F.lit(b) for b in range(0, n_resamples, BLOCK)])))
    keyed = drawn.groupBy("_gid", "_block").cogroup(blocks.select("_gid", "_block", "_context").groupBy("_gid", "_block"))
    values_of = keyed.applyInPandas(finished, "_gid long, _block int, _values binary, _jack array<double>")
    gathered = values_of.groupBy("_gid").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_values"))).alias("_all"), F.any_value("_jack").alias("_jack")
    )
    joined = gathered.join(whole.select("_gid", "_kinds", "_total"), "_gid").join(known.select("_gid", "n", "_context"), "_gid")

    @F.pandas_udf("point double, low double, high double")
    def bounds(parts: pd.Series, total: pd.Series, jack: pd.Series, context: pd.Series, n: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        out = []
        for p, t, (one, two, three), c, k, m in zip(parts, total, jack, context, n, kinds):
            c = np.array(c, float)
            point = float(statistic.finish(np.array(t)[None], c)[0])
            ends = point, point
            replicates = np.concatenate([np.frombuffer(b) for b in p])
            if m > 1 and np.isfinite(replicates).all() and np.ptp(replicates) > 0:
                shift = one / k
                spread = two - k * shift**2
                lean = -(three - 3 * shift * two + 2 * k * shift**3)
                speed = lean / (6 * spread**1.5) if spread > 0 else float("nan")
                ends = bca_bounds(replicates, point, speed, level)
            out.append((point, *ends))
        return pd.DataFrame(out, columns=["point", "low", "high"], dtype="float64")

    solved = joined.select("_gid", bounds(F.col("_all._values"), "_total", "_jack", "_context", "n", "_kinds").alias("_s"))
    joined = base.join(solved, "_gid", "left")
    point, low, high = (F.col(f"_s.{c}") for c in ("point", "low", "high"))
    finite = F.coalesce(usable(low) & usable(high) & (low < high), F.lit(False))
    sure = F.when(usable(point), point)
    result = joined.select(
        "_g",
        sure.alias("point"),
        F.when(finite, low).otherwise(sure).alias("low"),
        F.when(finite, high).otherwise(sure).alias("high"),
        F.lit(level).alias("cl"),
        "n",
        (~finite).alias("degenerate"),
    )
    columns = ["point", "low", "high", "cl", "n", "degenerate"]
    return result.select("_g.*", *columns) if keys else result.select(*columns)
