"""Toxicity: two class-conditional Kneser-Ney models over characters, compared by the length of the text.

A text is read as lower-case symbols, letters as they are and every run of other characters as one
boundary, in windows of ``ORDER`` symbols. Two models, of toxic and of ordinary texts, give the last
symbol of a window after the others: interpolated Kneser-Ney with absolute discount, backing off to
one shared model whose lower orders are continuation counts over both classes. What one class only
has counts fully, what is rare hardly, and what neither has only by the weight of the back-off. The
logarithms of the ratio are summed over all windows and divided by their number to the power
``LENGTH``: between the mean, which thins out what is said twice in a long text, and the sum.

Windows are counted over all labelled texts that are not held out, in ``SLOTS`` hashed slots: the
model has a fixed size however much text there is, and windows that share a slot share their counts.
A third of these texts (``crc32(id) % 4 == 3``) is also scored by models of the rest; its histogram of
raw values, at fixed steps, fits the two numbers of a logistic curve (Platt, 1999).

Texts are used whole. A null text is empty; a text without a window has raw value 0. A null id has no
label and is not held out. Of several labels for one id the largest holds, each row of a repeated id
is learned from, and null labels are passed over. Where labels are absent, or all alike, every score
is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tonemark.llm.shared import cut, with_arrow

ORDER = 4
SLOTS = 1 << 20
DISCOUNT = 0.9
LENGTH = 0.6
PREDICTED = 0.3
#: Bits of a symbol in a window's name. Letters beyond 4,094 share symbols.
_BITS = 12
_CHUNK = 1 << 20
#: Step and reach of the histogram of raw values.
_STEP, _REACH = 0.005, 50.0

_COUNTS = ["ordinary", "toxic", "ordinary_cal", "toxic_cal"]
_SLOT = T.StructType(
    [T.StructField("slot", T.IntegerType()), T.StructField("name", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in _COUNTS]
)


class Model(NamedTuple):
    """Logarithmic ratios by slot: of windows, NaN where never counted, and of back-off weights."""

    ratio: np.ndarray
    backoff: np.ndarray


def symbols(text: str) -> np.ndarray:
    """Symbols of lower-cased text; characters that are not letters are 0, once for each run."""
    data = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    data = np.where(letter, data % ((1 << _BITS) - 1) + 1, 0).astype(np.int64)
    return data[np.concatenate([[True], letter[1:] | letter[:-1]])] if len(data) else data


def windows(text: str) -> Iterator[np.ndarray]:
    """Names of all windows, a chunk of characters at a time; the last symbol is in the lowest bits."""
    tail = np.zeros(1, np.int64)
    for start in range(0, len(text) + 1, _CHUNK):
        part = symbols(text[start : start + _CHUNK])
        if start + _CHUNK > len(text):
            part = np.append(part, 0) if not len(part) or part[-1] else part
        whole = np.concatenate([tail, part[1:] if len(part) and not part[0] and not tail[-1] else part])
        n = len(whole) - ORDER + 1
        if n > 0:
            name = whole[:n].copy()
            for k in range(1, ORDER):
                name = name << _BITS | whole[k : k + n]
            yield name
            tail = whole[n:]
        else:
            tail = whole


def slot_of(name: np.ndarray) -> np.ndarray:
    mixed = name.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(40)).astype(np.int64) % SLOTS


def count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by slot of a partition of (text, toxic, calibrating), with one name for each slot."""
    counts = np.zeros((SLOTS, len(_COUNTS)), np.int64)
    names = np.full(SLOTS, np.iinfo(np.int64).max)
    for batch in batches:
        for text, toxic, calibrating in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for name in windows(text or ""):
                name, times = np.unique(name, return_counts=True)
                slot = slot_of(name)
                np.add.at(counts, (slot, int(toxic) + 2 * int(calibrating)), times)
                # a slot is named after its smallest window, whatever the order of the rows
                np.minimum.at(names, slot, name)
    used = np.flatnonzero(counts.any(axis=1))
    for start in range(0, len(used), 1 << 16):
        part = used[start : start + (1 << 16)]
        columns = [part.astype(np.int32), names[part], *(counts[part, i] for i in range(len(_COUNTS)))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=to_arrow_schema(_SLOT))


def _shared_backoff(names: np.ndarray) -> np.ndarray:
    """Kneser-Ney chance of each window's last symbol after all but the first: continuation counts of
    both classes together, each order discounted in favour of the one below."""
    grams = [np.unique(names)]
    for k in range(ORDER - 1, 0, -1):
        grams.append(np.unique(grams[-1] & ((1 << _BITS * k) - 1)))
    counts = [
        np.bincount(np.searchsorted(short, long & ((1 << _BITS * (ORDER - 1 - at)) - 1)), minlength=len(short))
        for at, (long, short) in enumerate(zip(grams[:-1], grams[1:]))
    ]
    below = counts[-1] / counts[-1].sum()
    for k in range(2, ORDER):
        gram, count = grams[ORDER - k], counts[ORDER - k - 1]
        _, context = np.unique(gram >> _BITS, return_inverse=True)
        total, kinds = np.bincount(context, count)[context], np.bincount(context)[context]
        lower = below[np.searchsorted(grams[ORDER - k + 1], gram & ((1 << _BITS * (k - 1)) - 1))]
        below = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds * lower) / total
    return below[np.searchsorted(grams[1], names & ((1 << _BITS * (ORDER - 1)) - 1))]


def build(slots: np.ndarray, names: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> Model | None:
    """Ratios of the two models by slot; None if a class has no text."""
    used = ordinary + toxic > 0
    if not ordinary.any() or not toxic.any():
        return None
    slots, names = slots[used], names[used]
    backoff = _shared_backoff(names)
    contexts, context = np.unique(names >> _BITS, return_inverse=True)
    chances, weights = [], []
    for count in (ordinary[used], toxic[used]):
        total, kinds = np.bincount(context, count), np.bincount(context, count > 0)
        weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        own = np.maximum(count - DISCOUNT, 0) / np.maximum(total, 1)[context]
        chances.append(np.log(own + weight[context] * backoff))
        weights.append(np.log(weight))
    ratio = np.full(SLOTS, np.nan, np.float32)
    ratio[slots] = chances[1] - chances[0]
    weight = np.zeros(SLOTS, np.float32)
    weight[slot_of(contexts)] = weights[1] - weights[0]
    return Model(ratio, weight)


def raw_value(text: str | None, model: Model) -> float:
    """Sum of the logarithmic ratios over the power of the number of windows."""
    total, n = 0.0, 0
    for name in windows(text or ""):
        value = model.ratio[slot_of(name)]
        value = np.where(np.isnan(value), model.backoff[slot_of(name >> _BITS)], value)
        total += float(value.sum(dtype=np.float64))
        n += len(name)
    return total / max(n, 1) ** LENGTH


def fold(doc_id: Column) -> Column:
    """The id's remainder of four; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from; a null id counts as not held out."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def _one_label(labels: DataFrame, doc_id: str, toxic: str) -> DataFrame:
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull() & ~held_out(F.col(doc_id)))
    return rows.groupBy(F.col(doc_id).alias("_id")).agg((F.max(toxic) >= 1).alias("_toxic"))


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic"
) -> tuple[Model | None, Model | None]:
    """The models of all labelled texts, and those that leave out the calibrating third."""
    rows = docs.where(F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    rows = rows.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    # labels grow with the documents, so both sides are dealt by id at any size
    known = rows.join(_one_label(labels, doc_id, toxic).hint("shuffle_merge"), "_id")
    known = known.select("_text", "_toxic", (fold(F.col("_id")) == 3).alias("_cal"))
    counted = known.mapInArrow(count_windows, _SLOT).groupBy("slot")
    # at most SLOTS rows
    table = cut(counted.agg(F.min("name").alias("name"), *[F.sum(c).alias(c) for c in _COUNTS]), "windows").toArrow()
    slots, names, *counts = (table.column(c).to_numpy() for c in ["slot", "name", *_COUNTS])
    order = np.argsort(slots)
    slots, names = slots[order], names[order]
    ordinary, tox, ordinary_cal, tox_cal = (c[order] for c in counts)
    return build(slots, names, ordinary + ordinary_cal, tox + tox_cal), build(slots, names, ordinary, tox)


def with_raw(docs: DataFrame, models: tuple, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``raw`` and, for calibrating rows, ``raw_cal``; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(tuple(m) if m else None for m in models))

    def make(texts: list, calibrating: list) -> list:
        final, partial = (Model(*m) if m else None for m in shared.value)
        raw = [raw_value(t, final) if final else None for t in texts]
        return [raw, [raw_value(t, partial) if partial and c else None for t, c in zip(texts, calibrating)]]

    fields = [T.StructField("raw", T.DoubleType()), T.StructField("raw_cal", T.DoubleType())]
    marked = docs.withColumn("_cal", fold(F.col(doc_id)) == 3)
    return with_arrow(marked, [text, "_cal"], make, fields).drop("_cal")


def logistic(x: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through counts at ``x``, targets smoothed as by Platt."""
    n, k = ordinary.sum(), toxic.sum()
    goal = (toxic * (k + 1) / (k + 2) + ordinary / (n + 2)) / np.maximum(ordinary + toxic, 1)
    size = ordinary + toxic
    a, b = 0.0, float(np.log((k + 1) / (n + 1)))

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((size * (np.logaddexp(0, z) - goal * z)).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        slope = np.array([(size * (p - goal) * x).sum(), (size * (p - goal)).sum()])
        w = size * p * (1 - p)
        bend = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]]) + 1e-9 * np.eye(2)
        da, db = np.linalg.solve(bend, slope)
        step, before = 1.0, loss(a, b)
        while step > 1e-6 and loss(a - step * da, b - step * db) > before:
            step /= 2
        a, b = a - step * da, b - step * db
        if abs(step * da) + abs(step * db) < 1e-9:
            break
    return float(a), float(b)


def calibrate(
    raw: DataFrame, labels: DataFrame, doc_id: str = "doc_id", toxic: str = "toxic"
) -> tuple[float, float] | None:
    """Fit the logistic curve on a histogram of all calibrating rows; None if a class is absent."""
    rows = raw.where(F.col("raw_cal").isNotNull()).select(F.col(doc_id).alias("_id"), "raw_cal")
    bin_ = F.round(F.greatest(F.lit(-_REACH), F.least(F.lit(_REACH), F.col("raw_cal"))) / _STEP).cast("int")
    joined = rows.join(_one_label(labels, doc_id, toxic), "_id").groupBy(bin_.alias("bin"))
    table = joined.agg(F.count_if(~F.col("_toxic")).alias("n"), F.count_if("_toxic").alias("k")).orderBy("bin").toPandas()
    if not table["n"].sum() or not table["k"].sum():
        return None
    return logistic(*(table[c].to_numpy(float) * s for c, s in (("bin", _STEP), ("n", 1), ("k", 1))))


def score(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic"
) -> DataFrame:
    """Add ``held_out``, ``score`` and ``predicted``; the text goes, all other columns stay."""
    models = fit(docs, labels, doc_id, text, toxic)
    raw = cut(with_raw(docs, models, doc_id, text).drop(text), "raw_scores")
    curve = calibrate(raw, labels, doc_id, toxic)
    # without a calibrating third of both classes the ratio itself decides, against equal odds
    a, b = curve or (1.0, 0.0)
    z = F.coalesce(1 / (1 + F.exp(-F.lit(a) * F.col("raw") - F.lit(b))), F.lit(0.0))
    scored = raw.withColumns({"held_out": held_out(F.col(doc_id)), "score": z})
    return scored.withColumn("predicted", (F.col("score") >= PREDICTED).cast("int")).drop("raw", "raw_cal")
