"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its subwords, the byte strings of two to four bytes inside
its words and at their ends; subwords share hashed rows. Embeddings and softmax are trained together
by stochastic gradient descent in numpy, on at most ``PER_LABEL`` documents of each label taken by a
digest of their id. A fifth of these is held back to set the temperature of the scores and the score
below which a prediction is marked as not accepted.

As the model is linear in the mean, prediction needs one row of logits per subword. Texts are used
whole. A null text, or one without a letter, is ``und`` with score 0. Documents with null id or null
label are not learned from; without any labelled text everything is ``und``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemark.llm.shared import with_arrow

UNKNOWN = "und"
PER_LABEL = 400
BUCKETS = 1 << 16
WIDTH = 16
EPOCHS = 6
RATE = 0.5
SIZES = (2, 3, 4)
#: Share of right calibration predictions that may fall below the accepted score.
REFUSED = 0.005
_CHUNK = 1 << 20
_PARTS = 64

FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("accepted", T.BooleanType()),
]


class Model(NamedTuple):
    labels: list[str]
    logits: np.ndarray
    temperature: float
    least_score: float


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def subwords(text: str) -> np.ndarray:
    """Hashed rows of all subwords; ASCII characters other than letters end a word."""
    data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    data = np.where(letter, data, 32).astype(np.uint32)
    found = []
    for size in SIZES:
        n = len(data) - size + 1
        if n <= 0:
            continue
        value, inside = np.zeros(n, np.uint32), np.ones(n, bool)
        for k in range(size):
            value = value * np.uint32(0x01000193) ^ data[k : k + n]
            if 0 < k < size - 1:
                inside &= letter[k : k + n]
        inside &= letter[:n] | letter[size - 1 :]
        value = value * np.uint32(0x9E3779B1)
        found.append((value[inside] >> np.uint32(8)) % np.uint32(BUCKETS))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def logits_of(text: str, table: np.ndarray) -> np.ndarray:
    """Mean row of logits over the whole text, a chunk of characters at a time."""
    total, n = np.zeros(table.shape[1]), 0
    for start in range(0, len(text), _CHUNK):
        rows = subwords(text[start : start + _CHUNK])
        total += table[rows].sum(axis=0, dtype=np.float64)
        n += len(rows)
    return total / max(n, 1)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model | None:
    """Fit on rows of (label, subword rows, their counts), in a fixed order."""
    labels = sorted({label for label, _, _ in samples})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    held = set(order[: len(samples) // 5].tolist())
    emb = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    out = np.zeros((WIDTH, len(labels)))
    index = {label: i for i, label in enumerate(labels)}
    learned = [i for i in order.tolist() if i not in held]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(learned).tolist():
            label, rows, counts = samples[i]
            share = counts / counts.sum()
            mean = share @ emb[rows]
            wrong = softmax(mean @ out)
            wrong[index[label]] -= 1
            step = out @ wrong
            out -= rate * np.outer(mean, wrong)
            # rows share the mean's weight, so each is moved by its part of the text times their number
            emb[rows] -= rate * np.outer(share * len(rows), step)
    logits = (emb @ out).astype(np.float32)
    held_back = [samples[i] for i in sorted(held)] or samples
    scores = np.array([(c / c.sum()) @ logits[r] for _, r, c in held_back])
    truth = np.array([index[label] for label, _, _ in held_back])

    # smoothed truth (Platt, 1999): a finite set without mistakes does not prove certainty
    sure = (len(truth) + 1) / (len(truth) + 2)

    def loss(t: float) -> float:
        chance = np.clip(softmax(scores / t)[np.arange(len(truth)), truth], 1e-12, 1 - 1e-12)
        return -(sure * np.log(chance) + (1 - sure) * np.log(1 - chance)).mean()

    temperature = min(np.geomspace(0.05, 20, 60).tolist(), key=loss)
    chosen = softmax(scores / temperature)
    right = chosen.max(axis=1)[chosen.argmax(axis=1) == truth]
    least = float(np.quantile(right, REFUSED)) if len(right) else 0.0
    return Model(labels, logits, temperature, least)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Train on the bounded sample. Only subword counts of the sampled texts reach the driver."""
    usable = docs.where(F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())
    usable = usable.where(~held_out(F.col(doc_id)))
    ranked = usable.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_label"))
    ranked = ranked.withColumn("_part", F.pmod(F.hash("_id"), F.lit(_PARTS)))
    # a label may hold a large part of all rows, so it is thinned in parts first
    for keys in (["_label", "_part"], ["_label"]):
        draw = Window.partitionBy(*keys).orderBy(F.xxhash64("_id"), "_id")
        ranked = ranked.withColumn("_rank", F.row_number().over(draw)).where(F.col("_rank") <= PER_LABEL)
    # at most PER_LABEL ids for each label, so texts can stay where they are
    picked = F.broadcast(ranked.select("_id").distinct())
    rows = usable.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_label"), F.col(text).alias("_text"))
    rows = rows.join(picked, "_id", "left_semi")
    # many rows may share an id; each task lets through no more than the bound of each label
    draw = Window.partitionBy("_label").orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text"))
    rows = rows.withColumn("_rank", F.row_number().over(draw)).where(F.col("_rank") <= PER_LABEL)

    def make(texts: list) -> list:
        pairs = [np.unique(subwords(t), return_counts=True) if has_letter(t) else ([], []) for t in texts]
        return [[np.asarray(a, "<i4").tobytes() for a, _ in pairs], [np.asarray(b, "<i4").tobytes() for _, b in pairs]]

    fields = [T.StructField("_rows", T.BinaryType()), T.StructField("_counts", T.BinaryType())]
    sample = with_arrow(rows, ["_text"], make, fields).select("_id", "_label", "_rows", "_counts").collect()
    sample.sort(key=lambda r: (r["_id"], r["_label"], bytes(r["_rows"])))
    read = [(r["_label"], np.frombuffer(r["_rows"], "<i4"), np.frombuffer(r["_counts"], "<i4")) for r in sample]
    return train([s for s in read if len(s[1])])


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``accepted``; columns of these names are replaced."""
    # rows of logits: a fixed number of buckets times the number of labels
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model) if model else None)

    def one(value: str | None) -> tuple[str, float, bool]:
        if shared.value is None or not has_letter(value):
            return UNKNOWN, 0.0, False
        labels, logits, temperature, least = shared.value
        chance = softmax(logits_of(value, logits) / temperature)
        best = int(chance.argmax())
        return labels[best], float(chance[best]), bool(chance[best] >= least)

    return with_arrow(docs, [text], lambda texts: list(zip(*map(one, texts))) or [[], [], []], FIELDS)
