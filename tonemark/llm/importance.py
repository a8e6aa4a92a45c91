"""Resampling by importance: draw the documents that look most like a target, with random noise.

Words and pairs of words fall into hashed buckets. A bucket's gain is the logarithm of how much more
often the target has it than all documents (in thousandths, add-one smoothed); a document's weight is
the floored mean of its gains. With Gumbel noise from a digest of the id added, the highest scores
are a sample without replacement in proportion to the weights (DSIR, Xie et al., 2023).

The draw sorts nothing as a whole. Scores are stored, and exact counts at a few thresholds at a time
close in on the lowest score that is drawn; among the rows with that score the same search goes over
ids, then over digests of the text, then over places in the stored table, which only rows alike in
all of these ever need. The drawn rows are parted by range and numbered by part for their ranks.

Rows with null text have no words, weight 0, and are never drawn. A null id is digested as an empty
string and comes after all others of its score. Repeated rows are drawn one by one. Without documents,
or without a target, the smoothed counts still give every bucket a gain.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemark.llm.shared import cut, with_arrow

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Thresholds counted by one job of the search.
PIVOTS = 63
_CHUNK = 1 << 20
_CELL = np.dtype("<u2") if BUCKETS <= 1 << 16 else np.dtype("<u4")
#: Lower-case letters, digits and bytes from 0x80 on stay, upper-case letters are lowered, the rest parts words.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def buckets(text: str | None) -> tuple[int, np.ndarray]:
    """Number of words, and the buckets of all words and pairs, repeats included."""
    data = (text or "").encode().translate(_WORDS)
    n, found, last, start = 0, [], None, 0
    while start < len(data):
        end = data.find(b" ", start + _CHUNK)
        words = data[start : end if end >= 0 else len(data)].split()
        start = end if end >= 0 else len(data)
        if not words:
            continue
        n += len(words)
        single = list(map(zlib.crc32, words))
        spaced = list(map(zlib.crc32, repeat(b" "), single))
        first = [] if last is None else [zlib.crc32(words[0], last)]
        pairs = map(zlib.crc32, words[1:], spaced)
        last = spaced[-1]
        found.append((np.array([*single, *first, *pairs], np.uint32) % BUCKETS).astype(_CELL))
    return n, np.concatenate(found) if found else np.zeros(0, _CELL)


def with_buckets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``n_features`` and the packed ``features`` of each whole text."""

    def make(texts: list) -> list:
        found = [buckets(t) for t in texts]
        return [[n for n, _ in found], [len(b) for _, b in found], [b.tobytes() for _, b in found]]

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType())]
    return with_arrow(docs, [text], make, [*fields, T.StructField("features", T.BinaryType())])


def bucket_counts(featured: DataFrame) -> np.ndarray:
    """How often each bucket occurs; a row per bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total += np.bincount(np.frombuffer(packed.as_buffer(), _CELL), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    rows = featured.select("features").mapInArrow(count, "bucket long, n long")
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(BUCKETS, np.int64)
    total[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the target's share of each bucket over that of all documents."""
    s_all, t_all = float(raw.sum()), float(target.sum())
    pairs = zip(raw.tolist(), target.tolist())
    odds = [((t + 1.0) * (s_all + BUCKETS)) / ((s + 1.0) * (t_all + BUCKETS)) for s, t in pairs]
    return np.array([math.floor(1000 * math.log(o)) for o in odds], np.int64)


def with_weight(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """Add ``weight``, the floored mean gain of a row's features, in place of the features."""
    shared = featured.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def make(packed: list) -> list:
        cells = [np.frombuffer(p, _CELL) for p in packed]
        return [[int(shared.value[c].sum()) // len(c) if len(c) else 0 for c in cells]]

    weighed = with_arrow(featured, ["features"], make, [T.StructField("weight", T.LongType())])
    return weighed.drop("features")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _least_reaching(rows: DataFrame, key: str, wanted: int) -> tuple[int | None, int]:
    """The smallest value of ``key`` up to which at least ``wanted`` rows lie, and how many lie below
    it; null values come last and give None. Bisection with ``PIVOTS`` exact counts a job."""
    ends = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("n")).first()
    if ends["n"] < wanted:
        return None, ends["n"]
    low, high, below = ends["lo"], ends["hi"], 0
    while low < high:
        span = high - low
        pivots = sorted({low + span * i // (PIVOTS + 1) for i in range(1, PIVOTS + 1)} - {high} | {low})
        counts = rows.agg(*[F.count_if(F.col(key) <= F.lit(p).cast("long")) for p in pivots]).first()
        for pivot, n in zip(pivots, counts):
            if n >= wanted:
                high = pivot
                break
            low, below = pivot + 1, n
    return low, below


def cutoff(rows: DataFrame, keys: list[str], wanted: int) -> Column:
    """The condition that holds for the first ``wanted`` rows by ascending ``keys``, nulls last; the
    keys together have to tell all rows apart, and there have to be enough rows."""
    taken: Column = F.lit(False)
    tied, alike = rows, F.lit(True)
    for key in keys:
        value, below = _least_reaching(tied, key, wanted)
        before = F.lit(True) if value is None else F.coalesce(F.col(key) < F.lit(value).cast("long"), F.lit(False))
        before = F.col(key).isNotNull() if value is None else before
        taken = taken | (alike & before)
        wanted -= below
        same = F.col(key).isNull() if value is None else F.coalesce(F.col(key) == F.lit(value).cast("long"), F.lit(False))
        alike = alike & same
        tied = tied.where(same)
        if not wanted:
            return taken
        if tied.count() == wanted:
            return taken | alike
    return taken | alike


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number all rows by ``order``: parted by range, numbered inside the parts, moved by what the
    parts before hold."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the upper bits of this number are the part, the lower 33 the place in it; stored, so that both stay
    placed = cut(placed.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    starts, total = {}, 0
    for row in sizes:  # one row for each part
        starts[row["part"]] = total
        total += row["n"]
    if not starts:
        return placed.withColumn(name, F.lit(None).cast("long")).drop("_at")
    offset = F.get(F.array([F.lit(starts.get(p, 0)) for p in range(max(starts) + 1)]), part.cast("int"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, (offset + place + 1).cast("long")).drop("_at")


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Add ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``, null where not drawn.

    The text goes, all other columns stay; columns named like the new ones are replaced.
    """
    made = ["n_words", "n_features", "features", "weight", "score", "rank"]
    slim = docs.select([c for c in docs.columns if c not in made]).withColumn("_digest", F.xxhash64(text))
    featured = cut(with_buckets(slim, text).drop(text), "features")
    wanted = bucket_counts(with_buckets(target.select(text), text))
    weighed = with_weight(featured, gains(bucket_counts(featured), wanted))
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col(doc_id), seed))
    # ascending in all keys: the negated score first
    scored = scored.withColumns({"_down": -F.col("score"), "_id": F.col(doc_id).cast("long")})
    scored = cut(scored.withColumn("_place", F.monotonically_increasing_id()), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    n = percent * able.count() // 100
    keys = ["_down", "_id", "_digest", "_place"]
    drawn = (F.col("n_words") >= least_words) & cutoff(able.select(*keys), keys, n) if n else F.lit(False)
    order = [F.asc_nulls_last(k) for k in keys]
    chosen = ranked(scored.where(drawn), order)
    others = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return chosen.unionByName(others).drop(*keys)
