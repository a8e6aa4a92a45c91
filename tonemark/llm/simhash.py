"""SimHash near-duplicates by meeting in the middle.

Two fingerprints that differ in at most four bits have a value between them that is at most two bits
from each, and two fingerprints that share such a value differ in at most four bits. So every distinct
fingerprint gives out all values within two bits of it, equal values meet, and each of them links the
fingerprints it came from to the smallest one among them: complete without a list of pairs.

A fingerprint has 2,081 such values. The shuffle does not carry them one by one: rows go out for the
values' low bits only, 1 + b + b(b-1)/2 of them for b bits, and the task that holds a pattern of low
bits makes the high bits of its own values, so each value is made once, where it meets its equals.

A null text counts as empty. A text without words has fingerprint zero, which is linked like any
other. Rows with one id are told apart by nothing but their text: the component's id is the smallest
id in it, null only where all are null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemark.llm.shared import components, cut, sorted_groups, with_arrow

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
_HALF = RADIUS // 2
_BITS = 64
#: Fingerprints that a pattern of low bits should have, and values made at once inside a task.
_PER_PATTERN = 2_000
_AT_ONCE = 1 << 21

FINGERPRINT = T.StructField("simhash", T.LongType())


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the text's word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE_WORDS:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
        starts = [0, *[e + 1 for e in ends[:-SHINGLE_WORDS]]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE_WORDS - 1 :])]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    major = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(major, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``simhash``; a column of that name is replaced."""
    return with_arrow(docs, [text], lambda texts: [[fingerprint(t) for t in texts]], [FINGERPRINT])


def _masks(width: int, distance: int) -> np.ndarray:
    """All values of ``width`` bits with exactly ``distance`` bits set."""
    made = [sum(1 << i for i in bits) for bits in combinations(range(width), distance)]
    return np.array(made, np.uint64)


def _meet(rest: np.ndarray, budget: np.ndarray, ids: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Links (id, smallest id) among rows that share a value within their budgets of bits.

    ``rest`` holds the bits that are still open, ``width`` of them. Too large a set is split by its
    next bits, which keeps each value in one part.
    """
    masks = [_masks(width, d) for d in range(_HALF + 1)] if width <= _BITS else []
    sizes = np.cumsum([len(m) for m in masks])
    if width > 8 and sizes[budget].sum() > _AT_ONCE:
        step = np.uint64(6)
        low, high = rest & np.uint64(63), rest >> step
        ones = np.array([bin(v).count("1") for v in range(64)])
        for value in range(64):
            left = budget - ones[(low ^ np.uint64(value)).astype(np.intp)]
            near = left >= 0
            if near.any():
                yield from _meet(high[near], left[near], ids[near], width - 6)
        return
    values, owners = [], []
    for d, mask in enumerate(masks):
        able = np.flatnonzero(budget >= d)
        values.append((rest[able, None] ^ mask[None, :]).ravel())
        owners.append(np.repeat(able, len(mask)))
    value, owner = np.concatenate(values), ids[np.concatenate(owners)]
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(owner, starts)[np.cumsum(new) - 1]
    linked = owner != least
    if linked.any():
        yield np.unique(np.stack([owner[linked], least[linked]], axis=1), axis=0)


def _expand(low_bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(frames, "pattern"):
            if len(group) < 2:
                continue
            ids = group["simhash"].to_numpy()
            rest = ids.view(np.uint64) >> np.uint64(low_bits)
            budget = group["budget"].to_numpy().astype(np.intp)
            for links in _meet(rest, budget, ids, _BITS - low_bits):
                yield pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    return run


def links(prints: DataFrame, count: int) -> DataFrame:
    """Links ``(a, b)`` that join all fingerprints within four bits; ``prints`` has each once.

    ``count`` sets only how finely the work is dealt out.
    """
    low_bits = 8
    while low_bits < 28 and count * (1 + low_bits * (low_bits + 1) // 2) >> low_bits > _PER_PATTERN:
        low_bits += 1
    masks = [(int(m), _HALF - d) for d in range(_HALF + 1) for m in _masks(low_bits, d)]
    kind = "array<struct<mask:bigint,budget:int>>"
    moves = F.from_json(F.lit(str([{"mask": m, "budget": b} for m, b in masks]).replace("'", '"')), kind)
    rows = prints.select("simhash", F.explode(moves).alias("_m")).select(
        "simhash",
        F.col("simhash").bitwiseAND(F.lit((1 << low_bits) - 1)).bitwiseXOR(F.col("_m.mask")).alias("pattern"),
        F.col("_m.budget").alias("budget"),
    )
    dealt = rows.repartition("pattern").sortWithinPartitions("pattern")
    return dealt.mapInPandas(_expand(low_bits), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """One row per document: id, ``carry`` columns, ``simhash``, ``component_id`` and ``component_root``,
    the smallest fingerprint of the component, which tells components apart whatever their ids are."""
    marked = with_fingerprint(docs.select(doc_id, *carry, text), text).select(doc_id, *carry, "simhash")
    marked = cut(marked, "fingerprints")
    prints = cut(marked.groupBy("simhash").agg(F.min(doc_id).alias("_first")), "prints")
    roots = components(links(prints.select("simhash"), prints.count()))
    named = prints.join(roots, prints["simhash"] == roots["node"], "left").select(
        "simhash", "_first", F.coalesce("root", "simhash").alias("_root")
    )
    named = cut(named, "named")
    ids = named.groupBy("_root").agg(F.min("_first").alias("component_id"))
    labels = named.join(ids, "_root").select("simhash", "component_id", F.col("_root").alias("component_root"))
    return marked.join(labels, "simhash").select(doc_id, *carry, "simhash", "component_id", "component_root")
