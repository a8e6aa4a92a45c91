"""Removal of long repeated byte strings by prefix-free parsing.

A rolling hash over sixteen bytes sets triggers, and triggers part each text into phrases. Where a
text repeats, its triggers and phrases repeat, so the parse is compared first and bytes only where
it leaves a question:

1. The head of each phrase is counted over the corpus. A window of ``LENGTH`` bytes can only repeat
   if all heads inside it do. Texts without such a window are done.
2. The suffixes of the text that start within one phrase, cut at the depth of a window, are taken
   together: as dictionary suffix plus the parse that follows. Phrases that agree with another one to
   that depth are settled, with all windows that start in them.
3. What is left is the places where repeats start, end or change partner. There each suffix is
   compared by itself, against all others of its kind and one phrase of each settled class that
   begins with the same head.

Suffixes are ordered by digests of their first ``LENGTH`` bytes, which puts equal ones side by side;
their order by letters, and beyond that depth, is never asked for. Digests have 95 bits. Occurrences
among the rows that a task gathers at once are compared there, so a digest has at most one row for each
such bunch in a shuffle; a bunch is of a fixed size, however large the task.

A null text is empty. Rows are told apart even if they have the same id, null included. Only the
removal is judged on bytes: the kept bytes may end inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemark.llm.shared import cut, with_arrow

LENGTH = 400
TRIGGER = 16
HEAD = 32
#: Mean length of a phrase.
PHRASE = 60
#: Digest rows that a task gathers before it compares them and sends them on.
GATHERED = 1 << 20
#: Starts of windows without a phrase head inside carry this mark in their place.
_BARE = 1 << 40
_MASK = (1 << 64) - 1


class _Hasher:
    """Polynomial digests of all substrings of one text, in two lanes of 64 bits."""

    def __init__(self):
        rng = np.random.default_rng(20_240_607)
        self.tables = rng.integers(1, 1 << 64, (2, 256), dtype=np.uint64)
        self.bases = [0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1]
        self.powers = [self._grown(b, 1024) for b in self.bases]
        self.inverses = [self._grown(pow(b, -1, 1 << 64), 1024) for b in self.bases]

    @staticmethod
    def _grown(base: int, n: int) -> np.ndarray:
        out, step = np.ones(1, np.uint64), base
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(step)])
            step = step * step & _MASK
        return out

    def sums(self, data: np.ndarray, lane: int) -> np.ndarray:
        n = len(data)
        if n >= len(self.powers[lane]):
            self.powers[lane] = self._grown(self.bases[lane], n + 1)
            self.inverses[lane] = self._grown(pow(self.bases[lane], -1, 1 << 64), n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.tables[lane][data] * self.powers[lane][:n], out=out[1:])
        return out

    def of(self, sums: np.ndarray, lane: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (sums[ends] - sums[starts]) * self.inverses[lane][starts]
        value ^= value >> np.uint64(32)
        return value * np.uint64(0xD6E8FEB86659FD93)


class _Text:
    """Phrase heads of one text, and digests of its substrings."""

    def __init__(self, hasher: _Hasher, data: bytes):
        self.hasher, self.data = hasher, np.frombuffer(data, np.uint8)
        self.n = len(data)
        self.lanes = {0: hasher.sums(self.data, 0)}
        self.n_windows = max(0, self.n - LENGTH + 1)
        at = np.arange(max(0, self.n - HEAD + 1))
        rolling = hasher.of(self.lanes[0], 0, at, at + TRIGGER)
        self.heads = np.flatnonzero((rolling >> np.uint64(40)) % np.uint64(PHRASE) == 0)

    def head_digests(self) -> np.ndarray:
        return self.hasher.of(self.lanes[0], 0, self.heads, self.heads + HEAD)

    def digests(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if 1 not in self.lanes:
            self.lanes[1] = self.hasher.sums(self.data, 1)
        second = self.hasher.of(self.lanes[1], 1, starts, ends) >> np.uint64(33)
        return self.hasher.of(self.lanes[0], 0, starts, ends), second.astype(np.int64)

    def _inside(self, places: np.ndarray) -> np.ndarray:
        """Number of these heads inside each window."""
        upto = np.zeros(self.n + 2, np.int32)
        upto[places + 1] = 1
        np.cumsum(upto, out=upto)
        reach = LENGTH - HEAD + 1
        return upto[reach : reach + self.n_windows] - upto[: self.n_windows]

    def bare(self) -> np.ndarray:
        """Starts of windows without a head."""
        gaps = np.diff(np.concatenate([[-1], self.heads, [self.n]]))
        if gaps.max() <= LENGTH - HEAD + 1:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self._inside(self.heads) == 0)

    def bare_classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Bare windows by content: starts, the class of each, whether a class comes twice in this
        text, and the place of each class's first member among the starts, with all digests.

        Periodic texts have many bare windows and few classes, so only the first of each is sent on.
        """
        starts = self.bare()
        h1, h2 = self.digests(starts, starts + LENGTH)
        # inside one text 64 bits tell windows apart
        _, first, kind, n = np.unique(h1, return_index=True, return_inverse=True, return_counts=True)
        return starts, kind, n > 1, (first, h1, h2)

    def spread_bare(self, marked: np.ndarray) -> np.ndarray:
        """All bare starts whose window is that of a marked start, or comes twice in this text."""
        starts, kind, again, (first, _, _) = self.bare_classes()
        return starts[(again | np.isin(starts[first], marked))[kind]] if len(starts) else starts

    def possible(self, repeated: np.ndarray, bare: np.ndarray) -> np.ndarray:
        """Which windows have repeated heads only, or have none and were seen twice."""
        out = self._inside(np.setdiff1d(self.heads, repeated)) == 0
        none = self._inside(self.heads) == 0
        out &= ~none
        out[bare] = True
        return out

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last window start that have each head as their first one; may be empty."""
        before = np.concatenate([[-1], self.heads[:-1]]) if len(self.heads) else self.heads
        first = np.maximum(before + 1, self.heads - (LENGTH - HEAD))
        return first, np.minimum(self.heads, self.n_windows - 1)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


#: Second part of keys that stand for no digest: later rows of one bunch, and phrases never settled.
_LATER, _ALONE = -1, -2
_ROWS = "h1 long, h2 int, owner long, place long, head long, known boolean"


def _paired(
    h1: np.ndarray, h2: np.ndarray, owner: np.ndarray, place: np.ndarray, head: np.ndarray, null_owner: np.ndarray,
    known: np.ndarray,
) -> Iterator[pa.RecordBatch]:
    """Rows of one bunch. Digests met more than once here are known to repeat: their later rows get a
    key of their own, and the first stands for all of them against other bunches."""
    if not len(h1):
        return
    order = np.lexsort((place, owner, h2, h1))
    h1, h2, owner, place, head, null_owner, known = (
        x[order] for x in (h1, h2, owner, place, head, null_owner, known)
    )
    same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    later = np.concatenate([[False], same])
    known = known | later | np.concatenate([same, [False]])
    salt = owner.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ place.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h1, second = np.where(later, salt, h1), np.where(later, _LATER, h2).astype(np.int32)
    for a in range(0, len(h1), 1 << 16):
        b = slice(a, a + (1 << 16))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(_signed(h1[b])), pa.array(second[b]), pa.array(owner[b], mask=null_owner[b]),
                pa.array(place[b]), pa.array(head[b]), pa.array(known[b]),
            ],
            names=["h1", "h2", "owner", "place", "head", "known"],
        )


class _Rows:
    """Digest rows that a task gathers from its texts, a bunch at a time."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.n = 0

    def add(
        self, owner: int | None, h1: np.ndarray, h2: np.ndarray, place: np.ndarray,
        head: np.ndarray | None = None, known: np.ndarray | None = None,
    ) -> None:
        if len(h1):
            n = len(h1)
            self.n += n
            self.parts.append(
                (h1, h2, np.full(n, owner or 0, np.int64), place.astype(np.int64),
                 np.zeros(n, np.int64) if head is None else _signed(head), np.full(n, owner is None),
                 np.zeros(n, bool) if known is None else known)
            )

    def add_bare(self, owner: int | None, text: _Text, mark: int) -> None:
        starts, _, again, (first, h1, h2) = text.bare_classes()
        if len(starts):
            self.add(owner, h1[first], h2[first], starts[first] + mark, known=again)

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        """The rows gathered so far, if they are so many."""
        if self.n >= least:
            made = [np.concatenate(x) for x in zip(*self.parts)]
            self.parts, self.n = [], 0
            yield from _paired(*made)


def _bytes(column: pa.Array) -> list:
    return column.cast(pa.binary()).to_pylist()


def _places(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", "<i8")


def _head_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, rows = _Hasher(), _Rows()
    for batch in batches:
        for owner, data in zip(batch.column(0).to_pylist(), _bytes(batch.column(1))):
            if data and len(data) >= LENGTH:
                text = _Text(hasher, data)
                rows.add(owner, text.head_digests(), np.zeros(len(text.heads), np.int64), text.heads)
                rows.add_bare(owner, text, _BARE)
                yield from rows.batches(GATHERED)
    yield from rows.batches()


def _phrase_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of all windows of a phrase together; phrases with impossible windows stand alone."""
    hasher, rows = _Hasher(), _Rows()
    for batch in batches:
        for owner, packed, possible in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            text = _Text(hasher, zstandard.decompress(packed))
            open_ = np.unpackbits(np.frombuffer(possible, np.uint8), count=text.n_windows)
            first, last = text.phrases()
            upto = np.concatenate([[0], np.cumsum(open_, dtype=np.int64)])
            some = np.flatnonzero(first <= last)
            n_open = upto[last[some] + 1] - upto[first[some]]
            some, n_open = some[n_open > 0], n_open[n_open > 0]
            whole = n_open == last[some] - first[some] + 1
            h1, h2 = text.digests(first[some], last[some] + LENGTH)
            own = np.full(len(some), owner, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + some.astype(np.uint64)
            h1 = np.where(whole, h1, own)
            h2 = np.where(whole, h2, _ALONE)
            rows.add(owner, h1, h2, some, text.head_digests()[some])
            yield from rows.batches(GATHERED)
    yield from rows.batches()


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, rows = _Hasher(), _Rows()
    for batch in batches:
        for owner, packed, possible, phrases in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            text = _Text(hasher, zstandard.decompress(packed))
            open_ = np.unpackbits(np.frombuffer(possible, np.uint8), count=text.n_windows).astype(bool)
            wanted = np.zeros(text.n_windows, bool)
            first, last = text.phrases()
            for k in phrases or []:
                wanted[first[k] : last[k] + 1] = True
            starts = np.flatnonzero(wanted & open_)
            rows.add(owner, *text.digests(starts, starts + LENGTH), starts)
            rows.add_bare(owner, text, 0)
            yield from rows.batches(GATHERED)
    yield from rows.batches()


def _found(rows: DataFrame) -> DataFrame:
    """Rows with ``repeated``; a digest has at most one row of each bunch."""
    n = F.count(F.lit(1)).over(Window.partitionBy("h1", "h2"))
    return rows.withColumn("repeated", F.col("known") | ((n > 1) & (F.col("h2") != _ALONE)))


def _result(text: bytes, removed: np.ndarray) -> tuple[int, int, int, str, list[dict[str, int]]]:
    edges = np.diff(np.concatenate([[0], removed.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()
    spans = [{"start": i, "end": j} for i, j in zip(starts, ends)]
    kept = np.frombuffer(text, np.uint8)[~removed].tobytes()
    return len(text), int(removed.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans


_OUT = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end")]))),
]


def _sift(texts: list, places: list) -> list:
    """Texts with a window that may repeat keep their bytes and a bit per window; others are done."""
    hasher = _Hasher()
    packed, bits, done = [], [], []
    for data, flags in zip(texts, places):
        raw = zstandard.decompress(data)
        mask = None
        if flags:
            flags = np.array(flags, np.int64)
            text = _Text(hasher, raw)
            bare = text.spread_bare(flags[flags >= _BARE] - _BARE)
            possible = text.possible(np.unique(flags[flags < _BARE]), bare)
            mask = possible if possible.any() else None
        packed.append(None if mask is None else data)
        bits.append(None if mask is None else np.packbits(mask).tobytes())
        done.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest() if mask is None else None, None if bits[-1] else []))
    return [packed, bits, *zip(*done)]


def _finish(packed: list, phrases: list, windows: list) -> list:
    hasher, out = _Hasher(), []
    for data, settled, starts in zip(packed, phrases, windows):
        raw = zstandard.decompress(data)
        text = _Text(hasher, raw)
        covered = np.zeros(text.n + 1, np.int64)
        first, last = text.phrases()
        settled, starts = np.array(settled or [], np.int64), np.array(starts or [], np.int64)
        starts = np.union1d(starts, text.spread_bare(starts)).astype(np.int64)
        np.add.at(covered, np.concatenate([first[settled], starts]), 1)
        np.add.at(covered, np.concatenate([last[settled], starts]) + LENGTH, -1)
        out.append(_result(raw, np.cumsum(covered)[:-1] > 0))
    return list(zip(*out))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans`` (the
    removed bytes, end exclusive) and ``has_repeats``."""
    # rows with equal id and text share a key, so places of a repeated or null id never meet in one list
    docs = docs.select(F.xxhash64(doc_id, text).alias("owner"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    heads = _found(docs.select("owner", "text").mapInArrow(_head_rows, _ROWS)).where("repeated")
    flags = heads.groupBy("owner").agg(F.collect_set("place").alias("places"))

    binary = [T.StructField("packed", T.BinaryType())]
    pack = with_arrow(
        docs, ["text"], lambda texts: [[zstandard.compress((t or "").encode()) for t in texts]], binary
    ).select("owner", "id", "packed")
    sifted = with_arrow(
        pack.join(flags, "owner", "left").drop("owner"), ["packed", "places"], _sift, [*binary, T.StructField("possible", T.BinaryType()), *_OUT]
    )
    # rows get a number of their own when they are stored, so equal ids stay apart from here on
    sifted = sifted.drop("places").withColumn("row", F.monotonically_increasing_id())
    stored = cut(sifted, "sifted")
    some = stored.where(F.col("packed").isNotNull()).select("row", "packed", "possible")

    phrases = _found(some.mapInArrow(_phrase_rows, _ROWS))
    number = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("owner", "place"))
    first = (number == 1) & (F.col("h2") != _LATER)
    phrases = cut(phrases.select("owner", "place", "head", "repeated", first.alias("first")), "phrases")
    asked = phrases.where(~F.col("repeated")).select("head").distinct()
    stand_ins = phrases.where(F.col("repeated") & F.col("first"))
    stand_ins = stand_ins.join(asked, "head", "left_semi").select("owner", "place")
    open_ = phrases.where(~F.col("repeated")).select("owner", "place").unionByName(stand_ins)
    open_ = open_.groupBy("owner").agg(F.collect_list("place").alias("phrases"))
    settled = phrases.where("repeated").groupBy("owner").agg(F.collect_list("place").alias("settled"))

    wanted = some.join(open_, some["row"] == open_["owner"], "left").select("row", "packed", "possible", "phrases")
    windows = _found(wanted.mapInArrow(_window_rows, _ROWS)).where("repeated").select("owner", "place")
    windows = cut(windows.groupBy("owner").agg(F.collect_list("place").alias("windows")), "windows")

    marks = settled.join(windows, "owner", "full")
    last = some.select("row", "packed").join(marks, F.col("row") == F.col("owner"), "left")
    last = last.select("row", "packed", "settled", "windows")
    ended = with_arrow(last, ["packed", "settled", "windows"], _finish, _OUT)
    names = [f.name for f in _OUT]
    ids = stored.select("row", "id", *[F.col(c).alias(f"_{c}") for c in names])
    joined = ids.join(ended.select("row", *names), "row", "left")
    out = joined.select(F.col("id").alias(doc_id), *[F.coalesce(c, f"_{c}").alias(c) for c in names])
    return out.withColumn("has_repeats", F.col("n_removed") > 0)
