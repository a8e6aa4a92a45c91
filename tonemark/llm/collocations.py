"""Collocations: frequent phrases of two to five words, counted by vertically partitioned suffix trees.

The scheme follows ERA (Mansour et al., 2011), with words for letters and suffixes cut off at five
words, at the end of a piece, and before what is too rare for any phrase:

1. Words are counted, then pairs of frequent words, then triples of frequent pairs. No phrase holds a
   rare one, so suffixes end before it. The tasks know the frequent ones by bitmaps of fixed size,
   whose false hits only cost work.
2. Every task counts the suffixes it sees and writes each once.
3. Vertical partitioning: prefixes of what was written are counted in hashed cells, of three words, of
   four and of five. A cell with more suffixes than the budget is cut up by the next longer prefixes.
   Cells within the budget are packed into groups.
4. A group's suffixes arrive sorted, so its tree is walked depth first with one path in memory; the
   total of a leaf is its count, that of a node the sum over its leaves. Nodes above the prefix of a
   group are partial and are added up across groups.

Scores are exact: products are decimals of 38 digits. A null text is empty, a null language is
``und`` and one group with texts of that language. Repeated rows and ids count as often as they
occur. Without phrases there are no rows. Words may hold any other character; two of them are
recoded on the way, see ``_CODE``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonemark.llm.shared import cut

LONGEST = 5
#: Words of the prefixes that vertical partitioning starts from; shorter phrases are counted whole.
SHORTEST = 3
LEAST = 100
TOP = 2000
UNKNOWN = "und"
#: Most suffixes of a group, and how many groups there are at least for each shuffle partition.
BUDGET = 4_000_000
GROUPS_EACH = 4
#: Bits of the bitmaps of frequent words, pairs and triples (4 MB each), and most cells of each prefix length (16 MB).
BITS = 1 << 25
MOST_CELLS = 1 << 22
#: Distinct words, and places of a text, that a task holds before it sends them off.
_HELD = 250_000
_PLACES = 2_000_000
_CHUNK = 1 << 20
_BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Breaks become '.', which no word holds. So do '!' and NUL get free, and NUL, the smallest byte,
#: then parts words in a suffix: byte order is order by words. A NUL inside a word is written '!'.
_CODE = bytes(
    ord(".") if c in _BREAKS else ord("!") if c == 0 else ord(" ") if c == 9 else c + 32 if 65 <= c <= 90 else c
    for c in range(256)
)
_SEP = b"\x00"


class Parts(NamedTuple):
    """The vertical partition: the group of each cell for prefixes of three words, four and so on; -1
    where it is cut up."""

    groups: list[np.ndarray]
    n_groups: int


def tokens(text: str | None) -> Iterator[tuple[list[bytes], bool]]:
    """Words and breaks of a text, a chunk at a time, each with whether it is the last."""
    data = (text or "").encode().translate(_CODE)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + _CHUNK)
        end = end if end >= 0 else len(data)
        yield data[start:end].replace(b".", b" . ").split(), end == len(data)
        start = end


def _seed(lang: str) -> int:
    return zlib.crc32(lang.encode() + _SEP)


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, phrase, f) of all words of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, count in held.items() for w, n in count.items() if w != b"."]
            held.clear()
            return _batch(rows, ["lang", "phrase", "f"], [pa.string(), pa.string(), pa.int64()])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count = held.setdefault(lang, Counter())
                for words, _ in tokens(text):
                    count.update(words)
                if sum(map(len, held.values())) > _HELD:
                    yield out()
        yield out()

    return docs.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _bits(sums: list[np.ndarray]) -> np.ndarray:
    """Bits of words, pairs or triples from the checksums of their words."""
    mixed = sums[0].astype(np.uint64)
    for value in sums[1:]:
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + value.astype(np.uint64)
    return mixed % np.uint64(BITS) if len(sums) == 1 else (mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS.bit_length() + 1)


def frequent_bitmap(frequent: DataFrame) -> np.ndarray:
    """Bytes with the set bits of phrases of one length; blocks of 4 KB reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2)))
            sums = [[zlib.crc32(w, _seed(lang)) for w in phrase.encode().split(_SEP)] for lang, phrase in rows]
            bits = _bits([np.array(column, np.uint64) for column in zip(*sums)]) if sums else []
            # the functions below number bits and blocks from 1
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(bits, np.int64) + 1)], names=["bit"])

    bits = frequent.select("lang", "phrase").mapInArrow(run, "bit long")
    blocks = bits.groupBy(F.bitmap_bucket_number("bit").alias("block"))
    whole = bytearray(BITS // 8)
    for row in blocks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect():
        at = (row["block"] - 1) * len(row["bits"])
        whole[at : at + len(row["bits"])] = row["bits"]
    return np.frombuffer(bytes(whole), np.uint8)


def _is_set(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bitmap[(bits >> np.uint64(3)).astype(np.int64)] >> (bits & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class _Words(dict):
    """Numbers of a language's frequent words in this task; breaks and rare words are 0."""

    def __init__(self, lang: str, bitmap: np.ndarray) -> None:
        self.lang, self.seed, self.bitmap = lang, _seed(lang), bitmap
        self.empty()

    def empty(self) -> None:
        self.clear()
        self[b"."] = 0
        self.names, self.sums = [b""], np.zeros(1 << 10, np.uint64)

    def __missing__(self, word: bytes) -> int:
        checksum = zlib.crc32(word, self.seed)
        bit = checksum % BITS
        number = 0
        if self.bitmap[bit >> 3] >> (bit & 7) & 1:
            number = len(self.names)
            self.names.append(word)
            if number == len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            self.sums[number] = checksum
        self[word] = number
        return number


def _scan(docs: DataFrame, shared, schema: str, places: Callable, sink: Callable) -> DataFrame:
    """``places`` turns the word numbers of a text into rows of numbers, for the starts before
    ``stop``; ``sink`` makes batches of all rows a task holds of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Words] = {}
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, rows in held.items():
                if rows:
                    yield from sink(known[lang], np.concatenate(rows), shared.value)
                rows.clear()
                if len(known[lang]) > 2 * _HELD:
                    known[lang].empty()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in known:
                    known[lang], held[lang] = _Words(lang, shared.value[0][0]), []
                carried = np.zeros(0, np.int32)
                for words, last in tokens(text):
                    new = np.fromiter(map(known[lang].__getitem__, words), np.int32, len(words))
                    numbers = np.concatenate([carried, new])
                    stop = len(numbers) if last else max(0, len(numbers) - LONGEST + 1)
                    rows = places(known[lang], numbers, stop, shared.value)
                    if len(rows):
                        held[lang].append(rows)
                        size += len(rows)
                    carried = numbers[stop:]
                # texts are short on the whole, so a dictionary is looked at between them
                if size > _PLACES or max(map(len, known.values())) > 4 * _HELD:
                    yield from out()
                    size = 0
        yield from out()

    return docs.mapInArrow(run, schema)


def _candidates(words: _Words, numbers: np.ndarray, bitmaps: Sequence[np.ndarray]) -> np.ndarray:
    """Where phrases one word longer than the last bitmap's start, all of whose parts are frequent."""
    found, sums = numbers > 0, words.sums[numbers]
    for size, bitmap in enumerate(bitmaps[1:], 2):
        found = found[:-1] & found[1:]
        at = np.flatnonzero(found)
        found[at] = _is_set(bitmap, _bits([sums[at + k] for k in range(size)]))
    return found[:-1] & found[1:]


def _grams(words: _Words, numbers: np.ndarray, stop: int, shared: tuple) -> np.ndarray:
    """Rows of the numbers of each candidate."""
    size = len(shared[0]) + 1
    if len(numbers) < size:
        return np.zeros((0, size), np.int32)
    starts = np.flatnonzero(_candidates(words, numbers, shared[0])[:stop])
    return numbers[starts[:, None] + np.arange(size)]


def _suffixes(words: _Words, numbers: np.ndarray, stop: int, shared: tuple) -> np.ndarray:
    """Rows of the five numbers of each suffix of three words or more, 0 where it is cut off."""
    if len(numbers) < SHORTEST:
        return np.zeros((0, LONGEST), np.int32)
    found, sums = _candidates(words, numbers, shared[0][:-1]), words.sums[numbers]
    at = np.flatnonzero(found)
    found[at] = _is_set(shared[0][-1], _bits([sums[at + k] for k in range(SHORTEST)]))
    starts = np.flatnonzero(found[:stop])
    rows = np.zeros((len(starts), LONGEST), np.int32)
    rows[:, :SHORTEST] = numbers[starts[:, None] + np.arange(SHORTEST)]
    going, padded = np.ones(len(starts), bool), np.concatenate([found, np.zeros(LONGEST, bool)])
    for k in range(SHORTEST, LONGEST):
        going &= padded[starts + k - SHORTEST + 1]
        rows[going, k] = numbers[starts[going] + k]
    return rows


def _packed(rows: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of the distinct rows, and their counts. Rows go into one number where they fit, else two
    numbers at a time become one; either way equal rows are told exactly."""
    size = rows.shape[1]
    bits = 63 // size
    if int(rows.max(initial=0)) < 1 << bits:
        code = rows[:, 0].astype(np.int64)
        for k in range(1, size):
            code = code << bits | rows[:, k]
        code, counts = np.unique(code, return_counts=True)
        return [code >> bits * (size - 1 - k) & ((1 << bits) - 1) for k in range(size)], counts
    code = rows[:, 0].astype(np.int64)
    for k in range(1, size):
        code = np.unique(code << 32 | rows[:, k], return_inverse=True)[1]
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    return list(rows[first].T), counts


def _send(words: _Words, rows: np.ndarray, shared: tuple) -> Iterator[pa.RecordBatch]:
    """Each distinct row as a phrase, with its count."""
    columns, counts = _packed(rows)
    name = words.names.__getitem__
    for start in range(0, len(counts), 1 << 16):
        part = slice(start, start + (1 << 16))
        phrases = map(_SEP.join, zip(*[map(name, c[part].tolist()) for c in columns]))
        if rows.shape[1] == LONGEST:
            # numbers of 0 stand at the end, and the word 0 is empty
            phrases = (p.rstrip(_SEP) for p in phrases)
        made = pa.array(list(phrases), pa.string())
        langs = pa.array([words.lang] * len(made), pa.string())
        yield pa.RecordBatch.from_arrays([langs, made, pa.array(counts[part])], names=["lang", "phrase", "f"])


def _partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def vertical_partition(suffixes: DataFrame) -> Parts:
    """Count cells and pack them; only tables of cells reach the driver."""
    total = suffixes.agg(F.sum("f")).first()[0] or 0
    budget = max(1, min(BUDGET, total // (GROUPS_EACH * _partitions(suffixes.sparkSession))))
    cells = 1 << 12
    while cells < min(MOST_CELLS, 16 * total // budget):
        cells *= 2
    length = F.size(F.split("phrase", "\\x00"))

    def counted(depth: int) -> DataFrame:
        prefix = F.substring_index("phrase", "\x00", depth).cast("binary")
        key = F.concat(F.col("lang").cast("binary"), F.lit(bytearray(_SEP)), prefix)
        cell = (F.crc32(key) % cells).cast("int").alias("cell")
        rows = suffixes.where(length >= depth).groupBy(F.lit(depth - SHORTEST).alias("at"), cell)
        return rows.agg(F.sum("f").alias("n"))

    found = reduce(DataFrame.unionAll, map(counted, range(SHORTEST, LONGEST + 1))).toArrow()
    counts = np.zeros((LONGEST - SHORTEST + 1, cells), np.int64)
    counts[found.column("at").to_numpy(), found.column("cell").to_numpy()] = found.column("n").to_numpy()
    # the longest prefix is never cut up: a task writes a suffix once, whatever its count
    sizes = counts.ravel()
    placed = (sizes <= budget) | (np.arange(sizes.size) >= (LONGEST - SHORTEST) * cells)
    order = np.argsort(-np.where(placed, sizes, -1), kind="stable")
    load = np.cumsum(np.where(placed, np.minimum(sizes, budget), 0)[order])
    groups = np.empty(sizes.size, np.int32)
    groups[order] = np.maximum(load - 1, 0) // budget
    groups[~placed] = -1
    return Parts(list(groups.reshape(LONGEST - SHORTEST + 1, cells)), int(groups.max()) + 1)


def _prefix_ends(suffix: bytes) -> list[int]:
    """Where the prefixes of three words, four words and so on end."""
    ends, at = [], suffix.find(_SEP, suffix.find(_SEP) + 1)
    while at >= 0:
        at = suffix.find(_SEP, at + 1)
        ends.append(at if at >= 0 else len(suffix))
    return ends


def with_group(suffixes: DataFrame, parts: Parts) -> DataFrame:
    """Rows (group, depth, lang, suffix, n): the group of each suffix's prefix, and its length."""
    # bounded by MOST_CELLS
    shared = suffixes.sparkSession.sparkContext.broadcast(tuple(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, n_groups = shared.value
        cells = len(groups[0])
        for batch in batches:
            lang, phrase, n = (batch.column(batch.schema.get_field_index(c)) for c in ("lang", "phrase", "f"))
            made = []
            for of, suffix in zip(lang.to_pylist(), phrase.to_pylist()):
                seed, data = _seed(of), suffix.encode()
                # a suffix shorter than its prefix would be is a leaf of its own
                group, depth = zlib.crc32(data, seed) % n_groups, LONGEST + 1
                for at, end in enumerate(_prefix_ends(data)):
                    placed = int(groups[at][zlib.crc32(data[:end], seed) % cells])
                    if placed >= 0:
                        group, depth = placed, SHORTEST + at
                        break
                made.append((group, depth))
            columns = [pa.array(c, pa.int32()) for c in (zip(*made) if made else ([], []))]
            yield pa.RecordBatch.from_arrays([*columns, lang, phrase, n], names=["group", "depth", "lang", "suffix", "n"])

    return suffixes.mapInArrow(run, "group int, depth int, lang string, suffix string, n long")


def tree_nodes(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Walk the trees of sorted suffixes: rows (lang, phrase, f) of nodes of three words or more that
    are frequent, or may be together with other groups."""
    key: tuple | None = None
    path: list[str] = []
    totals = [0] * (LONGEST + 1)
    partial = 0
    rows: list[tuple] = []

    def close(depth: int) -> None:
        for d in range(len(path), depth, -1):
            n = totals[d]
            if d >= SHORTEST and (n >= least or d < partial):
                rows.append((key[1], "\x00".join(path[:d]), n))
            totals[d - 1] += n
            totals[d] = 0

    for batch in batches:
        for group, depth, lang, suffix, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
            words = suffix.split("\x00")
            if (group, lang) != key:
                close(0)
                key, common = (group, lang), 0
            else:
                common, shorter = 0, min(len(words), len(path))
                while common < shorter and words[common] == path[common]:
                    common += 1
                close(common)
            path, partial = words, depth
            totals[len(words)] += n
        if len(rows) > 10_000:
            yield _batch(rows, ["lang", "phrase", "f"], [pa.string(), pa.string(), pa.int64()])
            rows.clear()
    close(0)
    yield _batch(rows, ["lang", "phrase", "f"], [pa.string(), pa.string(), pa.int64()])


def phrase_counts(docs: DataFrame, frequent: DataFrame, least: int) -> DataFrame:
    """Rows (lang, phrase, f) of all phrases of two to five words with ``least`` occurrences."""
    spark, schema = docs.sparkSession, "lang string, phrase string, f long"
    bitmaps, counted = [frequent_bitmap(frequent)], []
    for size in range(2, SHORTEST + 1):
        shared = spark.sparkContext.broadcast((bitmaps,))  # fixed size, see BITS
        found = _scan(docs, shared, schema, _grams, _send).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        counted.append(cut(found.where(F.col("f") >= least), f"phrases_{size}"))
        bitmaps = [*bitmaps, frequent_bitmap(counted[-1])]
    counted.pop()
    suffixes = cut(_scan(docs, spark.sparkContext.broadcast((bitmaps,)), schema, _suffixes, _send), "suffixes")
    grouped = with_group(suffixes, vertical_partition(suffixes))
    trees = grouped.repartition(_partitions(spark), "group").sortWithinPartitions("group", "lang", "suffix")
    nodes = trees.mapInArrow(lambda batches: tree_nodes(batches, least), "lang string, phrase string, f long")
    longer = nodes.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return reduce(DataFrame.unionByName, counted, longer)


def scored(phrases: DataFrame, counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """The lowest-scoring cut of each phrase: (lang, phrase, a, n, l, r, score). ``counts`` has the
    frequent words and phrases, which hold all parts of a frequent phrase."""
    split = F.split("phrase", "\\x00")

    def piece(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("_w", start, length), "\x00")

    cuts = F.transform(
        F.sequence(F.lit(1), F.size("_w") - 1),
        lambda k: F.struct(k.alias("k"), piece(F.lit(1), k).alias("_left"), piece(k + 1, F.size("_w") - k).alias("_right")),
    )
    rows = phrases.withColumn("_w", split).select("lang", "phrase", F.col("f").alias("a"), F.inline(cuts))
    for side, name in (("_left", "l"), ("_right", "r")):
        rows = rows.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    rows = rows.join(sizes, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    rows = rows.select("*", (wide["a"] * 1000 * wide["n"]).cast("decimal(38,0)").alias("_over"), (wide["l"] * wide["r"]).alias("_under"))
    rows = rows.withColumn("score", F.expr("_over div _under").cast("long"))
    best = rows.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
    return best.select("lang", "phrase", "a", "n", "_cut.l", "_cut.r", "_cut.score")


def without_parts(phrases: DataFrame) -> DataFrame:
    """Phrases that no longer one explains. A longer phrase is at most as frequent as what it holds,
    so the one that explains is as frequent; so is every phrase in between, and one word more does."""
    words = F.split("phrase", "\\x00")
    longer = phrases.withColumn("_w", words).where(F.size("_w") > 2)
    inner = [F.array_join(F.slice("_w", i, F.size("_w") - 1), "\x00") for i in (1, 2)]
    held = longer.select("lang", F.explode(F.array(*inner)).alias("phrase"), "f").distinct()
    return phrases.join(held, ["lang", "phrase", "f"], "left_anti")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    words = cut(word_counts(rows), "words")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    phrases = cut(phrase_counts(rows, frequent, least), "phrases")
    kept = scored(without_parts(phrases), frequent.unionByName(phrases), sizes)
    plain = F.replace(F.replace("phrase", F.lit("\x00"), F.lit(" ")), F.lit("!"), F.lit("\x00"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase"))
    named = kept.withColumn("phrase", plain).withColumn("rank", F.row_number().over(order).cast("long"))
    return named.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
