"""Byte-level BPE: merges by a priority queue over a doubly linked list of symbols, and back.

The pairs of a word wait in a heap by merge rank, then by place. Taking one joins two neighbours of
the list and puts the two new pairs into the heap; entries whose pair is gone by then are skipped.
Decoding puts the vocabulary's byte strings one after another.

A null text counts as empty and has no tokens. A string of a special token in a text becomes that
token. Rows keep all their columns; columns named like the results are replaced.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush
from pathlib import Path
from typing import NamedTuple

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tonemark.llm.shared import with_arrow

# Fixed value: how this family of vocabularies parts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BITS = 20
#: Words a task remembers, and the longest it does; the frequent ones come early.
CACHED_WORDS = 1 << 18
CACHED_LENGTH = 48

FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("decoded", T.StringType()),
]


class Vocabulary(NamedTuple):
    """``pieces``: bytes of each id; ``single``: id of each byte; ``merges``: pair to rank and result."""

    pieces: list[bytes]
    single: list[int]
    merges: dict[int, int]
    special: dict[str, int]


def _byte_letters() -> dict[str, int]:
    """The printable stand-in letter of each byte: itself if visible, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = {}, 256
    for byte in range(256):
        letters[chr(byte if byte in visible else spare)] = byte
        spare += byte not in visible
    return letters


def load_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file of the byte-level kind. Its size is fixed, so it travels with the tasks."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    ids, letters = data["model"]["vocab"], _byte_letters()
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    pieces = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for token, i in ids.items():
        pieces[i] = token.encode() if token in special else bytes(letters[c] for c in token)
    for token, i in special.items():
        pieces[i] = token.encode()
    single = [0] * 256
    for letter, byte in letters.items():
        single[byte] = ids[letter]
    merges = {}
    for rank, pair in enumerate(data["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.setdefault(ids[a] << _BITS | ids[b], rank << _BITS | ids[a + b])
    return Vocabulary(pieces, single, merges, special)


def merge_word(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """Apply all merges to a word's symbols, lowest rank first, leftmost first among equals."""
    n, find = len(symbols), merges.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    shift, low = n.bit_length(), (1 << _BITS) - 1
    mask = (1 << shift) - 1
    heap = []
    for i in range(n - 1):
        found = find(symbols[i] << _BITS | symbols[i + 1])
        if found is not None:
            heap.append(found >> _BITS << shift | i)
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i = entry & mask
        j = after[i]
        if j >= n or symbols[i] < 0:
            continue
        found = find(symbols[i] << _BITS | symbols[j])
        if found is None or found >> _BITS != entry >> shift:
            continue
        symbols[i], symbols[j] = found & low, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = find(symbols[i] << _BITS | symbols[k])
            if found is not None:
                heappush(heap, found >> _BITS << shift | i)
        h = before[i]
        if h >= 0:
            found = find(symbols[h] << _BITS | symbols[i])
            if found is not None:
                heappush(heap, found >> _BITS << shift | h)
    return [s for s in symbols if s >= 0]


class _Words(dict):
    """Words to their ids as little-endian bytes; new words are merged on first sight."""

    def __init__(self, vocabulary: Vocabulary):
        self.single, self.merges = vocabulary.single, vocabulary.merges

    def __missing__(self, word: str) -> bytes:
        single = self.single
        ids = merge_word([single[b] for b in word.encode()], self.merges)
        made = np.array(ids, "<u4").tobytes()
        if len(word) <= CACHED_LENGTH and len(self) < CACHED_WORDS:
            self[word] = made
        return made


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.words = vocabulary, _Words(vocabulary)
        self.parts = regex.compile(PATTERN).findall
        names = sorted(map(regex.escape, vocabulary.special), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(names) + ")") if names else None

    def encode(self, text: str) -> bytes:
        pieces = self.special.split(text) if self.special else [text]
        out, word = [], self.words.__getitem__
        for i, piece in enumerate(pieces):
            if i % 2:
                out.append(np.array([self.vocabulary.special[piece]], "<u4").tobytes())
            elif piece:
                out.append(b"".join(map(word, self.parts(piece))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        pieces = self.vocabulary.pieces.__getitem__
        return b"".join(map(pieces, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` to every row."""
    # of a fixed size; the dict stays with a worker process that Spark reuses, and keeps known words
    shared = docs.sparkSession.sparkContext.broadcast((tuple(load_vocabulary(vocabulary_path)), {}))

    def make(texts: list) -> list:
        vocabulary, kept = shared.value
        if "codec" not in kept:
            kept["codec"] = Codec(Vocabulary(*vocabulary))
        codec = kept["codec"]
        ids = [codec.encode(t or "") for t in texts]
        return [[len(i) // 4 for i in ids], ids, [codec.decode(i) for i in ids]]

    return with_arrow(docs, [text], make, FIELDS)
