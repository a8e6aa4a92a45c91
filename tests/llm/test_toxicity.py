import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tonemark.llm import toxicity as ops

PLAIN = ["mira", "solen", "tavi", "rodu", "kesta", "lumo", "pari", "dene"]
RUDE = ["grobfuk", "zwackol", "blargon"]


def prose(rng, rude, n=60):
    words = [rng.choice(PLAIN) + rng.choice(PLAIN)[: rng.randint(0, 3)] for _ in range(n)]
    for _ in range(max(2, n // 30) if rude else 0):
        words.insert(rng.randrange(len(words)), rng.choice(RUDE) + rng.choice(["", "a", "ix", "et"]))
    return " ".join(words)


def rows_of(seed, n=500):
    rng = random.Random(seed)
    made = [(i, rng.random() < 0.2) for i in range(n)]
    return [(i, prose(rng, t, rng.randint(10, 120)), "xx", "s") for i, t in made], [(i, int(t)) for i, t in made]


def names(text):
    return [n for part in ops.windows(text) for n in part.tolist()]


def test_windows_of_texts():
    a, b = (ord(c) % 4095 + 1 for c in "ab")
    assert names("Ab") == [((0 << 12 | a) << 12 | b) << 12 | 0]
    assert names("") == names("1 ?") == names("é") == []
    assert names("ab  12 cd") == names("AB cd") and len(names("ab cd")) == 4


@pytest.mark.parametrize("chunk", [1, 2, 7, 50])
def test_long_texts_in_chunks(monkeypatch, chunk):
    text = "  " + prose(random.Random(3), True) + " 12 ünd so, weiter  "
    whole = names(text)
    monkeypatch.setattr(ops, "_CHUNK", chunk)
    assert names(text) == whole


def test_ratios_against_the_formula():
    """Chances by dictionaries and recursion, as the books write Kneser-Ney."""
    plain, rude = ["mira tavi mira", "solen mira"], ["mira zwack", "zwack tavi"]
    counts = [Counter(n for t in texts for n in names(t)) for texts in (plain, rude)]
    types = sorted(set(counts[0]) | set(counts[1]))
    symbols = {n: tuple(n >> 12 * k & 4095 for k in (3, 2, 1, 0)) for n in types}
    grams = {4: set(symbols.values())}
    for k in (3, 2, 1):
        grams[k] = {g[1:] for g in grams[k + 1]}
    before = Counter(g[1:] for k in (4, 3, 2) for g in grams[k])
    d = ops.DISCOUNT

    def shared(gram):
        if len(gram) == 1:
            return before[gram] / sum(before[g] for g in grams[1])
        rest = [g for g in grams[len(gram)] if g[:-1] == gram[:-1]]
        return (max(before[gram] - d, 0) + d * len(rest) * shared(gram[1:])) / sum(before[g] for g in rest)

    def chance(gram, count):
        own = {symbols[n]: c for n, c in count.items() if symbols[n][:-1] == gram[:-1]}
        if not own:
            return shared(gram[1:])
        return (max(own.get(gram, 0) - d, 0) + d * len(own) * shared(gram[1:])) / sum(own.values())

    array = np.array(types)
    slots = ops.slot_of(array)
    assert len(set(slots.tolist())) == len(types)
    model = ops.build(slots, array, *(np.array([c[n] for n in types]) for c in counts))
    for n, slot in zip(types, slots):
        want = math.log(chance(symbols[n], counts[1]) / chance(symbols[n], counts[0]))
        assert model.ratio[slot] == pytest.approx(want, abs=1e-5)
    text = "mira zwack solen"
    want = sum(math.log(chance(tuple(n >> 12 * k & 4095 for k in (3, 2, 1, 0)), counts[1]) / chance(tuple(n >> 12 * k & 4095 for k in (3, 2, 1, 0)), counts[0]))
               for n in names(text) if n in symbols)
    known = [n for n in names(text) if n in symbols]
    assert ops.raw_value(text, model) == pytest.approx(
        (want + sum(float(model.backoff[ops.slot_of(np.array([n >> 12]))[0]]) for n in names(text) if n not in symbols)) / len(names(text)) ** ops.LENGTH, abs=1e-5
    ) and known


def test_held_out_accuracy_and_special_rows(frame, spark):
    rows, labels = rows_of(1)
    rows += [(900, None, "xx", "s"), (901, "", "xx", "s"), (None, prose(random.Random(9), True), "xx", "s"), rows[0], rows[0]]
    labels += [labels[0], (0, 0), (None, 1), (901, None), (5000, 1)]
    known = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("_toxic", ops.F.lit("clash"))
    got = ops.score(frame(rows), known).collect()
    assert len(got) == len(rows)
    truth = {True: [], False: []}
    of = {i: max(t or 0 for j, t in labels if i == j) for i, _ in labels}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] is not None and r["doc_id"] < 900:
            truth[r["held_out"]].append(r["predicted"] == of[r["doc_id"]])
    assert np.mean(truth[True]) > 0.97 and np.mean(truth[False]) > 0.97
    again = ops.score(frame(rows, parts=7), known.repartition(3)).collect()
    assert Counter((r["doc_id"], r["score"]) for r in got) == Counter((r["doc_id"], r["score"]) for r in again)


def test_held_out_labels_are_never_read(frame, spark):
    rows, labels = rows_of(2)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    scores = [
        {r["doc_id"]: r["score"] for r in ops.score(frame(rows), spark.createDataFrame(kept, "doc_id long, toxic int")).collect()}
        for kept in (labels, flipped)
    ]
    assert scores[0] == scores[1]


def test_without_labels(frame, spark):
    rows, labels = rows_of(4, 20)
    for kept in ([], [(i, 0) for i, _ in labels]):
        got = ops.score(frame(rows), spark.createDataFrame(kept, "doc_id long, toxic int")).collect()
        assert [(r["score"], r["predicted"]) for r in got] == [(0.0, 0)] * 20
    assert ops.score(frame(rows).limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0
