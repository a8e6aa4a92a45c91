import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tonemark.llm import exact_substrings as ops

SCHEMA = "doc_id long, text string"


def brute(docs):
    w, seen = ops.LENGTH, Counter()
    texts = [(t or "").encode() for _, t in docs]
    for d in texts:
        seen.update(d[i : i + w] for i in range(len(d) - w + 1))
    out = []
    for (key, _), d in zip(docs, texts):
        gone = bytearray(len(d))
        for i in range(len(d) - w + 1):
            if seen[d[i : i + w]] > 1:
                gone[i : i + w] = b"\1" * w
        kept = bytes(x for x, y in zip(d, gone) if not y)
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        digest = hashlib.sha256(kept).hexdigest()
        out.append((key, len(d), sum(gone), len(spans), digest, spans, any(gone)))
    return ordered(out)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, str(r[0]), r[1:]))


def run(spark, docs, parts=3):
    df = spark.createDataFrame(docs, SCHEMA).repartition(parts)
    rows = ops.remove_repeats(df).collect()
    return ordered((*r[:5], [tuple(s) for s in r["spans"]], r["has_repeats"]) for r in rows)


def words(rng, n, letters="abcdefghijéü "):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_on_spliced_texts(spark, seed):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(300, 2500)) for _ in range(8)]
    docs = []
    for i in range(40):
        text = ""
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            a = rng.randrange(len(b))
            text += b[a : a + rng.randint(100, 1500)] + words(rng, rng.choice([0, 0, 3, 80]))
        docs.append((i, text))
    assert run(spark, docs) == brute(docs)


def test_periodic_short_null_and_repeated_rows(spark):
    rng = random.Random(3)
    one, two = words(rng, 900), words(rng, 700)
    docs = [
        (1, "a" * 3000), (2, "a" * 399), (3, "b" * 400), (4, "b" * 400), (5, "c" * 401), (6, "xyz" * 500),
        (7, None), (8, ""), (9, one), (9, two), (9, one), (None, two + "end"), (None, None), (10, "é" * 300),
    ]
    assert run(spark, docs) == brute(docs)
    assert run(spark, docs, 1) == brute(docs)


def test_one_text_repeated_many_times_and_empty_table(spark):
    text = words(random.Random(4), 1000, "abcdefg ")
    got = run(spark, [(i, text) for i in range(60)] + [(99, text[100:600])])
    assert [r[2] for r in got] == [1000] * 60 + [500]
    assert run(spark, []) == []


def test_null_id_on_most_rows(spark):
    rng = random.Random(5)
    shared = words(rng, 450)
    docs = [(None, words(rng, 30) + shared + words(rng, 20)) for _ in range(80)] + [(None, shared)] * 30
    assert run(spark, docs) == brute(docs)


def test_a_task_gathers_bunches_of_a_fixed_size(spark, monkeypatch):
    rng = random.Random(6)
    shared = words(rng, 700)
    docs = [(i, words(rng, 300) + shared[: 500 + 10 * i] + words(rng, 300)) for i in range(20)]
    sizes = []
    paired = ops._paired
    monkeypatch.setattr(ops, "GATHERED", 50)
    monkeypatch.setattr(ops, "_paired", lambda *rows: sizes.append(len(rows[0])) or paired(*rows))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], names=["owner", "text"])
    assert sum(b.num_rows for b in ops._head_rows(iter([batch]))) == sum(sizes)
    # a bunch ends with the text that fills it
    assert len(sizes) > 3 and max(sizes) < 50 + max(len(t.encode()) for _, t in docs) / 20
    monkeypatch.setattr(ops, "_paired", paired)
    assert run(spark, docs, 1) == brute(docs)
