import hashlib
import math
import random
import zlib

import pyarrow as pa
import pytest

from tonemark.llm import importance as ops


def brute(rows, target, percent, least_words):
    def features(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = "".join(c if c >= "\x80" or c.isdigit() or "a" <= c <= "z" else " " for c in lowered).split(" ")
        words = [w for w in words if w]
        made = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        return len(words), [zlib.crc32(f.encode()) % 10000 for f in made]

    raw, wanted = [0] * 10000, [0] * 10000
    for _, text, *_ in rows:
        for b in features(text)[1]:
            raw[b] += 1
    for text in target:
        for b in features(text)[1]:
            wanted[b] += 1
    s_all, t_all = sum(raw), sum(wanted)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) for s, t in zip(raw, wanted)]
    out = []
    for i, text, *_ in rows:
        n, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def prose(rng, n):
    return " ".join(rng.choice(["Alpha", "beta", "été", "x9", "the", "of", "naïve", "omega"]) + rng.choice(["", ",", "!", "\n"]) for _ in range(n))


def key(row):
    return tuple((v is None, v or 0) for v in row)


@pytest.mark.parametrize("pivots", [1, 63])
def test_against_brute_force(frame, spark, monkeypatch, pivots):
    monkeypatch.setattr(ops, "PIVOTS", pivots)
    rng = random.Random(pivots)
    rows = [(i, prose(rng, rng.randint(0, 60)), "xx", "s") for i in range(150)]
    rows += [(200, None, "xx", "s"), (201, "", None, None), (202, "\x00\t-", None, None), (None, prose(rng, 40), None, None)]
    target = [prose(rng, 30) for _ in range(5)] + [None]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = ops.resample(frame(rows), wanted)
    assert "clash" not in (got.select("score", "rank", "weight").first() or ())
    got = [tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=key) == sorted(brute(rows, target, 25, 20), key=key)


def test_long_texts_in_chunks(monkeypatch):
    text = prose(random.Random(1), 300)
    whole = ops.buckets(text)
    monkeypatch.setattr(ops, "_CHUNK", 7)
    n, cells = ops.buckets(text)
    assert n == whole[0] and sorted(cells.tolist()) == sorted(whole[1].tolist())


def test_repeated_rows_are_drawn_one_by_one(frame, spark):
    """The cut-off falls among rows alike in score and id, some of them wholly alike."""
    same = prose(random.Random(2), 30)
    rows = [(7, same, "xx", "s")] * 90 + [(7, same[::-1], "xx", "s")] * 30 + [(None, same, "xx", "s")] * 40
    none = spark.createDataFrame([], "text string")
    got = ops.resample(frame(rows, parts=5), none, percent=50).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 81))
    scores = [r["score"] for r in got]
    assert scores == sorted(scores, reverse=True)
    again = ops.resample(frame(rows, parts=3), none, percent=50).where("rank is not null").orderBy("rank").collect()
    assert [(r["doc_id"], r["n_features"], r["score"]) for r in again] == [(r["doc_id"], r["n_features"], r["score"]) for r in got]


def test_cutoff_with_wide_ids_and_nulls(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 2]), rng.choice([None, -(2**62), 2**62, 5]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    ordered = sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))
    for n in (1, 7, 20, 39, 58, 60):
        got = sorted(map(tuple, df.where(ops.cutoff(df, ["a", "b", "c"], n)).collect()), key=lambda r: r[2])
        assert got == sorted(ordered[:n], key=lambda r: r[2])


def test_nothing_to_draw(frame, spark):
    none = spark.createDataFrame([], "text string")
    assert ops.resample(frame([(1, "few words", "x", "s")]).limit(0), none).count() == 0
    assert [r["rank"] for r in ops.resample(frame([(1, "few words", "x", "s")]), none).collect()] == [None]
    assert isinstance(ops.with_buckets(frame([(1, "a b", "x", "s")])).toArrow(), pa.Table)
