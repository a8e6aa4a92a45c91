import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tonemark.llm import language_id as ops

SYLLABLES = {"xx": ["ka", "ro", "mi", "tu"], "yy": ["sch", "ung", "ein", "ver"], "zz": ["éa", "ño", "cio", "que"]}


def prose(rng, lang, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_subwords_stay_inside_words():
    one = set(ops.subwords("ab cd").tolist())
    assert one == set(ops.subwords("ab").tolist()) | set(ops.subwords("cd").tolist())
    assert len(ops.subwords("")) == 0 and len(ops.subwords("12 !?")) == 0
    assert set(ops.subwords("AB").tolist()) == set(ops.subwords("ab").tolist())


def test_long_texts_are_read_whole(monkeypatch):
    table = np.random.default_rng(1).normal(size=(ops.BUCKETS, 2)).astype(np.float32)
    text = prose(random.Random(1), "xx", 300)
    whole = ops.logits_of(text, table)
    monkeypatch.setattr(ops, "_CHUNK", 100)
    assert np.abs(ops.logits_of(text, table) - whole).max() < 0.1
    assert (ops.logits_of(text + prose(random.Random(2), "zz", 300), table) != whole).any()


def test_held_out_accuracy_and_special_rows(frame):
    rng = random.Random(7)
    rows = [(i, prose(rng, lang), lang, "s") for i in range(400) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(900, None, "xx", "s"), (901, "", "xx", "s"), (902, "12 34 !", "xx", "s"), (903, prose(rng, "yy"), None, "s")]
    rows += [(None, prose(rng, "zz"), "zz", "s"), (903, prose(rng, "yy"), None, "s")]
    df = frame(rows)
    model = ops.fit(df)
    assert model.labels == ["xx", "yy", "zz"]
    got = ops.predict(df, model).withColumn("held", ops.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows)
    right = {True: [], False: []}
    for r in got:
        if r["doc_id"] is None:
            assert r["lang_pred"] == "zz" and not r["held"]
        elif r["doc_id"] in (900, 901, 902):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
        elif r["doc_id"] == 903:
            assert r["lang_pred"] == "yy"
        else:
            assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
            right[r["held"]].append(r["lang_pred"] == r["lang"])
    assert np.mean(right[True]) > 0.98 and np.mean(right[False]) > 0.98
    again = ops.fit(df.repartition(5))
    assert (again.logits == model.logits).all()


def test_mixtures_score_lower_than_clear_texts(frame):
    rng = random.Random(8)
    df = frame([(i, prose(rng, lang), lang, "s") for i in range(200) for lang in SYLLABLES])
    model = ops.fit(df)
    mixed = frame([(i, prose(rng, "xx", 10) + " " + prose(rng, "yy", 10), None, None) for i in range(20)])
    clear = ops.predict(df, model).agg(F.avg("score"), F.avg(F.col("accepted").cast("double"))).first()
    blurred = ops.predict(mixed, model).agg(F.avg("score"), F.avg(F.col("accepted").cast("double"))).first()
    assert clear[0] > blurred[0] and clear[1] > 0.95 > blurred[1]


def test_rows_of_one_id_stay_within_the_bound(frame, monkeypatch):
    rng = random.Random(9)
    rows = [(8, prose(rng, "xx", 5), "xx", "s") for _ in range(300)] + [(i, prose(rng, "yy", 5), "yy", "s") for i in range(100, 130)]
    monkeypatch.setattr(ops, "PER_LABEL", 20)
    seen = []
    monkeypatch.setattr(ops, "train", lambda samples: seen.append([label for label, _, _ in samples]))
    assert zlib.crc32(b"8") % 4 != 2
    ops.fit(frame(rows))
    assert seen[0].count("xx") == 20 and 0 < seen[0].count("yy") <= 20


def test_nothing_to_learn_from(frame):
    df = frame([(1, "some text", None, None)])
    model = ops.fit(df)
    assert model is None
    assert [tuple(r) for r in ops.predict(df, model).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert ops.predict(df.limit(0), model).count() == 0
