import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tonemark.llm import quality_rules as ops


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [t for t in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", t)]
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    symbols = sum(text.count(c) for c in ops.SYMBOLS)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_counts_equal_plain_python(frame):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "one", "a\nb\na\n a\n\n\n", "#$ é %&", "x " * 40, "\x0bw\x0c", "a b c d e f g h " * 2]
    texts += ["a b c d e f g h i a b c d e f g h", "😀 é\x85x y", prose(rng, 3000), "w " * 20000]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(5, 60))) for _ in range(60)]
    df = frame([(i, t, "en", "s") for i, t in enumerate(texts)])
    counted = ops.with_statistics(df).collect()
    assert len(counted) == len(texts)
    for r in counted:
        assert tuple(r[c] for c in ops.STATISTICS) == slow(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_clean_stays_and_outliers_go(frame):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(40, 1500)), rng.choice(["en", None]), rng.choice(["s", "t", None])) for i in range(900)]
    junk = ["".join(w + rng.choice(["###", "&&&", "$$$"]) + " " for w in prose(rng, 200).split()) for _ in range(20)]
    junk += [" ".join("x" * rng.randint(60, 90) for _ in range(100)) for _ in range(20)]
    rows += [(1000 + i, t, "en", "s") for i, t in enumerate(junk)]
    rows += [(2000, "few words", "en", "s"), (2001, None, None, None), (2002, "again and again " * 50, "en", "s")]
    rows += [(2003, prose(rng, 9), "zz", "rare"), (2004, prose(rng, 200), "zz", "rare"), (5, rows[5][1], *rows[5][2:])]
    got = ops.rate(frame(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, _, _, _, repeated = slow(r["text"])
        assert r["base_failed"] == (n < 20 or 100 * repeated > 30 * n)
        assert r["kept"] == (r["doc_id"] < 1000 or r["doc_id"] == 2004), r["doc_id"]


def test_a_third_of_outliers_does_not_move_the_centre(frame):
    rng = random.Random(3)
    rows = [(i, prose(rng, 200), "en", "s") for i in range(400)]
    rows += [(1000 + i, prose(rng, 200).replace(" ", " #$%&*|<> "), "en", "s") for i in range(100)]
    got = {r["doc_id"]: r["kept"] for r in ops.rate(frame(rows)).collect()}
    assert all(kept == (i < 1000) for i, kept in got.items())


def test_distance_equals_the_matrix_form(spark):
    rng = np.random.default_rng(4)
    n = 400
    words = rng.integers(30, 900, n)
    rows = [
        (i, "en", "s", int(w), int(w * rng.uniform(4, 7)), int(rng.poisson(5)), int(rng.poisson(1)), int(rng.integers(0, 8)))
        for i, w in enumerate(words)
    ]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in ops.STATISTICS))
    model = ops.fit(df)
    m = model.first()
    centre = np.array([m[f"_m_{i}"] for i in range(5)])
    factor = np.array([[m[f"_l_{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    inverse = np.linalg.inv(factor @ factor.T)
    rated = ops.judged(df, model)
    x = np.array(df.select(*ops.vector()).collect())
    got = {r["doc_id"]: r["distance"] for r in rated.collect()}
    ids = [r["doc_id"] for r in df.select("doc_id").collect()]
    for i, row in zip(ids, x):
        assert got[i] == pytest.approx(np.sqrt((row - centre) @ inverse @ (row - centre)), rel=1e-6)


def test_texts_are_counted_once(frame):
    rows = [(i, prose(random.Random(i), 40), "en", "s") for i in range(120)]
    plan = ops.rate(frame(rows))._jdf.queryExecution().optimizedPlan().toString()
    # what is rated comes from the stored counts, and words are looked for without deleting characters one by one
    assert "regexp" not in plan and "n_repeat_words" in plan
    counted = ops.with_statistics(frame(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in counted


def test_empty_table_and_no_python_on_the_way(frame, capsys):
    df = frame([(1, "a b", "en", "s")])
    assert ops.rate(df.limit(0)).count() == 0
    plan = ops.rate(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
