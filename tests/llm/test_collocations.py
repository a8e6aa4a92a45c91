import random
import re
from collections import Counter

import pytest

from tonemark.llm import collocations as ops

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, top):
    """All phrases by slicing, all longer phrases looked through, big integers throughout."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, sizes = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall(r"[^ \t]+", piece)
            sizes[lang] += len(words)
            for m in range(1, 6):
                count.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    often = {k: n for k, n in count.items() if n >= least and len(k) > 2}
    held = Counter()
    for (lang, *words), n in often.items():
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                if j - i < len(words):
                    part = (lang, *words[i:j])
                    held[part] = max(held[part], n)
    out = []
    for lang in sizes:
        found = []
        for key, a in often.items():
            if key[0] != lang or held[key] >= a:
                continue
            cuts = []
            for k in range(1, len(key) - 1):
                left, right = count[key[: k + 1]], count[(lang, *key[k + 1 :])]
                cuts.append((1000 * a * sizes[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            phrase = " ".join(key[1:])
            found.append((-score, -a, phrase.encode(), (lang, phrase, a, left, right, sizes[lang], score)))
        for rank, row in enumerate(sorted(found)[:top], 1):
            out.append((row[3][0], rank, *row[3][1:]))
    return sorted(out)


def sample(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "B", "cé", "d\x00x", "e\x01", "\x00", "f"] + [f"rare{i}" for i in range(40)]
    weights = [20, 15, 10, 6, 4, 3, 2] + [1] * 40
    rows = []
    for i in range(n):
        made = rng.choices(words, weights, k=rng.randint(0, 60))
        if rng.random() < 0.4:
            made += ["one", "hot", "passage", "of", "seven", "words", "here"] * rng.randint(1, 3)
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ", ", ". ", "\n", "  "]) for w in made)
        rows.append((i, text, rng.choice(["xx", "xx", "yy", None]), "s"))
    rows += [(None, None, "xx", "s"), (1, "", None, "s"), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("seed, budget", [(1, 4_000_000), (2, 3)])
def test_against_brute_force(frame, monkeypatch, seed, budget):
    monkeypatch.setattr(ops, "BUDGET", budget)
    rows = sample(seed)
    got = ops.collocations(frame(rows), least=6, top=50)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(rows, 6, 50)


def test_small_buffers_and_few_bits_change_nothing(frame, monkeypatch):
    rows = sample(3)
    want = brute(rows, 6, 50)
    for name, value in (("_PLACES", 50), ("_HELD", 5), ("_CHUNK", 10), ("BITS", 1 << 15), ("MOST_CELLS", 8)):
        monkeypatch.setattr(ops, name, value)
    assert sorted(map(tuple, ops.collocations(frame(rows), least=6, top=50).collect())) == want


def test_products_beyond_64_bits_and_ties(spark):
    import pyspark.sql.functions as F

    f = 3_000_000_000_000
    phrases = spark.createDataFrame([("x", "a\x00b", f), ("x", "a\x00b\x00c", f - 1), ("x", "b\x00c", f)], "lang string, phrase string, f long")
    words = spark.createDataFrame([("x", w, f + i) for i, w in enumerate("abc")], "lang string, phrase string, f long")
    sizes = spark.createDataFrame([("x", 10**14)], "lang string, n long")
    got = {r["phrase"]: r for r in ops.scored(phrases, words.unionByName(phrases), sizes).collect()}
    assert got["a\x00b"]["score"] == 1000 * f * 10**14 // (f * (f + 1))
    three = got["a\x00b\x00c"]
    cuts = [(1000 * (f - 1) * 10**14 // (f * f), 1, f, f), (1000 * (f - 1) * 10**14 // (f * (f + 2)), 2, f, f + 2)]
    assert (three["score"], three["l"], three["r"]) == (min(cuts)[0], *min(cuts)[2:])
    assert ops.scored(phrases.where(F.lit(False)), words, sizes).count() == 0


def test_no_phrases_no_rows(frame):
    assert ops.collocations(frame([(1, "a b c", "xx", "s")])).count() == 0
    assert ops.collocations(frame([(1, "a b", "xx", "s")]).limit(0), least=1).count() == 0
