import random
import re

import numpy as np
import xxhash

from tonemark.llm import simhash as ops
from tonemark.llm.shared import components


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_equals_the_definition():
    for text in (None, "", "  \t", "One", "Été À B", "a b c d", "a b c d a b c d a b c d", "x y z\x1cw \x0bq r s"):
        assert ops.fingerprint(text) % (1 << 64) == slow_print(text)


def test_links_reach_exactly_the_prints_within_four_bits(spark, monkeypatch):
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:30]:
        for bits in (1, 2, 3, 4, 5, 6):
            prints.add(p ^ sum(1 << i for i in rng.sample(range(64), bits)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 4]
    df = spark.createDataFrame([(s,) for s in signed], "simhash long").repartition(3)
    want = closure(signed, near)
    for at_once in (1 << 21, 3000):
        monkeypatch.setattr(ops, "_AT_ONCE", at_once)
        links = [(r["a"], r["b"]) for r in ops.links(df, len(signed)).collect()]
        assert all(((a ^ b) % (1 << 64)).bit_count() <= 4 for a, b in links)
        got = closure(signed, links)
        assert got == want


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = {r["node"]: r["root"] for r in components(df).collect()}
    want = closure({n for e in edges for n in e}, edges)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(df.limit(0)).count() == 0


def test_near_duplicates_over_rows(frame):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(300)) for _ in range(6)]
    rows = []
    for i in range(40):
        words = rng.choice(texts).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(300)] = "new"
        rows.append((i, " ".join(words)))
    rows += [(50, None), (51, ""), (52, " \n"), (53, "Word"), (54, "word"), (None, "word"), (54, "word")]
    prints = [(i, slow_print(t)) for i, t in rows]
    at = range(len(prints))
    near = [(a, b) for a in at for b in at if a < b and (prints[a][1] ^ prints[b][1]).bit_count() <= 4]
    root = closure(at, near)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    want = sorted((str(i), p, least.get(root[k])) for k, (i, p) in enumerate(prints))
    found = ops.near_duplicates(frame([(*r, None, None) for r in rows])).collect()
    assert sorted((str(r["doc_id"]), r["simhash"] % (1 << 64), r["component_id"]) for r in found) == want
    assert ops.near_duplicates(frame([])).count() == 0


def test_masks():
    assert len(ops._masks(10, 2)) == 45 and ops._masks(5, 0).tolist() == [0]
    assert np.bitwise_count(ops._masks(12, 2)).tolist() == [2] * 66
