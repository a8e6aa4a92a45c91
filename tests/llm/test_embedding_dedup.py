import numpy as np
import pytest

from tonemark.llm import embedding_dedup as ops


def brute(rows):
    n = len(rows)
    good = [
        v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
        for _, v in rows
    ]
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.9:
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted((str(k), links[i], least.get(find(i), k)) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("tile", [512, 7])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(ops, "TILE", tile)
    rng = np.random.default_rng(tile)
    middles = rng.normal(size=(12, 16))
    rows = [(i, (middles[rng.integers(12)] + rng.normal(size=16) * rng.choice([0, 0.2, 0.45])).tolist()) for i in range(220)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, []), (305, [1e30] * 16)]
    rows += [(306, [float("inf")] + [1.0] * 15), (307, [1.0] * 8), (308, [2.0] * 8), (309, [-1.0] * 16), (310, [1.0] * 16)]
    rows += [(311, rows[0][1]), (311, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ops.near_duplicates(df).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in got) == brute(rows)


def test_bound_never_rules_out_a_link():
    rng = np.random.default_rng(4)
    for scale in (1e-3, 1.0, 50.0):
        x = rng.normal(size=(200, 24)) * np.exp(rng.normal(size=(200, 24)) * 2) * scale
        y = x + rng.normal(size=x.shape) * np.abs(x) * 0.6
        a, b = ops.Tile(np.arange(200), np.ones(200), x), ops.Tile(np.arange(200), np.ones(200), y)
        cosine = (x @ y.T) / np.outer(a.norms, b.norms)
        for threshold in (0.5, 0.9, 0.99):
            found = {(p, q) for ps, qs in ops.linked_pairs(a, b, threshold) for p, q in zip(ps.tolist(), qs.tolist())}
            assert found == set(zip(*[x.tolist() for x in np.nonzero(cosine >= threshold)]))


def test_empty_table(spark):
    assert ops.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
