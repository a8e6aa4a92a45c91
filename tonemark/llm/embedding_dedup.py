"""Embedding near-duplicates by quantised tile products with proven error bounds.

Equal vectors are one class from the start. Classes are laid out in tiles around pivots. Each unit
vector is quantised to 8-bit codes, and the norm of what this loses is kept, so the product of two
code rows is within a known distance of the true cosine. Tiles are multiplied in pairs; a pair of
tiles is passed over when their centres and radii rule out the threshold, and only pairs of vectors
that the bound does not rule out are computed again in double precision.

A tile pair gives back, for each class, the number of its links and one root, not the links.
Vectors that are null, zero, or hold null or non-finite components link with nothing; so do vectors
of different length. Rows with equal vectors are each counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemark.llm.shared import components, cut, sorted_groups

THRESHOLD = 0.9
TILE = 512
#: Tiles per group; the groups form the grid of tasks. Fewest groups, for work to spread.
GROUP_TILES = 64
LEAST_GROUPS = 8
_MOST_PIVOTS = 1024
#: Slack for rounding in single precision, far above what 2**24-exact products can lose.
_SLACK = 1e-5
_PAIRS_AT_ONCE = 1 << 18


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scale of each row, and the norm of each row's rounding error."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes, scale, error


class Tile:
    """Vectors that lie near each other, with what bounds their products with others."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray):
        self.ids, self.counts, self.vectors = ids, counts, vectors
        self.norms = np.linalg.norm(vectors, axis=1)
        unit = vectors / self.norms[:, None]
        codes, self.scale, self.error = quantise(unit)
        # products of codes stay below 2**24 up to a thousand dimensions, so floats hold them exactly
        self.codes = codes.astype(np.float32 if vectors.shape[1] <= 1024 else np.float64)
        middle = unit.mean(axis=0)
        size = np.linalg.norm(middle)
        self.centre = middle / size if size > 1e-9 else unit[0]
        self.radius = np.arccos(np.clip(unit @ self.centre, -1, 1)).max()


def linked_pairs(a: Tile, b: Tile, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of the tiles with cosine at least ``threshold``; each pair once if a is b."""
    if a.vectors.shape[1] != b.vectors.shape[1]:
        return
    between = np.arccos(np.clip(a.centre @ b.centre, -1, 1))
    if between - a.radius - b.radius > np.arccos(threshold) + 1e-6:
        return
    near = a.codes @ b.codes.T
    near *= b.scale.astype(near.dtype)[None, :]
    worst = b.error.max()
    least = (threshold - (a.error * (1 + worst) + worst) - _SLACK) / a.scale
    i, j = np.nonzero(near >= least.astype(near.dtype)[:, None])
    if a is b:
        once = i < j
        i, j = i[once], j[once]
    for start in range(0, len(i), _PAIRS_AT_ONCE):
        p, q = i[start : start + _PAIRS_AT_ONCE], j[start : start + _PAIRS_AT_ONCE]
        exact = np.einsum("ij,ij->i", a.vectors[p], b.vectors[q]) / (a.norms[p] * b.norms[q])
        hit = exact >= threshold
        yield p[hit], q[hit]


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest place that each place is joined with."""
    root = np.arange(n)
    while pairs:
        before = root.copy()
        for p, q in pairs:
            least = np.minimum(root[p], root[q])
            np.minimum.at(root, p, least)
            np.minimum.at(root, q, least)
        root = root[root]
        if (root == before).all():
            break
    return root


def _grid(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in sorted_groups(frames, "pair"):
            tiles = []
            for (group, _), rows in cell.groupby(["group", "tile"], sort=True):
                vectors = np.stack([np.frombuffer(v, np.float64) for v in rows["vector"]])
                tiles.append((group, Tile(rows["cid"].to_numpy(), rows["n"].to_numpy(), vectors)))
            starts = np.cumsum([0, *[len(t.ids) for _, t in tiles]])
            links, pairs = np.zeros(starts[-1], np.int64), []
            one_group = len({g for g, _ in tiles}) == 1
            for x, (g, a) in enumerate(tiles):
                for y in range(x, len(tiles)):
                    h, b = tiles[y]
                    # a cell of one group pairs its own tiles, a cell of two only tiles across them
                    if (g == h) != one_group or g == h and not cell["own"].iloc[0]:
                        continue
                    for p, q in linked_pairs(a, b, threshold):
                        np.add.at(links, starts[x] + p, b.counts[q])
                        np.add.at(links, starts[y] + q, a.counts[p])
                        pairs.append((starts[x] + p, starts[y] + q))
            root = _roots(starts[-1], pairs)
            ids = np.concatenate([t.ids for _, t in tiles])
            some = links > 0
            yield pd.DataFrame({"cid": ids[some], "links": links[some], "root": ids[root[some]]})

    return run


def classes(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """One row per distinct usable vector: ``cid``, the vector, its rows and their smallest id."""
    value = F.col(embedding)
    usable = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists(value, lambda x: x != 0)
    kept = rows.where(value.isNotNull() & F.coalesce(usable & some, F.lit(False)))
    grouped = kept.groupBy(value.alias("vector")).agg(F.count(F.lit(1)).alias("n"), F.min(vec_id).alias("first"))
    return cut(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")


def _laid_out(unique: DataFrame, count: int) -> DataFrame:
    """Classes with their tile: the nearest pivot, and a part of it where a pivot has many.

    The pivots are a bounded sample that decides the layout only.
    """
    n_pivots = int(min(_MOST_PIVOTS, max(1, count // TILE)))
    picked = unique.orderBy(F.xxhash64("cid"), "cid").limit(n_pivots).collect()
    by_size: dict[int, np.ndarray] = {}
    for r in picked:
        v = np.array(r["vector"], np.float64)
        v = v / np.linalg.norm(v)
        by_size[len(v)] = np.vstack([by_size[len(v)], v]) if len(v) in by_size else v[None, :]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cells, packed = [], []
            for v in frame["vector"]:
                v = np.asarray(v, np.float64)
                pivots = by_size.get(len(v))
                cells.append(len(v) * _MOST_PIVOTS + (int((pivots @ v).argmax()) if pivots is not None else 0))
                packed.append(v.tobytes())
            yield pd.DataFrame({"cid": frame["cid"], "n": frame["n"], "vector": packed, "cell": cells})

    placed = unique.select("cid", "n", "vector").mapInPandas(place, "cid long, n long, vector binary, cell long")
    placed = cut(placed, "placed")
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("_parts"))
    part = F.pmod(F.xxhash64("cid"), F.col("_parts"))
    return placed.join(parts, "cell").select("cid", "n", "vector", F.struct("cell", part.alias("part")).alias("_t"))


def near_duplicates(
    rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per vector: id, ``n_links`` and ``component_id``."""
    rows = rows.select(vec_id, embedding)
    unique = classes(rows, vec_id, embedding)
    count = unique.count()
    groups = max(LEAST_GROUPS, -(-count // (TILE * GROUP_TILES)))
    laid = _laid_out(unique, count).withColumn("tile", F.xxhash64("_t"))
    laid = laid.withColumn("group", F.pmod(F.col("tile"), F.lit(groups)).cast("int"))
    # every group meets every group in one cell of the grid
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("other")
    met = laid.select("cid", "n", "vector", "tile", "group", other)
    pair = F.least("group", "other") * groups + F.greatest("group", "other")
    met = met.select(
        "cid", "n", "vector", "tile", "group", pair.alias("pair"), (F.col("group") == F.col("other")).alias("own")
    )
    dealt = met.repartition("pair").sortWithinPartitions("pair", "tile")
    found = cut(dealt.mapInPandas(_grid(threshold), "cid long, links long, root long"), "tile_links")

    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = unique.select("cid", "vector", "n", "first").join(linked, "cid", "left")
    named = named.join(roots, named["cid"] == roots["node"], "left")
    named = cut(named.withColumn("root", F.coalesce("root", "cid")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(least, "root").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    joined = rows.join(labels, rows[embedding] == labels["vector"], "left")
    return joined.select(
        vec_id,
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", vec_id).alias("component_id"),
    )
