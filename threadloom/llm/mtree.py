"""Exact top-k inner products by best-first search in M-trees.

Components become integers. With one more component that brings every vector to the same length, the
order by inner product is the order by Euclidean distance, a metric. Vectors go to the nearest of a
bounded number of pivots; each region, in blocks of bounded size however many vectors it has, becomes
an M-tree whose pages hold routing vectors with covering radii and distances to their parent. A query
first searches its own region for a bound; then every tree that the bound doesn't exclude, taking pages
by their least possible distance, and skipping computations that the stored distances make needless.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import mapped
from threadloom.session import written

SCALE = 1024
PAGE, FANOUT = 256, 16
#: Vectors per tree, pivots at most, queries per block, lanes of trees at most.
TREE, PIVOTS, QUERIES, LANES = 1 << 14, 1 << 12, 1 << 12, 1 << 10
LONG = (1 << 63) - 1


def integers(vector: list | None) -> np.ndarray | None:
    """floor(1024 * x) of every component (exact in doubles); None if the vector takes no part."""
    if vector is None or any(x is None for x in vector):
        return None
    whole = np.asarray(vector, np.float64)
    return np.floor(SCALE * whole) if np.isfinite(whole).all() and np.isfinite(SCALE * whole).all() else None


def inner(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Exact inner products of integer rows ``x`` with ``q``, held within the range of long."""
    if not x.size:
        return [0] * len(x)
    if np.abs(x).max() * np.abs(q).max() * len(q) < 1 << 53:
        return (x @ q).astype(np.int64).tolist()
    return [max(-LONG - 1, min(LONG, sum(int(a) * int(b) for a, b in zip(row, q)))) for row in x]


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows with the component that makes their length ``norm``."""
    rest = np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0.0))
    return np.column_stack((x, rest))


class Tree:
    """An M-tree over at most a block of vectors; pages of entries, leaves last.

    An inner page is (center per entry, covering radius, distance to parent, page of entry); a leaf is
    (vectors, ids, distance to parent).
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, norm: float) -> None:
        self.norm, self.pages = norm, []
        order = np.lexsort((ids,))
        ids, x = ids[order], x[order]
        points = lifted(x, norm)
        self.center = points.mean(0) if len(points) else np.zeros(1)
        self.root = self._page(ids, x, points, self.center)
        self.radius = float(np.linalg.norm(points - self.center, axis=1).max(initial=0.0))

    def _page(self, ids: np.ndarray, x: np.ndarray, points: np.ndarray, parent: np.ndarray) -> int:
        if len(ids) <= PAGE:
            self.pages.append((True, x, ids, np.linalg.norm(points - parent, axis=1)))
            return len(self.pages) - 1
        parts = self._split(points)
        centers = np.stack([points[p].mean(0) for p in parts])
        radii = np.array([np.linalg.norm(points[p] - c, axis=1).max() for p, c in zip(parts, centers)])
        below = np.array([self._page(ids[p], x[p], points[p], c) for p, c in zip(parts, centers)])
        self.pages.append((False, centers, radii, np.linalg.norm(centers - parent, axis=1), below))
        return len(self.pages) - 1

    @staticmethod
    def _split(points: np.ndarray) -> list[np.ndarray]:
        """Parts around seeds that lie far from each other; even parts if the points are the same."""
        far = np.linalg.norm(points - points[0], axis=1)
        seeds, nearest, owner = [0], far, np.zeros(len(points), np.int64)
        while len(seeds) < FANOUT and nearest.max() > 0:
            seeds.append(int(nearest.argmax()))
            d = np.linalg.norm(points - points[seeds[-1]], axis=1)
            closer = d < nearest
            owner[closer], nearest = len(seeds) - 1, np.minimum(nearest, d)
        parts = [np.flatnonzero(owner == i) for i in range(len(seeds))]
        parts = [p for p in parts if len(p)]
        if max(map(len, parts)) > 0.9 * len(points):  # little told apart: cut the largest evenly as well
            largest = max(parts, key=len)
            parts = [p for p in parts if p is not largest] + np.array_split(largest, FANOUT)
        return [p for p in parts if len(p)]

    def search(self, query: int, q: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """Best (score, id), ids other than ``query``, of at least ``least``; higher first, then smaller id."""
        lift = np.append(q, 0.0)
        base = float(q @ q) + self.norm * self.norm
        best: list[tuple[int, int]] = []

        def reach() -> float:
            """Largest distance that can still be among the best, with room for rounding."""
            bound = best[k - 1][0] if len(best) >= k else least
            bound = bound if least is None or bound is None else max(bound, least)
            return float("inf") if bound is None else float(np.sqrt(max(base - 2.0 * bound, 0.0))) * (1 + 1e-9) + 1e-7 * (1 + self.norm)

        to_root = float(np.linalg.norm(self.center - lift))
        heap, far = [(max(to_root - self.radius, 0.0), self.root, to_root)], reach()
        while heap:
            bound, number, to_parent = heappop(heap)
            if bound > far:
                break
            leaf, *page = self.pages[number]
            if leaf:
                x, ids, to = page
                open_ = np.flatnonzero((np.abs(to - to_parent) <= far) & (ids != query))
                if len(open_):
                    found = [(s, i) for s, i in zip(inner(x[open_], q), ids[open_].tolist()) if least is None or s >= least]
                    if found:
                        best = sorted({*best, *found}, key=lambda f: (-f[0], f[1]))[:k]
                        far = reach()
            else:
                centers, radii, to, below = page
                open_ = np.flatnonzero(np.abs(to - to_parent) - radii <= far)
                distances = np.linalg.norm(centers[open_] - lift, axis=1)
                for d, r, n in zip(distances.tolist(), radii[open_].tolist(), below[open_].tolist()):
                    if d - r <= far:
                        heappush(heap, (max(d - r, bound), n, d))
        return best


def _far_apart(points: np.ndarray, number: int) -> np.ndarray:
    """Up to ``number`` points, each the farthest from those before."""
    chosen, nearest = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < number and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


PREPARED = [("vec_id", "long"), ("dim", "int"), ("length", "double"), ("ints", "doubles")]


def prepared(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, dim, length, ints) of the vectors that take part.

    Null ids, null vectors and vectors with null or non-finite components take none.
    """

    def make() -> Callable:
        def work(keys: list, values: list) -> Iterator[tuple]:
            rows = [(k, len(v), float(np.linalg.norm(v)), v) for k, v in zip(keys, map(integers, values)) if k is not None and v is not None]
            yield tuple(zip(*rows)) if rows else ((),) * len(PREPARED)

        return work

    return mapped(vectors.select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v")), ["k", "v"], PREPARED, make)


def _routed(rows: DataFrame, pivots: dict[int, np.ndarray], norms: dict[int, float]) -> DataFrame:
    """``rows`` with the region of the nearest pivot of their dimension."""

    def make() -> Callable:
        def work(ids: list, dims: list, ints: list) -> Iterator[tuple]:
            regions = np.zeros(len(ids), np.int64)
            dims_ = np.array(dims)
            for dim in np.unique(dims_):
                own = np.flatnonzero(dims_ == dim)
                for part in np.array_split(own, -(-len(own) // 1024)):
                    x = lifted(np.array([ints[i] for i in part], np.float64).reshape(len(part), -1), norms[dim])
                    p = pivots[dim]
                    regions[part] = ((p * p).sum(1)[None, :] - 2 * x @ p.T).argmin(1)
            yield ids, dims, regions, ints

        return work

    return mapped(rows, ["vec_id", "dim", "ints"], [("vec_id", "long"), ("dim", "int"), ("region", "long"), ("ints", "doubles")], make)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` largest integer inner products per query.

    ``queries`` has the columns of ``vectors``; a vector whose id is the query's is not its own
    answer. Equal scores rank by smaller id. Only vectors of as many components as the query are
    compared. Rows that repeat an id with the same vector count once; an id with several vectors is
    answered, and answers, with each of them. Scores beyond the range of long are held at its ends.
    Fewer candidates than ``k`` give fewer rows, an empty table none.
    """
    rows = written(prepared(vectors, key, vector), "vectors")
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("norm")).collect()
    norms = {r["dim"]: r["norm"] for r in sizes}
    pivots = {}
    for r in sizes:
        number = min(PIVOTS, -(-r["n"] // TREE))
        share = min(1.0, 8 * number / r["n"] + 64 / r["n"])
        hashed = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) <= share * (1 << 30)
        sample = rows.where((F.col("dim") == r["dim"]) & hashed).select("vec_id", "ints").limit(16 * number + 256).collect()
        first = sample or rows.where(F.col("dim") == r["dim"]).select("vec_id", "ints").limit(1).collect()
        points = lifted(np.array([s["ints"] for s in sorted(first)], np.float64).reshape(len(first), -1), r["norm"])
        pivots[r["dim"]] = _far_apart(points, number)
    routed = written(_routed(rows, pivots, norms), "routed")
    blocks = routed.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / TREE).cast("int").alias("blocks"))
    placed = routed.join(blocks, ["dim", "region"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "ints"), F.col("blocks")).cast("int"))
    lanes = max(1, min(blocks.agg(F.sum("blocks")).first()[0] or 0, LANES))
    lane = F.pmod(F.xxhash64("dim", "region", "block"), F.lit(lanes)).cast("int")

    def plant(rows: pd.DataFrame) -> pd.DataFrame:
        dim = int(rows["dim"].iloc[0])
        x = np.array(rows["ints"].tolist(), np.float64).reshape(len(rows), dim)
        tree = Tree(rows["vec_id"].to_numpy(), x, norms[dim])
        return pd.DataFrame({"dim": [dim], "region": rows["region"].iloc[:1], "block": rows["block"].iloc[:1], "tree": [pickle.dumps(tree.__dict__)]})

    planted = placed.drop("blocks").groupBy("dim", "region", "block").applyInPandas(plant, "dim int, region bigint, block int, tree binary")
    trees = written(planted.withColumn("lane", lane), "trees")
    known = prepared(queries, key, vector).where(F.col("dim").isin(list(norms))).dropDuplicates(["vec_id", "ints"])
    asked = written(_routed(known, pivots, norms), "queries")

    def searched(asked: DataFrame, keys: list[str]) -> DataFrame:
        """(query_id, vec_id, score) from the trees that share ``keys`` with a block of queries."""
        packed = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.ceil(F.lit(max(1, asked.count())) / QUERIES)))
        own = [c for c in keys if c != "lane"]
        lists = packed.groupBy(*own, "part").agg(F.collect_list(F.struct("vec_id", "ints", "least")).alias("queries"))
        if "lane" in keys:  # every block of queries goes to every lane of trees
            lists = lists.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        pairs = trees.join(lists, keys).select("tree", "queries")

        def make() -> Callable:
            def work(planted: list, asked: list) -> Iterator[tuple]:
                for data, queries in zip(planted, asked):
                    tree = Tree.__new__(Tree)
                    tree.__dict__.update(pickle.loads(data))
                    out = [(q["vec_id"], i, s) for q in queries for s, i in tree.search(q["vec_id"], np.array(q["ints"], np.float64), k, q["least"])]
                    yield tuple(zip(*out)) if out else ((), (), ())

            return work

        return mapped(pairs, ["tree", "queries"], [("query_id", "long"), ("vec_id", "long"), ("score", "long")], make)

    none = F.lit(None).cast("bigint").alias("least")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    home = searched(asked.withColumn("least", none), ["dim", "region"]).distinct().withColumn("rank", F.row_number().over(place))
    bounds = written(home.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least")), "bounds")
    found = searched(asked.join(bounds, "vec_id", "left"), ["dim", "lane"]).distinct()
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
