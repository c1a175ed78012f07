"""Nearest neighbours by largest inner product: vantage-point trees per shard.

One more coordinate, sqrt(M^2 - |x|^2) with M the largest norm (0 for queries), turns the largest
inner product into the smallest Euclidean distance, where the triangle inequality holds. The top of one
vantage-point tree, fitted on at most ``TOP_SAMPLE`` vectors of each length, deals all candidates into
shards; a shard that many equal vectors make too large is parted by hash. Each part's tree is built once and written.

A query goes to the shard it lies in first. The distance of its k-th best there, and the exact ranges of
distances between the top's vantage points and a shard's members, tell which other shards can hold
nearer ones; it is sent to these alone. Blocks of queries go down a tree together. In the top as in the trees a child
is skipped for a query if the distance bound exceeds ``factor`` times the distance of its k-th best so far.
Factor 1 skips only what can't matter, so the search is exact; smaller factors skip more.

Inner products are taken in double precision on the original vectors, for each pair in the same
order of summation, so equal vectors tie, and ties go to the smaller id.

Defined cases: null ids, and vectors that are null, zero or hold null or non-finite components,
take no part; of rows that repeat an id the smallest vector counts; vectors are compared with
those of their own length only; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.stored import stored

SHARD_ROWS, BLOCK_ROWS, LEAF = 16_384, 4_096, 128
#: Vectors of each length that the top is fitted on, and its shards at most: beyond, shards get more parts.
TOP_SAMPLE, MOST_SHARDS = 8_192, 16_384
#: Below 1 the search prunes more than is safe.
FACTOR = 0.9


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v, size) of the vectors that take part, one per id."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL")
    rows = rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))


class Top:
    """A vantage-point tree of ``depth`` levels over all candidates; its leaves are the shards. Children of node i: 2i + 1, 2i + 2."""

    def __init__(self, points: np.ndarray, norm: float, depth: int) -> None:
        self.depth, self.inner, self.norm = depth, 2**depth - 1, norm
        self.points = np.zeros((self.inner, points.shape[1] if points.ndim == 2 else 0))
        self.lifts, self.radius = np.zeros(self.inner), np.full(self.inner, np.inf)
        rng = np.random.Generator(np.random.PCG64(len(points)))
        lifts = self.lift(points)
        held: dict[int, np.ndarray] = {0: np.arange(len(points))}
        for node in range(self.inner):
            rows = held.pop(node)
            if len(rows):
                vantage = rows[rng.integers(len(rows))]
                self.points[node], self.lifts[node] = points[vantage], lifts[vantage]
                apart = self.apart(node, points[rows], lifts[rows])
                self.radius[node] = np.median(apart)
                near = apart <= self.radius[node]
                held[2 * node + 1], held[2 * node + 2] = rows[near], rows[~near]
            else:
                held[2 * node + 1] = held[2 * node + 2] = rows
        # least and largest distance of the members of both children, once known
        self.low, self.high = np.full((self.inner, 2), np.inf), np.full((self.inner, 2), -np.inf)

    def lift(self, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm - (points**2).sum(1), 0)) if len(points) else np.empty(0)

    def apart(self, node: int, points: np.ndarray, lifts: np.ndarray | float) -> np.ndarray:
        return np.sqrt(((points - self.points[node]) ** 2).sum(1) + (lifts - self.lifts[node]) ** 2)

    def route(self, points: np.ndarray, lifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard of each point, and its distances to the vantage points on the way."""
        at = np.zeros(len(points), np.int64)
        passed = np.empty((len(points), self.depth))
        for level in range(self.depth):
            for node in np.unique(at).tolist():
                rows = np.flatnonzero(at == node)
                passed[rows, level] = self.apart(node, points[rows], lifts[rows])
            at = 2 * at + 1 + (passed[:, level] > self.radius[at])
        return at - self.inner, passed

    def opened(self, queries: np.ndarray, limit: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, shard): the shards whose members can lie within the limit of a query."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        ahead = [(0, np.arange(len(queries)))]
        while ahead:
            node, rows = ahead.pop()
            if not len(rows):
                continue
            if node >= self.inner:
                found.append((rows, np.full(len(rows), node - self.inner)))
                continue
            apart = self.apart(node, queries[rows], 0.0)
            for side in (0, 1):
                bound = np.maximum(self.low[node, side] - apart, apart - self.high[node, side])
                ahead.append((2 * node + 1 + side, rows[bound <= limit[rows] * (1 + 1e-9) + slack[rows]]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


class Tree:
    """Points in tree order; nodes (first, last, vantage point, child, near low, near high, far low, far high)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, norm: float) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.points, self.norm = ids[order], points[order], norm
        self.lift = np.sqrt(np.maximum(norm - (self.points**2).sum(1), 0))
        self.nodes: list[tuple] = []
        self.rng = np.random.Generator(np.random.PCG64(len(ids)))
        place = np.arange(len(ids))
        self._build(place, 0)
        self.ids, self.points = self.ids[place], self.points[place]
        del self.rng, self.lift

    def _build(self, place: np.ndarray, first: int) -> int:
        """Orders ``place`` (a view) and returns the number of its node."""
        at = len(self.nodes)
        self.nodes.append(())
        if len(place) <= LEAF:
            place.sort()
            self.nodes[at] = (first, first + len(place), -1, -1, 0.0, 0.0, 0.0, 0.0)
            return at
        vantage = place[self.rng.integers(len(place))]
        apart = np.sqrt(((self.points[place] - self.points[vantage]) ** 2).sum(1) + (self.lift[place] - self.lift[vantage]) ** 2)
        order = np.argsort(apart, kind="stable")  # halves by rank: equal distances can't empty a side
        place[:] = place[order]
        apart = apart[order]
        half = len(place) // 2
        point, lift = self.points[vantage].copy(), self.lift[vantage]
        self._build(place[:half], first)
        far = self._build(place[half:], first + half)
        self.nodes[at] = (first, first + len(place), (point, lift), far, apart[0], apart[half - 1], apart[half], apart[-1])
        return at


class Search:
    """The k best of one tree for a block of queries, of those that score ``floor`` or more."""

    def __init__(self, tree: Tree, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, factor: float) -> None:
        self.tree, self.own, self.queries, self.floor, self.k, self.factor = tree, ids, queries, floor, k, factor
        self.reach = (queries**2).sum(1) + tree.norm
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.visit(0, np.arange(len(ids)))

    def distance(self, rows: np.ndarray) -> np.ndarray:
        worst = np.maximum(self.score[rows, -1], self.floor[rows])
        return np.where(np.isfinite(worst), np.sqrt(np.maximum(self.reach[rows] - 2 * worst, 0)), np.inf)

    def open(self, rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return rows[bound <= self.distance(rows) * self.factor * (1 + 1e-9) + 1e-9 * np.sqrt(self.reach[rows])]

    def visit(self, at: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        first, last, vantage, far, near_low, near_high, far_low, far_high = self.tree.nodes[at]
        if far < 0:
            self.leaf(first, last, rows)
            return
        # the queries' further coordinate is 0, so the vantage point's own one is part of its norm
        point, lift = vantage
        apart = np.sqrt(np.maximum(((self.queries[rows] - point) ** 2).sum(1) + lift**2, 0))
        near_bound = np.maximum(0, np.maximum(near_low - apart, apart - near_high))
        far_bound = np.maximum(0, np.maximum(far_low - apart, apart - far_high))
        closer = near_bound <= far_bound
        self.visit(at + 1, self.open(rows[closer], near_bound[closer]))
        self.visit(far, self.open(rows[~closer], far_bound[~closer]))
        self.visit(far, self.open(rows[closer], far_bound[closer]))
        self.visit(at + 1, self.open(rows[~closer], near_bound[~closer]))

    def leaf(self, first: int, last: int, rows: np.ndarray) -> None:
        points, ids = self.tree.points[first:last], self.tree.ids[first:last]
        rough = self.queries[rows] @ points.T
        rough[self.own[rows][:, None] == ids[None, :]] = -np.inf
        slack = 1e-9 * (self.reach[rows] + 1)
        worst = np.maximum(self.score[rows, -1], self.floor[rows])
        q, p = np.nonzero((rough >= (worst - slack)[:, None]) & np.isfinite(rough))
        if not len(q):
            return
        exact = (self.queries[rows[q]] * points[p]).sum(1)  # summed alike for every pair
        touched, where = np.unique(q, return_inverse=True)
        count = np.bincount(where)
        column = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
        score = np.full((len(touched), self.k + count.max()), -np.inf)
        found = np.full(score.shape, np.iinfo(np.int64).max)
        held = rows[touched]
        score[:, : self.k], found[:, : self.k] = self.score[held], self.found[held]
        score[where, self.k + column], found[where, self.k + column] = exact, ids[p]
        order = np.lexsort((found, -score), axis=1)[:, : self.k]
        self.score[held] = np.take_along_axis(score, order, 1)
        self.found[held] = np.take_along_axis(found, order, 1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def fitted(candidates: DataFrame, shard_rows: int) -> dict[int, Top]:
    """The top for each vector length, from a bounded sample; with one shard there is nothing to fit."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    plan = candidates.groupBy("size").agg(F.count("*").alias("n"), (F.max(norm) * (1 + 1e-12)).alias("norm")).collect()
    tops = {}
    for row in plan:
        shards = min(MOST_SHARDS, -(-row.n // shard_rows))
        depth = (shards - 1).bit_length()
        points = []
        if depth:
            # about twice the sample lies below this hash
            order, below = F.xxhash64("vec_id"), int((min(1.0, 2 * TOP_SAMPLE / row.n) - 0.5) * 2**64)
            near = candidates.filter((F.col("size") == row.size) & (order < min(below, 2**63 - 1)))
            points = [r.v for r in near.orderBy(order, "vec_id").limit(TOP_SAMPLE).select("v").collect()]
        tops[row["size"]] = Top(np.array(points, float).reshape(len(points), row["size"]), row.norm, depth)
    return tops


def nearest(candidates: DataFrame, queries: DataFrame, k: int, factor: float = FACTOR,
            shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for every query. Both: (vec_id, v, size)."""
    candidates, queries = stored(candidates), stored(queries)
    tops = fitted(candidates, shard_rows)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                top, points = tops[size], _matrix(part["v"])
                shard, passed = top.route(points, top.lift(points))
                yield part.assign(shard=shard, passed=list(passed))

    members = stored(candidates.mapInPandas(dealt, "vec_id long, v array<double>, size int, shard long, passed array<double>"))
    # the nodes on the way to a shard follow from its number
    for top_size, top in tops.items():
        for level in range(top.depth):
            child = F.shiftright(F.col("shard") + top.inner + 1, top.depth - level - 1) - 1
            ranges = members.filter(F.col("size") == top_size).groupBy(child.alias("child")).agg(
                F.min(F.get("passed", F.lit(level))).alias("low"), F.max(F.get("passed", F.lit(level))).alias("high"))
            for row in ranges.collect():  # at most MOST_SHARDS rows
                top.low[(row.child - 1) // 2, (row.child - 1) % 2], top.high[(row.child - 1) // 2, (row.child - 1) % 2] = row.low, row.high

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(part["vec_id"].to_numpy(), _matrix(part["v"]), tops[key[0]].norm)
        return pd.DataFrame({"size": [key[0]], "shard": [key[1]], "part": [key[2]], "tree": [pickle.dumps(vars(tree))]})

    def gather(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("query_id")
        held = pickle.dumps((part["query_id"].to_numpy(), _matrix(part["q"]), part["floor"].to_numpy()))
        return pd.DataFrame({"size": [key[0]], "shard": [key[1]], "block": [key[2]], "queries": [held]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree, block in zip(batch["tree"], batch["queries"], strict=True):
                ids, points, floor = pickle.loads(block)
                index = Tree.__new__(Tree)
                vars(index).update(pickle.loads(tree))
                done = Search(index, ids, points, floor, k, factor)
                real = np.isfinite(done.score)
                yield pd.DataFrame({"query_id": np.repeat(ids, real.sum(1)), "vec_id": done.found[real], "score": done.score[real]})

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                if size in tops:
                    points = _matrix(part["v"])
                    shard, _ = tops[size].route(points, np.zeros(len(points)))
                    yield pd.DataFrame({"query_id": part["vec_id"], "q": part["v"], "size": size, "shard": shard, "floor": -np.inf})

    def elsewhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                top, points = tops[size], _matrix(part["q"])
                reach = (points**2).sum(1) + top.norm
                floor = part["worst"].to_numpy(float, na_value=-np.inf)
                limit = np.where(np.isfinite(floor), np.sqrt(np.maximum(reach - 2 * floor, 0)), np.inf) * factor
                row, shard = top.opened(points, limit, 1e-9 * np.sqrt(reach))
                other = shard != part["shard"].to_numpy()[row]
                row, shard = row[other], shard[other]
                yield pd.DataFrame({
                    "query_id": part["query_id"].to_numpy()[row], "q": part["q"].to_numpy()[row], "size": size, "shard": shard, "floor": floor[row]})

    def parts_of(rows: DataFrame, key: str, most: int, name: str) -> DataFrame:
        """Rows of a shard dealt into parts of bounded size."""
        plan = rows.groupBy("size", "shard").agg(F.ceil(F.count("*") / most).alias("parts"))
        return rows.join(plan, ["size", "shard"]).withColumn(name, F.pmod(F.xxhash64(key), F.col("parts")).cast("long")).drop("parts")

    trees = stored(parts_of(members, "vec_id", shard_rows, "part").groupBy("size", "shard", "part").applyInPandas(
        build, "size int, shard long, part long, tree binary"))

    def asked(asks: DataFrame) -> DataFrame:
        """What the trees of the asked shards find: each block of queries meets the parts of its shard."""
        blocks = parts_of(asks, "query_id", block_rows, "block").groupBy("size", "shard", "block").applyInPandas(
            gather, "size int, shard long, block long, queries binary")
        return stored(trees.join(blocks, ["size", "shard"]).select("tree", "queries").mapInPandas(search, "query_id long, vec_id long, score double"))

    ask = "query_id long, q array<double>, size int, shard long, floor double"
    first = stored(queries.mapInPandas(home, ask))
    found = asked(first)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    if any(top.depth for top in tops.values()):
        worst = ranked(found).filter(F.col("rank") == k).select("query_id", F.col("score").alias("worst"))
        found = found.unionByName(asked(stored(first.join(worst, "query_id", "left").mapInPandas(elsewhere, ask))))
    return ranked(found).select("query_id", "rank", "vec_id", "score")
