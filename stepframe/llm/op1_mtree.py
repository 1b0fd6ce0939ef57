"""Exact top-k search by inner product with M-trees and best-first search.

Vectors get one more coordinate, sqrt(M - |x|^2), where M is the largest squared norm; a query gets 0 there. Then the squared
Euclidean distance is |q|^2 + M - 2 q.x, so nearest means the highest inner product, and the triangle inequality holds.

Rows go to the nearest of at most ``PIVOTS`` pivots (a bounded sample by hash); a pivot's cell is dealt by hash into pages of
about ``PAGE`` rows, so a vector that a third of all rows share is spread over many pages. Each page holds an M-tree in paged
nodes: routing objects with covering radius and distance to the parent, leaves with the distance to their routing object.
A query first searches one page of its nearest pivot for a bound on its k-th score; then each block of ``TOGETHER`` queries meets
each page, and its queries visit the pages of all pivots whose ball can still hold a score as high; what they find in a task
bounds the rest of it. Blocks and pages are read side by side: neither is copied through a shuffle or to the driver. In a page, nodes are taken
best first, and entries are passed over where stored parent distances already exclude them. Bounds have
a relative slack and ties are never excluded; scores are whole numbers.

Vectors null, without an id, or holding null or non-finite components, take no part; shorter ones are filled with zeros. Scaled
components are kept whole; a vector whose squared norm, and so a score, could pass 64 bits raises OverflowError. Ties go to the smaller id; repeated ids are separate rows, of which a query excludes its own id.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepframe.llm.shared import ship, stored

PIVOTS = 256
PAGE = 2048
LEAF = 64
FANOUT = 16
SLACK = 1e-9
#: Squared norms stay under this, with room for rounding: no inner product passes int64.
MOST = 2.0**63 * (1 - 1e-6)
#: Queries that visit a page together.
TOGETHER = 1024
#: No score.
NONE = np.iinfo(np.int64).min


def scaled(vectors: DataFrame, key: str, column: str, scale: int) -> DataFrame:
    """vec_id, v (binary of int64), norm, dims for the vectors that take part."""
    ship(vectors.sparkSession)
    kind = "array<double>"
    good = F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast(kind).alias("e")).where(good)

    def run(batches):
        for b in batches:
            lists = b.column(1)
            whole = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
            if any(float(whole[s:e] @ whole[s:e]) >= MOST for s, e in zip(starts, ends, strict=True)):
                raise OverflowError("an embedding is too long for scores of 64 bits")
            ints = whole.astype(np.int64)
            parts = [ints[s:e] for s, e in zip(starts, ends, strict=True)]
            cols = [b.column(0), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([int(p @ p) for p in parts], pa.int64()), pa.array((ends - starts).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "v", "norm", "dims"])

    return rows.mapInArrow(run, "vec_id long, v binary, norm long, dims int")


def matrix(raw, dims: int) -> np.ndarray:
    """Vectors as rows, filled with zeros up to ``dims``."""
    raw = [bytes(x) for x in raw]
    if all(len(x) == 8 * dims for x in raw):
        return np.frombuffer(b"".join(raw), np.int64).reshape(len(raw), dims)
    out = np.zeros((len(raw), dims), np.int64)
    for i, x in enumerate(raw):
        out[i, : len(x) // 8] = np.frombuffer(x, np.int64)
    return out


class MTree:
    """One page. Distances are in the space with the added coordinate."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: int):
        self.most, self.exact = most, float(most) < 2.0**51
        norms = (vectors * vectors).sum(1)
        self.full = np.column_stack([vectors.astype(np.float64), np.sqrt(np.maximum(0.0, float(most) - norms.astype(np.float64)))])
        self.order: list[np.ndarray] = []
        self.nodes: list[tuple] = []  # (leaf, routing rows or members, radii, parent or own distances, children)
        self.ids, self.vectors = ids, vectors
        everything = np.arange(len(ids))
        self.root = int(everything[0])
        self.root_node = self._build(everything, self._apart(everything, self.root))
        del self.full

    def _apart(self, rows: np.ndarray, to: int) -> np.ndarray:
        diff = self.full[rows] - self.full[to]
        return np.sqrt((diff * diff).sum(1))

    def _build(self, rows: np.ndarray, apart: np.ndarray) -> int:
        if len(rows) <= LEAF:
            self.nodes.append((True, rows, None, apart, None))
            return len(self.nodes) - 1
        n = min(FANOUT, -(-len(rows) // LEAF))
        seeds = rows[np.argsort(apart, kind="stable")[np.linspace(0, len(rows) - 1, n).astype(int)]]
        far = np.stack([self._apart(rows, int(s)) for s in seeds])
        mine = far.argmin(0)
        if np.bincount(mine, minlength=n).max() == len(rows):  # equal vectors
            mine = np.arange(len(rows)) * n // len(rows)
        routing, radii, parents, children = [], [], [], []
        for c in range(n):
            own = np.flatnonzero(mine == c)
            if len(own):
                d = far[c, own]
                routing.append(seeds[c])
                radii.append(d.max())
                parents.append(apart[np.flatnonzero(rows == seeds[c])[0]])
                children.append(self._build(rows[own], d))
        self.nodes.append((False, np.array(routing), np.array(radii), np.array(parents), children))
        return len(self.nodes) - 1

    def scores(self, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """A row for each query."""
        if self.exact:
            return (queries.astype(np.float64) @ self.vectors[rows].astype(np.float64).T).astype(np.int64)
        return queries @ self.vectors[rows].T

    def search(self, query: np.ndarray, own_id: int, k: int, least: int | None) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id) with scores from ``least`` up, and how many inner products were computed."""
        best = Best(1, k, np.array([NONE if least is None else least]))
        _, scores, ids, computed = self.search_all(query[None], np.array([own_id]), best)
        turn = np.lexsort((ids, -scores))[:k]
        return list(zip(scores[turn].tolist(), ids[turn].tolist(), strict=True)), computed

    def search_all(self, queries: np.ndarray, own_ids: np.ndarray, best: Best, rows_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Best-first for a block of queries, which share the visit of a node as far as each may still need it: query number, score and id of
        what can be among the best, and how many inner products were computed. ``rows_of``: the queries' places in ``best``."""
        place = np.arange(len(queries)) if rows_of is None else rows_of
        sq = (queries * queries).sum(1).astype(np.float64) + float(self.most)
        scale = np.sqrt(sq) * SLACK + SLACK

        def far(s: np.ndarray, who: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0.0, sq[who][:, None] - 2.0 * s.astype(np.float64)))

        def reach(who: np.ndarray) -> np.ndarray:
            floor = best.floor[place[who]]
            return np.where(floor == NONE, np.inf, far(floor[:, None], who)[:, 0] * (1 + SLACK) + SLACK) + scale[who]

        everyone, found, computed = np.arange(len(queries)), [], len(queries)
        start = far(self.scores(np.array([self.root]), queries), everyone)[:, 0]
        heap, pushed = [(0.0, 0, self.root_node, everyone, np.zeros(len(queries)), start)], 0
        while heap:
            _, _, at, who, bound, d = heapq.heappop(heap)
            limit = reach(who)
            if not (ok := bound <= limit).all():
                who, bound, d, limit = who[ok], bound[ok], d[ok], limit[ok]
            if not len(who):
                continue
            leaf, rows, radii, apart, children = self.nodes[at]
            low = np.abs(d[:, None] - apart[None])
            if leaf:
                may = (low <= limit[:, None]) & (self.ids[rows][None] != own_ids[who][:, None])
                if not (used := may.any(0)).all():
                    rows, may = rows[used], may[:, used]
                if not len(rows):
                    continue
                computed += int(may.sum())
                s = self.scores(rows, queries[who])
                may &= s >= best.floor[place[who]][:, None]
                q, r = np.nonzero(may)
                if len(q):
                    found.append((who[q], s[q, r], self.ids[rows[r]]))
                    own = np.flatnonzero(may.any(1))
                    best.add(place[who[own]], np.where(may[own], s[own], NONE))
                continue
            may = low - radii[None] <= limit[:, None]
            computed += int(may.sum())
            away = far(self.scores(rows, queries[who]), who)
            for c in np.flatnonzero(may.any(0)).tolist():
                under = np.maximum(bound, away[:, c] - radii[c])
                if (ok := may[:, c] & (under <= limit)).any():
                    pushed += 1
                    heapq.heappush(heap, (float(under[ok].min()), pushed, children[c], who[ok], under[ok], away[ok, c]))
        if not found:
            return (np.empty(0, np.int64),) * 3 + (computed,)
        q, s, i = (np.concatenate(x) for x in zip(*found, strict=True))
        ok = s >= best.floor[place[q]]
        return q[ok], s[ok], i[ok], computed


class Best:
    """The k highest scores that each of a block of queries has met, and the score below which nothing counts (ties do)."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.top, self.floor = k, np.full((n, k), NONE), least.astype(np.int64).copy()

    def add(self, who: np.ndarray, scores: np.ndarray) -> None:
        both = np.concatenate([self.top[who], scores], 1)
        self.top[who] = np.partition(both, both.shape[1] - self.k, 1)[:, -self.k :]
        self.floor[who] = np.maximum(self.floor[who], self.top[who].min(1))


def top_k(vectors: DataFrame, k: int, every: int, key: str = "vec_id", column: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, the k highest inner products with other rows."""
    spark = vectors.sparkSession
    rows = stored(scaled(vectors, key, column, scale), "vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, most, dims = rows.agg(F.count("*"), F.max("norm"), F.max("dims")).first()
    if not n:
        return empty
    dims = max(dims, 1)
    sample = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(PIVOTS, n // (PAGE // 2)))).collect()
    centres = matrix([r.v for r in sample], dims)
    lift = lambda v: np.column_stack([v.astype(np.float64), np.sqrt(np.maximum(0.0, float(most) - (v * v).sum(1).astype(np.float64)))])
    high = lift(centres)
    high_sq = (high * high).sum(1)

    def to_pivots(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + high_sq[None] - 2 * x @ high.T))

    def near(batches):
        for b in batches:
            far = to_pivots(lift(matrix(b.column(1).to_pylist(), dims)))
            pivot = far.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(len(pivot)), pivot])], ["vec_id", "v", "pivot", "far"])

    dealt = stored(rows.select("vec_id", "v").mapInArrow(near, "vec_id long, v binary, pivot int, far double"), "cells")
    cells = {r.pivot: (-(-r.n // PAGE), r.far) for r in dealt.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # at most PIVOTS
    table = spark.createDataFrame([(p, m) for p, (m, _) in cells.items()], "pivot int, pages int")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = MTree(pdf["vec_id"].to_numpy(np.int64), matrix(pdf["v"], dims).copy(), most)
        return pd.DataFrame({"pivot": pdf["pivot"].iloc[:1].to_numpy(), "page": pdf["page"].iloc[:1].to_numpy(), "tree": [pickle.dumps(tree)]})

    paged = dealt.join(F.broadcast(table), "pivot").withColumn("page", F.pmod(F.xxhash64("vec_id", "v"), F.col("pages")).cast("int"))
    trees = stored(paged.select("vec_id", "v", "pivot", "page").groupBy("pivot", "page").applyInPandas(build, "pivot int, page int, tree binary"), "m-trees")

    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v")
    radius = np.full(len(centres), -np.inf)
    for p, (_, far) in cells.items():
        radius[p] = far

    def packed(b, own):
        """Ids, vectors and bounds of queries in one binary."""
        least = [NONE if x is None else x for x in b.column(2).take(own).to_pylist()] if b.num_columns > 2 else [NONE] * len(own)
        return pickle.dumps((b.column(0).take(own).to_numpy(zero_copy_only=False), matrix(b.column(1).take(own).to_pylist(), dims), np.array(least, np.int64)))

    def first(batches):
        for b in batches:
            v = matrix(b.column(1).to_pylist(), dims)
            far = np.where(np.isinf(radius), np.inf, to_pivots(np.column_stack([v, np.zeros(len(v))])))
            pivot = far.argmin(1)
            for p in np.unique(pivot):
                own = np.flatnonzero(pivot == p)
                for at in range(0, len(own), TOGETHER):
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([0], pa.int32()), pa.array([packed(b, pa.array(own[at : at + TOGETHER]))], pa.binary())], ["pivot", "page", "queries"])

    def together(batches):
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                yield pa.RecordBatch.from_arrays([pa.array([packed(b, pa.array(range(at, min(at + TOGETHER, b.num_rows))))], pa.binary())], ["queries"])

    def search(batches):
        # what a block's queries have met in this task's pages so far is a bound in the next ones
        held: dict[bytes, Best] = {}
        raw = t = None
        for b in batches:
            for pivot, tree, block in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if raw is None or not tree.as_buffer().equals(raw):
                    raw = tree.as_buffer()
                    t = pickle.loads(raw)
                ids, v, least = pickle.loads(block.as_buffer())
                name = hashlib.blake2b(block.as_buffer(), digest_size=16).digest()
                best = held.setdefault(name, Best(len(ids), k, least))
                sq = (v * v).sum(1).astype(np.float64)
                away = np.sqrt(np.maximum(0.0, sq + high_sq[pivot] - 2 * v @ high[pivot, :-1]))
                reach = np.where(best.floor == NONE, np.inf, np.sqrt(np.maximum(0.0, sq + float(most) - 2.0 * best.floor)))
                own = np.flatnonzero(away - radius[pivot] <= reach + np.sqrt(sq + float(most)) * 1e-6 + 1e-3)
                if not len(own):
                    continue
                q, s, i, _ = t.search_all(v[own], ids[own], best, own)
                turn = np.lexsort((i, -s, q))
                q, s, i = q[turn], s[turn], i[turn]
                ok = np.arange(len(q)) - np.searchsorted(q, q) < k
                yield pa.RecordBatch.from_arrays([pa.array(ids[own[q[ok]]]), pa.array(i[ok]), pa.array(s[ok])], ["query_id", "vec_id", "score"])

    found = "query_id long, vec_id long, score long"

    # Spark can't tell how much the functions above put out and would take it for small, so it is told never to broadcast it
    tried = trees.join(queries.mapInArrow(first, "pivot int, page int, queries binary").hint("merge"), ["pivot", "page"])
    tries = tried.select("pivot", "tree", "queries").mapInArrow(search, found)
    met = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    tries = tries.withColumn("rank", F.row_number().over(met)).where(F.col("rank") <= k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    bounded = stored(queries.join(tries.hint("merge"), queries.vec_id == tries.query_id, "left").select("vec_id", "v", "least"), "bounds")
    blocks = stored(bounded.mapInArrow(together, "queries binary"), "query-blocks")
    pairs = trees.crossJoin(blocks.hint("shuffle_replicate_nl")).select("pivot", "tree", "queries")
    ranked = pairs.mapInArrow(search, found).withColumn("rank", F.row_number().over(met))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
