"""Exact top-k inner-product search with a ball tree per shard.

Rows are dealt at random into shards of bounded size.  A shard's task builds one ball tree and
answers the queries that stream past it in blocks by branch and bound: nodes leave a heap in the
order of their inner-product upper bound ``q.c + |q| r`` and are skipped once that bound is below
the query's current k-th score.  Shards are searched in waves, each four times as many as all
before; the k-th scores found so far travel with the queries to the next wave, so that it starts
with a bound already in force.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
rows without an id; rows that repeat id and vector count once; a query id that occurs with several
vectors of one length asks with the first of them in the order of components; rows with the query's
id are its own; only vectors of equal length are compared; ties go to the smaller id; numbers of any
size are scored exactly, and a score beyond a long is given as the nearest long; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.llm.common import finite_vector, materialize, shard_by_shard, spread

FOUND = "query_id long, vec_id long, score long"
#: Below this product of magnitudes every partial sum of an inner product is exact in a double.
EXACT = float(2**53)
_LOWEST = np.iinfo(np.int64).min


def quantize(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) in double precision."""
    return np.floor(scale * vectors.astype(np.float64))


class BallTree:
    """Balanced ball tree over the rows of ``points`` (doubles)."""

    def __init__(self, points: np.ndarray, leaf: int = 64):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, end, left child, right child
        centers, radii = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            me = len(self.nodes)
            if parent >= 0:
                s, e, a, b = self.nodes[parent]
                self.nodes[parent] = (s, e, me, b) if side == 0 else (s, e, a, me)
            own = points[self.order[start:end]]
            center = own.mean(axis=0)
            away = np.sqrt(((own - center) ** 2).sum(axis=1))
            centers.append(center)
            radii.append(away.max())
            self.nodes.append((start, end, -1, -1))
            if end - start > leaf and radii[-1] > 0:
                far = own[away.argmax()]
                along = (own - far) @ (own[((own - far) ** 2).sum(axis=1).argmax()] - far)
                half = (end - start) // 2
                self.order[start:end] = self.order[start:end][np.argpartition(along, half)]
                todo += [(start, start + half, me, 0), (start + half, end, me, 1)]
        self.centers, self.radii = np.array(centers), np.array(radii)


def _merge(scores: np.ndarray, ids: np.ndarray, new_scores: np.ndarray, new_ids: np.ndarray, k: int):
    """The k best of each row by (score descending, id ascending)."""
    s = np.concatenate([scores, new_scores], axis=1)
    i = np.concatenate([ids, np.broadcast_to(new_ids, new_scores.shape)], axis=1)
    at = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, at, 1), np.take_along_axis(i, at, 1)


class Shard:
    """The rows of one shard, and their ball tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, scale: float, k: int, leaf: int = 64):
        self.scale, self.k, dim = scale, k, vectors.shape[1]
        with np.errstate(over="ignore"):
            points = quantize(vectors, scale)
        base = points if np.isfinite(points).all() else vectors
        # Of equal vectors only the k + 1 smallest ids can be among anyone's best.
        by = np.lexsort((ids, *base.T)) if dim else np.argsort(ids)
        ids, base = ids[by], base[by]
        new = np.ones(len(ids), bool)
        new[1:] = (base[1:] != base[:-1]).any(axis=1)
        again = np.zeros(len(ids), bool)
        again[1:] = ~new[1:] & (ids[1:] == ids[:-1])
        by, ids, new = by[~again], ids[~again], new[~again]
        first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        few = np.arange(len(ids)) - first <= k
        self.ids, self.vectors, self.points = ids[few], vectors[by[few]], points[by[few]]
        self.most = max(float(np.abs(self.points).max(initial=0)), 1.0)
        self.tree = BallTree(self.points, leaf) if self.most < EXACT else None

    def search(self, q_ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, block: int = 64):
        """(query ids, vec ids, scores) of each query's k best rows of the shard that reach its bound.

        ``bounds``: a k-th score known from elsewhere; rows below it can't be in the result.
        """
        with np.errstate(over="ignore"):
            queries = quantize(vectors, self.scale)
        biggest = self.most * max(float(np.abs(queries).max(initial=0)), 1.0)
        dim = max(vectors.shape[1], 1)
        if self.tree is None or not biggest * dim < EXACT:
            return self._wide(q_ids, vectors)
        tree, k = self.tree, self.k
        t_points, t_ids = self.points[tree.order], self.ids[tree.order]
        slack = 1e-9 * biggest * dim + 1e-6
        norms = np.sqrt((queries**2).sum(axis=1))
        out = []
        near = np.argsort(queries @ tree.centers[0], kind="stable")
        for at in range(0, len(q_ids), block):
            mine = near[at : at + block]
            q, own, norm = queries[mine], q_ids[mine], norms[mine]
            best = (np.full((len(mine), k), -np.inf), np.full((len(mine), k), np.iinfo(np.int64).max))
            kth = bounds[mine].astype(np.float64)

            def bound(node: int, rows: np.ndarray, q=q, norm=norm) -> np.ndarray:
                return q[rows] @ tree.centers[node] + norm[rows] * tree.radii[node] + slack

            everyone = np.arange(len(mine))
            heap = [(-float(bound(0, everyone).max()), 0, everyone)]
            while heap:
                _, node, rows = heapq.heappop(heap)
                rows = rows[bound(node, rows) >= kth[rows]]
                if not len(rows):
                    continue
                start, end, a, b = tree.nodes[node]
                if a >= 0:
                    for child in (a, b):
                        upper = bound(child, rows)
                        if (keep := upper >= kth[rows]).any():
                            heapq.heappush(heap, (-float(upper[keep].max()), child, rows[keep]))
                    continue
                scores = q[rows] @ t_points[start:end].T
                scores[t_ids[start:end] == own[rows][:, None]] = -np.inf
                scores[scores < kth[rows][:, None]] = -np.inf
                if (hit := np.isfinite(scores).any(axis=1)).any():
                    rows = rows[hit]
                    s, i = _merge(best[0][rows], best[1][rows], scores[hit], t_ids[start:end], k)
                    best[0][rows], best[1][rows] = s, i
                    kth[rows] = np.maximum(kth[rows], s[:, -1])
            got = np.isfinite(best[0])
            out.append((np.repeat(own, got.sum(axis=1)), best[1][got], best[0][got].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _wide(self, q_ids, vectors):
        """Components so large that doubles are inexact: whole numbers of any size, kept within a long."""
        out: list[tuple[int, int, int]] = []
        rows = [self._whole(p) for p in self.vectors]
        for own, v in zip(q_ids.tolist(), vectors, strict=True):
            q = self._whole(v)
            scored = [(-sum(a * b for a, b in zip(q, p, strict=True)), i) for i, p in zip(self.ids.tolist(), rows, strict=True) if i != own]
            out += [(own, i, min(max(-s, _LOWEST), 2**63 - 1)) for s, i in heapq.nsmallest(self.k, scored)]
        return tuple(np.array([x[n] for x in out], dtype=np.int64) for n in range(3))

    def _whole(self, vector) -> list[int]:
        return [math.floor(self.scale * x) if abs(x) < EXACT else math.floor(self.scale * int(x)) if self.scale % 1 else int(self.scale) * int(x) for x in vector.tolist()]


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def top_k(
    df: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    scale: float = 256.0,
    shard_rows: int = 4096,
    query_rows: int = 1024,
) -> DataFrame:
    """Columns query_id, rank, vec_id, score: the exact k best rows for each query row.

    ``is_query``: a condition on ``df``.  A task holds the about ``shard_rows`` rows of a shard at a
    time and searches ``query_rows`` queries at once, whatever the table's size.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), is_query.alias("asks")).filter(
        finite_vector("vec") & F.col("id").isNotNull()
    )
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    rows = rows.withColumn("dim", F.size("vec"))
    entries = rows.select("dim", F.pmod(F.xxhash64("id", "vec"), F.lit(shards)).alias("shard"), F.lit(False).alias("asks"), "id", "vec", F.lit(None).cast("long").alias("bound"))
    first = F.min(F.transform("vec", lambda x: x.cast("double"))).alias("vec")
    queries = rows.filter("asks").groupBy("id", "dim").agg(first).select("dim", "id", "vec")
    queries = materialize(queries, "topk-queries")
    entries = entries.withColumn("vec", F.transform("vec", lambda x: x.cast("double")))

    def build(t: pa.Table) -> Shard:
        return Shard(t.column("id").to_numpy(), _vectors(t.column("vec")), scale, k)

    def answer(index: Shard, part: pa.RecordBatch) -> pa.RecordBatch:
        found = [(np.zeros(0, np.int64),) * 3]
        q_ids, q_vectors, bounds = part.column("id").to_numpy(), _vectors(part.column("vec")), part.column("bound").to_numpy()
        for at in range(0, len(q_ids), query_rows):
            to = slice(at, at + query_rows)
            found.append(index.search(q_ids[to], q_vectors[to], bounds[to]))
        cols = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from shard_by_shard(batches, ("dim", "shard"), build, answer)

    def wave(asked: DataFrame, low: int, high: int) -> DataFrame:
        """The shards from low to high - 1 against all queries, which carry their bounds."""
        each = F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long"))).alias("shard")
        asked = asked.select("dim", each, F.lit(True).alias("asks"), "id", "vec", "bound")
        held = entries.filter((F.col("shard") >= low) & (F.col("shard") < high))
        return spread(held.unionByName(asked), high - low, "dim", "shard").mapInArrow(kernel, FOUND)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found, low = None, 0
    while low < shards:
        high = min(shards, max(1, 5 * low))
        bounded = queries.withColumn("bound", F.lit(_LOWEST).cast("long"))
        if found is not None:
            kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low")).filter(F.col("n") >= k)
            bounded = queries.join(kth.select(F.col("query_id").alias("id"), "low"), "id", "left")
            bounded = bounded.withColumn("bound", F.coalesce("low", F.lit(_LOWEST)))
        new = wave(bounded, low, high)
        new = new if found is None else new.unionByName(found.drop("rank"))
        best = new.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found = best.select("query_id", "rank", "vec_id", "score")
        if high < shards:
            found = materialize(found, "topk-wave")
        low = high
    return found
