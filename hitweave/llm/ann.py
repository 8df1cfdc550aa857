"""Approximate nearest neighbours with an inverted multi-index.

The two halves of the vectors are quantised separately; a row's cell is its pair of centroids.  A
query walks the pairs in the order of summed distance (here: falling summed inner product) with a
heap, until the cells it has passed hold enough rows; the sum reached then is its bar.  The entries
of all cells above the bar are scored exactly.

Codebooks, and the share of rows a query must pass, are fitted on a bounded sample (``SAMPLE`` rows,
those with the smallest hashes): the share is what the sample's own nearest neighbours need for a
recall of ``RECALL``.  Every row is indexed.  Neighbouring cells are filed together in shards of
bounded size, a crowded cell in several; a query visits only the shards that hold a cell above its
bar, and streams past a shard's entries in blocks.  Of equal vectors a shard scores only the ids
that can be among the k nearest, and they count once against the share.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows without an id; rows that repeat id and vector count once; a query id that occurs with
several vectors of one length asks with the first of them in the order of components; rows with the
query's id are its own; each length of vectors has codebooks and an index of its own; ties go to the smaller id; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.llm.common import finite_vector, materialize, shard_by_shard, spread

SAMPLE = 16_384
#: Of the sample, so many rows are queries when the share is fitted.
ASKED = 256
CENTROIDS = 64
RECALL = 0.96
SHARD_ROWS = 4096
#: Walks of the pairs of centroids in a task.
QUERIES_A_TASK = 256


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """At most k centroids of ``points``."""
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centers = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        own = nearest(points, centers)
        total = np.zeros_like(centers)
        np.add.at(total, own, points)
        n = np.bincount(own, minlength=len(centers))
        centers[n > 0] = total[n > 0] / n[n > 0, None]
    return centers


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(axis=1)[None, :] - 2 * points @ centers.T).argmin(axis=1)


def pairs_by_sum(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Index pairs in the order of falling first[i] + second[j] (multi-sequence walk with a heap).

    The heap holds one pair of each row begun; a row begins when the row before it has given its first pair.
    """
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    rows, cols, a, b = (-first[a]).tolist(), (-second[b]).tolist(), a.tolist(), b.tolist()
    heap, last = [(rows[0] + cols[0], 0, 0)], len(cols) - 1
    while heap:
        _, i, j = heap[0]
        yield a[i], b[j]
        if j < last:
            heapq.heapreplace(heap, (rows[i] + cols[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if not j and i + 1 < len(rows):
            heapq.heappush(heap, (rows[i + 1] + cols[0], i + 1, 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed up in extended precision, so that equal vectors score alike everywhere."""
    out = np.zeros(len(a))
    for at in range(0, len(a), 4096):
        out[at : at + 4096] = (a[at : at + 4096].astype(np.longdouble) * b[at : at + 4096]).sum(axis=1)
    return out


def fitted_share(points: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int, recall: float = RECALL) -> float:
    """The share of rows that a query must pass so that ``recall`` of its k nearest are among them."""
    half, wide, n = books[0].shape[1], len(books[1]), len(points)
    cell = nearest(points[:, :half], books[0]) * wide + nearest(points[:, half:], books[1])
    held = np.bincount(cell, minlength=len(books[0]) * wide)
    places = []
    for q in range(min(ASKED, n)):
        scores = points @ points[q]
        scores[q] = -np.inf
        best = np.argpartition(-scores, min(k, n - 1))[: min(k, n - 1)] if n > 1 else np.zeros(0, int)
        sums = ((points[q, :half] @ books[0].T)[:, None] + (points[q, half:] @ books[1].T)[None, :]).ravel()
        order = np.argsort(-sums, kind="stable")
        passed = np.empty(len(order))
        passed[order] = np.cumsum(held[order])
        places.append(passed[cell[best]] / n)
    places = np.concatenate(places) if places else np.ones(1)
    return float(np.quantile(places, recall)) if len(places) else 1.0


def bar(first: np.ndarray, second: np.ndarray, held: list[list[int]], budget: float) -> float:
    """The summed inner product of the last pair of a walk that passes ``budget`` rows; -inf if there are fewer."""
    passed = 0
    for i, j in pairs_by_sum(first, second):
        passed += held[i][j]
        if passed >= budget:
            return float(first[i] + second[j]) - 1e-9
    return -np.inf


class Shard:
    """The entries of some cells, in their order."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, cells: np.ndarray, books, k: int):
        ids, points, cells = distinct_entries(ids, points, cells, k)
        by = np.argsort(cells, kind="stable")
        self.ids, self.points, self.books, self.k = ids[by], points[by], books, k
        self.own, self.count = np.unique(cells[by], return_counts=True)

    def search(self, q_ids: np.ndarray, queries: np.ndarray, bars: np.ndarray, block: int = 64):
        """(query ids, vec ids, scores) of each query's k best among the entries in cells above its bar."""
        half, wide, k = self.books[0].shape[1], len(self.books[1]), self.k
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(q_ids), block):
            q, own, bar_ = queries[at : at + block], q_ids[at : at + block], bars[at : at + block]
            first, second = q[:, :half] @ self.books[0].T, q[:, half:] @ self.books[1].T
            passed = first[:, self.own // wide] + second[:, self.own % wide] >= bar_[:, None]
            scores = q @ self.points.T
            scores[~np.repeat(passed, self.count, axis=1) | (self.ids[None, :] == own[:, None])] = -np.inf
            if scores.shape[1] > k:
                # what may tie with the k-th stays until exact scores and ids decide
                kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                kth = np.where(np.isfinite(kth), kth - 1e-12 * np.abs(kth) - 1e-12, -np.inf)
            else:
                kth = np.full(len(q), -np.inf)
            row, col = np.nonzero((scores >= kth[:, None]) & (scores > -np.inf))
            s, i = exact(q[row], self.points[col]), self.ids[col]
            order = np.lexsort((i, -s, row))
            row, s, i = row[order], s[order], i[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            out.append((own[row[rank < k]], i[rank < k], s[rank < k]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def filed(held: np.ndarray, shard_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first shard and its number of shards: neighbouring small cells share one, a crowded cell has several."""
    first, many = np.zeros(held.size, np.int64), np.ones(held.size, np.int64)
    shard, rows = 0, 0
    for cell, n in enumerate(held.ravel().tolist()):
        if rows and rows + n > shard_rows:
            shard, rows = shard + 1, 0
        first[cell], many[cell] = shard, max(1, -(-n // shard_rows))
        rows += n
        if many[cell] > 1:
            shard, rows = shard + int(many[cell]), 0
    return first, many


def distinct_entries(ids: np.ndarray, points: np.ndarray, cells: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without repeated rows, and of equal vectors only the k + 1 smallest ids: others are among nobody's k nearest."""
    by = np.lexsort((ids, *points.T))
    ids, points, cells = ids[by], points[by], cells[by]
    same = np.zeros(len(ids), bool)
    same[1:] = (points[1:] == points[:-1]).all(axis=1)
    again = same & (np.concatenate([[False], ids[1:] == ids[:-1]]))
    ids, points, cells, same = ids[~again], points[~again], cells[~again], same[~again]
    first = np.maximum.accumulate(np.where(~same, np.arange(len(ids)), 0))
    few = np.arange(len(ids)) - first <= k
    return ids[few], points[few], cells[few]


def search(
    df: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    centroids: int = CENTROIDS,
    share: float | None = None,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Columns query_id, rank, vec_id, score: the k nearest found for each query row, by inner product in doubles.

    ``share`` of the distinct vectors is passed by each query; by default it is fitted for the recall.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), is_query.alias("asks")).filter(
        finite_vector("vec") & F.col("id").isNotNull() & F.exists("vec", lambda x: x != 0)
    )
    sizes = sorted(r["dim"] for r in rows.groupBy(F.size("vec").alias("dim")).agg(F.count_if("asks").alias("asking")).filter("asking > 0").collect())
    if not sizes:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x.cast("double")))
    each = [_search_length(rows.filter(F.size("vec") == dim), dim, k, centroids, share, shard_rows) for dim in sizes]
    found = functools.reduce(DataFrame.unionByName, each)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_length(rows: DataFrame, dim: int, k: int, centroids: int, share: float | None, shard_rows: int) -> DataFrame:
    """Columns query_id, vec_id, score: candidates of each query among the rows (id, vec, asks), all of length dim."""
    half = max(1, dim // 2)
    sample = rows.select("vec", F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).toPandas()
    fitted = np.unique(np.stack(sample["vec"].to_numpy()).astype(np.float64), axis=0)
    fitted = fitted[np.random.default_rng(3).permutation(len(fitted))]
    books = kmeans(fitted[:, :half], centroids), kmeans(fitted[:, half:], centroids) if dim > half else np.zeros((1, 0))
    share = fitted_share(fitted, books, k) if share is None else share
    wide = len(books[1])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1))
            cell = nearest(v[:, :half], books[0]) * wide + nearest(v[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["id", "vec", "asks", "cell"])

    index = materialize(rows.mapInArrow(encode, "id long, vec array<double>, asks boolean, cell int"), "index")
    # At most centroids squared rows: a table that doesn't grow with the input.
    counts = index.groupBy("cell", F.xxhash64("vec").alias("v")).agg(F.count("*").alias("n")).groupBy("cell").agg(F.count("*").alias("n"), F.sum("n").alias("rows"))
    held, every = np.zeros((len(books[0]), wide), np.int64), np.zeros((len(books[0]), wide), np.int64)
    for cell, n, all_rows in counts.collect():
        held[cell // wide, cell % wide], every[cell // wide, cell % wide] = n, all_rows
    budget, weights = share * held.sum(), held.tolist()
    at, many = filed(every, shard_rows)
    shards = int((at + many).max())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1))
            first, second = v[:, :half] @ books[0].T, v[:, half:] @ books[1].T
            bars = np.array([bar(a, b, weights, budget) for a, b in zip(first, second, strict=True)])
            visits = []
            for a, b, low in zip(first, second, bars, strict=True):
                cells = np.flatnonzero(((a[:, None] + b[None, :] >= low) & (every > 0)).ravel())
                one = np.unique(at[cells])
                more = [np.arange(at[c], at[c] + many[c]) for c in cells[many[cells] > 1].tolist()]
                visits.append(np.unique(np.concatenate([one, *more])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bars), pa.array(visits, pa.list_(pa.int64()))], names=["id", "vec", "bar", "visits"])

    # few rows, each of which takes a while: a stated number of parts is not coalesced
    asking = index.filter("asks").groupBy("id").agg(F.min("vec").alias("vec"))
    n = asking.count()
    asked = asking.repartition(max(1, min(-(-n // QUERIES_A_TASK), 20_000)), F.col("id")).mapInArrow(walk, "id long, vec array<double>, bar double, visits array<long>")
    asked = materialize(asked, "asked")
    queries = asked.select(F.explode("visits").alias("shard"), F.lit(True).alias("asks"), "id", "vec", F.lit(None).cast("int").alias("cell"), "bar")
    table = rows.sparkSession.createDataFrame([(c, int(at[c]), int(many[c])) for c in np.flatnonzero(every.ravel()).tolist()], "cell int, first long, many long")
    entries = index.join(F.broadcast(table), "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("id", "vec"), F.col("many"))).alias("shard"), F.lit(False).alias("asks"), "id", "vec", "cell", F.lit(None).cast("double").alias("bar")
    )

    def build(t: pa.Table) -> Shard:
        return Shard(t.column("id").to_numpy(), _matrix(t.column("vec")), t.column("cell").to_numpy(), books, k)

    def answer(own: Shard, part: pa.RecordBatch) -> pa.RecordBatch:
        found = own.search(part.column("id").to_numpy(), _matrix(part.column("vec")), part.column("bar").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from shard_by_shard(batches, ("shard",), build, answer)

    return spread(entries.unionByName(queries), shards, "shard").mapInArrow(meet, "query_id long, vec_id long, score double")
