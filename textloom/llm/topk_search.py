"""Exact top-k inner products by no-random-access aggregation.

For a query, each dimension is a list of the candidates sorted by what they contribute. The lists are
read from their tops, all to the same depth. A candidate's lower bound adds the least value of every list
that it was not yet met in, its upper bound the last value read there. Reading stops when the k-th best
lower bound passes the upper bound of every other candidate, met or not; for those that may still be among
the best, what the lists hold further down is added up, which gives their final scores.

Many queries read the lists of a block together: to a depth, a list is a column whose unread places hold
its bound, so bounds of all queries and candidates are products of matrices. They are kept in floating
point, widened by its largest rounding error; final scores are sums of integers.

Defined results
---------------
* Components are quantised to floor(scale * x), x as a double; scores are exact integers, and end at the
  limits of a long where the sum lies beyond these.
* Vectors that are null, or hold a null or a component that is not finite, take no part, nor do rows
  without an id; they get no row. Vectors of another length than the query's are no candidates.
* A query is not its own candidate: rows with its id are left out. Rows that agree in id and vector
  count once; under one id with several vectors, each is a query and a candidate, and the result has
  the best of the id's queries for each candidate (a pair of ids appears once, with its best score).
* Ties go to the smaller id. Fewer than k candidates: all. An empty table gives an empty table.
* Other columns are never read, whatever their names.

At scale
--------
Queries and candidates are dealt to blocks by a hash of id and vector, so an id with very many vectors is
spread as well. A cell of the grid holds one block of either, of at most about ``BLOCK`` components, and
takes the candidates by parts; a query's k-th best score so far holds for the parts that follow. A row is sent
once for each block of the other side: queries are far fewer, so that is about once for a candidate. A
cell sends k rows a query; the best of all cells come from a grouped sort of those.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.lineage import checkpointed

#: Production parameters.
K, SCALE, EVERY = 5, 256, 50
#: Components of a block, about; candidates of a part; queries that read together.
BLOCK, PART, CHUNK = 1 << 22, 8192, 256
#: Shares of the lists that have been read when the bounds are compared; share of the candidates that is
#: resolved when no more are left; queries that try a depth before the others go there.
DEPTHS, RESOLVED, PILOT = (0.1, 0.4, 0.7, 0.85, 0.95, 1.0), 0.02, 8


class SortedLists:
    """The candidates of a part: of each dimension a list by value, to be read from either end."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.starts = np.flatnonzero(np.concatenate(([True], self.ids[1:] != self.ids[:-1])))
        self.n, self.dims = vectors.shape
        self.largest = np.abs(self.vectors.astype(np.float64)).max(axis=0)
        self.kind = np.float32 if not self.dims or self.largest.max() < 2.0**40 else np.float64
        self.values = self.vectors.astype(self.kind)
        self.lists = np.sort(self.values, axis=0)
        self.place = np.empty((self.n, self.dims), np.int32)
        np.put_along_axis(self.place, np.argsort(self.values, axis=0, kind="stable"), np.arange(self.n, dtype=np.int32)[:, None], axis=0)
        #: Entries of the lists that queries have read, and all.
        self.read, self.all = 0, 0
        self.columns: dict[int, tuple[np.ndarray, ...]] = {}

    def to(self, upto: int) -> tuple[np.ndarray, ...]:
        """The lists read from the high and from the low end: entries, or the bounds of unread ones."""
        if upto not in self.columns:
            met, v = self.place >= self.n - upto, self.values
            high = np.where(met, v, self.lists[0]), np.where(met, v, self.lists[self.n - upto])
            met = self.place < upto
            low = np.where(met, v, self.lists[-1]), np.where(met, v, self.lists[upto - 1])
            self.columns = {k: x for k, x in self.columns.items() if k > upto} | {upto: (*high, *low)}
        return self.columns[upto]

    def left(self, query_ids: np.ndarray, queries: np.ndarray, upto: int, k: int, known: np.ndarray) -> np.ndarray:
        """Which candidates may still be among the k best when that much of each list is read; ``known`` is
        a score that k other candidates are known to reach."""
        kind = self.kind if np.abs(queries).max(initial=0) < 2.0**40 else np.float64
        q = queries.astype(kind)
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        high_low, high_up, low_low, low_up = (x.astype(kind, copy=False) for x in self.to(upto))
        lower, upper = plus @ high_low.T + minus @ low_low.T, plus @ high_up.T + minus @ low_up.T
        error = (2 * self.dims + 16) * np.finfo(kind).eps * (np.abs(queries).astype(np.float64) @ self.largest)
        own = self.ids[None, :] == query_ids[:, None]
        lower[own], upper[own] = -np.inf, -np.inf
        if len(self.starts) < self.n:
            lower = np.maximum.reduceat(lower, self.starts, axis=1)
        kth = np.partition(lower, -k, axis=1)[:, -k].astype(np.float64) if k <= lower.shape[1] else np.full(len(q), -np.inf)
        return (upper >= (np.maximum(kth - error, known) - error)[:, None].astype(kind)) & ~own

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place of the query, id, score)`` of the k best candidates of each, and of others at most."""
        known = np.full(len(queries), -np.inf) if known is None else known
        open_, found = np.arange(len(queries)), []
        for depth in DEPTHS:
            upto = max(1, math.ceil(depth * self.n))
            pilot = open_[:PILOT]
            if upto < self.n and len(pilot) < len(open_):
                tried = self.left(query_ids[pilot], queries[pilot], upto, k, known[pilot])
                if tried.mean() > RESOLVED:
                    continue
            stays = self.left(query_ids[open_], queries[open_], upto, k, known[open_])
            done = (stays.mean(axis=1) <= RESOLVED) | (upto == self.n) | (stays.sum(axis=1) <= k)
            self.read += upto * int(np.count_nonzero(queries[open_[done]]))
            q, c = np.nonzero(stays[done])
            found.append((open_[done][q], c))
            open_ = open_[~done]
            if not len(open_):
                break
        self.all += self.n * int(np.count_nonzero(queries))
        q, c = (np.concatenate(x) for x in zip(*found))
        return q, self.ids[c], self.resolved(queries, q, c)

    def resolved(self, queries: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The final scores of candidates that are left."""
        most = float((np.abs(queries).astype(np.float64).max(axis=0, initial=0) * self.largest).sum())
        if most < 2.0**62:
            return np.concatenate([np.zeros(0, np.int64), *((queries[q[i : i + 65536]] * self.vectors[c[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536))])
        sums = (sum(a * b for a, b in zip(queries[i].tolist(), self.vectors[j].tolist())) for i, j in zip(q, c))
        return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in sums], np.int64)


def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k ids with the best scores, best first; of an id its best."""
    order = np.lexsort((~scores, ids, q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.concatenate((np.ones(min(1, len(q)), bool), (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])))
    q, ids, scores = q[first], ids[first], scores[first]
    order = np.lexsort((ids, ~scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    start = np.searchsorted(q, q)
    top = np.arange(len(q)) - start < k
    return q[top], ids[top], scores[top]


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query id, id, score)``: of each query the k best candidates of a cell, part by part."""
    out: list[tuple[np.ndarray, ...]] = []
    top: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3] * math.ceil(len(queries) / CHUNK)
    for i in range(0, len(ids), PART):
        lists = SortedLists(ids[i : i + PART], vectors[i : i + PART])
        for j, (q, c, s) in enumerate(top):
            own = slice(j * CHUNK, (j + 1) * CHUNK)
            known = np.full(len(queries[own]), -np.inf)
            full, last = np.unique(q[::-1], return_index=True)
            counts = np.bincount(q, minlength=len(known))
            known[full] = np.where(counts[full] >= k, s[::-1][last].astype(np.float64), -np.inf)
            more = lists.search(query_ids[own], queries[own], k, known)
            top[j] = best(*(np.concatenate(x) for x in zip((q, c, s), more)), k)
    for j, (q, c, s) in enumerate(top):
        out.append((query_ids[j * CHUNK + q], c, s))
    return tuple(np.concatenate(x) for x in zip(*out))


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, vector)`` of the rows that take part, each once; the vector as an array of longs."""
    vector = F.col(f"`{vector_col}`")
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = rows.where(F.col(f"`{id_col}`").isNotNull() & vector.isNotNull() & fits)
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return own.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("vector")).distinct()


def best_matches(candidates: DataFrame, queries: DataFrame | Column | None = None, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each query the k best candidates.

    ``queries`` is a table like ``candidates``, or a condition on the column ``id``; by default, ids
    divisible by ``EVERY``.
    """
    rows = checkpointed(quantised(candidates, id_col, vector_col, scale))
    if isinstance(queries, DataFrame):
        asked = checkpointed(quantised(queries, id_col, vector_col, scale))
    else:
        asked = rows.where(F.pmod("id", F.lit(EVERY)) == 0 if queries is None else queries)

    def count(table: DataFrame, least: int = 1) -> int:
        """Blocks of a table; ``least``, if it has parts for so many."""
        size = table.agg(F.count("*").alias("n"), F.sum(F.size("vector")).alias("all")).first()
        return max(1, math.ceil((size["all"] or 0) / BLOCK), min(least, math.ceil(size["n"] / (PART // 2))))

    n_rows, n_asked = count(rows, candidates.sparkSession.sparkContext.defaultParallelism), count(asked)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int")

    left = asked.select(block(n_asked).alias("q"), every(n_rows).alias("r"), F.lit(True).alias("asks"), "id", "vector")
    right = rows.select(every(n_asked).alias("q"), block(n_rows).alias("r"), F.lit(False).alias("asks"), "id", "vector")

    def search(key: tuple[pa.Scalar, ...], cell: pa.Table) -> pa.Table:
        asks, ids = (cell.column(c).to_numpy() for c in ("asks", "id"))
        vector = cell.column("vector").combine_chunks()
        ends, flat = vector.offsets.to_numpy(), vector.values.to_numpy()
        sizes = np.diff(ends)
        out = [(np.zeros(0, np.int64),) * 3]
        for size in np.unique(sizes[asks]).tolist():
            query, among = (np.flatnonzero(x & (sizes == size)) for x in (asks, ~asks))
            if len(among):
                of = lambda at: flat[ends[at][:, None] + np.arange(size)]  # noqa: B023, E731
                out.append(best_of(ids[query], of(query), ids[among], of(among), k))
        return pa.Table.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], names=["query_id", "vec_id", "score"])

    cells = left.union(right).groupBy("q", "r").applyInArrow(search, "query_id long, vec_id long, score long")
    pairs = cells.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
