"""Exact top-k inner products with vector-approximation files.

Rows are read in chunks. Each chunk keeps, besides its exact integer vectors, a cell of ``CELLS`` per dimension. The
cells' middles give every query a score that is off by at most a radius known from the cell widths; so a row's best
possible score needs no exact vector. The k rows with the highest bounds are read exactly, their kth score is a
threshold, and then only rows whose bound reaches it: what stays unread can't be among the first k. The threshold
carries over to the task's next chunks.

Queries are the stated set. They reach the workers in blocks of bounded size, each of which is one pass over the
rows; tasks send their k best per query, and a window that prunes before its shuffle merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

SCALE = 64
CELLS = 16
CHUNK_ROWS = 8192
#: Queries in one broadcast block, and those scored at once within a task.
BLOCK_QUERIES = 4096
LANE_QUERIES = 256


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) without null ids and vectors, and without those that hold null or non-finite components."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine
    )


def matrices(ids: pa.Array, lists: pa.Array, scale: int = SCALE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and integer vectors by dimension."""
    ids = np.asarray(ids, np.int64)
    ends = np.cumsum(np.asarray(lists.value_lengths(), np.int64)) if len(lists) else np.zeros(0, np.int64)
    sizes = np.diff(ends, prepend=0)
    flat = np.floor(scale * np.asarray(lists.flatten(), np.float64)).astype(np.int64)
    out = {}
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        at = (ends[rows] - d)[:, None] + np.arange(d)
        out[int(d)] = ids[rows], flat[at]
    return out


class Best:
    """The k best (score, id) so far of each query of one dimension."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def merge(self, q: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
        """Adds exact (query, score, id) triples."""
        touched = np.unique(q)
        q = np.concatenate([np.repeat(touched, self.k), q])
        score = np.concatenate([self.score[touched].ravel(), score])
        found = np.concatenate([self.found[touched].ravel(), found])
        order = np.lexsort((found, -score, q)) if len(q) and score.min() > np.iinfo(np.int64).min else np.lexsort((found, ~score, q))
        q, score, found = q[order], score[order], found[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = place < self.k
        self.score[q[best], place[best]], self.found[q[best], place[best]] = score[best], found[best]

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(ids):
            return
        low, high = rows.min(0), rows.max(0)
        width = np.maximum(1, -(-(high - low + 1) // CELLS))
        cell = ((rows - low) // width).astype(np.uint8)  # the approximation file of the chunk
        half = (width - 1) / 2
        middle = low + cell * width.astype(np.float64) + half
        for begin in range(0, len(self.ids), LANE_QUERIES):
            lane = np.arange(begin, min(begin + LANE_QUERIES, len(self.ids)))
            queries = self.queries[lane].astype(np.float64)
            radius = np.abs(queries) @ half
            bound = queries @ middle.T + (radius + 1e-9 * (np.abs(queries) @ np.abs(middle).max(0)) + 1e-6)[:, None]
            bound[self.ids[lane][:, None] == ids] = -np.inf
            k = min(self.k, len(ids))
            first = np.argpartition(-bound, k - 1, axis=1)[:, :k]
            exact = np.einsum("qkd,qd->qk", rows[first], self.queries[lane])
            own = np.take_along_axis(bound, first, 1) == -np.inf
            np.put_along_axis(bound, first, -np.inf, 1)
            q, at = np.nonzero(~own)
            self.merge(lane[q], exact[q, at], ids[first[q, at]])
            need = self.score[lane, -1].astype(np.float64)  # of what is known to be there, the kth
            q, at = np.nonzero(bound >= np.maximum(need, -1e300)[:, None])
            for cut in range(0, len(q), 1 << 16):
                a, b = q[cut : cut + (1 << 16)], at[cut : cut + (1 << 16)]
                self.merge(lane[a], np.einsum("nd,nd->n", rows[b], self.queries[lane[a]]), ids[b])


def query_blocks(queries: DataFrame, block: int = BLOCK_QUERIES) -> Iterator[pa.Table]:
    """Queries in blocks of about ``block`` rows, read one after the other."""
    blocks = max(1, -(-queries.count() // block))
    for i in range(blocks):
        yield queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toArrow()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): per query the k rows with the highest integer inner products, ties to smaller ids.

    Both tables have vec_id and embedding; other columns play no part. Components count as floor(scale * x), below
    2**31. Vectors that are null or hold null or non-finite components, and rows without an id, take no part; rows of
    another dimension than the query's aren't scored against it; a query's own id isn't its candidate. Repeated query
    rows are answered once by id and vector; repeated candidates each count. Empty tables give no rows.
    """
    rows, asked = usable(vectors), usable(queries).distinct()
    spark = rows.sparkSession
    rows = rows.coalesce(2 * spark.sparkContext.defaultParallelism)  # a task that reads more prunes more and sends less
    out = "query_id long, vec_id long, score long"
    parts = []
    for block in query_blocks(asked):
        shared = spark.sparkContext.broadcast(matrices(block["vec_id"].combine_chunks(), block["embedding"].combine_chunks(), scale))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {d: Best(ids, q, k) for d, (ids, q) in shared.value.items()}
            for batch in batches:
                for begin in range(0, batch.num_rows, CHUNK_ROWS):
                    part = batch.slice(begin, CHUNK_ROWS)
                    for d, (ids, x) in matrices(part.column(0), part.column(1), scale).items():
                        if d in best:
                            best[d].add(ids, x)
            for one in best.values():
                for begin in range(0, len(one.ids), LANE_QUERIES):
                    found = one.found[begin : begin + LANE_QUERIES]
                    q, at = np.nonzero(found != np.iinfo(np.int64).max)
                    columns = [one.ids[begin + q], found[q, at], one.score[begin + q, at]]
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

        parts.append(rows.mapInArrow(run, out))
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
