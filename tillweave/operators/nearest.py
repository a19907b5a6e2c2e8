"""Exact nearest vectors for many queries: inverted cells with triangle bounds.

Vectors of length one are dealt to the cell of their nearest pivot and keep their distance to it. A query first meets its
own cell, and the k-th best score there bounds how far the rest may be: by the triangle inequality no vector is nearer than
the distance of its cell's pivot less the cell's radius, nor than the difference of both distances to the pivot. So
the query goes only to cells within reach, and there only to a slice of the vectors in order of their distances.

Both sides meet by (cell, part, block): parts of a cell and blocks of queries are of bounded size, so no cell, however
hot, is one task's, and a task keeps k rows per query. Pivots and one row per cell are all that reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillweave.session import stored

#: Pivots together, vectors of one part of a cell, and queries of one block hold at most so many bytes.
PIVOT_BYTES, PART_BYTES, BLOCK_BYTES = 1 << 25, 1 << 25, 1 << 23
#: Vectors that a cell should hold at least on average: fewer aren't worth a cell.
CELL_ROWS = 1024
#: What distances of rounded numbers may be off by.
SLACK = 1e-6


@dataclass
class Cells:
    """Stored vectors (id, vector, cell, part, far) with their pivots and per cell the number of parts and the radius."""

    rows: DataFrame
    pivots: np.ndarray
    parts: np.ndarray
    radius: np.ndarray


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of unit vectors; all rows have the same number of components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(pc.list_flatten(column), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return flat / np.sqrt((flat * flat).sum(1))[:, None]


def _usable(vector: str) -> Column:
    """Vectors with a direction: not null, no null or non-finite components, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def _far(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))


def build_cells(vectors: DataFrame, vector_id: str, embedding: str = "embedding") -> Cells | None:
    """The index of all usable vectors; None if there are none. Vectors of another dimension than most take no part."""
    rows = vectors.filter(_usable(embedding)).select(F.col(vector_id).alias("id"), F.col(embedding).alias("vector"))
    size = F.size("vector").alias("size")
    most = rows.groupBy(size).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    if most is None:
        return None
    dimension, n = most["size"], most.n
    many = max(1, min(math.isqrt(n), n // CELL_ROWS, PIVOT_BYTES // (8 * dimension)))
    rows = rows.filter(F.size("vector") == dimension)
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(many).select("vector").toArrow()
    pivots = _matrix(chosen["vector"])
    vector_type = dict(rows.dtypes)["vector"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dots = _matrix(batch.column(1)) @ pivots.T
            cell = dots.argmax(1)
            far = _far(dots[np.arange(len(cell)), cell])
            yield pa.record_batch([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], names=["id", "vector", "cell", "far"])

    dealt = rows.mapInArrow(assign, f"id {dict(rows.dtypes)['id']}, vector {vector_type}, cell int, far double")
    per_part = max(1, PART_BYTES // (8 * dimension))
    dealt = stored(dealt, "vector-cells")
    parts, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():
        parts[r.cell], radius[r.cell] = -(-r.n // per_part), r.far
    n_parts = F.get(F.lit(parts.tolist()), F.col("cell"))
    return Cells(dealt.withColumn("part", F.pmod(F.xxhash64("id"), n_parts).cast("int")), pivots, parts, radius)


def _best(scores: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    order = pc.sort_indices(pa.table({"s": -scores[some], "i": ids.take(pa.array(some))}), [("s", "ascending"), ("i", "ascending")])
    return some[np.asarray(order)[:k]]


def _search_cell(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Per query its k best of a part of a cell that lie within its reach, and a row without id that counts the scored ones."""
    order = np.argsort(np.asarray(vectors["far"]), kind="stable")
    far, ids = np.asarray(vectors["far"])[order], vectors["id"].combine_chunks().take(pa.array(order))
    units, asked = _matrix(vectors["vector"])[order], _matrix(queries["vector"])
    found_q, found_v, found_s, counts = [], [], [], []
    for i, (near, reach) in enumerate(zip(np.asarray(queries["far"]), np.asarray(queries["reach"]))):
        low, high = np.searchsorted(far, near - reach - SLACK, "left"), np.searchsorted(far, near + reach + SLACK, "right")
        counts.append(max(0, high - low))
        if high <= low:
            continue
        rough = units[low:high] @ asked[i]
        if len(rough) > k:
            some = np.flatnonzero(rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9)
        else:
            some = np.arange(len(rough))
        # Sums in one fixed order, so that equal vectors have equal scores.
        scores = (units[low + some] * asked[i]).sum(1)
        some += low
        best = _best(scores, ids.take(pa.array(some)), k)
        found_q += [i] * len(best)
        found_v += some[best].tolist()
        found_s += scores[best].tolist()
    query_ids, n = queries["query"].combine_chunks(), queries.num_rows
    rows = pa.table({"query": query_ids.take(pa.array(found_q, pa.int64())), "id": ids.take(pa.array(found_v, pa.int64())), "score": pa.array(found_s, pa.float64()), "scored": pa.nulls(len(found_q), pa.int64())})
    scored = pa.table({"query": query_ids, "id": pa.nulls(n, ids.type), "score": pa.nulls(n, pa.float64()), "scored": pa.array(counts, pa.int64())})
    return pa.concat_tables([rows, scored])


def search(cells: Cells, queries: DataFrame, query_id: str, embedding: str = "embedding", k: int = 10) -> DataFrame:
    """(query, id, score, scored): at least the k best ids of every query, and how many vectors were scored (id null)."""
    pivots, parts, radius = cells.pivots, cells.parts, cells.radius
    dimension, types = pivots.shape[1], dict(cells.rows.dtypes)
    asked = queries.filter(_usable(embedding) & (F.size(embedding) == dimension))
    asked = stored(asked.select(F.col(query_id).alias("query"), F.col(embedding).alias("vector")), "queries")
    id_type, vector_type = dict(asked.dtypes)["query"], dict(asked.dtypes)["vector"]
    blocks = max(1, -(-asked.count() // max(1, BLOCK_BYTES // (8 * dimension))))
    filled = np.flatnonzero(parts)

    def route(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                distance = _far(_matrix(batch.column(1)) @ pivots[filled].T)
                own, reach = distance.argmin(1), np.asarray(batch.column(2))
                if first:
                    row, at = np.arange(len(own)), own
                else:
                    within = distance - radius[filled] <= reach[:, None] + SLACK
                    within[np.arange(len(own)), own] = False
                    row, at = np.nonzero(within)
                n = parts[filled[at]]
                row, at = np.repeat(row, n), np.repeat(at, n)
                part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                for begin in range(0, len(row), 1000):
                    some = slice(begin, begin + 1000)
                    rows = batch.take(pa.array(row[some]))
                    yield pa.record_batch(
                        [*rows.columns, pa.array(distance[row[some], at[some]]), pa.array(filled[at[some]], pa.int32()), pa.array(part[some], pa.int32())],
                        names=["query", "vector", "reach", "far", "cell", "part"],
                    )

        return run

    schema = f"query {id_type}, vector {vector_type}, reach double, far double, cell int, part int"
    result = f"query {id_type}, id {types['id']}, score double, scored long"
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block")
    inside = cells.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(reaching: DataFrame, first: bool) -> DataFrame:
        routed = reaching.mapInArrow(route(first), schema).select("*", block)
        keys = ["cell", "part", "block"]
        # Only parts that a query asks for travel.
        wanted = inside.join(routed.select(*keys).distinct(), keys, "left_semi")
        return wanted.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(lambda v, q: _search_cell(v, q, k), result)

    own = stored(meet(asked.withColumn("reach", F.lit(float("inf"))), True), "own-cells")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
    kth = own.filter("id IS NOT NULL").withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == k)
    reach = kth.select("query", F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * F.col("score"))).alias("reach"))
    others = asked.join(reach, "query", "left").select("query", "vector", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    return own.unionByName(meet(others, False))
