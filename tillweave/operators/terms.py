"""Term vectors that any engine can make: terms are hashed by the first 32 bits of their MD5.

A vector has a place per bucket; a term counts for its bucket, weighed by how few texts have it. Making vectors is one pass
without a shuffle; fitting is one pass that sends a count per bucket and task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


@dataclass
class TermModel:
    """The text column a model was fitted on and the weight of each bucket."""

    text: str
    weights: np.ndarray


def terms(text: Column) -> Column:
    """Runs of letters and digits of any script, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _counts(lists: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of every bucket that a row's terms fall into."""
    words = pc.list_flatten(lists).dictionary_encode()
    of_word = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dimension for w in words.dictionary.to_pylist()], np.int64)
    bucket = of_word[np.asarray(words.indices)] if len(words) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
    pairs, n = np.unique(row * dimension + bucket, return_counts=True)
    return pairs // dimension, pairs % dimension, n


TERMS_AT_ONCE = 1 << 18


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, cut after some 262,144 terms of the last column, so memory is bounded by a text, not by a batch of long ones."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0)).astype(np.int64)
        starts = np.flatnonzero(np.diff((np.cumsum(lengths) - lengths) // TERMS_AT_ONCE, prepend=-1)).tolist()
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, end - start)


def fit_terms(df: DataFrame, text: str, dimension: int = 1536) -> TermModel:
    """Weights ``ln((n + 1) / (m + 1))`` of the buckets, m of all n texts having a term in it; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dimension + 1, np.int64)
        for batch in _pieces(batches):
            total[:dimension] += np.bincount(_counts(batch.column(0), dimension)[1], minlength=dimension)
            total[dimension] += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    sums = df.select(terms(F.col(text)).alias("t")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = dict(map(tuple, sums.collect()))  # a row per bucket at most
    return TermModel(text, np.array([math.log((found.get(dimension, 0) + 1) / (found.get(b, 0) + 1)) for b in range(dimension)]))


def term_vectors(model: TermModel, df: DataFrame, out: str = "embedding") -> DataFrame:
    """Adds vectors of length one; all zeros for a text without a term that weighs anything. Other columns are kept."""
    weights, dimension = model.weights, len(model.weights)
    rest = [f for f in df.schema if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            row, bucket, n = _counts(batch.column(batch.num_columns - 1), dimension)
            dense = np.zeros((batch.num_rows, dimension))
            dense[row, bucket] = n * weights[bucket]
            length = np.sqrt((dense * dense).sum(1))
            dense /= np.where(length > 0, length, 1.0)[:, None]
            ends = pa.array(np.arange(batch.num_rows + 1) * dimension, pa.int32())
            yield pa.record_batch([*batch.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(dense.reshape(-1)))], names=names)

    names = [*(f"c{i}" for i in range(len(rest))), "vector"]
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rest)), "vector array<double>"])
    made = df.select(*[F.col(f"`{f.name}`").alias(n) for f, n in zip(rest, names)], terms(F.col(model.text)).alias("vector")).mapInArrow(run, schema)
    return made.select(*[F.col(n).alias(f.name) for f, n in zip(rest, names)], F.col("vector").alias(out))
