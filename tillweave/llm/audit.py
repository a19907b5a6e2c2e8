"""Filter interaction audit over sorted posting lists: what filters remove alone, in any order, and needlessly.

Each text is measured once, into a narrow row with a bit for each filter that it fails. Failing rows are sorted by part
and id; a part's rows are read in blocks, each a range of ids, and a block keeps one sorted list of failing places per
filter, and the same lists of its good and of its toxic documents. Unions of lists are galloping k-way merges, and what
a filter removes after others is the galloping difference of its list and their union. Sizes are all that leaves
a block; they are summed per part, set of filters before and filter, and every order is read from these sums.

A place is the number of a row in its block, in order of ids, so rows with equal ids or none count one by one. A block
holds ``BLOCK`` rows at most, wherever its part is large, so no part is gathered. Nothing is broadcast by hand; the
orders of the filters are a literal.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tillweave.llm.common import SPACE_CLASS, stored

#: Rows of one part that a block of posting lists covers.
BLOCK = 1 << 16
#: The filter that fails copies: rows whose text a smaller id has.
COPIES = "E"
# The failure conditions of the contract over n_words, n_distinct, n_upper, n_chars and text.
FILTERS = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_upper > 5 * n_chars",
    "D": "has_mark",
}
MARKS = r"[#$%&*|]"


# Merges of sorted lists


def gallop(ids: list, start: int, least: int) -> int:
    """The first place from ``start`` on whose id is at least ``least``: doubling steps, then bisection."""
    high, step, n = start, 1, len(ids)
    while high < n and ids[high] < least:
        start, high, step = high + 1, high + step, step * 2
    return bisect_left(ids, least, start, min(high, n))


def same_run(a: list, i: int, b: list, j: int) -> int:
    """How many ids from ``a[i]`` and ``b[j]`` on are equal, at least: doubling lengths while they are."""
    run, step = 1, 1
    while a[i + run : i + run + step] == b[j + run : j + run + step] and i + run + step <= len(a) and j + run + step <= len(b):
        run, step = run + step, step * 2
    return run


def union(lists: list[list]) -> list:
    """All ids of sorted lists, each once: the list with the smallest head gives a run, up to the next head."""
    heads = [(ids[0], k, 0) for k, ids in enumerate(lists) if ids]
    heapq.heapify(heads)
    out = []
    while heads:
        _, k, at = heads[0]
        ids = lists[k]
        if len(heads) == 1:
            out += ids[at:]
            break
        other, rival, there = min(heads[1:3])
        stop = gallop(ids, at, other)
        out += ids[at:stop]
        if stop < len(ids) and ids[stop] == other:
            stop += same_run(ids, stop, lists[rival], there)  # the rival gives these
        if stop < len(ids):
            heapq.heapreplace(heads, (ids[stop], k, stop))
        else:
            heapq.heappop(heads)
    return out


def difference(ids: list, gone: list) -> list:
    """The ids of one sorted list that another doesn't hold."""
    out, i, j = [], 0, 0
    while i < len(ids) and j < len(gone):
        stop = gallop(ids, i, gone[j])
        out += ids[i:stop]
        i = stop
        if i < len(ids):
            j = gallop(gone, j, ids[i])
            if j < len(gone) and gone[j] == ids[i]:
                run = same_run(ids, i, gone, j)
                i, j = i + run, j + run
    return out + ids[i:]


def intersection(a: list, b: list) -> list:
    """The ids that two sorted lists share."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        i = gallop(a, i, b[j])
        if i < len(a):
            j = gallop(b, j, a[i])
            if j < len(b) and a[i] == b[j]:
                run = same_run(a, i, b, j)
                out += a[i : i + run]
                i, j = i + run, j + run
    return out


def removals(lists: list[list]) -> dict[tuple[int, int], int]:
    """For every set of lists (as bits) and a list outside of it, how many ids of that list the set doesn't hold."""
    n = len(lists)
    unions = {0: []}
    for size in range(1, n):
        for some in combinations(range(n), size):
            unions[sum(1 << k for k in some)] = union([lists[k] for k in some])
    return {
        (before, k): len(difference(lists[k], gone)) for before, gone in unions.items() for k in range(n) if not before >> k & 1
    }


# Rows


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, the counts and marks that filters look at, and a 128-bit hash of the whole text (null: empty)."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    )
    words = F.regexp_extract_all("text", F.lit(f"[^{SPACE_CLASS}]+"), F.lit(0))
    return base.select(
        "doc_id", "part", F.size(words).alias("n_words"), F.size(F.array_distinct(words)).alias("n_distinct"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("n_upper"), F.length("text").alias("n_chars"), F.col("text").rlike(MARKS).alias("has_mark"),
        F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2"),
    )


def failing_rows(docs: DataFrame, labels: DataFrame, filters: dict[str, str | Column] | None = None, copies: str | None = COPIES) -> DataFrame:
    """One narrow row per document: part, doc_id, fails (a bit for each filter, in order of their names), good, toxic.

    ``filters`` are conditions over the columns of ``measured``; ``copies`` names the filter of repeated texts, or is
    None. Several labels of one id count as good or toxic if any of them is.
    """
    conditions = dict(FILTERS if filters is None else filters)
    names = sorted([*conditions, *([copies] if copies else [])])
    bit = lambda name, failed: F.when(failed, F.lit(1 << names.index(name))).otherwise(F.lit(0))
    fails = sum((bit(n, F.expr(c) if isinstance(c, str) else c) for n, c in conditions.items()), F.lit(0))
    rows = stored(measured(docs).select("doc_id", "part", "h1", "h2", fails.alias("fails")), "measured")
    if copies:
        # Stored, so that Spark knows its size and deals both sides anew where it is too large to be sent to the rows.
        first = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        first = stored(first.where("first < last").select("h1", "h2", "first"), "first-copies")
        rows = rows.join(first, ["h1", "h2"], "left").withColumn("fails", F.col("fails") + bit(copies, F.col("doc_id") > F.col("first")))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    either = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    return rows.join(marks, "doc_id", "left").select("part", "doc_id", "fails", either("good"), either("toxic"))


def blocks_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Runs of rows of one part, from rows sorted by part, of at most ``most`` rows."""
    held: list[pa.RecordBatch] = []
    part, size = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode()
        index = np.asarray(codes.indices)
        cuts = [0, *(np.flatnonzero(np.diff(index)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            name = codes.dictionary[int(index[begin])].as_py()
            while begin < end:
                if held and (name != part or size == most):
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                part, stop = name, min(end, begin + most - size)
                held.append(batch.slice(begin, stop - begin))
                size, begin = size + stop - begin, stop
    if held:
        yield pa.Table.from_batches(held)


def posting_lists(rows: DataFrame, filters: list[str], block: int = BLOCK) -> DataFrame:
    """part, first_id, last_id, filter, ids: the sorted failing ids of every filter in every range of a part's ids.

    ``rows`` are those of ``failing_rows``. Blocks in which a filter fails nothing have no list of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in blocks_of(batches, block):
            ids, fails = some["doc_id"].combine_chunks(), np.asarray(some["fails"])
            for k, name in enumerate(filters):
                places = np.flatnonzero(fails >> k & 1)
                if len(places):
                    columns = [some["part"][:1].combine_chunks(), ids[:1], ids[len(ids) - 1 :], pa.array([name]), pa.array([ids.take(pa.array(places)).to_pylist()], pa.list_(pa.int64()))]
                    yield pa.record_batch(columns, names=["part", "first_id", "last_id", "filter", "ids"])

    return sorted_runs(rows).mapInArrow(run, "part string, first_id long, last_id long, filter string, ids array<long>")


def sorted_runs(rows: DataFrame) -> DataFrame:
    """Failing rows in order of part and id; rows that are alike in both are dealt out by a hash of the rest."""
    order = ["part", "doc_id", F.xxhash64("fails", "good", "toxic")]
    return rows.where("fails != 0").select("part", "doc_id", "fails", "good", "toxic").repartitionByRange(*order).sortWithinPartitions("part", "doc_id")


def removal_sizes(rows: DataFrame, n_filters: int, block: int = BLOCK) -> DataFrame:
    """part, before (bits), filter (its number), removed, good_lost, toxic_lost: sums over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in blocks_of(batches, block):
            fails = np.asarray(some["fails"])
            lists = [np.flatnonzero(fails >> k & 1).tolist() for k in range(n_filters)]
            counts = [removals(lists)]
            for mark in ("good", "toxic"):
                marked = np.flatnonzero(np.asarray(some[mark])).tolist()
                counts.append(removals([intersection(ids, marked) for ids in lists]))
            keys = [key for key, n in counts[0].items() if n]
            columns = [
                pa.array([some["part"][0].as_py()] * len(keys), pa.string()), pa.array([b for b, _ in keys], pa.int32()), pa.array([k for _, k in keys], pa.int32()),
                *(pa.array([c[key] for key in keys], pa.int64()) for c in counts),
            ]
            yield pa.record_batch(columns, names=["part", "before", "filter", "removed", "good_lost", "toxic_lost"])

    sizes = sorted_runs(rows).mapInArrow(run, "part string, before int, filter int, removed long, good_lost long, toxic_lost long")
    return sizes.groupBy("part", "before", "filter").agg(*(F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost")))


def audit(
    docs: DataFrame, labels: DataFrame, filters: dict[str, str | Column] | None = None, copies: str | None = COPIES, block: int = BLOCK,
) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of documents that the step concerns.

    Needs doc_id, source and text, and labels of doc_id, quality and toxic; other columns play no part. A null source
    is the empty one; a null text is empty and a copy of empty ones. Rows with equal ids count one by one and aren't
    copies of each other unless a smaller id has the text; a row without an id is never a copy, and has no labels.
    An empty table has no parts, and gives no rows; empty labels lose nothing. Columns: part, filter_order, step,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    names = sorted([*(FILTERS if filters is None else filters), *([copies] if copies else [])])
    n = len(names)
    rows = stored(failing_rows(docs, labels, filters, copies), "failing-rows")
    # At most n * 2^(n - 1) sums a part, so a part's sums are one small map.
    sizes = removal_sizes(rows, n, block).groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct(F.expr(f"before * {n} + filter"), F.struct("removed", "good_lost", "toxic_lost")))).alias("sizes")
    )
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("all")).join(sizes, "part", "left")
    orders = ",".join(f"array({','.join(map(str, order))})" for order in permutations(range(n)))
    size = lambda what, before, number: f"coalesce(try_element_at(sizes, ({before}) * {n} + {number}).{what}, 0L)"
    bits = "aggregate(slice(places, 1, {}), 0, (b, x) -> b | shiftleft(1, x))"
    others = f"{(1 << n) - 1} - shiftleft(1, number)"
    times = f"element_at(array({','.join(str(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))}), bit_count(b) + 1)"
    return (
        parts.withColumn("places", F.explode(F.expr(f"array({orders})")))
        .withColumn("step", F.explode(F.expr(f"sequence(1, {n})")))
        .withColumn("number", F.expr("element_at(places, step)"))
        .withColumn("before", F.expr(bits.format("step - 1")))
        .select(
            "part",
            F.array_join(F.transform("places", lambda x: F.element_at(F.array(*map(F.lit, names)), x + 1)), "").alias("filter_order"),
            "step",
            F.expr(f"all - aggregate(sequence(1, step), 0L, (a, j) -> a + {size('removed', bits.format('j - 1'), 'element_at(places, j)')})").alias("kept"),
            F.expr(size("removed", "before", "number")).alias("removed"),
            F.expr(f"{size('removed', '0', 'number')} - {size('removed', 'before', 'number')}").alias("redundant"),
            F.expr(size("removed", others, "number")).alias("unique_fails"),
            F.expr(size("good_lost", "before", "number")).alias("good_lost"),
            F.expr(size("toxic_lost", "before", "number")).alias("toxic_lost"),
            F.expr(
                f"aggregate(filter(sequence(0, {(1 << n) - 1}), b -> b & shiftleft(1, number) = 0), 0L, "
                f"(a, b) -> a + {times} * {size('removed', 'b', 'number')})"
            ).alias("shapley"),
        )
    )
