"""Importance resampling to a target distribution: array-scored weights and a parallel sort by regular sampling.

Features are runs of consecutive words, hashed into buckets. Corpus and target are counted once into arrays of one
count per bucket; the log ratios are an array of gains, and a document's weight is the mean gain of its features, read
from that array for a batch of documents at once. A seeded Gumbel number per document is added, so that the highest
scores are a draw without replacement in proportion to the weights.

Exact ranks come from parallel sorting by regular sampling: tasks sort their rows, the sorted runs are written, every
``step``-th row of each run is a sample, the sorted samples give regular splitters, rows are exchanged by segment
between splitters, each segment is sorted by its task, and the counts of the segments before it give its first
rank. Rows are told apart by (score, id, place in its run), so equal rows are dealt out as well. Segments beyond the draw are
never exchanged.

To the driver go the counts of the buckets (their number is a parameter), ``SAMPLES`` samples a segment and one count
per segment; these are also what tasks are sent. Nothing else is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillweave.llm.common import bytes_of, slices_of, small_batches, stored

RUN_WORDS = 1
BUCKETS = 10_000
PERCENT = 10
MIN_WORDS = 20
SEED = 2024
#: Samples a segment, and rows that a segment should hold at most; there are as many segments as shuffles have
#: partitions, or more.
SAMPLES = 32
SEGMENT_ROWS = 1 << 22
#: Words of more bytes are hashed one by one.
LONG_WORD = 48
# Bytes of words: digits, a-z (A-Z lower-cased) and all bytes of characters beyond ASCII; 0 for others.
_CODE = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts, where words begin, their lengths, and the number of words of each text."""
    code = _CODE[data]
    inside = code != 0
    first = np.zeros(len(code) + 1, bool)
    first[offsets] = True
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    stop[:-1] &= ~inside[1:] | first[1:-1]
    begin = np.flatnonzero(start)
    return code, begin, np.flatnonzero(stop) + 1 - begin, np.diff(np.searchsorted(begin, offsets))


def extended(state: np.ndarray, code: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of a word each: all words take a byte at a time, longest first."""
    order = np.argsort(-length, kind="stable")
    state, begin, length = state[order], begin[order], length[order]
    n_long = int(np.searchsorted(-length, -LONG_WORD, "left"))
    for i in range(n_long):
        word = code[begin[i] : begin[i] + length[i]].tobytes()
        state[i] = zlib.crc32(word, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    short = slice(n_long, len(order))
    crc, at, lengths = state[short], begin[short], length[short]
    for k in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -k, "left"))
        crc[:n] = _TABLE[(crc[:n] ^ code[at[:n] + k]) & 255] ^ (crc[:n] >> 8)
    out = np.empty_like(state)
    out[order] = state
    return out


def features_of(data: np.ndarray, offsets: np.ndarray, run_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature, the text that has it, and the number of words of each text."""
    code, begin, length, counts = words_of(data, offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    state = np.full(len(begin), 0xFFFFFFFF, np.uint32)
    found, owners = [], []
    for k in range(run_words):
        if k:  # a run of k words, a space and the word after it
            same = owner[k:] == owner[: len(owner) - k] if len(owner) > k else np.zeros(0, bool)
            at = np.flatnonzero(same)
            state = state[np.searchsorted(places, at)]
            state = _TABLE[(state ^ 32) & 255] ^ (state >> 8)
            state = extended(state, code, begin[at + k], length[at + k])
        else:
            at = np.arange(len(begin))
            state = extended(state, code, begin, length)
        places = at
        found.append((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
        owners.append(owner[at])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), counts


def bucket_counts(texts: DataFrame, run_words: int = RUN_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; each task sums its own before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for begin, stop in slices_of(batch.column(0)):
                found, _, _ = features_of(*bytes_of(batch.column(0).slice(begin, stop - begin)), run_words, buckets)
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for row in small_batches(texts).select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of a bucket's shares, with one more feature in each bucket."""
    many = float(len(corpus))
    ratio = (target + 1.0) * (corpus.sum() + many) / ((corpus + 1.0) * (target.sum() + many))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Floored thousandths of a Gumbel number that seed and id decide."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, run_words: int = RUN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, version (a hash of the text), n_words, n_features, weight and score of every document."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in slices_of(batch.column(2)):
                part = batch.slice(begin, stop - begin)
                found, owner, words = features_of(*bytes_of(part.column(2)), run_words, buckets)
                n = np.bincount(owner, minlength=len(words))
                # Gains of a text sum to well under 2^53 in magnitude, so sums of doubles are exact.
                total = np.bincount(owner, weights=gain[found], minlength=len(words)).astype(np.int64)
                columns = [part.column(0), part.column(1), pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(total // np.maximum(n, 1), pa.int64())]
                yield pa.record_batch(columns, names=["doc_id", "version", "n_words", "n_features", "weight"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    rows = rows.mapInArrow(run, "doc_id long, version long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


# Parallel sorting by regular sampling


def _keys(score: np.ndarray, ids: pa.Array, place: np.ndarray) -> tuple:
    """Keys for np.lexsort, last one first: score from high to low, id with none last, place."""
    return place, np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), -score


def exact_ranks(rows: DataFrame, most: int, samples: int = SAMPLES, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``rows`` with ``rank``, from 1 on by falling ``score`` and rising ``doc_id`` (none last), null beyond ``most``.

    Needs a ``place`` that no two rows share, with the run in its high bits and, in the low 33, its number in the run.
    """
    spark, n = rows.sparkSession, rows.count()
    nothing = F.lit(None).cast("long").alias("rank")
    if not n or most <= 0:
        return rows.select(*rows.columns, nothing)
    segments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // segment_rows))
    step = max(1, n // (samples * segments))
    number, run_of = F.col("place").bitwiseAND((1 << 33) - 1), F.shiftright("place", 33)
    regular = rows.where(F.pmod(number - F.pmod(F.xxhash64(run_of), F.lit(step)), F.lit(step)) == 0)
    sample = regular.select("score", "doc_id", "place").toArrow()
    order = np.lexsort(_keys(np.asarray(sample["score"]), sample["doc_id"].combine_chunks(), np.asarray(sample["place"])))
    picked = order[sorted({len(order) * k // segments for k in range(1, segments)})] if len(order) else order
    cut_score, cut_ids, cut_place = (sample[c].combine_chunks().take(pa.array(picked, pa.int64())) for c in ("score", "doc_id", "place"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([np.asarray(cut_score), np.asarray(batch["score"])])
            place = np.concatenate([np.asarray(cut_place), np.asarray(batch["place"])])
            order = np.lexsort(_keys(score, pa.concat_arrays([cut_ids, batch["doc_id"]]), place))
            # A splitter equals the row it was taken from and sorts before it, so that row opens the segment.
            passed = np.cumsum(order < len(cut_score))
            segment = np.empty(len(order), np.int32)
            segment[order] = passed
            yield pa.record_batch([*batch.columns, pa.array(segment[len(cut_score) :])], schema=batch.schema.append(pa.field("segment", pa.int32())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    routed = rows.mapInArrow(route, f"{schema}, segment int")
    size = {r.segment: r.n for r in routed.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, before = [], 0
    for k in range(len(cut_score) + 1):
        base.append((k, before))
        before += size.get(k, 0)
    drawn = spark.createDataFrame([b for b in base if b[1] < most], "segment int, before long")
    last = drawn.count() - 1
    inside = routed.where(F.col("segment") <= last)
    local = Window.partitionBy("segment").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "place")
    ranked = inside.withColumn("_local", F.row_number().over(local)).join(drawn, "segment")
    rank = F.col("before") + F.col("_local")
    ranked = ranked.select(*rows.columns, F.when(rank <= most, rank).alias("rank"))
    return ranked.unionByName(routed.where(F.col("segment") > last).select(*rows.columns, nothing))


def draw(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS,
    buckets: int = BUCKETS, seed: int = SEED, **sort,
) -> DataFrame:
    """doc_id, version, n_words, n_features, weight, score and rank (null if not drawn) of every document.

    Needs doc_id and text of ``docs`` and text of ``target``; other columns play no part. ``percent`` of the documents
    with ``min_words`` are drawn. Null texts and those without words have no features, weight 0, and aren't drawn. Rows
    with equal ids share their random number and count one by one; rows without an id share one as well, and come last among
    ties. An empty table gives no rows; an empty target has equal shares of all buckets.
    """
    gain = gains(bucket_counts(docs, run_words, buckets), bucket_counts(target, run_words, buckets))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    runs = weigh(docs, gain, run_words, seed).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    runs = stored(runs, "sorted-runs")
    can = F.col("n_words") >= min_words
    eligible = runs.where(can)
    ranked = exact_ranks(eligible, eligible.count() * percent // 100, **sort)
    others = runs.where(~can).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).drop("place")


def resample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of ``docs``, with all its columns. Of rows equal in id and text, all or none come."""
    drawn = draw(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn_id"), F.col("version").alias("_drawn_version"))
    drawn = stored(drawn.distinct(), "drawn-ids")
    same = F.col("_drawn_id").eqNullSafe(docs["doc_id"].cast("long")) & (F.col("_drawn_version") == F.xxhash64(docs["text"]))
    return docs.join(drawn, same, "left_semi")
