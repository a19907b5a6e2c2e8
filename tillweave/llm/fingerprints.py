"""Document fingerprints: MinHash signatures over shingles, compared symbol by symbol, joined by bands.

A shingle is a run of ``SHINGLE`` code points (a shorter text is one shingle), so texts without blanks and texts of few
words have shingles too. Shingles are hashed to 32 bits; ``SYMBOLS`` universal hashes ``a * x + b`` with odd ``a``, each
a permutation of the 32-bit numbers, give one minimum each, for all texts of a slice at once in numpy. A symbol is 16
bits of a mixed minimum, and the share of equal symbols estimates the Jaccard similarity of two sets.

``edited_fingerprints`` compares each text with an edited form that ends in the beginning of the next document. Texts are
shuffled once: rows are routed to ranges of ids between regular sample points, each range is sorted by its task and read in
order, and the row that opens a range is sent to the range before it as well. The part that text and edited form
share is hashed once, as the minimum over a text is the smaller one of the minima over its parts.

``near_classes`` links texts that are alike: equal texts are one class from the start, bands of the signatures are join keys in
Spark, and each link is verified on the whole shingle sets. Each bucket of a band proposes one hub to its other
classes; buckets that then still hold several components propose further hubs, till every bucket's classes have been
compared to a hub or are one component, so pairs of a bucket are never all listed.

To the driver go sample points only (``SAMPLES`` per partition of the shuffle), and tasks are sent these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillweave.llm.common import small_batches, stored
from tillweave.llm.neardup import components

SHINGLE = 7
SYMBOLS = 128
PERCENT = 80
#: A band is a key: two texts 0.8 alike share none of 25 bands of 5 symbols with a probability of 5e-5.
BANDS = 25
ROWS = 5
SAMPLES = 64
#: Code points that a worker hashes at once, and bytes of texts that it holds beside its batch.
SLICE = 1 << 17
SLICE_CHARS = 1 << 20
_RNG = np.random.default_rng(11)
_A = (_RNG.integers(0, 1 << 31, SYMBOLS, np.int64) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, SYMBOLS, np.int64).astype(np.uint32)
_NONE = np.uint32(0xFFFFFFFF)
NOTHING = np.zeros(0, np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 32-bit numbers; a permutation."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def shingle_hashes(points: np.ndarray) -> np.ndarray:
    """A hash of every run of ``SHINGLE`` code points; of all, if they are fewer; none of none."""
    n = min(SHINGLE, len(points))
    if not n:
        return np.zeros(0, np.uint32)
    out = np.full(len(points) - n + 1, n, np.uint32)
    for k in range(n):
        out *= np.uint32(0x9E3779B1)
        out ^= out >> np.uint32(15)
        out += points[k : len(points) - n + 1 + k]
    return mixed(out)


def minima(parts: list[np.ndarray]) -> np.ndarray:
    """For each array of shingle hashes, its minimum under each permutation; the largest number where there are none."""
    out = np.full((len(parts), SYMBOLS), _NONE, np.uint32)
    sizes = np.array([len(p) for p in parts], np.int64)
    full = np.flatnonzero(sizes)
    groups = np.split(full, np.flatnonzero(np.diff(np.cumsum(sizes[full]) // SLICE)) + 1)
    for some in groups:
        if not len(some):
            continue
        values = np.concatenate([parts[i] for i in some])
        begin = np.cumsum(sizes[some]) - sizes[some]
        work = np.empty_like(values)
        for k in range(SYMBOLS):
            np.multiply(values, _A[k], out=work)
            np.add(work, _B[k], out=work)
            out[some, k] = np.minimum.reduceat(work, begin)
    return out


def symbols(low: np.ndarray) -> np.ndarray:
    return (mixed(low) >> np.uint32(16)).astype(np.uint16)


def as_text(signatures: np.ndarray) -> list[str]:
    """Four hex digits a symbol."""
    data = signatures.astype(">u2").tobytes().hex()
    return [data[i : i + 4 * SYMBOLS] for i in range(0, len(data), 4 * SYMBOLS)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal symbols, an estimate of the Jaccard similarity."""
    return (a == b).mean(1)


def signatures_of(texts: list[str]) -> np.ndarray:
    return symbols(minima([shingle_hashes(points_of(t)) for t in texts]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint`` (a column of that name is replaced); a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = as_text(signatures_of([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]))
            yield pa.record_batch([*batch.columns[:-1], pa.array(names, pa.string())], names=[*(f"c{i}" for i in range(batch.num_columns - 1)), "fingerprint"])

    kept = [f for f in docs.schema if f.name.lower() != "fingerprint"]
    types = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept))
    rows = small_batches(docs, 500).select(*(F.col(f"`{f.name}`") for f in kept), F.col("text").alias("_text"))
    out = rows.mapInArrow(run, f"{types}, fingerprint string")
    return out.select(*(F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)), "fingerprint")


# Edited forms


def compared(texts: list[str]) -> list[pa.Array]:
    """For all texts but the last, each followed by the next one: n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next."""
    parts, edits = [], []
    for text, following in zip(texts, texts[1:]):
        cut = len(text) // 4
        stays = len(text) - cut
        edits.append(text[:stays] + following[:cut])
        own, edited = points_of(text), points_of(edits[-1])
        # Shingles inside of what stays are shared; those that reach beyond it are the text's or the edited form's own.
        shared = max(0, stays - SHINGLE + 1)
        parts += [
            shingle_hashes(own[:stays]) if shared else NOTHING,
            *(shingle_hashes(x[shared:]) if not shared or len(x) - shared >= SHINGLE else NOTHING for x in (own, edited)),
        ]
    low = minima([*parts, shingle_hashes(points_of(texts[-1]))])
    shared, own, edited = (low[k : len(parts) : 3] for k in range(3))
    own = symbols(np.concatenate([np.minimum(shared, own), low[-1:]]))
    edited = symbols(np.minimum(shared, edited))
    return [
        pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
        pa.array(as_text(own[:-1]), pa.string()), pa.array(as_text(edited), pa.string()),
        pa.array(likeness(own[:-1], edited)), pa.array(likeness(own[:-1], own[1:])),
    ]


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    Documents stand in ascending order of doc_id, rows with equal ids by a hash of their texts, those without an id
    last, and the first one follows the last. The edited form has the last quarter of the code points, rounded down,
    replaced by as many from the beginning of the next document, or all it has. Needs doc_id and text; other columns
    play no part. A null text is empty: it has no shingles, is like an empty one (1.0) and unlike any other (0.0).
    One document alone follows itself; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    n = rows.count()
    segments = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Which rows are sampled decides about balance only; the points are read once and then fixed.
    points = rows.where(F.rand(SYMBOLS) < min(1.0, samples * segments / max(1, n))).select("doc_id", "hash")
    found = sorted({(r.doc_id is None, r.doc_id or 0, r.hash) for r in points.collect()})
    picked = sorted({found[len(found) * k // segments] for k in range(1, segments)}) if found else []
    least = rows.select("doc_id").agg(F.min("doc_id")).first()[0]
    first = rows.where(F.col("doc_id").eqNullSafe(F.lit(least).cast("long"))).agg(F.min("hash")).first()[0]
    head = (least is None, least or 0, first)
    cuts = [np.array([p[k] for p in picked], t) for k, t in enumerate((bool, np.int64, np.int64))]
    opens = {p: k for k, p in enumerate(picked)}  # the row that opens segment k + 1 also ends segment k

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0), np.asarray(batch.column(2))
            keys = [np.asarray(ids.is_null()), np.asarray(ids.fill_null(0)), hashes]
            order = np.lexsort([np.concatenate([c, k]) for c, k in zip(cuts, keys)][::-1])
            segment = np.empty(len(order), np.int64)
            segment[order] = np.cumsum(order < len(picked))
            segment = segment[len(picked) :]
            copies = []  # (row, segment that it follows)
            for i, key in enumerate(zip(*(k.tolist() for k in keys))):
                copies += [(i, opens[key])] if key in opens else []
                copies += [(i, len(picked))] if key == head else []
            whole = pa.array([*segment.tolist(), *(c[1] for c in copies)], pa.int64())
            take = pa.array([*range(batch.num_rows), *(c[0] for c in copies)], pa.int64())
            after = pa.array([False] * batch.num_rows + [True] * len(copies))
            yield pa.record_batch([*(c.take(take) for c in batch.columns), whole, after], names=["doc_id", "text", "hash", "segment", "after"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows (segment, id, text) whose likeness isn't known yet
        size = 0

        def done() -> pa.RecordBatch:
            columns = compared([text for _, _, text in held])
            return pa.record_batch([pa.array([i for _, i, _ in held[:-1]], pa.int64()), *columns], names=[c.split()[0] for c in EDITED.split(", ")])

        closed = None
        for batch in batches:
            for doc_id, text, segment, after in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if segment == closed:
                    continue  # the row after this segment stands several times
                held.append((segment, doc_id, text))
                size += len(text)
                if after:
                    closed = segment
                    yield done()
                    held, size = [], 0
                elif size > SLICE_CHARS and len(held) > 1:
                    yield done()
                    held = held[-1:]
                    size = len(text)

    routed = small_batches(rows, 500).mapInArrow(route, "doc_id long, text string, hash long, segment long, after boolean")
    order = ["segment", "after", F.col("doc_id").asc_nulls_last(), "hash"]
    return routed.repartition("segment").sortWithinPartitions(*order).select("doc_id", "text", "segment", "after").mapInArrow(compare, EDITED)


# Texts that are alike


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those with ``100 |A and B| >= percent |A or B|`` on the whole shingle sets of ``texts`` (node, text).

    Sets are of shingle hashes; a set of b is kept while the rows that follow have the same b.
    """
    side = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mine = None, NOTHING
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, b in enumerate(batch.column(1).to_pylist()):
                if b != known:
                    known, mine = b, np.unique(shingle_hashes(points_of(batch.column(3)[i].as_py())))
                other = np.unique(shingle_hashes(points_of(batch.column(2)[i].as_py())))
                both = len(np.intersect1d(mine, other, assume_unique=True))
                good[i] = 100 * both >= percent * (len(mine) + len(other) - both)
            keep = pa.array(good)
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    both = small_batches(pairs, 500).join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


def near_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id and class_id, the smallest doc_id that links of at least ``percent`` reach, of every document.

    Needs doc_id and text; other columns play no part. Null and empty texts have no shingles and link with nothing:
    each is a class of its own. Rows with equal texts are one class from the start; rows without an id name no class unless
    all of theirs lack one. An empty table gives no rows. Links are found where two signatures agree in a whole band (see
    ``BANDS``), and confirmed on whole sets. Rounds compare a bucket's rows with hubs, one per
    slot, in twice as many slots each round; a hub then leaves its bucket, and a bucket is done once it is one component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = signatures_of(batch.column(3).to_pylist())[:, : BANDS * ROWS]
            data = bands.reshape(-1, ROWS).tobytes()
            keys = pa.array([data[i : i + 2 * ROWS] for i in range(0, len(data), 2 * ROWS)], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(range(0, len(keys) + 1, BANDS), pa.int32()), keys)
            yield pa.record_batch([*batch.columns[:3], lists], names=["h1", "h2", "rep", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), F.col("text"))})
    # One row per text: its smallest id, and a number for it.
    texts = rows.where("text != ''").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min("text").alias("text"))
    texts = stored(texts.select("h1", "h2", "rep", "text"), "distinct-texts")
    nodes = small_batches(texts, 500).mapInArrow(run, "h1 long, h2 long, rep long, bands array<binary>")
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "signatures")
    texts = stored(texts.select("h1", "h2", "text").join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("node", "text"), "node-texts")
    keys = nodes.select("node", F.posexplode("bands").alias("band", "symbols")).select("node", F.xxhash64("band", "symbols").alias("key"))
    shared = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared-bands")
    members = stored(keys.join(shared, "key").withColumn("label", F.col("node")), "band-members")
    links, slots = None, 1
    while not members.isEmpty():
        # A hub for each slot of a bucket, the same nodes wherever they can be; a row with a label of its own meets it.
        chosen = F.xxhash64(F.lit(slots), "node")
        hubs = members.groupBy("key", F.pmod(chosen, F.lit(slots)).alias("slot")).agg(F.min_by(F.struct(F.col("node").alias("b"), F.col("label").alias("label_b")), chosen).alias("hub"))
        hubs = stored(hubs.select("key", "hub.*"), "band-hubs")
        pairs = members.join(hubs, "key").where("label != label_b").select(F.col("node").alias("a"), "b").distinct()
        new = stored(verified(stored(pairs, "hub-pairs"), texts, percent), "alike")
        links = new if links is None else links.unionByName(new)
        labels = stored(components(links), "classes")
        # Hubs have met all others of their buckets; buckets of one component are done.
        left = members.drop("label").join(hubs, [members["key"] == hubs["key"], members["node"] == hubs["b"]], "left_anti")
        left = left.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
        members, slots = stored(left.join(several, "key", "left_semi").select("node", "key", "label"), "open-members"), slots * 2
    named = nodes.select("h1", "h2", "rep", F.col("node").alias("label"))
    if links is not None:
        named = nodes.select("h1", "h2", "rep", "node").join(labels, "node", "left").select("h1", "h2", "rep", F.coalesce("label", "node").alias("label"))
    named = stored(named, "named")
    ids = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    of_text = stored(named.join(ids, "label").select("h1", "h2", "class_id"), "class-ids")
    return rows.select("doc_id", "h1", "h2").join(of_text, ["h1", "h2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
