"""MinHash near-dedup by a multi-index Hamming join.

A document's set of word shingles gets a signature of ``CHUNKS * CHUNK`` symbols of ``SYMBOL_BITS`` bits, one MinHash
each, so the share of equal symbols estimates Jaccard similarity. Signatures are cut into chunks. If two differ in at
most ``2 * CHUNKS - 1`` symbols, some chunk has at most one error (pigeonhole); so each chunk gives ``CHUNK`` keys, one
for each symbol that may be wrong, and pairs within that distance always share a key. A pair of similarity 0.8
exceeds the guarantee in every chunk with a probability below 3e-6, falling steeply above 0.8.

Work on Spark:

1. Equal sets are one node from the start (their fingerprint), so copies never meet as pairs.
2. Each bucket proposes its smallest and its largest node to the others. Of the candidates that it shares most keys
   with, a few whatever the size of its buckets, filtered by size and signature, each node verifies the most similar on full sets; verified links make components by distributed
   min-label contraction. Buckets that still hold several components propose the
   node that shares most keys with others in one more round.
3. Nodes of buckets that then hold several components meet across components by whole sets: a pair is listed where both
   hold the first shingle that they share, in an order from rare to frequent, if as much is left of both sets as a link
   needs (prefix and positional filter, exact). All are verified, in cells of bounded size so that sets aren't sent once
   per pair. Texts that share a passage, but less than a link needs, have no such place but by chance.
   Pairs inside a component change nothing and are never listed, so no link between components is lost.

Keys of one node alone end in a first count, which is all that is shuffled for them; the buckets are made of the rest.
Hot buckets are pre-aggregated; tables between steps are written to the shared folder, so that later joins deal both
sides anew, adaptive execution can split hot keys, and lost executors cost a task, not the chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tillweave.llm.common import bytes_of, discard, slices_of, small_batches, stored

CHUNKS = 12
CHUNK = 6
SYMBOL_BITS = 16
SYMBOLS = CHUNKS * CHUNK
WORDS = 5
PERCENT = 80
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BASE = 0x100000001B3
_SEEDS = np.random.default_rng(20240229).integers(0, 1 << 63, (2, SYMBOLS), np.int64).astype(np.uint64)
_MULTIPLIERS = _SEEDS[1] * np.uint64(2) + np.uint64(1)
_CODE = np.array([c + 32 if 65 <= c <= 90 else 0 if c == 32 or 9 <= c <= 13 else c for c in range(256)], np.uint8)
_CODE[0] = 1  # U+0000 is part of a word; 0 stands for white space


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the number of words in each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    code = _CODE[data]
    inside = code != 0
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:n]
    at, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    power = np.full(n + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    inverse = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(code.astype(np.uint64) * power[:n], out=total[1:])
    hashes = mixed((total[end] - total[at]) * inverse[at] + (end - at).astype(np.uint64) * _M3)
    counts = np.diff(np.searchsorted(at, offsets))
    return hashes, counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other; and where each text's end.

    Fewer words than a shingle has make one shingle of them all; no words make none.
    """
    hashes, counts = word_hashes(data, offsets)
    n_shingles = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(counts)), n_shingles)
    begin = np.cumsum(counts) - counts
    at = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    out = np.zeros(len(owner), np.uint64)
    for k in range(words):
        there = k < counts[owner]
        out = np.where(there, mixed(out * _M3 + hashes[np.minimum(at + k, max(0, len(hashes) - 1))] + np.uint64(k + 1)), out) if len(hashes) else out
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[new], owner[new]
    return out, np.cumsum(np.bincount(owner, minlength=len(counts)))


def reduced(ufunc: np.ufunc, values: np.ndarray, ends: np.ndarray, empty: int) -> np.ndarray:
    """``ufunc`` over each text's values; ``empty`` for texts without any."""
    begin = np.concatenate([[0], ends[:-1]])
    full = ends > begin
    out = np.full(len(ends), empty, values.dtype)
    if full.any():
        out[full] = ufunc.reduceat(values, begin[full])
    return out


def signatures(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of symbols per text."""
    out = np.zeros((len(ends), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        low = reduced(np.minimum, (values ^ _SEEDS[0, k]) * _MULTIPLIERS[k], ends, 0)
        out[:, k] = (mixed(low) >> np.uint64(64 - SYMBOL_BITS)).astype(np.uint16)
    return out


SKETCH = "doc_id long, n long, node long, check long, signature binary, x1 long"
#: Equal symbols that a candidate must show (0.8 falls short with a probability of 2e-5).
LEAST_SAME = 44
#: Bits in which 64-bit extracts, a bit of a symbol each, may differ (each differing symbol flips its bit half of the
#: time; 0.8 does so in 6 +- 2 and more than this with a probability below 1e-6; chance has 32 +- 4).
MOST_BITS_OF_ONE = 20
#: Candidates that a node verifies in a round of stars.
VERIFY = 3
#: Hubs whose signatures a node is compared with in a round of stars, those it shares most keys with.
COMPARED = 4
#: Bytes of sets that make a block, where full sets are compared.
BLOCK_BYTES = 1 << 24
#: Wanted documents (two numbers each) that are sent to the texts instead of shuffling these.
SENT_ROWS = 1 << 21
#: Frequent shingles whose order is sent to the sets; all others come before them.
ORDERED = 1 << 19


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), node and check (two fingerprints of the set) and its signature, from every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in slices_of(batch.column(1), 1 << 18):
                part = batch.slice(begin, stop - begin)
                values, ends = shingle_sets(*bytes_of(part.column(1)), words)
                n = np.diff(ends, prepend=0)
                node = reduced(np.add, mixed(values * _M2), ends, 0)
                check = reduced(np.bitwise_xor, mixed(values * _M3 + _M1), ends, 0)
                rows = signatures(values, ends)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(node.view(np.int64)), pa.array(check.view(np.int64)), pa.array([r.tobytes() for r in rows], pa.binary())]
                packed = np.packbits((rows[:, :64] & 1).astype(bool), axis=1)
                columns.append(pa.array(np.ascontiguousarray(packed).view(np.int64).reshape(-1)))
                yield pa.record_batch(columns, names=[c.split()[0] for c in SKETCH.split(", ")])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def keys_of(sets: DataFrame, *more: str) -> DataFrame:
    """(key, node): per chunk, a hash of the chunk's number, of the symbol left out and of the others."""
    size = SYMBOL_BITS // 8
    keys = []
    for c in range(CHUNKS):
        for j in range(CHUNK):
            low, high = c * CHUNK * size, (c * CHUNK + j) * size
            rest = (CHUNK - 1 - j) * size
            parts = [F.substring("signature", low + 1, high - low)] * (j > 0) + [F.substring("signature", high + size + 1, rest)] * (rest > 0)
            keys.append(F.xxhash64(F.lit(c * CHUNK + j), *parts))
    return sets.select("node", *more, F.explode(F.array(*keys)).alias("key"))


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those whose sizes can have the similarity and whose signatures share ``LEAST_SAME`` symbols, with the
    number of equal ones."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("signature").alias(f"s_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(bytes_of(batch.column(i))[0], np.uint16).reshape(-1, SYMBOLS) for i in (2, 3))
            same = (left == right).sum(1)
            near = same >= LEAST_SAME
            yield pa.record_batch([batch.column(0).filter(pa.array(near)), batch.column(1).filter(pa.array(near)), pa.array(same[near], pa.int32())], names=["a", "b", "same"])

    return both.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long, same int")


def full_sets(nodes: DataFrame, sets: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, members): the whole set of each node listed, made again from whole texts."""
    # Texts are only shuffled where the list of wanted ones is too long to be sent to them.
    wanted = stored(nodes.distinct().join(sets.select("node", F.col("rep").alias("doc_id")), "node"), "wanted")
    listed = F.broadcast(wanted) if wanted.count() <= SENT_ROWS else wanted

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in slices_of(batch.column(1), 1 << 18):
                part = batch.slice(begin, stop - begin)
                values, ends = shingle_sets(*bytes_of(part.column(1)), words)
                node = reduced(np.add, mixed(values * _M2), ends, 0).view(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                mine = np.flatnonzero(node == np.asarray(part.column(0), np.int64))
                yield pa.record_batch([pa.array(node[mine]), pa.array([values[begins[i] : ends[i]].tobytes() for i in mine], pa.binary())], names=["node", "members"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(listed, "doc_id").select("node", "text")
    full = stored(texts.mapInArrow(make, "node long, members binary").dropDuplicates(["node"]), "shingle-sets")
    discard(wanted)
    return full


def meetings(full: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different labels, among them all that ``percent`` links: where both hold the first shingle that they
    share, as many are left in both sets as a link needs.

    Shingles are in one order, the frequent ones last. A set's shingles up to the last one that can come first in a link
    are its rows. Of a shingle's rows, those of its most frequent label meet only the others.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in slices_of(batch.column(1), 1 << 22):
                data = bytes_of(batch.column(1).slice(begin, stop - begin))[0]
                yield pa.record_batch([pa.array(np.frombuffer(data, np.int64))], names=["shingle"])

    counts = full.select("node", "members").mapInArrow(opened, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"))
    counts = stored(counts.where("sets > 1"), "shingle-counts")
    least, total = 1, 0
    for row in sorted(counts.groupBy("sets").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        total += row.n
        if total > ORDERED:
            least = row.sets
            break
    listed = counts.where(F.col("sets") > least).toArrow()
    frequent, often = listed.column(0).to_numpy(), listed.column(1).to_numpy()
    order = np.argsort(frequent)
    shared = full.sparkSession.sparkContext.broadcast((frequent[order], often[order]))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, often = shared.value
        for batch in batches:
            for begin, stop in slices_of(batch.column(1), 1 << 22):
                data, offsets = bytes_of(batch.column(1).slice(begin, stop - begin))
                shingle, sizes = np.frombuffer(data, np.int64), np.diff(offsets) // 8
                place = np.searchsorted(frequent, shingle)
                there = place < len(frequent)
                there[there] = frequent[place[there]] == shingle[there]
                count = np.zeros(len(shingle), np.int64)
                count[there] = often[place[there]]
                owner = np.repeat(np.arange(len(sizes)), sizes)
                shingle = shingle[np.lexsort((shingle, count, owner))]
                at, n = np.arange(len(shingle)) - (offsets[:-1] // 8)[owner], sizes[owner]
                kept = 100 * (n - at) >= percent * n
                nodes = np.asarray(batch.column(0), np.int64)[begin:stop]
                yield pa.record_batch([pa.array(x[kept]) for x in (shingle, nodes[owner], n, n - at)], names=["shingle", "node", "n", "left"])

    rows = full.select("node", "members").mapInArrow(firsts, "shingle long, node long, n long, left long")
    rows = stored(rows.join(counts.select("shingle"), "shingle").join(labels, "node"), "first-shingles")
    mains = rows.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("rows")).groupBy("shingle").agg(
        F.max_by("label", F.struct("rows", "label")).alias("main"), F.count(F.lit(1)).alias("labels")
    )
    before, rows = rows, stored(rows.join(mains.where("labels > 1").select("shingle", "main"), "shingle"), "shingles-across")
    right = rows.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "left", "label")])
    met = rows.where("label != main").join(right, "shingle").where(
        f"label_b != label AND (label_b = main OR label < label_b) AND {100 + percent} * least(`left`, left_b) >= {percent} * (n + n_b)"
    )
    met = stored(met.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct(), "across-pairs")
    discard(counts, before, rows)
    return met


def verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those with ``100 |A and B| >= percent |A or B|`` on the full sets of both."""
    # Pairs are dealt into cells (block of a, block of b), and a set travels once to each cell that needs it, so a cell
    # holds two blocks of sets at most.
    blocks = max(1, -(-(full.agg(F.sum(F.length("members"))).first()[0] or 0) // BLOCK_BYTES))
    block = lambda node: F.pmod(F.xxhash64(node), F.lit(blocks))
    placed = pairs.select("a", "b", block("a").alias("block_a"), block("b").alias("block_b"))
    cells = pairs.select(block("a").alias("of_a"), block("b").alias("of_b"), "a", "b")
    needed = cells.select("of_a", "of_b", F.col("a").alias("node")).distinct().union(cells.select("of_a", "of_b", "b").distinct()).distinct().join(full, "node")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        good = linked(
            np.asarray(left["a"]), np.asarray(left["b"]), np.asarray(right["node"]), *bytes_of(right["members"].combine_chunks()), percent
        )
        return left.select(["a", "b"]).filter(pa.array(good))

    links = stored(placed.groupBy("block_a", "block_b").cogroup(needed.groupBy("of_a", "of_b")).applyInArrow(compare, "a long, b long"), "links")
    return links


def linked(a: np.ndarray, b: np.ndarray, node: np.ndarray, data: np.ndarray, offsets: np.ndarray, percent: int) -> np.ndarray:
    """For pairs of nodes, whether their sets (in order of ``node``, one after the other) are alike enough."""
    ids = np.unique(np.frombuffer(data, np.uint64), return_inverse=True)[1]
    begins, sizes = offsets[:-1] // 8, np.diff(offsets) // 8
    order = np.argsort(node)
    at = lambda x: order[np.searchsorted(node[order], x)]
    left, right = at(a), at(b)
    by_left = np.argsort(left, kind="stable")
    good = np.zeros(len(a), bool)
    inside = np.zeros(len(ids) and int(ids.max()) + 1, bool)
    cuts = np.flatnonzero(np.diff(left[by_left])) + 1
    for mine in np.split(by_left, cuts):
        own = ids[begins[left[mine[0]]] :][: sizes[left[mine[0]]]]
        inside[own] = True
        for some in np.split(mine, np.flatnonzero(np.diff(np.cumsum(sizes[right[mine]]) >> 20)) + 1):
            count = sizes[right[some]]
            first = np.cumsum(count) - count
            where = np.arange(int(count.sum())) + np.repeat(begins[right[some]] - first, count)
            both = np.add.reduceat(inside[ids[where]], first, dtype=np.int64)
            good[some] = 100 * both >= percent * (len(own) + count - both)
        inside[own] = False
    return good


def stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (u, v) has either one edge, to a node without any of its own, or none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("own")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("own")))
    ends = ends.groupBy("node").agg(F.sum("own").alias("edges"), F.min("own").alias("least"))
    return ends.where("edges > 1 OR edges = 1 AND least = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``links`` (a, b) reaches.

    Edges point from larger to smaller nodes. Each round, a node's neighbours are tied to the smallest of them and then
    its smaller neighbours to each other's smallest, until every edge points at its component's smallest node. Both
    halves are grouped minima joined back, so a hub's neighbours are never gathered.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "links")
    while not stars(edges):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        discard(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small.where("u != v").distinct(), "small-star")
        discard(large)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept (whether that is its own).

    Needs doc_id and text; other columns play no part. Texts lower-case A-Z; words are runs of anything but blanks and
    U+0009 to U+000D. Null texts and those without words have no shingles and link with nothing. Repeated rows are
    copies; rows without an id are never the smallest, and are kept where nothing else is. An empty table gives none.
    """
    base = stored(sketches(docs, words), "sketches")
    sets = base.where("n > 0").groupBy("node", "check", "n").agg(
        F.min("doc_id").alias("rep"), F.max("x1").alias("x1"), F.max("signature").alias("signature")
    )
    sets = stored(sets.where("rep IS NOT NULL"), "sets")
    # Most keys belong to one node alone. A first pass sends keys and counts only; all later ones see the shared keys.
    shared = stored(keys_of(sets).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key"), "shared-keys")
    members = stored(keys_of(sets, "x1").join(shared, "key").select("key", "node", "x1"), "members")
    discard(shared)
    # In a bucket of two, the xor of the extracts is the pair's own; chance meetings end here.
    met = f"NOT (count(1) = 2 AND bit_count(bit_xor(x1)) > {MOST_BITS_OF_ONE})"
    found = members.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("other"), F.count(F.lit(1)).alias("rows"), F.expr(met).alias("met"))
    found = stored(found.where("met").select("key", "hub", "other", "rows"), "buckets")
    meet = members.select("key", "node").join(found.where("rows > 2").select("key", "hub", "other"), "key")
    meet = meet.select(F.col("node").alias("a"), F.explode(F.array("hub", "other")).alias("b")).where("a != b")
    pairs = found.where("rows = 2").select(F.col("other").alias("a"), F.col("hub").alias("b")).unionByName(meet)

    def star_links(pairs: DataFrame) -> DataFrame:
        most = Window.partitionBy("a").orderBy(F.col("keys").desc(), "b")
        listed = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("keys")).withColumn("_rank", F.row_number().over(most))
        near = stored(alike(listed.where(F.col("_rank") <= COMPARED).select("a", "b"), sets, percent), "near-pairs")
        order = Window.partitionBy("a").orderBy(F.col("same").desc(), "b")  # at most a hub or two per key
        best = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= VERIFY)
        best = stored(best.select("a", "b"), "star-pairs")
        full = full_sets(best.select(F.col("a").alias("node")).distinct().union(best.select("b").distinct()), sets, docs, words)
        links = verified(best, full, percent)
        discard(near, best, full)
        return links

    def labelled(links: DataFrame) -> DataFrame:
        return stored(components(links), "labels")

    def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def mixed_rows(rows: DataFrame) -> DataFrame:
        """Rows of buckets that hold nodes of several components."""
        several = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.expr(met).alias("met")).where("low != high AND met").select("key")
        return stored(rows.join(stored(several, "mixed-buckets"), "key"), "mixed-rows")

    links = star_links(pairs)
    before, members = members, mixed_rows(with_labels(members, labelled(links)))
    discard(before, found)
    # The next hub of a bucket is its node that shares most keys with other nodes: of many copies of one text, the one
    # that most of them are near to.
    rows = members.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    central = stored(members.join(rows, "key").groupBy("node").agg(F.sum("rows").alias("met")), "centres")
    hubs = members.join(central, "node").groupBy("key").agg(*[F.max_by(c, F.struct("met", "node")).alias(f"{c}_b") for c in ("node", "label")])
    hubs = stored(hubs, "hubs")
    again = members.join(hubs, "key").where("label != label_b").select(F.col("node").alias("a"), F.col("node_b").alias("b"))
    links = links.unionByName(star_links(again))
    before, members = members, mixed_rows(with_labels(members.drop("label"), labelled(links)))
    discard(before, hubs, central)
    full = full_sets(members.select("node"), sets, docs, words)
    more = verified(meetings(full, members.select("node", "label").distinct(), percent), full, percent)
    discard(members, full)
    final = components(links.unionByName(more))

    named = sets.select("node", "check", "rep").join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = stored(named, "labelled-sets")
    ids = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_node = stored(named.join(ids, "label").select("node", "check", "component_id"), "component-ids")
    discard(named, sets)
    return base.join(of_node, ["node", "check"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each component, that of its smallest id; of rows with the same id one, and all without an id."""
    ids = stored(near_duplicates(docs, words, percent).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "kept-ids")
    return docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).join(ids, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
