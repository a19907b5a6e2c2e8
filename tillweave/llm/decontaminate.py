"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Every item is cut into overlapping windows of ``WINDOW`` normalised characters, ``STEP`` apart. A document is contaminated by an item
if one of its windows aligns with some stretch of the document within the window's edit budget (one edit for each
``CHARS_PER_EDIT`` characters). A window of L characters within e edits of a stretch shares at least
``L + 1 - q (e + 1)`` q-grams with it, all on diagonals that lie at most e apart on either side; so shared q-grams are
counted in diagonal bands of width 4 e that overlap by half, one of which holds all of them. Regions that meet the
bound are verified by a banded alignment. Nothing that meets the definition is lost.

Items are the stated query set: their q-gram index goes to the workers in blocks of bounded size, and each block is
one pass over the documents, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillweave.llm.common import slices_of

Q = 12
#: An excerpt of at least WINDOW + STEP - 1 normalised characters, from wherever in an item, holds a whole window.
WINDOW = 52
STEP = 8
CHARS_PER_EDIT = 16
#: Characters of items in one broadcast index (about 30 bytes each); more items make more blocks.
BLOCK_CHARS = 4_000_000
_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_tables: dict[str, np.ndarray] = {}


def _lower_table() -> np.ndarray:
    """Code point to its lower-case letter or digit; everything else is a blank. One code point stays one."""
    if "lower" not in _tables:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x30000):
            char = chr(c)
            if char.isalnum():
                low = char.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _tables["lower"] = out
    return _tables["lower"]


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters and digits with single blanks between, as code points, and their places in ``text``.

    The separator U+0001 stands for itself, so that texts can be joined.
    """
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _lower_table()[raw]
    code[raw == 1] = 1
    blank = code == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    if len(keep):
        keep[0] = True
    at = np.flatnonzero(keep)
    return code[at], at


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram, by doubling."""
    size, have, out = 1, codes.astype(np.uint64) + np.uint64(1), None
    shift = 0
    power = _BASE
    left = q
    while left:
        if left & 1:
            piece = have[shift : len(codes) - q + 1 + shift]
            out = piece.copy() if out is None else out * power + piece
            shift += size
        left >>= 1
        if left:
            have = have[:-size] * power + have[size:]
            power = np.uint64(int(power) ** 2 & (1 << 64) - 1)
            size *= 2
    out = (out ^ (out >> np.uint64(29))) * _MIX
    return out ^ (out >> np.uint64(32))


class Index:
    """q-grams of item windows: sorted hashes with (item, place), and a bit table that most others fail."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, window: int = WINDOW, step: int = STEP, per_edit: int = CHARS_PER_EDIT):
        self.q, self.ids = q, np.array([i for i, _ in items], np.int64)
        self.texts = [normalise(t)[0] for _, t in items]
        self.texts = [t[int(len(t) > 0 and t[0] == 32) :] for t in self.texts]
        hashes, owner, place = [], [], []
        win_item, win_start, win_size = [], [], []
        for k, t in enumerate(self.texts):
            if len(t) < q:
                continue
            h = gram_hashes(t, q)
            hashes.append(h)
            owner.append(np.full(len(h), k, np.int64))
            place.append(np.arange(len(h)))
            size = min(window, len(t))
            starts = sorted({*range(0, len(t) - size + 1, step), len(t) - size})
            win_item += [k] * len(starts)
            win_start += starts
            win_size += [size] * len(starts)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        h, owner, place = join(hashes).astype(np.uint64), join(owner), join(place)
        order = np.argsort(h, kind="stable")
        self.hash, self.owner, self.place = h[order], owner[order], place[order]
        self.grams, self.first = np.unique(self.hash, return_index=True)
        self.count = np.diff(np.append(self.first, len(self.hash)))
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.win_item, self.win_start, self.win_size = (np.array(x, np.int64) for x in (win_item, win_start, win_size))
        self.budget = self.win_size // per_edit
        self.least = np.maximum(1, self.win_size + 1 - q * (self.budget + 1))
        self.win_first = np.searchsorted(self.win_item, np.arange(len(items) + 1))

    def regions(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows (document, window, first diagonal) that meet the bound. ``ends``: where each document's codes end."""
        if len(codes) < self.q or not len(self.grams):
            return np.zeros((0, 3), np.int64)
        h = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        found = np.searchsorted(self.grams, h[at])
        found[found == len(self.grams)] = 0
        hit = self.grams[found] == h[at]
        at, found = at[hit], found[hit]
        n = self.count[found]
        row = np.repeat(np.arange(len(at)), n)
        posting = self.first[found][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at, item, place = at[row], self.owner[posting], self.place[posting]
        # Every window that holds the gram: windows of an item start at most STEP apart, the last one aside.
        n = self.win_first[item + 1] - self.win_first[item]
        row = np.repeat(np.arange(len(at)), n)
        win = self.win_first[item][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        inside = (place[row] >= self.win_start[win]) & (place[row] + self.q <= self.win_start[win] + self.win_size[win])
        row, win = row[inside], win[inside]
        doc = np.searchsorted(ends, at[row], "right")
        diagonal = at[row] - place[row] + self.win_start[win]  # where the window would begin
        half = 2 * self.budget[win] + 1
        keys = []
        for shift in (0, 1):
            band = (diagonal + shift * half) // (2 * half)
            keys.append(np.stack([doc, win, band * 2 * half - shift * half], 1))
        keys, counts = np.unique(np.concatenate(keys), axis=0, return_counts=True)
        return keys[counts >= self.least[keys[:, 1]]]

    def verify(self, codes: np.ndarray, ends: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edits of each region's window against its document inside the band, and where that alignment ends
        (a code) and began (its diagonal). Windows of one size are aligned together, a row of the matrix a step."""
        edits = np.full(len(regions), 1 << 20)
        last = np.zeros(len(regions), np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        for size in np.unique(self.win_size[regions[:, 1]]):
            mine = np.flatnonzero(self.win_size[regions[:, 1]] == size)
            budget = int(self.budget[regions[mine[0], 1]])
            for cut in range(0, len(mine), 2000):
                some = mine[cut : cut + 2000]
                doc, win, base = regions[some].T
                width = 2 * (2 * budget + 1) + 2 * budget + 1
                low = base - budget
                pattern = np.stack([self.texts[self.win_item[w]][self.win_start[w] : self.win_start[w] + size] for w in win])
                lane = np.arange(width)
                cost = np.zeros((len(some), width), np.int64)
                for i in range(size):
                    place = low[:, None] + i + lane
                    valid = (place >= begins[doc][:, None]) & (place < ends[doc][:, None])
                    char = np.where(valid, codes[np.clip(place, 0, len(codes) - 1)], 1)
                    new = cost + (char != pattern[:, i : i + 1])
                    new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
                    cost = np.minimum.accumulate(new - lane, axis=1) + lane
                best = cost.argmin(1)
                edits[some] = cost[np.arange(len(some)), best]
                last[some] = low + size + best
        return edits, last, begins[regions[:, 0]] if len(regions) else last


FOUND = "item_id long, window_start long, doc_start long, doc_end long, edits int"


def find_leaks(texts: list[str | None], index: Index) -> list[list[tuple]]:
    """For each text, the rows of ``FOUND``, one per item: its best window, and the stretch of the text from the first
    to the last of the item's matching windows."""
    joined = "\x01".join((t or "").replace("\x01", " ") for t in texts)
    codes, at = normalise(joined)
    ends = np.append(np.flatnonzero(codes == 1), len(codes))
    regions = index.regions(codes, ends)
    edits, last, _ = index.verify(codes, ends, regions)
    good = edits <= index.budget[regions[:, 1]] if len(regions) else np.zeros(0, bool)
    text_begin = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts])])
    out: list[list[tuple]] = [[] for _ in texts]
    best: dict[tuple[int, int], list] = {}
    for (doc, win, _), e, end in zip(regions[good], edits[good], last[good]):
        item = int(index.win_item[win])
        begin = max(int(end) - int(index.win_size[win]), ends[doc - 1] + 1 if doc else 0)
        start, stop = int(at[begin] - text_begin[doc]), int(at[min(end, ends[doc]) - 1] + 1 - text_begin[doc])
        row = best.setdefault((int(doc), item), [int(e), int(index.win_start[win]), start, stop])
        if (int(e), int(index.win_start[win])) < (row[0], row[1]):
            row[0], row[1] = int(e), int(index.win_start[win])
        row[2], row[3] = min(row[2], start), max(row[3], stop)
    for (doc, item), (e, window, start, stop) in sorted(best.items()):
        out[doc].append((int(index.ids[item]), window, start, stop, e))
    return out


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about ``block_chars`` characters, read block by block; items without id or text are left out."""
    clean = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = clean.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    for k in range(blocks):
        yield [(r.item_id, r.text) for r in clean.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()]


def contamination(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id, window_start, doc_start, doc_end, edits): one row for each document and item that leaks into it.

    ``docs`` needs doc_id and text; other columns play no part, so names can't clash. Null and empty texts and items
    leak nothing, nor do items of fewer than ``Q`` normalised characters. Equal rows give equal rows. Places are
    character offsets in the document's own text; window_start counts normalised characters of the item. Empty tables
    give no rows.
    """
    spark = docs.sparkSession
    parts = []
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, **how)
            for batch in batches:
                for begin, stop in slices_of(batch.column(1)):
                    part = batch.slice(begin, stop - begin)
                    found = find_leaks(part.column(1).to_pylist(), index)
                    rows = [(d, *r) for d, leaks in zip(part.column(0).to_pylist(), found) for r in leaks]
                    columns = list(zip(*rows)) if rows else [[]] * 6
                    kinds = [pa.int64()] * 5 + [pa.int32()]
                    yield pa.record_batch(
                        [pa.array(c, k) for c, k in zip(columns, kinds)],
                        names=["doc_id", "item_id", "window_start", "doc_start", "doc_end", "edits"],
                    )

        parts.append(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + FOUND))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, that no item leaks into; rows without an id are judged by their text alike.

    One pass: each task keeps the rows of its batches that the index doesn't flag, so no join is needed.
    """
    spark, out = docs.sparkSession, docs
    place = docs.columns.index("text")
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, **how)
            for batch in batches:
                clean = [not leaks for a, b in slices_of(batch.column(place)) for leaks in find_leaks(batch.column(place).slice(a, b - a).to_pylist(), index)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
