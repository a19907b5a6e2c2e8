"""Token ids as binary blocks: canonical length-limited Huffman codes from global counts.

The format is a pair of Parquet data sets, so that any store that Spark can write will do:

``codebook``
    one row per id in use: ``id``, ``length`` (bits, at most ``MAX_BITS``). Codes are canonical: they count up
    in order of (length, id), so lengths alone rebuild the tables.
``blocks``
    one row per block of whole documents: ``part`` and ``block`` (their order is the order of doc_id),
    ``first`` (tokens of the part's blocks before),
    ``n_tokens``, ``doc_ids`` and ``doc_tokens`` (ids of each document, the end id included), ``bits`` (the codes,
    most significant bit first) and ``offsets`` (bit offset of every ``STRIDE``-th token). A block needs nothing but
    the codebook to be read; its checkpoints are decoded side by side with one table look-up a token.

Work on Spark: tokenize once and store 16-bit ids; sum partial counts; range-sort by doc_id; code block by block.
Only the counts of the vocabulary and one total per partition reach the driver.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillweave.llm.common import shared_path, slices_of, stored

END_ID = 0
MAX_BITS = 20
STRIDE = 256
BLOCK_TOKENS = 1 << 18
#: Distinct words whose ids a worker remembers before it starts anew; bounds memory, changes no result.
MEMO_WORDS = 800_000


class WordEncoder:
    """Ids of whole texts by the tokenizers library, remembered word by word.

    The byte-level pre-tokenizer cuts wherever white space follows another character, after a line feed that another
    character follows, and between a letter and a full stop or comma. A text is cut at such places only, so the ids of
    its parts stand in a row; each distinct part is encoded once by the library. Texts with white space before a blank
    or line feed are encoded whole.

    A part's number is its place in ``numbers``, which counts up by itself, so a part is looked up once; the ids of all
    parts lie behind each other in one array, and those of a batch are gathered by number.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.forget()
        self.marks = dict(zip(".,", self.looked_up([".", ","])))
        feed = self.looked_up(["\n"])[0]
        self.feed = int(feed[0]) if len(feed) == 1 else -1

    def forget(self) -> None:
        """Drops all parts, which bounds memory."""
        self.numbers: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.ids = np.zeros(1 << 16, self.kind)
        self.ends = np.zeros(1 << 16, np.int64)  # where the ids of each part end
        self.known = 0  # parts whose ids are there
        self.uncut: set[int] = set()  # parts that white space ends

    def looked_up(self, parts: list[str]) -> list[np.ndarray]:
        out = []
        for begin in range(0, len(parts), 20_000):
            out += [np.array(got.ids, self.kind) for got in self.tokenizer.encode_batch_fast(parts[begin : begin + 20_000], add_special_tokens=False)]
        return out

    def looked_up_words(self, words: list[str], at_once: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without white space, a blank before each, and their numbers: many to a call, with line feeds, which are cut off, between."""
        ids, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        groups = [words[begin : begin + at_once] for begin in range(0, len(words), at_once)]
        joined = ["".join(f" {w}\n" for w in some) for some in groups]
        for some, got in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            found = np.array(got.ids, self.kind)
            ends = np.flatnonzero(found == self.feed)
            if self.feed >= 0 and len(ends) == len(some):
                ids.append(np.delete(found, ends))
                sizes.append(np.diff(ends, prepend=-1) - 1)
            else:  # something that the library doesn't cut off
                each = self.looked_up([" " + w for w in some])
                ids += each
                sizes.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def learn(self) -> None:
        """Finds the ids of the parts that have a number only. One that doesn't begin with a line feed stands for a blank and itself."""
        fresh = list(itertools.islice(reversed(self.numbers), len(self.numbers) - self.known))[::-1]
        if not fresh:
            return
        self.uncut.update(self.known + i for i, p in enumerate(fresh) if p == "" or p[-1].isspace())
        mark = [self.marks[p[-1]] if p[-1:] in self.marks and p[-2:-1].isalpha() else None for p in fresh]
        stems = [p if m is None else p[:-1] for p, m in zip(fresh, mark)]
        plain = np.fromiter((p.isalpha() or len(p.split()) == 1 and p == p.strip() for p in stems), bool, len(stems))
        at = np.flatnonzero(~plain)
        other = self.looked_up([stems[i] if stems[i][:1] == "\n" else " " + stems[i] for i in at.tolist()])
        words, counts = self.looked_up_words([stems[i] for i in np.flatnonzero(plain).tolist()])
        ids = np.concatenate([words, *other, *(self.marks[m] for m in ".,")])
        # Where each stem's ids lie in ``ids``, and how many they are.
        size = np.zeros(len(stems), np.int64)
        size[plain], size[at] = counts, [len(x) for x in other]
        begin = np.zeros(len(stems), np.int64)
        begin[plain] = np.cumsum(counts) - counts
        begin[at] = len(words) + np.cumsum(size[at]) - size[at]
        marks_at = len(ids) - sum(len(self.marks[m]) for m in ".,")
        where = {".": marks_at, ",": marks_at + len(self.marks["."])}
        ending = np.array([where[p[-1]] if m is not None else 0 for p, m in zip(fresh, mark)], np.int64)
        more = np.array([0 if m is None else len(m) for m in mark], np.int64)
        made = ids[runs(np.stack([begin, ending], 1).reshape(-1), np.stack([size, more], 1).reshape(-1))]
        before = int(self.ends[self.known - 1]) if self.known else 0
        self.ids = grown(self.ids, before, made)
        self.ends = grown(self.ends, self.known, before + np.cumsum(size + more))
        self.known = len(self.numbers)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        if self.known > MEMO_WORDS:
            self.forget()
        cut = [t.replace("\n", " \n").split(" ") for t in texts]
        heads = [parts.pop(0) for parts in cut]
        sizes = np.array([len(parts) for parts in cut], np.int64)
        number = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        self.learn()
        owner = np.repeat(np.arange(len(cut)), sizes)
        whole = np.array([a[-1:].isspace() for a in heads], bool)
        if self.uncut:
            whole[owner[np.isin(number, list(self.uncut))]] = True
        if whole.any():
            number, owner = number[~whole[owner]], owner[~whole[owner]]
            heads = [t if w else a for t, a, w in zip(texts, heads, whole.tolist())]
        begin = np.where(number > 0, self.ends[number - 1], 0)
        count = self.ends[number] - begin
        blob = self.ids[runs(begin, count)].tobytes()
        ends = (np.cumsum(np.bincount(owner, count, len(cut))).astype(np.int64) * self.kind.itemsize).tolist()
        return [a.tobytes() + blob[x:y] for a, x, y in zip(self.looked_up(heads), [0, *ends], ends)]


def runs(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of every run, ``count`` of them, one run after the other."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + count, count)


def grown(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` behind its first ``used`` values; doubled when full."""
    if used + len(more) > len(held):
        held = np.concatenate([held[:used], np.zeros(max(len(held), len(more)), held.dtype)])
    held[used : used + len(more)] = more
    return held


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, wide, ids): little-endian 16-bit ids of each whole text and the end id (32-bit for large vocabularies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        end = np.array([end_id], "<u4" if encoder.wide else "<u2").tobytes()
        for batch in batches:
            for begin, stop in slices_of(batch.column(1)):
                part = batch.slice(begin, stop - begin)
                ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.record_batch(
                    [part.column(0), pa.array([encoder.wide] * len(ids), pa.bool_()), pa.array([x + end for x in ids], pa.binary())],
                    names=["doc_id", "wide", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, wide boolean, ids binary")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ids_of(blob: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(blob, "<u4" if wide else "<u2")


def count_ids(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents; each task sends one row per id it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for begin, stop in slices_of(batch.column(1), 1 << 23):
                part = batch.slice(begin, stop - begin)
                flags, blobs = part.column(0).to_pylist(), part.column(1).to_pylist()
                for wide in set(flags):
                    n = np.bincount(ids_of(b"".join(b for b, f in zip(blobs, flags) if f == wide), wide), minlength=len(total))
                    total = np.pad(total, (0, len(n) - len(total)))
                    total += n
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return tokens.select("wide", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with none above ``max_bits``, by package-merge.

    Each level holds the sorted weights of leaves and of pairs from the level below, as rows of leaf counts would;
    going back from the top, the number of leaves taken at a level says that the lightest so many get one more bit.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError("more ids in use than codes of that length")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    weights = leaves
    leaf_flags = [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        weights = both[at]
        leaf_flags.append(at < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for flags in reversed(leaf_flags):
        picked = int(flags[:take].sum())
        lengths[:picked] += 1
        take = 2 * (take - picked)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of (length, id), and the codes in that order."""
    order = np.lexsort((ids, lengths))
    sizes = lengths[order]
    codes = np.zeros(len(ids), np.int64)
    # A code counts the space that all codes before it fill, in units of its own length.
    top = int(sizes[-1]) if len(sizes) else 0
    filled = np.concatenate([[0], np.cumsum(1 << (top - sizes))[:-1]]) if len(sizes) else codes
    return order, (filled >> (top - sizes)) if len(sizes) else codes


class Codec:
    """Encoding and table-driven decoding by one codebook."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order, codes = canonical_codes(ids, lengths)
        self.ids, self.sizes = ids[order], lengths[order]
        self.top = int(self.sizes[-1]) if len(order) else 1
        size = int(ids.max()) + 1 if len(ids) else 1
        self.code = np.zeros(size, np.uint64)
        self.length = np.zeros(size, np.int64)
        self.code[self.ids], self.length[self.ids] = codes.astype(np.uint64), self.sizes
        spans = 1 << (self.top - self.sizes)
        self.symbol_at = np.repeat(self.ids, spans).astype(np.uint32)
        self.length_at = np.repeat(self.sizes, spans).astype(np.uint8)

    def encode(self, ids: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
        """Bits in big-endian words, two of them in reserve, and the offset of every ``stride``-th token."""
        sizes = self.length[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        total = int(ends[-1]) if len(ends) else 0
        n_words = total // 32 + 3
        shifted = self.code[ids] << (64 - (starts & 31) - sizes).astype(np.uint64)
        word = starts >> 5
        # Codes don't overlap, so sums of their parts are the words; below 2**32 doubles are exact.
        bits = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), n_words)
        bits += np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words)
        return bits.astype(np.uint64).astype(">u4").tobytes(), starts[::stride].astype(np.int64)

    def decode(self, bits: bytes, offsets: np.ndarray, n: int, stride: int = STRIDE) -> np.ndarray:
        """All checkpoints advance together, a token a step."""
        words = np.frombuffer(bits, ">u4").astype(np.uint64)
        at = np.asarray(offsets, np.int64).copy()
        out = np.zeros((stride, len(at)), np.uint32)
        shift = np.uint64(64 - self.top)
        last = n - (len(at) - 1) * stride if len(at) else 0
        for step in range(min(stride, n)):
            if step == last and len(at):
                at = at[:-1]
            word, bit = at >> 5, (at & 31).astype(np.uint64)
            window = ((words[word] << np.uint64(32)) | words[word + 1]) << bit
            code = (window >> shift).astype(np.int64)
            out[step, : len(at)] = self.symbol_at[code]
            at = at + self.length_at[code]
        return out.T.reshape(-1)[:n]


BLOCKS = "part int, block int, first long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, bits binary, offsets array<long>"


def write_blocks(tokens: DataFrame, path: str, max_bits: int = MAX_BITS, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes ``codebook`` and ``blocks`` below ``path`` in ascending doc_id order; null ids come first, ties by ids' bytes.

    A block closes when it has ``block_tokens``; documents aren't cut, so a longer one makes a longer block.
    """
    spark = tokens.sparkSession
    rows = count_ids(tokens).orderBy("id").collect()  # at most one row per id of the vocabulary
    ids = np.array([r.id for r in rows], np.int64)
    lengths = code_lengths(np.array([r.n for r in rows], np.int64), max_bits)
    book = spark.createDataFrame([(int(i), int(x)) for i, x in zip(ids, lengths)], "id long, length int")
    book.coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((ids, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, block = Codec(*shared.value), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        first = size = 0

        def close() -> pa.RecordBatch:
            bits, offsets = codec.encode(np.concatenate(held).astype(np.int64))
            values = [[part], [block], [first], [size], [docs], [[len(x) for x in held]], [bits], [offsets.tolist()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
            names = [x.split(" ")[0] for x in BLOCKS.split(", ")]
            return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            for doc, wide, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held.append(ids_of(blob.as_py(), wide).copy())
                docs.append(doc)
                size += len(held[-1])
                if size >= block_tokens:
                    yield close()
                    docs, held, first, size, block = [], [], first + size, 0, block + 1
        if held:
            yield close()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")


def read_blocks(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decodes the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, ids.

    Totals of partitions, one row each, give every part its start.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    book = spark.read.parquet(f"{path}/codebook").orderBy("id").collect()
    shared = spark.sparkContext.broadcast((np.array([r.id for r in book], np.int64), np.array([r.length for r in book], np.int64)))
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    begin, at = {}, 0
    for r in totals:
        begin[r.part], at = at, at + r.n
    starts = spark.sparkContext.broadcast(begin)
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = codec.decode(row["bits"], np.array(row["offsets"]), row["n_tokens"])
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                raw, starts_in = ids.astype("<u4").tobytes(), ends - sizes
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts_in, ends)]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()), pa.array(starts_in + starts.value[row["part"]] + row["first"], pa.int64()),
                    pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].tolist() for a, b in zip(starts_in, ends)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    return blocks.mapInArrow(run, out)


def token_files(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """Encodes all documents, writes the files to the shared folder and reads them back.

    Needs ``doc_id`` and ``text``; other columns play no part. Null and empty texts are the end id alone; rows with
    equal ids are written one after the other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tokens = stored(tokenize(docs, tokenizer_path), "tokens")
    path = shared_path(spark, "token-files")
    write_blocks(tokens, path)
    return read_blocks(spark, path, with_ids)
