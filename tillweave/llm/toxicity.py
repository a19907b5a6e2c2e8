"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Examples are a bounded sample of labelled documents, ``PER_LABEL`` of each label. Terms are words and their proper
beginnings; all terms of the examples span the TF-IDF space. A term's weight also grows with how much the labels single
it out (1 plus its likelihood-ratio test where toxic examples hold it more often), so that a few telling words in a long
text decide who is near it, and no term is left out for being rare or untelling. The examples' inverted index keeps, for
each term and each block of examples that holds it, the largest weight; a text's bound for a block is the sum over its
terms, blocks are read in the order of their bounds, and reading stops when no bound exceeds the kth cosine: the
neighbours are exact. Their votes, weighted by squared cosine and by how the sample represents its label, are calibrated
by isotonic regression on leave-one-out votes of the examples. Neighbours are returned as evidence.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tillweave.llm.common import slices_of, stored
from tillweave.llm.langid import held_out
from tillweave.llm.tokens import grown

#: Bound of the labelled sample.
PER_LABEL = 1500
NEIGHBOURS = 25
BLOCK = 64
#: Terms that one example in so many holds are columns of the blocks' matrices.
COMMON = 16
#: Blocks that every text reads, those of its highest bounds; of the others it reads those that its bounds don't rule out.
FIRST_BLOCKS = 8
#: Texts that are searched at a time, and postings of rare terms that they meet.
AT_ONCE = 128
MOST_POSTINGS = 1 << 20
THRESHOLD = 0.3
PREFIXES = range(4, 11)
#: Words whose terms a worker remembers before it starts anew.
MEMO_WORDS = 400_000
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    """The word and, marked, its proper beginnings."""
    return [word] + [word[:n] + "~" for n in PREFIXES if n < len(word)]


def document_terms(text: str) -> set[str]:
    out: set[str] = set()
    for word in set(_WORD.findall(text.lower())):
        out.update(terms_of(word))
    return out


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indices of all ranges of ``n`` from ``first``, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Model(NamedTuple):
    terms: dict[str, int]
    weights: np.ndarray  # of the terms: inverse document frequency times what the labels tell
    ids: np.ndarray  # of the examples
    toxic: np.ndarray
    weight: np.ndarray  # documents that an example stands for
    pointer: np.ndarray  # term -> first entry
    block: np.ndarray  # entries, one per term and block that holds it: the block,
    most: np.ndarray  # its largest weight
    start: np.ndarray  # and its first posting
    owner: np.ndarray  # postings: example and weight
    value: np.ndarray
    steps: np.ndarray  # isotonic calibration: votes and probabilities
    level: np.ndarray
    base: float  # probability of a text without any term

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights, of length 1."""
        t, n = np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), float, len(counts))
        order = np.argsort(t)
        return t[order], self.weighed(np.array([len(t)]), t[order], n[order])

    def weighed(self, sizes: np.ndarray, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Weights of the terms of several texts, each text's of length 1."""
        w, of = (1 + np.log(n)) * self.weights[t], np.repeat(np.arange(len(sizes)), sizes)
        return w / np.maximum(np.sqrt(np.bincount(of, w * w, len(sizes))), 1e-12)[of]

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest positive cosine, ties to the earlier one, and the cosines."""
        return Search(self).nearest(np.array([len(t)]), t, w, k, np.array([without]))[0]

    def vote(self, found: np.ndarray, score: np.ndarray) -> float:
        w = score**2 * self.weight[found]
        return float((w * self.toxic[found]).sum() / w.sum()) if w.sum() > 0 else self.base

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, self.steps, self.level)) if len(self.steps) else self.base


class Search:
    """Nearest examples of several texts at a time.

    Postings of terms that few examples hold are summed first. Those of all others lie in a matrix for each block, so
    that a block is read for all texts that need it by one product. A block's bound is the product of the index's
    largest weights, and the best of the sums: never below a cosine.
    """

    def __init__(self, model: Model):
        self.model, self.blocks = model, max(1, -(-len(model.ids) // BLOCK))
        self.first = model.start[model.pointer[:-1]]
        self.held = model.start[model.pointer[1:]] - self.first
        common = np.flatnonzero(self.held * COMMON >= max(COMMON, len(model.ids)))
        self.column = np.full(len(self.held), -1, np.int64)
        self.column[common] = np.arange(len(common))
        whole = np.zeros((self.blocks, len(common), BLOCK))
        at, column = ranges(self.first[common], self.held[common]), np.repeat(np.arange(len(common)), self.held[common])
        whole[model.owner[at] // BLOCK, column, model.owner[at] % BLOCK] = model.value[at]
        n = model.pointer[common + 1] - model.pointer[common]
        at = ranges(model.pointer[common], n)
        self.whole, self.most = whole, np.zeros((len(common), self.blocks))
        self.most[np.repeat(np.arange(len(common)), n), model.block[at]] = model.most[at]

    def nearest(self, sizes: np.ndarray, t: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text, of ``sizes`` terms ``t`` with weights ``w``, the k examples of highest positive cosine, ties
        to the earlier one, and the cosines; ``without`` names an example, or -1, that a text doesn't count."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        ends, begin = np.cumsum(sizes), 0
        few = np.cumsum(np.concatenate([[0], np.where(self.column[t] < 0, self.held[t], 0)]))
        while begin < len(sizes):
            low = ends[begin] - sizes[begin]
            stop = begin + int(np.searchsorted(few[ends[begin : begin + AT_ONCE]], few[low] + MOST_POSTINGS, "right"))
            stop = max(begin + 1, stop)
            these = slice(low, ends[stop - 1])
            out += self.nearest_of(sizes[begin:stop], t[these], w[these], k, None if without is None else without[begin:stop])
            begin = stop
        return out

    def nearest_of(self, sizes: np.ndarray, t: np.ndarray, w: np.ndarray, k: int, without: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        m, rows, width, of = self.model, len(sizes), self.blocks * BLOCK, np.repeat(np.arange(len(sizes)), sizes)
        column = self.column[t]
        common = column >= 0
        x = np.zeros((rows, self.whole.shape[1]))
        x[of[common], column[common]] = w[common]
        n = self.held[t[~common]]
        at = ranges(self.first[t[~common]], n)
        score = np.bincount(np.repeat(of[~common] * width, n) + m.owner[at], m.value[at] * np.repeat(w[~common], n), rows * width).astype(float).reshape(rows, width)
        bound = x @ self.most + score.reshape(rows, self.blocks, BLOCK).max(2)

        def known() -> np.ndarray:
            cosines = np.where(np.repeat(read, BLOCK, 1), score, 0)
            if without is not None:
                cosines[without >= 0, without[without >= 0]] = 0
            return cosines

        def kth(cosines: np.ndarray) -> np.ndarray:
            return np.partition(cosines, width - k, 1)[:, width - k, None] if k <= width else np.zeros((rows, 1))

        read = np.zeros(bound.shape, bool)
        best = np.argpartition(-bound, min(FIRST_BLOCKS, self.blocks) - 1, 1)[:, :FIRST_BLOCKS]
        np.put_along_axis(read, best, True, 1)
        read &= bound > 0
        need = read
        for last in (False, True):
            for block in np.flatnonzero(need.any(0)).tolist():
                mine = np.flatnonzero(need[:, block])
                score[mine, block * BLOCK : (block + 1) * BLOCK] += x[mine] @ self.whole[block]
            if not last:
                need = ~read & (bound > 0) & (bound >= kth(known()) - 1e-12)
                read = read | need
        cosines = known()
        rounded = np.round(cosines, 12)
        near = (cosines > 0) & (rounded >= kth(rounded))
        out = []
        for i in range(rows):
            found = np.flatnonzero(near[i])
            found = found[np.lexsort((found, -rounded[i, found]))[:k]]
            out.append((found, cosines[i, found]))
        return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes and non-decreasing means by pooling adjacent violators."""
    groups: list[list[float]] = []
    for v, target, weight in sorted(zip(x.tolist(), y.tolist(), w.tolist())):
        if groups and groups[-1][3] == v:
            groups[-1][0] += target * weight
            groups[-1][1] += weight
        else:
            groups.append([target * weight, weight, v, v])
        while len(groups) > 1 and groups[-2][0] * groups[-1][1] >= groups[-1][0] * groups[-2][1]:
            s, n, _, high = groups.pop()
            groups[-1] = [groups[-1][0] + s, groups[-1][1] + n, groups[-1][2], high]
    steps = [v for g in groups for v in (g[2], g[3])]
    level = [g[0] / g[1] for g in groups for _ in range(2)]
    return np.array(steps), np.array(level)


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic) of at most ``per_label`` documents of each label, and how many the labels hold of each.

    A document with several labels is toxic if one says so. Only ids are ranked; the chosen ones are broadcast.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_label).drop("_rank")
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return stored(texts, "toxic-sample"), totals


def vocabulary(examples: DataFrame) -> list[str]:
    """All terms of the examples, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in slices_of(batch.column(0), 1 << 21):
                seen = set().union(*map(document_terms, batch.column(0).slice(begin, stop - begin).to_pylist()))
                yield pa.record_batch([pa.array(list(seen), pa.string())], names=["term"])

    return sorted(examples.select("text").mapInArrow(run, "term string").distinct().toArrow().column(0).to_pylist())


def telling(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The likelihood-ratio test of terms in ``a`` of ``n1`` toxic and ``b`` of ``n0`` other examples; 0 where toxic
    examples don't hold them more often."""

    def part(n: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.where(n > 0, n * np.log(np.maximum(n, 1e-12) / np.maximum(of, 1e-12)), 0)

    both, rest, of = a + b, n1 + n0 - a - b, max(1, n1 + n0)
    test = part(a, both * n1 / of) + part(b, both * n0 / of) + part(n1 - a, rest * n1 / of) + part(n0 - b, rest * n0 / of)
    return np.where(a * n0 > b * n1, np.maximum(2 * test, 0), 0)


class Reader:
    """Counts of a model's terms in texts; a word's terms are looked up once."""

    def __init__(self, terms: dict[str, int]):
        self.terms = terms
        self.forget()

    def forget(self) -> None:
        """Drops all words, which bounds memory."""
        self.numbers: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.found = np.zeros(1 << 16, np.int64)  # the terms of all words, one word after the other
        self.ends = np.zeros(1 << 16, np.int64)
        self.known = 0

    def learn(self) -> None:
        """Finds the terms of the words that have a number only."""
        fresh = list(itertools.islice(reversed(self.numbers), len(self.numbers) - self.known))[::-1]
        if not fresh:
            return
        got = [[self.terms[t] for t in terms_of(word) if t in self.terms] for word in fresh]
        before = int(self.ends[self.known - 1]) if self.known else 0
        self.found = grown(self.found, before, np.fromiter(itertools.chain.from_iterable(got), np.int64))
        self.ends = grown(self.ends, self.known, before + np.cumsum(np.fromiter(map(len, got), np.int64, len(got))))
        self.known = len(self.numbers)

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many terms each text has, these, ascending, and how often each occurs."""
        if self.known > MEMO_WORDS:
            self.forget()
        words = [_WORD.findall(text.lower()) for text in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        number = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(sizes.sum()))
        self.learn()
        held = np.repeat(np.arange(len(words)), sizes) * max(1, self.known) + number
        held.sort()
        first = np.flatnonzero(np.diff(held, prepend=-1))
        owner, number, times = *np.divmod(held[first], max(1, self.known)), np.diff(first, append=len(held))
        begin = np.where(number > 0, self.ends[number - 1], 0)
        n, width = self.ends[number] - begin, max(1, len(self.terms))
        held = np.repeat(owner, n) * width + self.found[ranges(begin, n)]
        order = np.argsort(held)
        held = held[order]
        first = np.flatnonzero(np.diff(held, prepend=-1))
        owner, t = np.divmod(held[first], width)
        times = np.add.reduceat(np.repeat(times, n)[order], first) if len(first) else first
        return np.bincount(owner, minlength=len(words)), t, times


def build(vectors: list[tuple[int, int, dict[int, int]]], terms: list[str], totals: dict[int, int]) -> Model:
    """The index and its calibration from (doc_id, toxic, term counts) of all examples."""
    flat = [x for v in vectors for x in v[2].items()]
    t, counts = (np.array([x[i] for x in flat], np.int64) for i in (0, 1))
    sizes = np.array([len(v[2]) for v in vectors], np.int64)
    return indexed(np.array([v[0] for v in vectors], np.int64), np.array([v[1] for v in vectors], float), sizes, t, counts, terms, totals)


def indexed(ids: np.ndarray, toxic: np.ndarray, sizes: np.ndarray, t: np.ndarray, counts: np.ndarray, terms: list[str], totals: dict[int, int]) -> Model:
    """``build`` from arrays: the terms and counts of all examples, ``sizes`` of them for each."""
    n, blocks = len(ids), max(1, -(-len(ids) // BLOCK))
    n1, n0 = int((toxic == 1).sum()), int((toxic == 0).sum())
    weight = np.where(toxic == 1, totals.get(1, 0) / max(1, n1), totals.get(0, 0) / max(1, n0))
    own = np.repeat(np.arange(n), sizes)
    a, b = (np.bincount(t[toxic[own] == y], minlength=len(terms)).astype(float) for y in (1, 0))
    weights = (np.log((n + 1) / (a + b + 1)) + 1) * (1 + telling(a, b, n1, n0))
    w = (1 + np.log(np.maximum(counts, 1))) * weights[t]
    w /= np.maximum(np.sqrt(np.bincount(own, w * w, n)), 1e-12)[own]
    order = np.lexsort((own, t))
    t, w, own = t[order], w[order], own[order]
    start = np.flatnonzero(np.diff(t * blocks + own // BLOCK, prepend=-1))
    most = np.maximum.reduceat(w, start) if len(start) else np.zeros(0)
    pointer = np.searchsorted(t[start], np.arange(len(terms) + 1))
    empty = sizes == 0
    base = float((weight * toxic)[empty].sum() / weight[empty].sum()) if empty.any() else float((weight * toxic).sum() / max(weight.sum(), 1e-9))
    model = Model(
        dict(zip(terms, range(len(terms)))), weights, ids, toxic, weight, pointer, (own[start] // BLOCK).astype(np.int32), most,
        np.append(start, len(t)), own.astype(np.int32), w, np.zeros(0), np.zeros(0), base,
    )
    some = np.flatnonzero(~empty)
    by_example = np.argsort(own, kind="stable")
    found = Search(model).nearest(sizes[some], t[by_example], w[by_example], without=some)
    votes = np.array([model.vote(*f) for f in found])
    steps, level = isotonic(votes, toxic[some], weight[some]) if len(some) else (np.zeros(0), np.zeros(0))
    return model._replace(steps=steps, level=level)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """The model from labelled documents that aren't held out: doc_id, text; doc_id, toxic. With one label only, or
    none, nothing tells texts apart, and the model has no terms."""
    examples, totals = sample(docs, labels, per_label)
    sizes = {r.toxic: r.n for r in examples.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    terms = vocabulary(examples) if sizes.get(1) and sizes.get(0) else []
    shared = examples.sparkSession.sparkContext.broadcast(dict(zip(terms, range(len(terms)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            for begin, stop in slices_of(batch.column(1)):
                part = batch.slice(begin, stop - begin)
                sizes, t, n = reader.rows(part.column(1).to_pylist())
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (t, n)]
                yield pa.record_batch([part.column(0), part.column(2), *lists], names=["doc_id", "toxic", "t", "n"])

    rows = examples.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic").mapInArrow(run, "doc_id long, toxic int, t array<int>, n array<int>").toArrow()
    order = [i for _, _, i in sorted(((v * 2654435761) % 2**32, v, i) for i, v in enumerate(rows.column(0).to_pylist()))]
    rows = rows.take(pa.array(order, pa.int64())).combine_chunks()
    ids, toxic = rows.column(0).to_numpy(), rows.column(1).to_numpy().astype(float)
    t, n = (pc.list_flatten(rows.column(i)).to_numpy().astype(np.int64) for i in (2, 3))
    return indexed(ids, toxic, pc.list_value_length(rows.column(2)).to_numpy().astype(np.int64), t, n, terms, totals)


SCORED = "score double, predicted int, evidence array<struct<doc_id: long, similarity: double, toxic: int>>"


def score_documents(docs: DataFrame, model: Model, k: int = NEIGHBOURS, threshold: float = THRESHOLD, shown: int = 3) -> DataFrame:
    """doc_id, score, predicted and the ``shown`` nearest examples of every whole text, in one pass without a shuffle.

    Needs doc_id and text; other columns play no part. Texts without any term, null and empty ones among them, get the
    probability of such texts and no evidence; without labels, 0. Equal texts score alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader, search, memo = Reader(model.terms), Search(model), {}
        for batch in batches:
            for begin, stop in slices_of(batch.column(1)):
                part = batch.slice(begin, stop - begin)
                texts = part.column(1).to_pylist()
                keys = [xxhash.xxh3_128_digest((text or "").encode()) for text in texts]
                if len(memo) > 100_000:
                    memo = {}
                fresh = {key: text or "" for key, text in zip(keys, texts) if key not in memo}
                sizes, t, n = reader.rows(list(fresh.values()))
                for key, size, (found, cosine) in zip(fresh, sizes.tolist(), search.nearest(sizes, t, model.weighed(sizes, t, n), k)):
                    near = [{"doc_id": int(model.ids[f]), "similarity": float(c), "toxic": int(model.toxic[f])} for f, c in zip(found[:shown], cosine)]
                    memo[key] = (model.calibrated(model.vote(found, cosine)), near) if size else (model.base, [])
                out = [memo[key] for key in keys]
                scores = [min(1.0, max(0.0, s)) for s, _ in out]
                kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
                yield pa.record_batch(
                    [part.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([e for _, e in out], kind)],
                    names=["doc_id", "score", "predicted", "evidence"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + SCORED)
