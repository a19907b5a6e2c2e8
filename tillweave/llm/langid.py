"""Language ID by a byte convolutional network: filters of several widths, max pooling and softmax, trained in numpy.

The network is fitted on the driver to a bounded sample, ``PER_LANGUAGE`` labelled documents of each language with
``TRAIN_WINDOWS`` windows each. It is applied to all windows of every text in Arrow batches; a text's prediction is the
mean of its windows' log probabilities, weighted by their letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tillweave.llm.common import bytes_of, slices_of, small_batches

#: Bounds of the labelled sample.
PER_LANGUAGE = 500
TRAIN_WINDOWS = 3
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 6
EPOCHS = 5
UNKNOWN = "und"
_REACH = max(WIDTHS)
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)], np.uint8)


def held_out(doc_id: Column) -> Column:
    """Whether the row must not be learnt from; false for a null id, which isn't learnt from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 letters lower-cased and other ASCII as blanks."""
    out = _FOLD[data]
    if len(out) > 1:
        latin = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][latin] += 32
    return out


class Network(NamedTuple):
    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter within each window, and where."""
        x = self.embedding[windows]
        n, length, d = x.shape
        view = np.lib.stride_tricks.as_strided(x, (n, length - _REACH + 1, _REACH * d), (x.strides[0], x.strides[1], x.strides[2]))
        out = np.ascontiguousarray(view).reshape(-1, _REACH * d) @ self.filters
        return out.reshape(n, length - _REACH + 1, -1), view

    def logits(self, windows: np.ndarray) -> np.ndarray:
        top = self.pooled(windows)[0].max(1) + self.bias
        return np.maximum(top, 0) @ self.dense + self.dense_bias


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def train(texts: list[str], labels: list[str], seed: int = 11, epochs: int = EPOCHS, per_text: int = TRAIN_WINDOWS) -> Network:
    """Fits the network by Adam to windows spread over each text; a third of them are cut short, as short texts are."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    windows, y = [], []
    for text, label in zip(texts, labels):
        data = folded(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
        for _ in range(per_text if len(data) > WINDOW else 1):
            begin = int(rng.integers(0, max(1, len(data) - WINDOW + 1)))
            size = int(rng.integers(16, WINDOW)) if rng.random() < 0.33 else WINDOW + _REACH - 1
            piece = data[begin : begin + size]
            windows.append(np.pad(piece, (0, WINDOW + _REACH - 1 - len(piece)), constant_values=32))
            y.append(languages.index(label))
    x, y = np.array(windows, np.uint8).reshape(-1, WINDOW + _REACH - 1), np.array(y)
    n_filters, n_out = FILTERS * len(WIDTHS), max(1, len(languages))
    mask = np.zeros((_REACH, EMBEDDING, n_filters), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
    mask = mask.reshape(_REACH * EMBEDDING, n_filters)
    f32 = lambda a: np.asarray(a, np.float32)
    values = [
        f32(rng.normal(0, 0.5, (256, EMBEDDING))), f32(rng.normal(0, 0.3, mask.shape)) * mask, np.zeros(n_filters, np.float32),
        f32(rng.normal(0, 0.2, (n_filters, n_out))), np.zeros(n_out, np.float32),
    ]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    size = 64
    share = np.bincount(y, minlength=n_out) if len(y) else np.ones(n_out)
    weight = f32(len(y) / (n_out * np.maximum(share, 1)))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for cut in range(0, len(order), size):
            rows = order[cut : cut + size]
            net = Network(languages, *values)
            out, view = net.pooled(x[rows])
            at = out.argmax(1)
            top = np.take_along_axis(out, at[:, None, :], 1)[:, 0] + net.bias
            act = np.maximum(top, 0)
            error = np.exp(log_softmax(act @ net.dense + net.dense_bias))
            error[np.arange(len(rows)), y[rows]] -= 1
            error *= (weight[y[rows]] / len(rows))[:, None]
            back = (error @ net.dense.T) * (top > 0)
            patches = view[np.arange(len(rows))[:, None], at]  # window, filter, what it saw
            d_filters = np.einsum("nf,nfk->kf", back, patches) * mask
            d_seen = (back[:, :, None] * net.filters.T[None]).reshape(len(rows), n_filters, _REACH, EMBEDDING)
            seen = x[rows][np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(_REACH)]
            d_embedding = np.zeros_like(net.embedding)
            np.add.at(d_embedding, seen.reshape(-1), d_seen.reshape(-1, EMBEDDING))
            step += 1
            for k, g in enumerate((d_embedding, d_filters, back.sum(0), act.T @ error, error.sum(0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                values[k] = f32(values[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
            values[1] *= mask
    return Network(languages, *values)


def predict(net: Network, data: np.ndarray, offsets: np.ndarray, at_once: int = 128) -> np.ndarray:
    """Log probabilities of each text, from all of its windows; texts without bytes get equal ones."""
    sizes = np.diff(offsets)
    code = folded(data[offsets[0] : offsets[-1]]) if len(sizes) else np.zeros(0, np.uint8)
    begin = offsets[:-1] - offsets[0]
    count = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), count)
    start = begin[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    end = (begin + sizes)[owner]
    total = np.zeros((len(sizes), len(net.languages)))
    for cut in range(0, len(owner), at_once):
        some = slice(cut, cut + at_once)
        place = start[some, None] + np.arange(WINDOW + _REACH - 1)
        windows = np.where(place < end[some, None], code[np.minimum(place, len(code) - 1)], 32)
        letters = (windows != 32).sum(1)
        np.add.at(total, owner[some], log_softmax(net.logits(windows)) * letters[:, None])
    seen = np.zeros(len(sizes))
    cumulated = np.concatenate([[0], np.cumsum(code != 32)])
    seen = cumulated[begin + sizes] - cumulated[begin]
    # Windows of one text aren't independent: their mean, not their sum, is the text's score, sharpened by its square root.
    return log_softmax(total / np.maximum(seen, 1)[:, None] * np.sqrt(np.maximum(1, count))[:, None])


def labelled_sample(docs: DataFrame, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` rows (text, label) of each label, those with the smallest hashes of their ids.

    Only ids are ranked, with a limit that each task applies first; the chosen ids, of bounded number, are broadcast.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    order = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", label).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_label)
    return usable.select("doc_id", "text", label).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").select("text", label)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network:
    """The network for the languages of ``docs`` (doc_id, text, lang), from rows that aren't held out."""
    rows = labelled_sample(docs.withColumn("lang", F.col("lang").cast("string")), "lang", per_language)
    # A training text is as long as its windows need: pieces from its whole length, chosen by place.
    piece = F.when(F.octet_length("text") <= 4096, F.col("text")).otherwise(
        F.concat_ws(" ", *(F.expr(f"substring(text, 1 + CAST(floor(length(text) * {k} / 8) AS INT), 500)") for k in range(8)))
    )
    got = sorted((r.lang, r.text) for r in rows.select(piece.alias("text"), "lang").collect() if _LETTER.search(r.text))
    order = np.random.default_rng(5).permutation(len(got))
    return train([got[i][1] for i in order], [got[i][0] for i in order])


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """All columns of ``docs`` but earlier ones of these names, with lang_pred and score.

    Every whole text is read, in one pass without a shuffle. Null texts, texts without a letter, and all texts if
    nothing was learnt are ``und`` with score 0. Equal rows give equal rows; an empty table gives none.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    place = [c.lower() for c in kept].index("text")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for begin, stop in slices_of(batch.column(place), 1 << 18):
                part = batch.slice(begin, stop - begin)
                data, offsets = bytes_of(part.column(place))
                if net.languages:
                    logs = predict(net, data, offsets)
                    best = logs.argmax(1)
                    names, scores = [net.languages[i] for i in best], np.exp(logs[np.arange(len(best)), best])
                else:
                    names, scores = [UNKNOWN] * len(part), np.zeros(len(part))
                plain = np.zeros(len(data) + 1, np.int64)
                np.cumsum((_FOLD[data] != 32) & (data < 128), out=plain[1:])
                for i in np.flatnonzero(plain[offsets[1:]] == plain[offsets[:-1]]):
                    text = part.column(place)[i].as_py()
                    if not text or not _LETTER.search(text):
                        names[i], scores[i] = UNKNOWN, 0.0
                columns = [*part.columns, pa.array(names, pa.string()), pa.array(np.minimum(scores, 1.0), pa.float64())]
                yield pa.record_batch(columns, names=[*part.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return small_batches(docs).mapInArrow(run, schema)
