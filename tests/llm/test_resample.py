"""Importance resampling: features, weights, ranks and the draw against a plain loop."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from test_free import odd
from tillweave.llm import resample
from tillweave.llm.common import bytes_of, stored


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def buckets_of(text, runs, buckets):
    words = words_of(text)
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, runs + 1) for i in range(len(words) - k + 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB1 é🙂\x00.", max_size=30)), max_size=6), st.integers(1, 3))
def test_features_equal_a_plain_loop(texts, runs):
    texts = [*texts, "x" * 100 + " y " + "z" * resample.LONG_WORD]
    found, owner, words = resample.features_of(*bytes_of(pa.array(texts, pa.string())), runs, 10_000)
    want = [(i, b) for i, t in enumerate(texts) for b in buckets_of(t, runs, 10_000)]
    assert sorted(zip(owner.tolist(), found.tolist())) == sorted(want)
    assert words.tolist() == [len(words_of(t)) for t in texts]


def plain_draw(docs, target, runs, buckets, percent, min_words, seed):
    corpus, aim = np.zeros(buckets, int), np.zeros(buckets, int)
    for counts, texts in ((corpus, [t for _, t in docs]), (aim, target)):
        for text in texts:
            for b in buckets_of(text, runs, buckets):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (corpus.sum() + buckets) / ((s + 1) * (aim.sum() + buckets)))) for s, t in zip(corpus.tolist(), aim.tolist())]
    rows = []
    for doc_id, text in docs:
        mine = [gain[b] for b in buckets_of(text, runs, buckets)]
        weight = sum(mine) // len(mine) if mine else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(mine), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= min_words])
    can = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    most = len(can) * percent // 100
    drawn = [(*r[:4], k if k <= most else None) for k, r in enumerate(can, 1)]
    return sorted(map(repr, [*drawn, *((*r[:4], None) for r in rows if not r[4])]))


def corpus(rng, n):
    letters = "abcdefg"
    return [(i * 7 - 90, " ".join("".join(rng.choices(letters, k=rng.randint(1, 3))) for _ in range(rng.choice([0, 5, 25, 40])))) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"run_words": 2, "buckets": 50, "percent": 35, "min_words": 3, "seed": 5}, {"percent": 0}, {"percent": 100}])
def test_draw_equals_a_plain_loop(spark, how):
    rng = random.Random(6)
    docs = corpus(rng, 400)
    docs += [(None, "no id " * 20), (None, "no id " * 20), (None, None), (3, ""), (4, None), (5, "é " * 30), (5, "é " * 30), (5, "other " * 30)]
    target = ["ab ab cd a b c", None, "", "É ef", "abc"]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, rank string").repartition(6)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    names = {"runs": how.get("run_words", 1), "buckets": how.get("buckets", 10_000), "percent": how.get("percent", 10), "min_words": how.get("min_words", 20), "seed": how.get("seed", 2024)}
    got = resample.draw(table, aim, **how).collect()
    assert sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in got) == plain_draw(docs, target, **names)


def test_ranks_of_many_segments(spark):
    """Ties, equal rows and a hot score are dealt over segments; ranks are those of one sort."""
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(50)]), rng.choice([7, 7, 7, rng.randint(-20, 20)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, score long").repartition(7)
    runs = df.sortWithinPartitions(F.col("score").desc(), F.col("doc_id").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id())
    runs = stored(runs, "runs")
    for most, segment_rows in ((3000, 100), (1200, 64), (1, 500), (5000, 1 << 20)):
        got = resample.exact_ranks(runs, most, samples=4, segment_rows=segment_rows).collect()
        assert len(got) == 3000 and len({r.place for r in got}) == 3000
        ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, min(most, 3000) + 1))
        key = lambda d, s: (-s, d is None, d or 0)
        assert [key(r.doc_id, r.score) for r in ranked] == sorted(key(*r) for r in rows)[: len(ranked)]


def test_resample_keeps_rows_whole(spark):
    docs = odd(spark, [(i, f"word{i % 13} " * 25) for i in range(10, 210)])
    target = docs.where("doc_id < 60").select("text")
    got = resample.resample(docs, target)
    drawn = {r.doc_id for r in resample.draw(docs, target).where("rank IS NOT NULL").collect()}
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == drawn and len(drawn) == 20
    assert resample.draw(docs.limit(0), target).collect() == [] and resample.resample(docs.limit(0), target).collect() == []
    assert resample.draw(docs, target.limit(0)).count() == docs.count()


def test_target_words_are_drawn_more_often(spark):
    docs = spark.createDataFrame([(i, ("wanted " if i % 2 else "other ") * 30) for i in range(2000)], "doc_id long, text string")
    target = spark.createDataFrame([("wanted " * 1000,)], "text string")
    got = [r.doc_id % 2 for r in resample.resample(docs, target).select("doc_id").collect()]
    assert len(got) == 200 and sum(got) > 0.9 * len(got)
