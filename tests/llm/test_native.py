"""Mixing and line dedup: edge cases and plans."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillweave.llm import lines, mixing

DOCS = "doc_id long, text string, source string, size string, n_lines string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, " ".join(["w%d" % (i % 7)] * (i % 23)), "abc"[i % 3] if i % 11 else None, "x", "y") for i in range(400)]
    rows += [(400, None, "a", "x", "y"), (401, "", "zz", "x", "y"), (5, "same id again", "a", "x", "y"), (None, "no id here", "b", "x", "y")]
    rows += [(402, "long " * 20_000, "b", "x", "y")]
    return spark.createDataFrame(rows, DOCS)


def test_mix_meets_targets_and_reruns_agree(corpus):
    got = mixing.mix_plan(corpus).collect()
    again = mixing.mix_plan(corpus.repartition(7)).collect()
    assert sorted(got, key=repr) == sorted(again, key=repr)
    assert len(got) == 405 and set(got[0].asDict()) == {"doc_id", "text", "source", "n_lines", "size", "source_size", "target", "taken"}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for source, t in target.items():
        assert abs(taken[source] - t) <= mixing.BLOCK_WORDS and t <= 2 * size[source]


def test_mixed_rows_hold_what_the_plan_takes(corpus):
    planned = {(r.doc_id, r.text): r.taken for r in mixing.mix_plan(corpus).collect()}
    mixed = mixing.mix_documents(corpus)
    assert mixed.columns == corpus.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    want = Counter()
    for (doc, _), n in planned.items():
        want[doc] += n
    assert +words == +want and {r.size for r in mixed.collect()} == {"x"}  # clashing columns keep their values


def test_seats_equal_the_plain_sainte_lague(spark):
    import random

    rng = random.Random(3)
    for n in (1, 2, 5, 30):
        weights = [rng.choice([0, 1, 7, 7, 100, 10_000]) for _ in range(n)]
        seats = rng.randint(0, 200)
        parties = spark.createDataFrame([("g", i, w, seats) for i, w in enumerate(weights)], "g string, p int, w long, seats long")
        got = {r.p: r.quota for r in mixing.apportion(parties, ["g"], "p", "w", "seats").collect()}
        quotients = sorted((-w / (2 * k + 1), i) for i, w in enumerate(weights) if w for k in range(seats))[:seats]
        assert got == {i: Counter(p for _, p in quotients)[i] for i in range(n)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix_plan(empty).collect() == [] and mixing.mix_documents(empty).collect() == []
    assert lines.dedup_lines(empty).collect() == []


def brute_lines(rows, least=2):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans(mixing_upper := "ABCDEFGHIJKLMNOPQRSTUVWXYZ", mixing_upper.lower())
    key = lambda x: x.strip(strip).translate(low)
    where = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                where.setdefault(key(x), set()).add(2**63 - 1 if i is None else i)
    out = []
    for i, t in rows:
        at = 2**63 - 1 if i is None else i
        stay = [x for x in (t or "").split("\n") if len(where.get(key(x), ())) < least or min(where[key(x)]) == at]
        out.append((i, "\n".join(stay), len((t or "").split("\n")), len((t or "").split("\n")) - len(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [2, 3])
def test_lines_equal_brute_force(spark, least):
    rows = [
        (1, "A common line\nshort\nown line of one\nA common line"), (2, "\ta COMMON line \nother text here\n\nother text here"),
        (3, "a common line"), (4, None), (5, ""), (6, "\n\n"), (None, "a common line\nkept by a nameless"), (2, "a common line\nsecond row of two"),
        (7, "ÄÖÜ common line\näöü common line"), (8, "ÄÖÜ common line"), (9, "\n".join(f"line number {i % 3000}" for i in range(9000))), (10, "line number 17\nx"),
        (3, "a common line"),
    ]
    docs = spark.createDataFrame([(i, t, "s", "c", "d") for i, t in rows], DOCS)
    got = lines.dedup_lines(docs, min_documents=least)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=repr) == brute_lines(rows, least)


def test_plans_hold_no_python(spark, corpus):
    for df in (mixing.mix_plan(corpus), mixing.mix_documents(corpus), lines.dedup_lines(corpus)):
        text = plan(df)
        assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text
