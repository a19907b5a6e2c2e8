"""The filter audit: merges against sets, and whole results against counting every document in every order."""

from __future__ import annotations

import random
import re
from itertools import permutations

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tillweave.llm import audit

SORTED = st.lists(st.integers(0, 60), max_size=40).map(lambda ids: sorted(set(ids)))


@settings(max_examples=300, deadline=None)
@given(st.lists(SORTED, max_size=5), SORTED, SORTED)
def test_merges_equal_sets(lists, a, b):
    assert audit.union(lists) == sorted(set().union(*lists))
    assert audit.difference(a, b) == sorted(set(a) - set(b))
    assert audit.intersection(a, b) == sorted(set(a) & set(b))


def test_merges_of_long_runs():
    a, b = list(range(0, 300_000)), [*range(1000, 200_000), *range(250_000, 400_000, 7)]
    assert audit.union([a, b, a]) == sorted({*a, *b})
    assert audit.difference(a, b) == sorted({*a} - {*b})
    assert audit.intersection(a, b) == sorted({*a} & {*b})
    assert audit.gallop(a, 5, 299_999) == 299_999 and audit.gallop(a, 7, 3) == 7 and audit.gallop(a, 0, 10**9) == len(a)


def failing(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    upper = len(re.findall("[A-Z]", text))
    return [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * upper > 5 * len(text), bool(re.search(r"[#$%&*|]", text))]


def brute(docs, labels):
    """Every document through every order, one after the other."""
    first, good, toxic = {}, set(), set()
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, quality, bad in labels:
        good |= {doc_id} if quality == 1 and doc_id is not None else set()
        toxic |= {doc_id} if bad == 1 and doc_id is not None else set()
    rows, out = {}, {}
    for doc_id, text, source in docs:
        text = text or ""
        copy = doc_id is not None and text in first and doc_id > first[text]
        rows.setdefault(source or "", []).append((doc_id, dict(zip("ABCDE", [*failing(text), copy]))))
    for part, some in rows.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = some
            for step, name in enumerate(order, 1):
                here = [r for r in left if r[1][name]]
                left = [r for r in left if not r[1][name]]
                shapley[name] += len(here)
                fails = [r for r in some if r[1][name]]
                out[part, "".join(order), step] = [
                    len(left), len(here), len(fails) - len(here), sum(sum(r[1].values()) == 1 for r in fails),
                    sum(r[0] in good for r in here), sum(r[0] in toxic for r in here), name,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return out


def corpus(rng, n):
    """Texts that fail any set of the filters, copies, odd texts, no ids and no sources."""
    docs = []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 60, 60, 90]))]
        if rng.random() < 0.3:
            words = words[:8] * 8
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        if rng.random() < 0.3:
            words.append(rng.choice("#$%&*|"))
        text = rng.choice([" ", "\n", "\t"]).join(words)
        docs.append((i * 3 - 50, rng.choice([text, text, text, "the same text", docs[-1][1] if docs else None]), rng.choice(["hot", "hot", "b", "", None])))
    odd = [(None, "no id"), (None, "no id"), (7, "no id"), (7, "no id"), (8, None), (9, ""), (10, " \t\n "), (11, "É\x00  "), (12, "very Long " * 20_000), (12, "other text")]
    return docs + [(i, t, "odd") for i, t in odd]


COLUMNS = "doc_id long, text string, source string"


def found(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_equals_brute_force(spark):
    rng = random.Random(8)
    docs = corpus(rng, 400)
    labels = [(rng.choice([None, i * 3 - 50]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(400)] + [(7, 1, 0), (7, 0, 1), (7, 1, 0)]
    # Extra columns with the names of results and of working columns play no part.
    table = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], COLUMNS + ", part int, fails string, h1 int").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("x"))
    want = brute(docs, labels)
    assert found(audit.audit(table, marks)) == want
    assert found(audit.audit(table, marks, block=7)) == want  # blocks don't change sums


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "A b", "s")], COLUMNS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs.limit(0), labels).collect() == []
    assert found(audit.audit(docs, labels)) == brute([(1, "A b", "s")], [])


def test_posting_lists(spark):
    """Lists of real ids, sorted, in ranges; other filters by conditions."""
    docs = spark.createDataFrame([(i, "x " * (i % 7), "s") for i in range(100)], COLUMNS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = audit.failing_rows(docs, labels, {"few": "n_words < 2", "odd": F.col("n_words") % 2 == 1}, copies=None)
    lists = audit.posting_lists(rows, ["few", "odd"], block=20).collect()
    for name, want in (("few", [i for i in range(100) if i % 7 < 2]), ("odd", [i for i in range(100) if i % 7 % 2])):
        mine = sorted((r for r in lists if r.filter == name), key=lambda r: r.first_id)
        assert sum((r.ids for r in mine), []) == want
        assert all(r.first_id <= r.ids[0] and r.ids[-1] <= r.last_id for r in mine) and len(mine) > 1
    row = audit.audit(docs, labels, {"few": "n_words < 2", "odd": "n_words % 2 = 1"}, copies=None).where("filter_order = 'fewodd' AND step = 2").first()
    assert row.removed == sum(i % 7 in (3, 5) for i in range(100))
