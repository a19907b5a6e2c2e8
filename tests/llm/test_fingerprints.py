"""Fingerprints against plain sets, edited forms against a plain loop, classes against all pairs."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from test_free import ODD, odd, prose
from tillweave.llm import fingerprints as fp


def shingles(text):
    n = min(fp.SHINGLE, len(text))
    return {text[i : i + n] for i in range(len(text) - n + 1)} if text else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_estimates_jaccard():
    rng = random.Random(3)
    texts = [prose(rng, 120) for _ in range(40)] + ["", "a", "abc", "日本語の文章です。", "🙂" * 9]
    texts += [t[: int(len(t) * rng.random())] + prose(rng, 30) for t in texts[:40]]
    signatures = fp.signatures_of(texts)
    assert len({*fp.as_text(signatures)}) == len({*texts}) and all(len(x) == 4 * fp.SYMBOLS for x in fp.as_text(signatures))
    off = []
    for i in range(len(texts)):
        for j in range(i):
            off.append(fp.likeness(signatures[i : i + 1], signatures[j : j + 1])[0] - jaccard(texts[i], texts[j]))
    assert np.abs(off).max() < 0.2 and abs(np.mean(off)) < 0.01
    alone = fp.signatures_of(texts[7:8])
    assert (alone == signatures[7:8]).all()  # a signature doesn't depend on the texts around it


def plain_edits(docs):
    """doc_id -> what the contract names, by a plain loop over the documents in order."""
    texts = [t or "" for _, t in docs]
    out = []
    for k, (doc_id, _) in enumerate(docs):
        text, after = texts[k], texts[(k + 1) % len(docs)]
        cut = len(text) // 4
        out.append((doc_id, text, text[: len(text) - cut] + after[:cut], after))
    return out


def test_edited_forms_equal_a_plain_loop(spark):
    rng = random.Random(9)
    docs = [(i * 3 - 40, rng.choice([prose(rng, rng.choice([1, 2, 5, 80])), "same", "", None, "short"])) for i in range(300)]
    docs += [(2000, "very long " * 30_000), (2001, "é🙂" * 7), (2002, "x" * 8)]
    table = spark.createDataFrame([(i, t, 5, "x", "y") for i, t in docs], "doc_id long, text string, hash int, fingerprint string, segment string")
    for samples in (1, 64):
        got = fp.edited_fingerprints(table.repartition(7), samples).collect()
        assert len(got) == len(docs)
        got = {r.doc_id: r for r in got}
        for doc_id, text, edited, after in plain_edits(docs):
            r = got[doc_id]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            own, new, following = (fp.signatures_of([x]) for x in (text, edited, after))
            assert (r.fingerprint, r.edited_fingerprint) == (fp.as_text(own)[0], fp.as_text(new)[0])
            assert (r.near_edited, r.near_next) == (fp.likeness(own, new)[0], fp.likeness(own, following)[0])


def test_odd_rows(spark):
    """No ids, repeated rows and ids, null and empty texts: every row has a successor, in a defined order."""
    docs = odd(spark, [(None, "no id"), (None, "other"), (1, "one more")] + [(4, "word")] * 200)
    got = fp.edited_fingerprints(docs).collect()
    assert sorted(r.doc_id is None for r in got) == sorted(i is None for i, _ in [*ODD, *[(None, "")] * 2, *[(4, "")] * 201])
    assert sum(r.near_next == 1.0 and r.near_edited < 1 for r in got if r.doc_id == 4) >= 200
    again = fp.edited_fingerprints(docs.repartition(3)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, again))
    single = fp.edited_fingerprints(docs.where("doc_id = 5")).first()
    text = ODD[6][1]
    cut = len(text) // 4
    assert single.edited_sha256 == hashlib.sha256((text[: len(text) - cut] + text[:cut]).encode()).hexdigest() and single.near_next == 1.0
    assert fp.edited_fingerprints(docs.limit(0)).collect() == []


def test_fingerprints_keep_columns(spark):
    got = fp.fingerprints(odd(spark))
    assert got.columns == [*odd(spark).columns, "fingerprint"]
    rows = got.collect()
    assert sorted(r.text or "-" for r in rows) == sorted(t or "-" for _, t in ODD) and all(r.node == "x" and r.score == 0.5 for r in rows)
    assert len({r.fingerprint for r in rows if r.text == "word"}) == 1
    again = fp.fingerprints(got.withColumnRenamed("fingerprint", "Fingerprint"))
    assert again.columns == got.columns and fp.fingerprints(odd(spark).limit(0)).collect() == []


def test_classes_equal_all_pairs(spark):
    rng = random.Random(2)
    docs = []
    passage = prose(rng, 25)
    for k in range(12):  # groups of near copies, chains, and a passage that many share
        text = prose(rng, 60)
        for _ in range(rng.choice([1, 3, 9])):
            docs.append((len(docs) * 2, text))
            words = text.split()
            for _ in range(rng.choice([0, 1, 2])):
                words[rng.randrange(len(words))] = "changed" + str(rng.randrange(99))
            text = " ".join(words)
    docs += [(1000 + i, f"{passage} {prose(rng, 12)}") for i in range(30)]
    docs += [(2000, None), (2001, ""), (2002, ""), (2003, "a"), (2004, "a"), (None, docs[0][1]), (2003, "b")]
    want = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            a, b = docs[i][1], docs[j][1]
            if a and b and (a == b or 5 * len(shingles(a) & shingles(b)) >= 4 * len(shingles(a) | shingles(b))):
                old, new = want[i], want[j]
                want = [new if x == old else x for x in want]
    lowest = {}
    for (doc_id, _), label in zip(docs, want):
        if doc_id is not None:
            lowest[label] = min(doc_id, lowest.get(label, doc_id))
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, node int, label string")
    got = sorted((str(r.doc_id), r.class_id) for r in fp.near_classes(table).collect())
    assert got == sorted((str(d[0]), lowest[label]) for d, label in zip(docs, want))
    assert fp.near_classes(table.limit(0)).collect() == []
