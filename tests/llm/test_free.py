"""The other operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillweave.llm import decontaminate, langid, licenses, neardup, pages, tokens, toxicity, vafile

ODD = [(None, "no id"), (1, None), (2, ""), (3, " \t\n "), (4, "word"), (4, "word"), (5, "🙂 é\x00\x01 ́x"), (6, "very long " * 30_000)]
DOCS = "doc_id long, text string, lang string, score double, n long, node string"


def odd(spark, more=()):
    return spark.createDataFrame([(i, t, "en", 0.5, 1, "x") for i, t in [*ODD, *more]], DOCS)


def prose(rng, n=60):
    parts = "the an re er on ing tion ha th st en le ou qu ver ge".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


# Decontamination

def edits_within(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def plain(text):
    return "".join(map(chr, decontaminate.normalise(text)[0])).strip()


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, rng.randint(3, 40))) for k in range(8)] + [(50, "tiny"), (51, None), (None, "x" * 50)]
    rows = []
    for d in range(60):
        text = prose(rng, 40)
        if d % 2:
            leak = list(items[d % 8][1])
            for _ in range(rng.choice([0, 1, 3, 6, 12])):
                leak[rng.randrange(len(leak))] = rng.choice("abcxyz é")
            text = text[:100] + " " + "".join(leak).upper() + "; " + text[100:]
        rows.append((100 + d, text))
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(odd(spark, rows), bench).collect()}
    want = set()
    for d, text in rows:
        for i, item in items:
            body = plain(item or "")
            if i is None or len(body) < decontaminate.Q:
                continue
            size = min(decontaminate.WINDOW, len(body))
            starts = {*range(0, len(body) - size + 1, decontaminate.STEP), len(body) - size}
            if any(edits_within(body[s : s + size], plain(text)) <= size // decontaminate.CHARS_PER_EDIT for s in starts):
                want.add((d, i))
    assert got == want and want
    clean = decontaminate.decontaminate(odd(spark, rows), bench)
    assert clean.columns == odd(spark).columns
    assert sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(str(i) for i, _ in ODD + rows if i not in {d for d, _ in want})


def test_excerpts_are_found_wherever_they_start(spark):
    """Exact excerpts of the stated length from every offset of an item, in the midst of other words."""
    rng = random.Random(9)
    item, size = plain(prose(rng, 45)), decontaminate.WINDOW + decontaminate.STEP - 1
    bench = spark.createDataFrame([(1, item), (2, prose(rng, 30))], "item_id long, text string")
    rows = [(s, f"{prose(rng, 20)}. {item[s : s + size].upper()}! {prose(rng, 20)}") for s in range(len(item) - size + 1)]
    rows += [(10_000 + i, prose(rng, 60)) for i in range(30)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(s, 1) for s in range(len(item) - size + 1)} and len(got) > 100


def test_leak_places_and_empty_tables(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame([(1, f"Before. {item}! After."), (2, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    (row,) = decontaminate.contamination(docs, bench).collect()
    assert (row.doc_id, row.item_id, row.edits) == (1, 7, 0) and f"Before. {item}! After."[row.doc_start : row.doc_end].strip(" !") == item
    assert decontaminate.contamination(docs, bench.limit(0)).collect() == [] and decontaminate.contamination(docs.limit(0), bench).collect() == []


# Token files

def test_token_files_round_trip(spark):
    path = tokens.public_tokenizer()
    encoder = tokens.WordEncoder(path)
    rng = random.Random(2)
    alphabet = ["a", "b", "é", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "|", "word", "12", "\x1c", "日本", "🙂"]
    rows = [(10 + k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for k in range(500)]
    got = tokens.token_files(odd(spark, rows).repartition(3), path, with_ids=True).collect()
    start = 0
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted((i for i, _ in ODD + rows if i is not None)) or got[0].doc_id is None
    texts = {}
    for i, t in ODD + rows:
        texts.setdefault(i, []).append(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0])
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and r.ids in texts[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert len(got) == len(ODD) + len(rows) and tokens.token_files(odd(spark).limit(0), path).collect() == []


def test_words_are_looked_up_once(monkeypatch):
    import random

    encoder = tokens.WordEncoder(tokens.public_tokenizer())
    monkeypatch.setattr(tokens, "MEMO_WORDS", 300)  # forgotten now and then
    rng, asked = random.Random(3), []
    pieces = [*"ab. ,\n\t \r!1\u00e9'\u00df\u65e5A-_", "  ", " \n", "don't", "..."]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(30))) for _ in range(2000)]

    class Counted(type(encoder.numbers)):
        def __getitem__(self, part):
            asked.append(part)
            return super().__getitem__(part)

    for begin in range(0, len(texts), 100):
        some = texts[begin : begin + 100]
        encoder.numbers, before = Counted(encoder.numbers.default_factory, encoder.numbers), len(asked)
        got = [np.frombuffer(b, "<u2").tolist() for b in encoder.encode(some)]
        assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
        assert len(asked) - before <= sum(len(t.replace("\n", " \n").split(" ")) - 1 for t in some)


def test_code_lengths_are_limited_and_optimal():
    rng = np.random.default_rng(1)
    import heapq

    for n in (1, 2, 3, 50, 1000):
        counts = rng.integers(50, 10_000, n)
        for bits in (10, 20):
            lengths = tokens.code_lengths(counts, bits)
            assert lengths.max() <= bits and (n == 1 or sum(0.5 ** lengths) == 1)
        heap, cost = counts.tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            heapq.heappush(heap, x := heapq.heappop(heap) + heapq.heappop(heap))
            cost += x
        assert n == 1 or (lengths * counts).sum() == cost
        codec = tokens.Codec(np.arange(n) * 3, tokens.code_lengths(counts, 12))
        ids = rng.choice(np.arange(n) * 3, 5000)
        assert (codec.decode(*codec.encode(ids), len(ids)) == ids).all()


# Top k

def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 8).round(2).tolist()) for i in range(300)]
    rows += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [0.1] * 8), (304, [1.0, 2.0]), (40, rows[40][1]), (305, [])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string").repartition(3)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in vafile.top_k(table, table.where("vec_id % 20 = 0"), 5).collect()}
    good = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q, x in {i: v for i, v in good if i % 20 == 0}.items():
        best = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want and vafile.top_k(table.limit(0), table.limit(0)).collect() == []


# License scan

def test_license_scan(spark):
    texts = [
        (20, "Licensed under the Apache License, Version 2.0."), (21, "under the MIT License; CC-BY-NC cc by nc cc by nc 4.0"), (22, "SPDX-License-Identifier: GPL-2.0-only"),
        (23, "the GNU Lesser General Public License v3"), (24, "a plain text that a permit covers"), (25, "CC BY-NC-SA 4.0"),
    ]
    rows = {r.doc_id: r for r in licenses.scan_licenses(odd(spark, texts)).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in ODD + texts:
        words = word.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        places = [(k, label) for k in range(len(words)) for p, label in licenses.BASE.items() if words[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert rows[22].labels == "gpl-2" and rows[23].labels == "lgpl-3" and rows[24].labels == "" and rows[24].score == 0
    assert rows[25].labels == "cc-by-nc,cc-by-nc-sa" and len(licenses.rules()) > 200
    assert all(any(a in b" " + r.keyword or a.decode().strip() in r.pattern.pattern.decode() for a in licenses._ANY) for r in licenses.rules())


@pytest.mark.parametrize("text, labels", [
    ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software', "mit"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice", "isc"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that: 1. Redistributions of source code", "bsd-2-clause"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of the holder nor the names", "bsd-3-clause"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gpl-3"),
    ("GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "lgpl-2.1"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2,mit"),
    ("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 AND ISC)", "gpl-2,isc"),
    ("this is GPL-2.0 code", "gpl-2"), ("Apache-2.0", "apache-2"), ("MPL-2.0 only", "mpl-2"), ("the GPL version 2", "gpl-2"), ("a BSD license", "bsd"),
    ("Python 2.0 and Apache 2.0.52 run", ""),
])
def test_license_texts_notices_and_identifiers(text, labels):
    assert licenses.scan(text)[5] == labels


def test_contained_detections_are_suppressed():
    f = licenses.Found
    strong, weak, twin, apart = f("a", 3, 1.0, 0, 6), f("b", 2, 1.0, 2, 5), f("a", 2, 1.0, 0, 6), f("c", 1, 1.0, 5, 8)
    assert licenses.resolve([weak, apart, twin, strong]) == [strong, apart]


# Language and toxicity

def test_language_id_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = langid.fit(docs)
    rows = langid.identify(docs, net).where(langid.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9 and all(0 <= r.score <= 1 for r in rows)
    got = {(r.doc_id, r.text): r for r in langid.identify(odd(spark, [(7, "1234 !?")]), net).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in [(1, None), (2, ""), (3, " \t\n "), (7, "1234 !?")])
    assert got[4, "word"].lang_pred in net.languages and len(got) == 8
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(odd(spark), nothing).collect()} == {"und"}


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        text = prose(rng, 50) + (" you " + rng.choice(["grobnik", "snarfle"]) if toxic else "")
        rows.append((i + 100, text))
        labels.append((i + 100, int(toxic), "x"))
    table = spark.createDataFrame([*labels, (1, 0, "x"), (None, 1, "x"), (100, 0, "x"), (9999, 1, "x"), (101, None, "x")], "doc_id long, toxic int, text string")
    docs = odd(spark, rows)
    model = toxicity.fit(docs, table)
    got = {(r.doc_id): r for r in toxicity.score_documents(docs, model).collect()}
    truth = {i: y for i, y, _ in labels}
    assert np.mean([got[i].predicted == y for i, y in truth.items()]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[2].evidence == [] and len(got) == 7 + 400
    none = toxicity.fit(docs, table.limit(0))
    assert {r.score for r in toxicity.score_documents(docs, none).collect()} == {0.0}


def test_rare_toxic_words_have_neighbours(spark):
    rng = random.Random(19)
    rows = [(i + 100, prose(rng, 40) + (f" zqx{'abcdefghij'[i // 10 % 10]}{'klmno'[i // 100]}w" if i % 5 == 0 else "")) for i in range(500)]
    model = toxicity.fit(odd(spark, rows), spark.createDataFrame([(i + 100, int(i % 5 == 0)) for i in range(500)], "doc_id long, toxic int"))
    mark = next(t.rsplit(" ", 1)[1] for i, t in rows if not (i % 5 or langid_held_out(spark, i)))
    asked = spark.createDataFrame([(1, f"nothing but {mark} here")], "doc_id long, text string")
    near = toxicity.score_documents(asked, model).first().evidence
    texts = dict(rows)
    assert near and near[0].toxic == 1 and near[0].similarity > 0.1 and mark in texts[near[0].doc_id]
    plain_word = next(w for i, t in rows if i % 5 and not langid_held_out(spark, i) for w in t.split() if len(w) > 3)
    assert plain_word in model.terms and model.weights.min() > 0


def langid_held_out(spark, i):
    return spark.range(i, i + 1).select(langid.held_out(F.col("id"))).first()[0]


def test_many_texts_are_searched_at_once():
    rng = random.Random(8)
    word = lambda: f"w{'abcdefgh'[min(7, int(rng.expovariate(0.5)))]}" + rng.choice(["", "", "x", "yz", rng.choice("klmnopq") + "rstuvw"])
    texts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(400)]
    names = sorted(set().union(*map(toxicity.document_terms, texts[:300])))
    reader = toxicity.Reader(dict(zip(names, range(len(names)))))
    sizes, t, n = reader.rows(texts)
    begins = np.cumsum(sizes) - sizes
    rows = [dict(zip(t[b : b + s].tolist(), n[b : b + s].tolist())) for b, s in zip(begins, sizes)]
    for text, row in zip(texts, rows):
        plain = {}
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            for term in toxicity.terms_of(w):
                if term in reader.terms:
                    plain[reader.terms[term]] = plain.get(reader.terms[term], 0) + 1
        assert plain == row
    model = toxicity.build([(i, i % 2, rows[i]) for i in range(300)], names, {0: 150, 1: 150})
    dense = np.zeros((400, len(names)))
    for k, row in enumerate(rows):
        if row:
            at, w = model.vector(row)
            dense[k, at] = w
    search = toxicity.Search(model)
    assert 0 < search.whole.shape[1] < len(names)  # both common and rare terms
    w = model.weighed(sizes, t, n)
    without = np.array([*range(300), *[-1] * 100])
    for k, (found, score) in enumerate(search.nearest(sizes, t, w, 7, without)):
        cosine = dense[:300] @ dense[k]
        cosine[without[k] if k < 300 else []] = 0
        best = [i for i in sorted(range(300), key=lambda i: (-round(cosine[i], 12), i)) if cosine[i] > 0][:7]
        assert found.tolist() == best and np.allclose(score, cosine[best])


def test_nearest_examples_are_exact():
    rng = random.Random(6)
    vectors = [(i, i % 2, {rng.randrange(30): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}) for i in range(500)]
    model = toxicity.build(vectors, [f"t{i}" for i in range(30)], {0: 250, 1: 250})
    dense = np.zeros((500, 30))
    for k, v in enumerate(vectors):
        t, w = model.vector(v[2])
        dense[k, t] = w
    for k in range(60):
        q = model.vector(vectors[k][2])
        if len(q[0]):
            found, score = model.nearest(*q, k=10)
            cosine = dense @ dense[k]
            assert np.allclose(score, np.sort(cosine)[::-1][:10]) and np.allclose(cosine[found], score)


# Pages

PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a>Menu</a></ul></nav>"
    "<div class='cookie-notice'>Cookies</div>%s<aside>Side</aside><form><p>Form<input></form><section id=comments><p>A comment</section>"
    "<div class=ad>Buy</div><footer>&copy; us</footer><script>x='<p>no</p>'</script></body></html>"
)


@pytest.mark.parametrize("body", ["<article><header><h1>Head &amp; line</h1></header><p>One<br>two <b>three</b><p>Four</article>", "<div class=content><h1>Head &amp; line</h1><p>One\n two <i>three</i></p><p>Four</div>"])
def test_main_text(spark, body):
    want = "Head & line\n\nOne two three\n\nFour"
    rows = [(1, "http://a.example/1", PAGE % body), (2, "http://a.example/2", (PAGE % body.replace("Four", "Five"))[:-40]), (3, None, None), (4, "odd", ""), (1, "http://a.example/1", PAGE % body)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = sorted((r.page_id, r.text) for r in pages.main_text(table).collect())
    assert got == [(1, want), (1, want), (2, want.replace("Four", "Five")), (3, ""), (4, "")] and pages.main_text(table.limit(0)).collect() == []
    clash = pages.main_text(table.selectExpr("*", "1 AS article", "'f' AS fixed", "'old' AS text"))
    assert clash.columns == [*table.columns, "article", "fixed", "text"]
    assert {(r.host, r.article, r.fixed) for r in clash.collect()} == {("x", 1, "f")} and sorted((r.page_id, r.text) for r in clash.collect()) == got


@pytest.mark.parametrize(
    "inner, want",
    [
        ("<p>x</p><button>Buy now</button><p>y</p>", "x\n\ny"),
        ("<p>one <span hidden>secret</span>two</p>", "one two"),
        ("<p>one <a class='share' href=#>Share</a> two <span class=\"ad\">Buy</span></p><p>three</p>", "one two\n\nthree"),
        ("<p>one <svg><text>drawn</text></svg> two</p>", "one two"),
        ("<p>one</p><select><option>A<option>B</select><p>two</p>", "one\n\ntwo"),
        ("<p>one <span class=ad>Buy</p><p>two</p>", "one\n\ntwo"),
        ("<p>one <i aria-hidden=true>icon <b>and</b> more</i> two <em>three</em></p>", "one two three"),
        ("lead <span class='has sidebar'><p>one</p><p>two</p></span> tail", "lead\n\ntail"),
        ("<p title='a > b'>one</p><p title=\"it's\">two<br/>three", "one\n\ntwo three"),
        ("<ul><li>one<li>two <ul><li>deep</ul><li>three</ul>", "one\n\ntwo\n\ndeep\n\nthree"),
    ],
)
def test_marked_phrases_are_left_out(inner, want):
    assert pages.extract(f"<body><article>{inner}</article></body>", None, set()) == want


def test_hostile_pages_take_linear_time():
    import time

    shapes = ["<a b" * 60_000 + '"', "<div>" * 60_000 + "x", "<div>x" * 30_000 + "</span>" * 30_000, "<span hidden>" * 60_000 + "x", "<a class=ad><p>x" * 20_000,
              "<!--" * 60_000, "<a b='" * 40_000, '<p x="' * 40_001, "<li>x" * 40_000, "<table><tr><td>x" * 20_000, "<" * 200_000, "<a =" * 60_000, "<b>" * 60_000 + "</i>" * 60_000]
    for shape in shapes:
        begin = time.perf_counter()
        pages.extract(shape, None, set())
        pages.tokens(shape)
        assert time.perf_counter() - begin < 10, shape[:20]


def test_texts_on_every_page_are_template(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div><p>Subscribe to our daily letter</p><p>Story number {i} {'tells more ' * 9}</p></div></body>") for i in range(6)]
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Story number {r.page_id} {'tells more ' * 9}".strip() for r in got)
    copies = [(i, f"http://c.example/{i}", "<body><article><p>The same story</p></article></body>") for i in range(6)]
    assert {r.text for r in pages.main_text(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()} == {"The same story"}


def test_pages_stored_twice_hide_no_single_page(spark):
    html = "<body><div><p>Subscribe to our daily letter</p><p>Story number %d %s</p></div></body>"
    rows = [(i, f"http://h.example/{i}", html % (i, "tells more " * 9)) for i in [*range(1, 10), *range(1, 10), 10]]
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 19 and all(r.text == f"Story number {r.page_id} {'tells more ' * 9}".strip() for r in got)


def test_pages_without_texts_leave_the_template(spark):
    html = "<body><div><p>Share this</p><p>Story number %d %s</p><p>Share this</p></div></body>"
    rows = [(i, f"http://h.example/{i}", html % (i, "tells more " * 9)) for i in range(6)]
    rows += [(6, "http://h.example/6", None), (7, "http://h.example/7", ""), (8, "http://h.example/8", "<html><body><div></div></body></html>")]
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Story number {i} {'tells more ' * 9}".strip() if i < 6 else "" for i in range(9)}


@pytest.mark.parametrize("name", ["post has-sidebar", "comments-open"])
def test_names_alone_empty_no_page(spark, name):
    body = f"<body><nav>Menu</nav><div class='{name}'><h1>Head</h1><p>A whole story of some length</p><div class=ad>Buy</div></div></body>"
    got = pages.main_text(spark.createDataFrame([(1, "http://n.example/1", body)], "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == ["Head\n\nA whole story of some length"]


def texts_of(spark, bodies):
    rows = [(i, f"http://l.example/{i}", body) for i, body in enumerate(bodies)]
    return {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_one_odd_page_keeps_no_template_from_being_found(spark):
    html = "<html><body><div><p>Subscribe to our daily letter</p><p>Story number %d %s</p><p>All rights are ours</p></div></body></html>"
    got = texts_of(spark, [html % (i, "tells more " * 9) for i in range(8)] + ["<p>Nothing was found here</p>"])
    assert got == {i: f"Story number {i} {'tells more ' * 9}".strip() for i in range(8)} | {8: "Nothing was found here"}


def test_each_layout_has_its_own_template(spark):
    one = "<html><body><div class=one><p>Read our letter</p><h1>Head %d</h1><p>%s</p></div><div class=x>Far below</div></body></html>"
    two = "<html><body><table><tr><td>Shop and save</td></tr></table><dl><dt>Item %d</dt><dd>%s</dd><dd>Ask the seller</dd></dl></body></html>"
    story = lambda i: f"number {i} " + f"tells {i} more " * 9
    got = texts_of(spark, [(one if i % 2 else two) % (i, story(i)) for i in range(16)])
    assert got == {i: f"{'Head' if i % 2 else 'Item'} {i}\n\n{story(i).strip()}" for i in range(16)}


def brute_classes(bodies):
    """Classes by whole vectors: path and text of their tokens that keep their place on all pages."""
    found = [pages.tokens(b) for b in sorted(set(bodies))]
    vectors = {}
    for t in {t for f in found for t in f}:
        vectors.setdefault(tuple(len(f[t][2]) if t in f else 0 for f in found), []).append(t)
    out = {}
    for vector, members in vectors.items():
        on = [f for f, n in zip(found, vector) if n]
        if len(on) < pages.LEAST_PAGES or len(on) * pages.SHARE < len(found) or len(members) < pages.LEAST_TOKENS:
            continue
        places = {t: set() for t in members}
        for f in on:
            for i, (_, t) in enumerate(sorted((at, t) for t in members for at in f[t][2])):
                places[t].add(i % len(members))
        steady = {t for t in members if len(places[t]) == 1}
        if len(steady) >= pages.LEAST_TOKENS:
            out[vector] = (steady, [[sorted(at for t in steady for at in f[t][2]) if n else [] for f, n in zip(found, vector)]][0])
    kept = set()
    for vector, (steady, places) in out.items():
        good = True
        for outer, (_, marks) in out.items():
            if outer != vector and max(outer) == 1 and all(o >= (n > 0) for o, n in zip(outer, vector)):
                slots = set()
                for f, n, at, m in zip(found, vector, places, marks):
                    if n:
                        rounds = {}
                        order = sorted((x, t) for t in vectors[vector] for x in f[t][2])
                        for i, (x, t) in enumerate(order):
                            if t in steady:
                                rounds.setdefault(i // len(vectors[vector]), []).append(x)
                        ends = [(sum(y < min(r) for y in m), sum(y < max(r) for y in m)) for r in rounds.values()]
                        good &= all(a == b for a, b in ends)
                        slots.add(tuple(sorted({a for a, _ in ends})))
                good &= len(slots) == 1
        if good:
            kept.add(frozenset(steady))
    return kept


def test_classes_are_those_of_whole_vectors(spark):
    import random

    rng, bodies = random.Random(5), []
    for i in range(40):
        menu = ["<li>Home</li>", "<li>News</li>", "<li>Shop</li>"]
        rng.shuffle(menu)
        notice = "<table><tr><td>Sale</td><td>Ends soon</td></tr></table>" if rng.random() < 0.5 else ""
        cards = "<section><h2>Card</h2><blockquote>Rate it</blockquote></section>" * rng.randrange(3)
        stray = "<dl><dt>a</dt>%s<dd>b</dd></dl>" % ("<h3>s</h3>" if i % 2 else "")
        note = "<ol><li>Note</li><li>More</li></ol>" if rng.random() < 0.4 else ""
        around = ["<h1>Site</h1>", stray, notice] if i % 3 else [notice, "<h1>Site</h1>", stray]
        bodies.append(f"<html><body><ul>{''.join(menu)}</ul>{''.join(around)}<article><p>Story {i}</p>{cards}</article>{note}<footer>End</footer></body></html>")
    rows = pages.page_tokens(spark.createDataFrame([(f"http://q.example/{i}", b) for i, b in enumerate(bodies + bodies[:9])], "url string, html string")).cache()
    got = {}
    for r in pages.template_classes(rows, pages.token_statistics(rows)).collect():
        got.setdefault(r.vector, set()).add((r.path, r.text))
    want = brute_classes(bodies)
    assert {frozenset(c) for c in got.values()} == want and len(want) > 2


# Near duplicates

def brute_components(rows, words):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    owner = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                old, new = owner[a], owner[b]
                owner = [new if o == old else o for o in owner]
    out = []
    for k, (i, _) in enumerate(rows):
        low = min((rows[j][0] for j in range(len(rows)) if owner[j] == owner[k] and rows[j][0] is not None), default=None)
        out.append((i, len(sets[k]), low, i == low))
    return sorted(out, key=repr)


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    rng = random.Random(words)
    rows = []
    for g in range(12):
        base = prose(rng, rng.randint(2, 80)).split()
        for k in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 14))):
                copy[rng.randrange(len(copy))] = "edit%d" % rng.randrange(50)
            rows.append((100 + 20 * g + k, " ".join(copy)))
    rows += ODD
    docs = odd(spark, rows[: -len(ODD)])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, words).collect()), key=repr)
    assert got == brute_components(ODD + rows[: -len(ODD)], words)
    assert neardup.near_duplicates(docs.limit(0), words).collect() == []
    kept = [r.doc_id for r in neardup.near_dedup(docs, words).collect()]
    assert sorted(kept, key=repr) == sorted({r[0] for r in got if r[3]}, key=repr)


def test_a_large_group_of_near_copies_compares_few_signatures(spark, monkeypatch):
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([*words[: i % 150], f"own{i}", *words[i % 150 + 1 :]])) for i in range(400)]
    compared, alike = [], neardup.alike
    monkeypatch.setattr(neardup, "alike", lambda pairs, *rest: (compared.append(pairs.count()), alike(pairs, *rest))[1])
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(got) == 400 and {r.component_id for r in got} == {0}
    assert 0 < compared[0] <= 4 * len(rows)


def test_texts_that_share_a_passage_are_not_all_compared(spark, monkeypatch):
    passage = [f"w{i}" for i in range(85)]
    rows = [(i, " ".join([*passage, *[f"own{i}x{k}" for k in range(15)]])) for i in range(150)]
    rows += [(200 + i, " ".join([t, "more"])) for i, t in rows[:5]]
    compared, verified = [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, *rest: (compared.append(pairs.count()), verified(pairs, *rest))[1])
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - 200 if i >= 200 else i for i, _ in rows}
    assert sum(compared) <= 8 * len(rows)  # of 12,000 pairs


def test_components_follow_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_license_detections_resolve_as_a_plain_loop():
    rng = random.Random(7)
    for n in (0, 1, 5, 60, 300):
        found = []
        for _ in range(n):
            start = rng.randrange(40)
            found.append(licenses.Found(rng.choice("abcd"), rng.randrange(4), 0.5, start, start + rng.randint(1, 12)))
        kept = []
        for f in sorted(found, key=lambda f: (-f.priority, f.start - f.end, f.start, f.label)):
            if not any(k.start <= f.start and f.end <= k.end for k in kept):
                kept.append(f)
        assert licenses.resolve(found) == kept


def test_license_scan_of_repeated_phrases_is_linear():
    import time

    text = "cc by nc under the mit license gpl version 2 all rights reserved " * 16_000  # about a megabyte
    begin = time.perf_counter()
    row = licenses.scan(text)
    took = time.perf_counter() - begin
    assert row[1] == 32_000 and row[2] == 0 and row[4] == "cc-by-nc,mit" and took < 8
    small = licenses.scan(text[: len(text) // 100])
    assert small[1] == 320 and small[5] == row[5]


def test_fractions_and_powers_are_no_letters(spark):
    rows = [(i, f"plain words number {i} in a row", "en") for i in range(40)] + [(i + 100, f"puros vocablos num {i} en fila", "es") for i in range(40)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd_ones = spark.createDataFrame([(1, "½ ² ③ 12"), (2, "½ é"), (3, "日本")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd_ones, net).collect()}
    assert got[1] == "und" and got[2] in ("en", "es") and got[3] in ("en", "es")


def test_language_stage_keeps_clashing_columns(spark):
    import corpus_pipeline

    rows = [(i, f"plain words number {i} in a row", "en", 7.5, "mine") for i in range(40)] + [(99, "½", "en", 7.5, "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    out = corpus_pipeline.language_id(spark, docs, "")
    assert out.columns == docs.columns and {(r.score, r.lang_pred) for r in out.collect()} == {(7.5, "mine")} and out.count() == 40
