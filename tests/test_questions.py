"""Questions, merchants and time phrases by hand, and matching against brute force."""

from __future__ import annotations

import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tillweave.operators import answers as qa, merchants as me, questions as qp, temporal as tr

REF = datetime.datetime(2024, 1, 15)


@pytest.fixture(scope="module")
def ranges(spark):
    def run(phrases: list[str], ref=REF):
        df = spark.createDataFrame([(p, ref) for p in phrases], "text string, reference_ts timestamp_ntz")
        out = tr.with_date_range(df).collect()
        return {r.text: (r.start_ts, r.end_ts, r.month_of_year) for r in out}

    return run


def _d(*parts):
    return datetime.datetime(*parts)


def test_time_phrases(ranges):
    got = ranges([
        "Receipts from 2023-12-25", "What did I buy last week?", "on 1/5/24", "spent in December 2023", "since March 3, 2023",
        "between March and April 2023", "week before Christmas 2023", "December receipts", "nothing", "on 2023-02-30",
        "bought on Feb 29th 2024", "last 5 days", "last month", "Q4",
    ])
    assert got["Receipts from 2023-12-25"][:2] == (_d(2023, 12, 25), _d(2023, 12, 26))
    assert got["What did I buy last week?"][:2] == (_d(2024, 1, 8), _d(2024, 1, 15))
    assert got["on 1/5/24"][:2] == (_d(2024, 1, 5), _d(2024, 1, 6))
    assert got["spent in December 2023"] == (_d(2023, 12, 1), _d(2024, 1, 1), None)
    assert got["since March 3, 2023"][0] == _d(2023, 3, 3)
    assert got["since March 3, 2023"][1] == REF + datetime.timedelta(microseconds=1)
    assert got["between March and April 2023"][:2] == (_d(2023, 3, 1), _d(2023, 5, 1))
    assert got["week before Christmas 2023"][:2] == (_d(2023, 12, 18), _d(2023, 12, 25))
    assert got["December receipts"] == (None, _d(2025, 1, 1), 12)
    assert got["nothing"] == (None, None, None)
    assert got["on 2023-02-30"] == (None, None, None)
    assert got["bought on Feb 29th 2024"][:2] == (_d(2024, 2, 29), _d(2024, 3, 1))
    assert got["last 5 days"][0] == _d(2024, 1, 10)
    assert got["last month"][:2] == (_d(2023, 12, 1), _d(2024, 1, 1))
    assert got["Q4"][:2] == (_d(2024, 10, 1), _d(2025, 1, 1))


def test_session_zone_plays_no_part(spark, ranges):
    phrases = ["today", "this week", "last year", "between 2023-03-01 and 2023-03-31"]
    plain = ranges(phrases)
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert ranges(phrases) == plain
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_prepositions_and_filters(spark):
    df = spark.createDataFrame(
        [(1, "Total at Walmart in SF"), (2, "spent at Costco and at Costco"), (3, "How much in December 2023?"), (4, "all of it"), (5, "at Target spent at Aldi")],
        "question_id bigint, text string",
    )
    got = {r.question_id: r.merchants for r in me.with_prepositions(df).collect()}
    assert got == {1: ["Walmart"], 2: ["Costco and at Costco"], 3: [], 4: [], 5: ["Target spent at Aldi", "Aldi"]}


def test_fuzzy_names(spark):
    """A misspelt and a partial name against three known ones, with the matching-block ratio."""
    corpus = me.known_names(spark.createDataFrame([("Starbucks",), ("Target",), ("Whole Foods Market",)], "merchant_name string"))
    df = spark.createDataFrame([(1, "Starbux"), (2, "Whole Foods"), (3, "Nothing Near"), (4, "at Target")], "question_id bigint, text string")
    got = {r.question_id: r.merchants for r in me.extract_merchants(df, corpus).collect()}
    assert got == {1: ["Starbucks"], 2: ["Whole Foods Market"], 3: [], 4: ["Target"]}


@pytest.mark.parametrize("measure", ["edit", "blocks"])
def test_index_loses_no_pair(spark, measure):
    """All pairs of odd, short, long and repetitive names at the threshold against the candidates of the index."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(5)
    names = {"".join(rng.choices("ab c1", k=rng.randint(3, 14))).strip() for _ in range(150)} | {"aaa", "aaaa", "abab" * 6, "x" * 30, "starbucks"}
    names |= {"".join(rng.choices("abcdefghij klmnop", k=rng.randint(8, 30))).strip() for _ in range(40)}
    typed = {"starbux", "aab", "aaaaa"}
    for n in sorted(names):
        t = list(n)
        for _ in range(rng.randint(1, max(1, len(n) // 3))):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 1)] = rng.choices("abcx ", k=rng.randint(0, 2))
        typed |= {"".join(t)} if len(t) >= 3 else set()
    name_df = spark.createDataFrame([(n,) for n in names if len(n) >= 3], "name_norm string")
    typed_df = spark.createDataFrame([(t,) for t in typed], "token_norm string")
    got = {(r.token_norm, r.name_norm) for r in me.candidates(typed_df, name_df, measure).collect()}

    def similarity(a, b):
        if measure == "blocks":
            return SequenceMatcher(None, a, b).ratio()
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return 1 - row[-1] / max(len(a), len(b))

    wanted = {(t, n) for t in typed for n in names if len(n) >= 3 and similarity(t, n) >= 0.75}
    assert len(wanted) > 100 and wanted <= got
    with pytest.raises(ValueError):
        me.candidates(typed_df, name_df, measure, 0.6)


@pytest.mark.parametrize("measure", ["edit", "blocks"])
def test_few_names_are_scored(spark, measure):
    """Of 30,000 generated names, a misspelt one is scored against less than one in a hundred."""
    import random

    rng = random.Random(11)
    syllables = "star buck mar ket tar get whole food bur ger pan da ex press home de pot cost co tra der joe sub way che vron shell val ero pub lix kro ger wal greens".split()
    kinds = "cafe grill foods fuel pharmacy books toys garden bakery".split()
    names = set()
    while len(names) < 30_000:
        names.add(" ".join(["".join(rng.choices(syllables, k=rng.randint(2, 3))), *rng.choices(kinds, k=rng.randint(0, 1)), *([str(rng.randint(1, 99))] if rng.random() < 0.3 else [])]))
    names = sorted(names)
    typed = {n[:i] + n[i + 1 :] for n in rng.sample(names, 200) for i in [rng.randrange(len(n))]} | {"starbux"}
    found = me.candidates(
        spark.createDataFrame([(t,) for t in typed], "token_norm string"),
        spark.createDataFrame([(n,) for n in [*names, "starbucks"]], "name_norm string"), measure,
    )
    n_scored = {r.token_norm: r.n for r in found.groupBy("token_norm").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(n_scored) >= 200 and sum(n_scored.values()) < 0.01 * len(names) * len(typed)


def test_short_names_resolve_to_known_ones(spark):
    corpus = me.known_names(spark.createDataFrame([("Walmart Supercenter",), ("Target",)], "merchant_name string"))
    df = spark.createDataFrame([(1, ["Walmart"]), (2, ["target store", "Elsewhere"]), (3, [])], "question_id bigint, merchants array<string>")
    got = {r.question_id: r.merchants for r in me.resolve_names(df, corpus).collect()}
    assert got == {1: ["Walmart Supercenter"], 2: ["Target", "Elsewhere"], 3: []}


@pytest.mark.parametrize("measure", ["edit", "blocks"])
def test_blocking_keys_lose_no_pair(spark, sf_dir, measure):
    """Best matches over blocking keys equal those over all pairs."""
    from difflib import SequenceMatcher

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    names = [r.p_name for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct().collect()]
    typed = sorted({n[:i] + n[i + 1:] for n in names[:12] for i in range(len(n))} | {n[::-1] for n in names[:10]} | {n[:5] for n in names} | {"rodhot", "blu ringg", "xyz"} | set(names[:6]))
    got = {
        r.token_norm: (r.name, round(r.score, 6))
        for r in me.best_matches(
            spark.createDataFrame([(t,) for t in typed], "token string"),
            me.known_names(spark.createDataFrame([(n,) for n in names], "merchant_name string")), "token", measure,
        ).collect()
    }
    wanted = {}
    for t in {" ".join(t.split()) for t in typed}:
        if len(t) < 3:
            continue
        scored = []
        for n in names:
            s = SequenceMatcher(None, t, n).ratio() if measure == "blocks" else 1 - edits(t, n) / max(len(t), len(n))
            scored.append((-(max(s, 0.9) if t in n or n in t else s), n))
        best = min(scored)
        if -best[0] >= 0.75 - 1e-12:
            wanted[t] = (best[1], round(-best[0], 6))
    assert got == wanted


def test_amounts_flags_and_payment(spark):
    df = spark.createDataFrame([(1, "between $5 and $1,250.50"), (2, "over $20 paid by debit or credit"), (3, "tips under $3.10 with amex"), (4, "plain")], "question_id bigint, text string")
    df = df.withColumn("reference_ts", F.lit("2024-01-15").cast("timestamp_ntz"))
    got = {r.question_id: r for r in qp.parse_questions(df).collect()}
    assert (got[1].min_amount, got[1].max_amount) == (D("5.00"), D("1250.50"))
    assert (got[2].min_amount, got[2].max_amount, got[2].payment_method) == (D("20.00"), None, "credit")
    assert (got[3].max_amount, got[3].metric, got[3].card_network, got[3].payment_method, got[3].has_tip) == (D("3.10"), "tip_amount", "amex", "credit", True)
    assert (got[4].query_type, got[4].merchants, got[4].categories, got[4].sum_basis) == ("general", [], [], "receipts")


FACTS = [
    # id, merchant, day, payment, network, amount, categories, return, discount
    (i, ["acme", "zenith", "omega"][i % 3], datetime.datetime(2023, 1 + i % 12, 1 + i % 28), ["cash", "credit", "debit"][i % 3],
     [None, "visa", None][i % 3], D(i * 10), [["groceries"], ["treats", "groceries"], ["other"], ["pharmacy", "treats"]][i % 4],
     i % 5 == 0, i % 7 == 0)
    for i in range(1, 121)
]
ASKED = [
    (1, dict(merchants=["Acme Store"])), (2, dict(merchants=["Zenith", "Acme"], start=_d(2023, 3, 1), end=_d(2023, 6, 15))),
    (3, dict(start=_d(2023, 2, 10), end=_d(2023, 5, 2))), (4, dict(categories=["treats", "groceries"])),
    (5, dict(payment="credit", low=D(300))), (6, dict(low=D(200), high=D(400))), (7, dict(is_return=True, has_discounts=True)),
    (8, dict()), (9, dict(start=_d(2020, 4, 1), end=_d(2024, 5, 1), month=4)), (10, dict(categories=["pharmacy"], network="visa")),
    (11, dict(merchants=["Nobody"])), (12, dict(start=_d(2023, 5, 2), end=_d(2023, 5, 2))),
    (13, dict(end=_d(2023, 5, 1), month=4)), (14, dict(merchants=["Acme"], end=_d(2024, 5, 1), month=4)),
]


@pytest.mark.parametrize("limit", ["-1", "10MB"])
def test_matching_against_all_pairs(spark, request, limit):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    facts = spark.createDataFrame(FACTS, "receipt_id bigint, merchant_name_norm string, transaction_date timestamp_ntz, payment_method string, card_network string, total_amount decimal(12,2), categories array<string>, is_return boolean, has_discounts boolean")
    facts = facts.withColumns({c: F.lit(False) for c in ("has_warranty", "has_delivery_fee", "has_tip")})
    params = spark.createDataFrame(
        [(q, a.get("merchants", []), a.get("start"), a.get("end"), a.get("month"), a.get("categories", []), a.get("payment"), a.get("network"),
          a.get("low"), a.get("high"), a.get("is_return", False), a.get("has_discounts", False)) for q, a in ASKED],
        "question_id bigint, merchants array<string>, start_ts timestamp_ntz, end_ts timestamp_ntz, month_of_year int, categories array<string>, payment_method string, card_network string, min_amount decimal(12,2), max_amount decimal(12,2), is_return boolean, has_discounts boolean",
    ).withColumns({c: F.lit(False) for c in ("has_warranty", "has_delivery_fee", "has_tip")})
    got = sorted((r.question_id, r.receipt_id) for r in qa.match(params, facts, "receipt_id", "total_amount", ["receipt_id"]).collect())
    wanted = []
    for q, a in ASKED:
        names = {m.lower().replace(" store", "") for m in a.get("merchants", [])}
        for (i, m, t, pay, net, amount, cats, ret, disc) in FACTS:
            ok = (not names or m in names) and (not a.get("start") or a["start"] <= t) and (not a.get("end") or t < a["end"])
            ok &= not a.get("month") or t.month == a["month"]
            ok &= not a.get("categories") or bool(set(cats) & set(a["categories"]))
            ok &= not a.get("payment") or pay == a["payment"]
            ok &= not a.get("network") or net == a["network"]
            ok &= a.get("low") is None or amount > a["low"]
            ok &= a.get("high") is None or amount < a["high"]
            if a.get("is_return") or a.get("has_discounts"):
                ok &= (a.get("is_return", False) and ret) or (a.get("has_discounts", False) and disc)
            if ok:
                wanted.append((q, i))
    assert got == sorted(wanted)


def test_cells_find_what_all_pairs_find(spark, monkeypatch):
    """Clusters, copies, vectors without a direction and string ids; cells in parts and queries in blocks."""
    import numpy as np

    from tillweave.operators import nearest, vectors as ve

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16))
    vecs = [centres[i % 8] + 0.2 * rng.normal(size=16) for i in range(600)]
    vecs += [vecs[3]] * 300 + [2 * vecs[3]] * 5  # a hot cell of copies; length plays no part
    rows = [(f"v{i:04d}", [float(np.float32(x)) for x in v]) for i, v in enumerate(vecs)]
    odd = [("n0", None), ("n1", [0.0] * 16), ("n2", [None] + [1.0] * 15), ("n3", [float("nan")] * 16), ("n4", [float("inf")] + [1.0] * 15), ("n5", [1.0, 2.0])]
    asked = [(i, rows[i * 7][1]) for i in range(60)] + [(100, [float(x) for x in rng.normal(size=16)]), (101, None), (102, [0.0] * 16), (103, [1.0])]
    units = np.array([v for _, v in rows], np.float64)
    units /= np.sqrt((units * units).sum(1))[:, None]
    want = set()
    for q, v in asked[:61]:
        v = np.array(v) / np.linalg.norm(v)
        scores = (units * v).sum(1)
        order = sorted(range(len(rows)), key=lambda i: (-scores[i], rows[i][0]))[:7]
        want |= {(q, rows[i][0], rank) for rank, i in enumerate(order, 1)}
    vectors = spark.createDataFrame(rows + odd, "vec string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame(asked, "q long, embedding array<float>")
    monkeypatch.setattr(nearest, "CELL_ROWS", 30)
    for part, block in ((1 << 25, 1 << 23), (16 * 8 * 40, 16 * 8 * 9)):
        monkeypatch.setattr(nearest, "PART_BYTES", part)
        monkeypatch.setattr(nearest, "BLOCK_BYTES", block)
        got = ve.top_k_many(vectors, queries, "vec", "q", k=7).collect()
        assert len(got) == len(want) and {(r.q, r.vec, r["rank"]) for r in got} == want
    cells = nearest.build_cells(vectors, "vec")
    scored = nearest.search(cells, queries, "q", k=7).agg(F.sum("scored")).first()[0]
    assert scored < 0.5 * 61 * len(rows)  # of all pairs, most are out of reach
    assert ve.top_k_many(vectors, queries, "vec", "q", k=7, cells=cells).count() == len(want)
    assert ve.top_k_many(vectors.filter("vec like 'n%'"), queries, "vec", "q").collect() == []
    assert ve.top_k_many(vectors, queries.limit(0), "vec", "q").collect() == []


def test_cosine_of_a_zero_vector_is_null(spark):
    from tillweave.operators import vectors as ve

    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(ve.cosine(F.col("a"), F.col("b"))).collect()] == [None, 1.0]


def test_hashed_neighbours_find_a_vector_itself(spark, sf_dir):
    from tillweave.operators import vectors as ve

    vecs = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = vecs.select(F.col("vec_id").alias("q"), "embedding")
    near = ve.similar_pairs_lsh(vecs, asked, "vec_id", "q", "embedding", 0.3)
    own = near.filter("q = vec_id").collect()
    assert len(own) == vecs.count() and all(abs(r.score - 1.0) < 1e-6 for r in own)


def test_concepts_filter_the_items_asked_for(spark):
    from tillweave.operators import questions as qp

    texts = ["How much have I spent on treats in total?", "How much on desserts?", "Find health-related purchases", "groceries and candy", "hello"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "question_id bigint, text string").withColumn(
        "reference_ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = {r.question_id: (r.categories, r.sum_basis) for r in qp.parse_questions(df).collect()}
    assert got[0] == got[1] == (["treats"], "items") and got[2] == (["pharmacy"], "items")
    assert got[3] == (["groceries"], "items") and got[4][0] == []


def test_day_counts_of_any_length_and_months_of_all_years(spark):
    from tillweave.operators import temporal as tr

    texts = ["last 250000 days", "last 99999999999999999999999 days", "past 007 days", "show december receipts"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    r = tr.resolve(F.col("text"), F.lit("2024-01-01").cast("timestamp_ntz"))
    got = {x.id: (x.s, x.e, x.m) for x in df.select("id", r.start_ts.cast("string").alias("s"), r.end_ts.isNotNull().alias("e"), r.month_of_year.alias("m")).collect()}
    assert got[0][0].startswith("1339-") and got[1][0].startswith("0001-01-01") and got[2][0].startswith("2023-12-25")
    assert got[3] == (None, True, 12)
