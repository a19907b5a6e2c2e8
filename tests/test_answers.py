"""Questions against facts: blocks of days, pieces, summary cells and names, beside plain loops."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tillweave.operators import answers as qa

FACTS = """receipt_id long, merchant_name_norm string, transaction_date timestamp_ntz, payment_method string, card_network string,
  total_amount decimal(12,2), tax_amount decimal(12,2), tip_amount decimal(12,2), categories array<string>, has_warranty boolean, is_return boolean,
  has_discounts boolean, has_delivery_fee boolean, has_tip boolean"""
ASKED = """question_id long, aggregation string, query_type string, start_ts timestamp_ntz, end_ts timestamp_ntz, month_of_year int, merchants array<string>,
  categories array<string>, payment_method string, card_network string, has_warranty boolean, is_return boolean, has_discounts boolean,
  has_delivery_fee boolean, has_tip boolean, min_amount decimal(12,2), max_amount decimal(12,2), sum_basis string, metric string"""
MICRO = dt.timedelta(microseconds=1)


def moment(rng, whole=0.5):
    day = dt.datetime(1999, 1, 1) + dt.timedelta(days=rng.randrange(800))
    return day if rng.random() < whole else day + dt.timedelta(seconds=rng.randrange(86400), microseconds=rng.randrange(3))


def money(rng):
    return rng.choice([None, D(rng.randrange(-500, 2000)) / 100, D(rng.randrange(0, 300_000)) / 100, D("50.00"), D("1234.56")])


def facts(rng, n):
    rows = []
    for i in range(n):
        kinds = rng.choice([None, [], ["groceries"], ["groceries", "pharmacy"], ["pharmacy", "groceries"], ["electronics"]])
        flags = [rng.choice([True, False, None]) for _ in qa.FLAGS]
        when = None if rng.random() < 0.03 else moment(rng)
        rows.append((i, rng.choice(["walmart", "walmart supercenter", "target", "big walmart", "wal mart"]), when, rng.choice(["cash", "credit", None]),
                     rng.choice(["visa", None]), money(rng), money(rng), money(rng), kinds, *flags))
    return rows


def questions(rng, n):
    rows = []
    for i in range(n):
        start, end, month = None, None, None
        shape = rng.random()
        if shape < 0.5:
            start = moment(rng)
            end = rng.choice([start + dt.timedelta(days=rng.choice([0, 1, 1, 7, 40, 400])), start + MICRO, moment(rng)])
        elif shape < 0.7:
            month = rng.randint(1, 12)
            end = rng.choice([None, dt.datetime(2000, month, 28) + dt.timedelta(days=4), moment(rng)])
            end = end and rng.choice([end, end.replace(day=1)])
            start = rng.choice([None, None, moment(rng)])
        elif shape < 0.8:
            start, end = rng.choice([(None, moment(rng)), (moment(rng), None)])
        pick = lambda values, p=0.3: rng.choice(values) if rng.random() < p else None
        flags = [rng.random() < 0.1 for _ in qa.FLAGS]
        low, high = pick([D("50.00"), D("3.10"), D("1234.56")], 0.25), pick([D("50.00"), D("1999.99"), D("3.15")], 0.25)
        rows.append((i, rng.choice(["sum", "average", "count"]), "general", start, end, month, pick([["Walmart"], ["target", "Walmart"], []], 0.2), pick([["groceries"], ["electronics", "groceries"], []]),
                     pick(["cash", "credit"]), pick(["visa"], 0.1), *flags, low, high, "receipts", rng.choice(["total_amount", "tax_amount", "tip_amount"])))
    return rows


def holds(q, f, meant=lambda asked, name: asked == name):
    (_, _, _, start, end, month, merchants, kinds, payment, network, *rest) = q
    flags, (low, high, _, _) = rest[:5], rest[5:]
    _, name, when, paid, net, amount, _, _, has, *held = f
    return not (
        (start is not None and not (when is not None and when >= start))
        or (end is not None and not (when is not None and when < end))
        or (month is not None and not (when is not None and when.month == month))
        or (merchants and not any(meant(m.lower(), name) for m in merchants))
        or (kinds and not set(kinds) & set(has or []))
        or (payment is not None and paid != payment)
        or (network is not None and net != network)
        or (any(flags) and not any(a and b for a, b in zip(flags, held)))
        or (low is not None and not (amount is not None and amount > low))
        or (high is not None and not (amount is not None and amount < high))
    )


def plain_audit(asked, rows, meant=lambda asked, name: asked == name):
    out = {}
    for q in asked:
        at = {"total_amount": 5, "tax_amount": 6, "tip_amount": 7}[q[-1]]
        values = [f[at] for f in rows if holds(q, f, meant) and f[at] is not None]
        value = None
        if values:
            value = {"sum": sum(values), "count": D(len(values)), "average": (sum(values) / len(values)).quantize(D("0.01"), "ROUND_HALF_UP")}[q[1]]
        out[q[0]] = (len(values), value)
    return out


@pytest.fixture(scope="module")
def asked_and_facts(spark):
    rng = random.Random(12)
    rows, asked = facts(rng, 600), questions(rng, 400)
    return rows, asked, spark.createDataFrame(rows, FACTS).repartition(3), spark.createDataFrame(asked, ASKED)


def test_day_blocks_cover_a_range_once(spark):
    rng = random.Random(4)
    ranges = [(a, a + rng.choice([0, 1, 5, 8, 63, 64, 700, 20_000])) for a in (rng.randrange(1 << 22, (1 << 22) + 30_000) for _ in range(200))] + [(0, 1 << 23), (5, 5), (9, 3)]
    df = spark.createDataFrame(ranges, "low long, high long").select("low", "high", qa.day_blocks("low", "high").alias("keys"))
    for r in df.collect():
        days = []
        for key in r["keys"]:
            level, number = (int(x) for x in key[1:].split(":"))
            days.append((number * 8**level, (number + 1) * 8**level))
        days.sort()
        assert len(days) <= 14 * 8 and all(a[1] == b[0] for a, b in zip(days, days[1:]))
        assert (days[0][0], days[-1][1]) == (r.low, r.high) if r.low < r.high else not days


def test_audit_equals_a_plain_loop(asked_and_facts):
    rows, asked, fact_df, question_df = asked_and_facts
    items = fact_df.withColumns({"item_id": F.col("receipt_id"), "item_price": F.col("total_amount")})
    want = plain_audit(asked, rows)
    assert sum(n > 0 for n, _ in want.values()) > 100
    got = {r.question_id: (r.agg_count, r.agg_value) for r in qa.audit(question_df, fact_df, items).collect()}
    assert got == want
    by_item = question_df.withColumns({"sum_basis": F.lit("items"), "metric": F.lit("item_price")})
    got = {r.question_id: (r.agg_count, r.agg_value) for r in qa.audit(by_item, fact_df, items).collect()}
    assert got == plain_audit([(*q[:-1], "total_amount") for q in asked], rows)


def test_match_equals_a_plain_loop(asked_and_facts):
    rows, asked, fact_df, question_df = asked_and_facts
    pairs = qa.match(question_df, fact_df, "receipt_id", "total_amount", ["receipt_id"]).collect()
    got = [(r.question_id, r.receipt_id) for r in pairs]
    assert len(got) == len(set(got)) and set(got) == {(q[0], f[0]) for q in asked for f in rows if holds(q, f)}


def test_pieces_keep_to_their_range(spark, asked_and_facts):
    """Ranges alone: what the blocks meet is hardly more than what matches, and one day meets one day."""
    rows, asked, fact_df, question_df = asked_and_facts
    plain = question_df.filter("start_ts < end_ts").select(
        *[F.col(f.name) if f.name in ("question_id", "start_ts", "end_ts", "sum_basis", "metric", "aggregation", "query_type") else F.lit(None).cast(f.dataType).alias(f.name) for f in question_df.schema]
    )
    keys = qa.question_keys(plain)
    met = keys.join(qa.fact_keys(fact_df, "receipt_id", qa._kinds(keys)), "_key").count()
    matches = qa.match(plain, fact_df, "receipt_id", "total_amount", ["receipt_id"]).count()
    assert matches > 1000 and met <= 2 * matches
    day = plain.filter("question_id = 0 OR true").limit(1).withColumns({"start_ts": F.lit("2000-03-05").cast("timestamp_ntz"), "end_ts": F.lit("2000-03-06").cast("timestamp_ntz")})
    assert [r._key for r in qa.question_keys(day).collect()] == [f"d0:{(dt.date(2000, 3, 5) - dt.date(1970, 1, 1)).days + qa.DAY_SHIFT}"]


def test_cells_merge(asked_and_facts):
    """Cells of two loads added up are the cells of both."""
    rows, _, fact_df, _ = asked_and_facts
    plain = lambda df: sorted(map(repr, (r.asDict() for r in df.collect())))
    cells = lambda df: qa.summary_cells(df, "total_amount", ["total_amount", "tip_amount"], True)
    whole = cells(fact_df)
    parts = cells(fact_df.filter("receipt_id < 250")).unionByName(cells(fact_df.filter("receipt_id >= 250")))
    assert plain(qa.merged_cells(parts).select(*whole.columns)) == plain(qa.merged_cells(whole).select(*whole.columns))
    assert whole.agg(F.sum("n_matches")).first()[0] == len(rows)


def test_amount_buckets_grow_with_amounts(spark):
    amounts = sorted({D(x) / 100 for x in [*range(-1300, 1300, 7), 99, 100, 999, 1000, 10**9, 10**12 - 1, 12345, 12999, 13000]})
    df = spark.createDataFrame([(a,) for a in amounts], "a decimal(12,2)").select("a", qa.amount_bucket(F.col("a")).alias("b"))
    buckets = [r.b for r in sorted(df.collect(), key=lambda r: r.a)]
    assert buckets == sorted(buckets) and len(set(buckets)) > 200


def test_partial_names_mean_every_name_that_holds_them(spark, asked_and_facts):
    rows, asked, fact_df, question_df = asked_and_facts
    items = fact_df.withColumns({"item_id": F.col("receipt_id"), "item_price": F.col("total_amount")})
    names = qa.names_within(question_df, fact_df.select("merchant_name_norm").withColumnRenamed("merchant_name_norm", "name_norm"))
    assert {(r.asked, r.name_norm) for r in names.collect()} == {("walmart", n) for n in ("walmart", "walmart supercenter", "big walmart")} | {("target", "target")}
    meant = lambda a, name: f" {a} " in f" {name} "
    named = [q for q in asked if q[6]]
    got = {r.question_id: (r.agg_count, r.agg_value) for r in qa.audit(question_df.filter(F.size("merchants") > 0), fact_df, items, names).collect()}
    assert got == plain_audit(named, rows, meant) and got != plain_audit(named, rows)
