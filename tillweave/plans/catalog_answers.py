"""Registered queries over facts: answers, dashboards, vectors, table maintenance and loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillweave.functions import fixed, text as tx
from tillweave.operators import answers as qa, dashboard as da, headers, merchants as me, questions as qp, terms, vectors as ve
from tillweave.plans.catalog_text import ORACLES as TEXT_ORACLES, RULES, receipts
from tillweave.plans.tables import customer_questions, item_facts, receipt_facts, table
from tillweave.plans.base_sql import documents as documents_sql
from tillweave.plans.render import rendered
from tillweave.session import stored, work_path
from tillweave.sources import documents as src, history, tables as tb
from tillweave.streaming import ingest

QUERIES, ORACLES = {}, {}


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# --- QA: questions of every customer against orders and lineitems --------------------------------

_PAYMENT = """CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'cash' WHEN 'MACHINERY' THEN 'credit' WHEN 'BUILDING' THEN 'credit'
  WHEN 'AUTOMOBILE' THEN 'debit' ELSE 'apple_pay' END"""
_ITEM_CATEGORY = """CASE p_type WHEN 'STANDARD' THEN 'groceries' WHEN 'PROMO' THEN 'restaurant' WHEN 'MEDIUM' THEN 'fast_food'
  WHEN 'LARGE' THEN 'coffee_shop' WHEN 'SMALL' THEN 'electronics' ELSE 'pharmacy' END"""

# What each kind of customer question asks for, written out by hand.
_ASKED = f"""
WITH latest AS (SELECT max(o_orderdate) AS ref FROM orders),
ask AS MATERIALIZED (
  SELECT c_custkey AS qid, c_custkey % 8 AS kind,
    CASE WHEN c_custkey % 8 IN (0, 1, 2, 4, 5, 6) THEN c_custkey END AS who,
    CASE c_custkey % 8 WHEN 0 THEN make_date(2000, (c_custkey % 12 + 1)::INT, 1) WHEN 3 THEN make_date(2000, (c_custkey % 12 + 1)::INT, 1)
      WHEN 1 THEN make_date(year(ref) - 1, 1, 1) WHEN 6 THEN DATE '2000-01-01' + (c_custkey % 100)::INT WHEN 7 THEN CAST(ref AS DATE) - 1 END AS d0,
    CASE c_custkey % 8 WHEN 0 THEN CAST(make_date(2000, (c_custkey % 12 + 1)::INT, 1) + INTERVAL 1 MONTH AS DATE)
      WHEN 3 THEN CAST(make_date(2000, (c_custkey % 12 + 1)::INT, 1) + INTERVAL 1 MONTH AS DATE)
      WHEN 1 THEN make_date(year(ref), 1, 1) WHEN 6 THEN DATE '2000-01-01' + (c_custkey % 100)::INT + 181 WHEN 7 THEN CAST(ref AS DATE) END AS d1,
    c_custkey % 8 = 4 AS groceries, CASE WHEN c_custkey % 8 = 5 THEN 200000 END AS min_amount, c_custkey % 8 = 6 AS returned,
    c_custkey % 8 <> 7 AS figure, c_custkey % 8 IN (4, 6, 7) AS by_item
  FROM customer, latest
),
reps AS MATERIALIZED (SELECT qid, CASE WHEN who IS NULL THEN min(qid) OVER (PARTITION BY who, kind, d0) ELSE qid END AS rep FROM ask),
rec AS MATERIALIZED (SELECT o_orderkey AS receipt_id, o_custkey AS cust, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
        o_orderpriority = '3-MEDIUM' AS groceries, o_orderstatus = 'F' AS ret FROM orders),
itm AS MATERIALIZED (SELECT receipt_id, cust, d, CAST(l_extendedprice AS DECIMAL(12,2)) AS amount, p_type = 'STANDARD' AS groceries, l_returnflag = 'R' AS ret, l_partkey AS pk
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN rec ON receipt_id = l_orderkey),
hit AS MATERIALIZED (
  SELECT qid, kind, false AS by_item, receipt_id, amount, NULL AS pk FROM ask JOIN reps USING (qid) JOIN rec ON rep = qid AND (who IS NULL OR who = cust) AND (d0 IS NULL OR (d >= d0 AND d < d1))
    AND (NOT ask.groceries OR rec.groceries) AND (min_amount IS NULL OR amount > min_amount) AND (NOT returned OR ret)
  UNION ALL
  SELECT qid, kind, true, receipt_id, amount, pk FROM ask JOIN reps USING (qid) JOIN itm ON rep = qid AND (who IS NULL OR who = cust) AND (d0 IS NULL OR (d >= d0 AND d < d1))
    AND (NOT ask.groceries OR itm.groceries) AND (min_amount IS NULL OR amount > min_amount) AND (NOT returned OR ret)
)
"""
_AGG = "CASE kind WHEN 1 THEN 'count' WHEN 2 THEN 'average' WHEN 6 THEN 'count' WHEN 7 THEN NULL ELSE 'sum' END"


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameter table of all customer questions, stored once and read by every later step."""
    path = work_path(spark, "params")
    qp.parse_questions(customer_questions(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


def receipt_matches(questions: DataFrame, spark, sf_dir) -> DataFrame:
    return qa.match(
        questions, receipt_facts(spark, sf_dir), "receipt_id", "total_amount",
        ["receipt_id", "merchant_name", "total_amount", "transaction_date", "filename"],
    )


def item_matches(questions: DataFrame, spark, sf_dir) -> DataFrame:
    return qa.match(
        questions, item_facts(spark, sf_dir), "item_id", "item_price",
        ["receipt_id", "item_name", "item_price", "item_category", "merchant_name", "filename", "transaction_date", "total_amount"],
    )


def qa1_filters(spark, sf_dir):
    unique = qa.unique_questions(params(spark, sf_dir))
    return receipt_matches(unique, spark, sf_dir).select("question_id", "receipt_id")


register("qa1_filters", qa1_filters, _ASKED + "SELECT qid AS question_id, receipt_id FROM hit WHERE NOT by_item")


def qa1_partial_names(spark, sf_dir):
    """Spending by country: every country's name means all merchants whose names hold it, one per kind of customer."""
    customer = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    shown = F.initcap(F.translate("n_name", "#_", "  "))
    named = customer.select("c_custkey", F.concat(shown, F.lit(" "), F.initcap("c_mktsegment")).alias("merchant_name"))
    facts = receipt_facts(spark, sf_dir).drop("merchant_name", "merchant_name_norm").join(named, "c_custkey")
    facts = facts.withColumn("merchant_name_norm", me.normalise(F.col("merchant_name")))
    asked = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("question_id"), F.concat(F.lit("How much have I spent at "), shown, F.lit("?")).alias("text"),
        F.lit("2001-01-01").cast("timestamp_ntz").alias("reference_ts"),
    )
    p = stored(qp.parse_questions(asked), "country-questions")
    names = qa.names_within(p, me.known_names(named))
    sums = qa.audit(p, facts, item_facts(spark, sf_dir), names)
    return sums.select("question_id", "agg_count", F.col("agg_value").cast("double").alias("agg_value"))


register("qa1_partial_names", qa1_partial_names, """
SELECT n_nationkey::BIGINT AS question_id, count(o_orderkey) AS agg_count, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS agg_value
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")


def qa2_any_flag(spark, sf_dir):
    facts = item_facts(spark, sf_dir).filter(
        qa.flag_filter(["is_return", "has_discounts"]) & F.col("item_category").isin("groceries", "pharmacy")
    )
    return facts.groupBy("item_category").agg(F.count(F.lit(1)).alias("n"), F.sum("item_price").cast("double").alias("total"))


register("qa2_any_flag", qa2_any_flag, f"""
SELECT {_ITEM_CATEGORY} AS item_category, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS total
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE (l_returnflag = 'R' OR l_discount > 0) AND p_type IN ('STANDARD', 'ECONOMY') GROUP BY 1""")


def qa3_receipt_predicates(spark, sf_dir):
    """Receipts of a month, name part, payment method and amount, with an item of a category."""
    facts = receipt_facts(spark, sf_dir).filter(
        (F.month("transaction_date") == 3) & (F.year("transaction_date") >= 1996) & F.col("merchant_name").contains("7")
        & F.col("payment_method").isin("cash", "credit") & (F.col("total_amount") > 50000)
    )
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("receipt_id"), "p_type"
    )
    return qa.receipts_with_item(facts, lines, "receipt_id", F.col("p_type") == "PROMO").select(
        "receipt_id", "merchant_name", F.col("total_amount").cast("double").alias("total_amount")
    )


register("qa3_receipt_predicates", qa3_receipt_predicates, f"""
SELECT o_orderkey AS receipt_id, replace(c_name, '#', ' ') || CASE WHEN c_custkey % 3 = 0 THEN ' Store' ELSE '' END AS merchant_name,
  CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS total_amount FROM orders JOIN customer ON o_custkey = c_custkey
WHERE month(o_orderdate) = 3 AND year(o_orderdate) >= 1996 AND contains(c_name, '7') AND {_PAYMENT} IN ('cash', 'credit') AND o_totalprice > 50000
  AND EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_type = 'PROMO')""")


def qa4_audit(spark, sf_dir):
    out = qa.audit(params(spark, sf_dir), receipt_facts(spark, sf_dir), item_facts(spark, sf_dir))
    return out.withColumn("agg_value", F.col("agg_value").cast("double"))


_AUDIT = _ASKED + """
, agg AS (SELECT ask.qid, ask.kind, count(amount) AS n, sum(amount) AS s FROM ask JOIN reps USING (qid) LEFT JOIN hit ON hit.qid = rep AND hit.by_item = ask.by_item
          WHERE figure GROUP BY 1, 2),
res AS (SELECT qid, kind, n, CASE WHEN n > 0 THEN CASE WHEN kind IN (1, 6) THEN CAST(n AS DECIMAL(38,2)) WHEN kind <> 2 THEN CAST(s AS DECIMAL(38,2))
          ELSE CAST((2 * CAST(s * 100 AS HUGEINT) + n) // (2 * n) AS DECIMAL(36,0)) * CAST(0.01 AS DECIMAL(2,2)) END END AS v FROM agg)
"""
register("qa4_audit", qa4_audit, _AUDIT + f"SELECT qid AS question_id, {_AGG} AS aggregation, n AS agg_count, CAST(v AS DOUBLE) AS agg_value FROM res")


def qa5_distinct_receipts(spark, sf_dir):
    unique = qa.unique_questions(params(spark, sf_dir))
    hits = item_matches(unique, spark, sf_dir).withColumn("score", F.col("item_price"))
    return qa.distinct_receipts(hits).select(
        "question_id", "receipt_id", "merchant_name", "filename", F.date_format("transaction_date", "yyyy-MM-dd").alias("transaction_day"),
        F.col("total_amount").cast("double").alias("total_amount"), F.col("best_score").cast("double").alias("best_score"),
    )


register("qa5_distinct_receipts", qa5_distinct_receipts, _ASKED + """
SELECT qid AS question_id, hit.receipt_id, replace(c_name, '#', ' ') || CASE WHEN c_custkey % 3 = 0 THEN ' Store' ELSE '' END AS merchant_name,
  'receipt_' || hit.receipt_id || '.txt' AS filename, strftime(rec.d, '%Y-%m-%d') AS transaction_day, CAST(rec.amount AS DOUBLE) AS total_amount,
  CAST(max(hit.amount) AS DOUBLE) AS best_score
FROM hit JOIN rec ON rec.receipt_id = hit.receipt_id JOIN customer ON c_custkey = rec.cust WHERE by_item GROUP BY ALL""")


def qa6_item_list(spark, sf_dir):
    """Items of the questions; questions about totals have no item hits and list receipts."""
    unique = qa.unique_questions(params(spark, sf_dir))
    items = item_matches(unique.filter(F.col("sum_basis") == "items"), spark, sf_dir)
    item_hits = items.select(
        "question_id", F.col("item_name").alias("name"), F.col("item_price").alias("price"),
        F.col("item_category").alias("category"), F.col("merchant_name").alias("merchant"), "filename",
    )
    return qa.item_list(item_hits, receipt_matches(unique, spark, sf_dir)).withColumn("price", F.col("price").cast("double"))


_WHO = "replace(c_name, '#', ' ') || CASE WHEN c_custkey % 3 = 0 THEN ' Store' ELSE '' END"
register("qa6_item_list", qa6_item_list, _ASKED + f"""
, ih AS (SELECT hit.* FROM hit JOIN ask ON ask.qid = hit.qid AND ask.by_item WHERE hit.by_item)
SELECT qid AS question_id, p_name AS name, CAST(ih.amount AS DOUBLE) AS price, {_ITEM_CATEGORY} AS category, {_WHO} AS merchant, 'receipt_' || ih.receipt_id || '.txt' AS filename
FROM ih JOIN rec ON rec.receipt_id = ih.receipt_id JOIN customer ON c_custkey = rec.cust JOIN part ON p_partkey = ih.pk
UNION ALL
SELECT DISTINCT qid, 'Receipt from ' || {_WHO}, CAST(hit.amount AS DOUBLE), 'Receipt', {_WHO}, 'receipt_' || hit.receipt_id || '.txt'
FROM hit JOIN rec ON rec.receipt_id = hit.receipt_id JOIN customer ON c_custkey = rec.cust
WHERE NOT by_item AND qid NOT IN (SELECT qid FROM ih)""")


def qa7_evidence(spark, sf_dir):
    """The three longest documents of every source as numbered evidence."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", "text")
    hits = qa.best_hits(docs, "source", [F.desc("n_chars"), F.asc("doc_id")], 3)
    return qa.evidence(hits, "source", "text").select("source", F.md5("evidence").alias("digest"), F.length("evidence").alias("length"))


register("qa7_evidence", qa7_evidence, """
WITH r AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents),
e AS (SELECT source, string_agg('--- Context ' || r || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY r) AS t FROM r WHERE r <= 3 GROUP BY 1)
SELECT source, md5(t) AS digest, CAST(length(t) AS INTEGER) AS length FROM e""")


def qa8_results(spark, sf_dir):
    out = qa.results(params(spark, sf_dir), receipt_facts(spark, sf_dir), item_facts(spark, sf_dir))
    return out.select("question_id", "answer", "confidence", "query_type")


_RESULT = _AUDIT + """
, cnt AS (SELECT ask.qid, ask.kind, count(hit.receipt_id) AS m FROM ask JOIN reps USING (qid) LEFT JOIN hit ON hit.qid = rep AND hit.by_item = ask.by_item GROUP BY 1, 2),
final AS (SELECT cnt.qid, m, cnt.kind, CASE WHEN m = 0 THEN 'I couldn''t find any receipts matching those criteria.'
  WHEN v IS NOT NULL THEN CASE WHEN cnt.kind IN (1, 6) THEN 'Count' WHEN cnt.kind = 2 THEN 'Average' ELSE 'Sum' END || ' over ' || n || ' values: ' || CAST(v AS DECIMAL(38,2))
  ELSE 'Found ' || m || ' matching rows.' END AS answer,
  CASE WHEN m = 0 THEN 0.0 WHEN v IS NOT NULL THEN 0.85 ELSE 0.7 END AS confidence
  FROM cnt LEFT JOIN res ON res.qid = cnt.qid)
"""
register("qa8_results", qa8_results, _RESULT + """
SELECT qid AS question_id, answer, CAST(confidence AS DOUBLE) AS confidence,
  CASE kind WHEN 0 THEN 'temporal' WHEN 2 THEN 'aggregation' WHEN 4 THEN 'merchant' WHEN 5 THEN 'amount' WHEN 6 THEN 'aggregation'
    ELSE 'general' END AS query_type FROM final""")


# --- DA ------------------------------------------------------------------------------------------


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("receipt_id"), F.col("c_name").alias("merchant_name"),
        F.col("o_orderdate").alias("transaction_date"), F.col("o_totalprice").alias("total_amount"),
    )


def _double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


register("da1_global_metrics",
         lambda s, d: _double(da.global_metrics(_orders(s, d), table(s, d, "lineitem")), "total_spent", "avg_receipt"), """
SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total_spent, count(*) AS receipt_count, count(DISTINCT c_name) AS unique_merchants,
  (SELECT count(*) FROM lineitem) AS total_items,
  CAST(CAST((2 * CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) * 100 AS HUGEINT) + count(*)) // (2 * count(*)) AS DECIMAL(36,0)) * CAST(0.01 AS DECIMAL(2,2)) AS DOUBLE) AS avg_receipt
FROM orders JOIN customer ON o_custkey = c_custkey""")


def da2_spend_over_time(spark, sf_dir):
    out = da.spend_over_time(_orders(spark, sf_dir), unit="week")
    return _double(out, "amount").withColumn("period", F.date_format("period", "yyyy-MM-dd"))


register("da2_spend_over_time", da2_spend_over_time, """
SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS amount, count(*) AS receipt_count
FROM orders GROUP BY 1""")


def da2_spend_points(spark, sf_dir):
    out = da.spend_points(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")
    return _double(out, "amount").withColumn("period", F.date_format("period", "yyyy-MM-dd"))


register("da2_spend_points", da2_spend_points,
         "SELECT strftime(o_orderdate, '%Y-%m-%d') AS period, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS amount FROM orders")
register("da3_top_merchants", lambda s, d: _double(da.top_merchants(_orders(s, d)), "total_spent"), """
SELECT c_name AS merchant_name, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total_spent FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))


register("da4_category_spend", lambda s, d: _double(da.spend_by_category(_lines(s, d), "p_type", "l_extendedprice"), "total_spent"), """
SELECT p_type AS category, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS total_spent FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
register("da5_merchant_visits", lambda s, d: _double(da.merchant_visits(_orders(s, d)), "last_total"), """
SELECT c_name AS merchant_name, count(*) AS visits, CAST(CAST(max_by(o_totalprice, (o_orderdate, o_orderkey)) AS DECIMAL(12,2)) AS DOUBLE) AS last_total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")


def da6_price_histogram(spark, sf_dir):
    out = da.price_histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return out.withColumns({c: F.round(c, 4) for c in ("bin_low", "bin_high")})


register("da6_price_histogram", da6_price_histogram, """
WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT CAST(least(floor((l_extendedprice - lo) * 10 / (hi - lo)) + 1, 10) AS INTEGER) AS bin, lo, (hi - lo) / 10 AS w FROM lineitem, e)
SELECT bin, count(*) AS n, round(any_value(lo + w * (bin - 1)), 4) AS bin_low, round(any_value(lo + w * bin), 4) AS bin_high FROM b GROUP BY bin""")
register("da7_category_counts", lambda s, d: da.counts_by(table(s, d, "events"), "event_type"), "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
register("da8_merchant_counts", lambda s, d: da.counts_by(table(s, d, "events"), "user_id"), "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
register("da9_monthly_totals", lambda s, d: _double(da.monthly_totals(_orders(s, d)), "total_spent"), """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total_spent
FROM orders GROUP BY 1, 2""")


def da10_items_per_large_receipt(spark, sf_dir):
    large = da.above(_orders(spark, sf_dir), 400000)
    counts = da.items_per_receipt(table(spark, sf_dir, "lineitem"), "l_orderkey")
    joined = large.join(counts, F.col("receipt_id") == F.col("l_orderkey"), "left")
    return _double(joined.select("receipt_id", "total_amount", F.coalesce("item_count", F.lit(0)).alias("item_count")), "total_amount")


register("da10_items_per_large_receipt", da10_items_per_large_receipt, """
SELECT o_orderkey AS receipt_id, o_totalprice AS total_amount, coalesce(n, 0) AS item_count
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_totalprice > 400000""")


def da11_latency(spark, sf_dir):
    out = da.latency_summary(table(spark, sf_dir, "events"), "value", "event_type")
    return out.select("event_type", F.round("mean", 4).alias("mean"), F.round("p95", 4).alias("p95"))


register("da11_latency", da11_latency,
         "SELECT event_type, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1")


# --- V -------------------------------------------------------------------------------------------


def v1_text_features(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ve.embed_text(docs, "text", dimension=512).select(
        "doc_id", F.size("embedding").alias("dimension"), F.round(ve.norm(F.col("embedding")), 3).alias("norm")
    )


register("v1_text_features", v1_text_features)


def v1_term_features(spark, sf_dir):
    """Every bucket of every document's term vector that isn't zero."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = terms.term_vectors(terms.fit_terms(docs, "text", 512), docs)
    parts = made.select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))
    return parts.filter("weight > 1e-9").withColumn("weight", F.round("weight", 5))


_TERMS_SQL = """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) AS term FROM documents),
b AS (SELECT doc_id, (('0x' || substr(md5(term), 1, 8))::BIGINT % {dimension})::INT AS bucket, count(*) AS n FROM t GROUP BY 1, 2),
idf AS (SELECT bucket, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(*) + 1)) AS idf FROM b GROUP BY 1),
w AS (SELECT doc_id, bucket, n * idf AS w FROM b JOIN idf USING (bucket)),
v AS (SELECT doc_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w WHERE w > 0)
"""
register("v1_term_features", v1_term_features, _TERMS_SQL.format(dimension=512) + "SELECT doc_id, bucket, round(weight, 5) AS weight FROM v WHERE weight > 1e-9")


def v1_search_text(spark, sf_dir):
    """The three stored documents nearest to every benchmark text, by rank; ids of equal scores are left to the tests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = terms.fit_terms(docs, "text", 256)
    asked = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = ve.search_text(model, terms.term_vectors(model, docs.select("doc_id", "text")), asked, "doc_id", "item_id", k=3)
    return found.select("item_id", "rank", "score")


register("v1_search_text", v1_search_text, _TERMS_SQL.format(dimension=256) + """
, qt AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) AS term FROM benchmark),
qb AS (SELECT item_id, (('0x' || substr(md5(term), 1, 8))::BIGINT % 256)::INT AS bucket, count(*) AS n FROM qt GROUP BY 1, 2),
qw AS (SELECT item_id, bucket, n * coalesce(idf, ln((SELECT count(*) FROM documents) + 1)) AS w FROM qb LEFT JOIN idf USING (bucket)),
qv AS (SELECT item_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM qw WHERE w > 0),
s AS (SELECT item_id, doc_id, sum(qv.weight * v.weight) AS score FROM qv JOIN v USING (bucket) GROUP BY 1, 2),
r AS (SELECT item_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC)::INT AS rank FROM s)
SELECT item_id, rank, round(score, 6) AS score FROM r WHERE rank <= 3""")


def _centroids(spark, sf_dir) -> DataFrame:
    """Mean vector of every label; as many queries as there are labels."""
    return ve.mean_vectors(table(spark, sf_dir, "embeddings"), "embedding", "label")


_CENTROID_SQL = """
WITH p AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
cp AS (SELECT label AS q, i, avg(CAST(v AS DOUBLE)) AS m FROM p GROUP BY 1, 2),
c AS (SELECT q, list(m ORDER BY i) AS u FROM cp GROUP BY 1),
s AS (SELECT q, vec_id, label, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), u) AS score FROM embeddings, c)
"""


def v2_cosine(spark, sf_dir):
    vectors, means = table(spark, sf_dir, "embeddings"), _centroids(spark, sf_dir).withColumnRenamed("embedding", "mean")
    return vectors.join(means, "label").select("vec_id", F.round(ve.cosine(F.col("embedding"), F.col("mean")), 6).alias("score"))


register("v2_cosine", v2_cosine, _CENTROID_SQL + "SELECT vec_id, round(score, 6) AS score FROM s WHERE q = label")


def v3_filtered_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    query = ve.mean_vectors(vectors, "embedding").scalar()
    return ve.top_k(vectors, query, "vec_id", predicate=ve.predicate({"label": [3, 5]})).select("vec_id", "label", "score")


register("v3_filtered_top_k", v3_filtered_top_k, """
WITH p AS (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT list(m ORDER BY i) AS u FROM (SELECT i, avg(CAST(v AS DOUBLE)) AS m FROM p GROUP BY 1))
SELECT vec_id, label, round(full_score, 6) AS score FROM (
  SELECT vec_id, label, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), u) AS full_score FROM embeddings, c WHERE label IN (3, 5))
ORDER BY full_score DESC, vec_id LIMIT 10""")


def v4_top_k_many(spark, sf_dir):
    queries = _centroids(spark, sf_dir).withColumnRenamed("label", "query_label")
    return ve.top_k_many(table(spark, sf_dir, "embeddings"), queries, "vec_id", "query_label", k=5)


register("v4_top_k_many", v4_top_k_many, _CENTROID_SQL + """
SELECT query_label, vec_id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM (
  SELECT q AS query_label, vec_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5""")


def v5_predicates(spark, sf_dir):
    spec = {
        "l_returnflag": ["R", "A"], "l_quantity": (10, 20),
        "any": [{"l_linestatus": "O"}, {"all": [{"l_discount": (None, 0.02)}, {"l_tax": (0.01, None)}]}],
    }
    return table(spark, sf_dir, "lineitem").filter(ve.predicate(spec)).groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n")
    )


register("v5_predicates", v5_predicates, """
SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_quantity BETWEEN 10 AND 20
  AND (l_linestatus = 'O' OR (l_discount <= 0.02 AND l_tax >= 0.01)) GROUP BY 1, 2""")


def v6_latest(spark, sf_dir):
    latest_order = ve.latest(table(spark, sf_dir, "orders"), "o_orderdate").select(
        F.lit("orders").alias("origin"), F.date_format("latest_ts", "yyyy-MM-dd HH:mm:ss").alias("latest"))
    latest_event = ve.latest(table(spark, sf_dir, "events"), "ts").select(
        F.lit("events").alias("origin"), F.date_format("latest_ts", "yyyy-MM-dd HH:mm:ss").alias("latest"))
    return latest_order.unionByName(latest_event)


register("v6_latest", v6_latest, """
SELECT 'orders' AS origin, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS latest FROM orders
UNION ALL SELECT 'events', strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events""")


# --- S and ST --------------------------------------------------------------------------------------


def s1_documents(spark, sf_dir):
    """Documents landed as raw receipts and read back."""
    raw = src.documents_from_table(table(spark, sf_dir, "documents"), "doc_id", "text")
    path = work_path(spark, "raw")
    src.land(raw, path)
    return spark.read.parquet(path).select("filename", F.length("raw_text").alias("length"), F.md5("raw_text").alias("digest"))


register("s1_documents", s1_documents,
         "SELECT 'receipt_' || doc_id || '.txt' AS filename, CAST(length(text) AS INTEGER) AS length, md5(text) AS digest FROM documents")


def s2_only_new(spark, sf_dir):
    """Documents that carry no label yet."""
    return src.only_new(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ("doc_id",)).select("doc_id", "lang")


register("s2_only_new", s2_only_new, "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")


def s3_quarantine(spark, sf_dir):
    # Both outputs read what the documents came to once, stored as narrow rows.
    read = stored(receipts(spark, sf_dir).select("filename", "parse_errors"), "read")
    good, bad = src.split_outputs(read)
    return bad.select("filename", F.array_join("parse_errors", ",").alias("reasons")).unionByName(
        good.groupBy(F.lit("readable").alias("filename")).agg(F.count(F.lit(1)).cast("string").alias("reasons"))
    )


register("s3_quarantine", s3_quarantine, documents_sql("""
SELECT filename, CASE dmg WHEN 0 THEN 'no date' WHEN 1 THEN 'no total' ELSE 'empty text,no date,no total' END AS reasons FROM base WHERE dmg >= 0
UNION ALL SELECT 'readable', CAST(count(*) AS VARCHAR) FROM base WHERE dmg < 0"""))


def s4_upsert(spark, sf_dir):
    """Purchases rewritten twice in one batch replace their old rows; late older versions of the others change nothing."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.lit(1).alias("version"))
    bought = events.filter(F.col("event_type") == "purchase")
    batch = bought.withColumns({"value": F.col("value") + 1, "version": F.lit(2)}).unionByName(
        bought.filter(F.col("value") > 20).withColumns({"value": F.col("value") + 2, "version": F.lit(3)})
    ).unionByName(
        events.filter(F.col("event_type") != "purchase").withColumns({"value": F.col("value") - 7, "version": F.lit(0)})
    )
    return tb.upsert(events, batch, ["event_id"], "version").withColumn("value", F.round("value", 2))


register("s4_upsert", s4_upsert, """
SELECT event_id, event_type, round(value + CASE WHEN event_type <> 'purchase' THEN 0 WHEN value > 20 THEN 2 ELSE 1 END, 2) AS value,
  CASE WHEN event_type <> 'purchase' THEN 1 WHEN value > 20 THEN 3 ELSE 2 END AS version FROM events""")


def s4_keyed_merge(spark, sf_dir):
    """The same batch merged into a table kept by key, twice; then a batch of one user's events."""
    path = work_path(spark, "keyed")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.lit(1).alias("version"))
    tb.create_keyed(events, path, ["event_id"], "version", buckets=16)
    bought = events.filter(F.col("event_type") == "purchase").withColumns({"value": F.col("value") + 1, "version": F.lit(2)})
    late = events.filter(F.col("event_type") != "purchase").withColumns({"value": F.col("value") - 7, "version": F.lit(0)})
    for batch in (bought.unionByName(late), bought, events.filter("user_id % 50 = 7").withColumns({"value": F.lit(0.0), "version": F.lit(3)})):
        tb.merge_keyed(batch, path, ["event_id"], "version")
    return tb.read_keyed(spark, path).withColumn("value", F.round("value", 2))


register("s4_keyed_merge", s4_keyed_merge, """
SELECT event_id, user_id, event_type, CASE WHEN user_id % 50 = 7 THEN 0 ELSE round(value + (event_type = 'purchase')::INT, 2) END AS value,
  CASE WHEN user_id % 50 = 7 THEN 3 WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS version FROM events""")


def s5_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey")
    kept = tb.delete_keys(table(spark, sf_dir, "lineitem"), gone, "l_orderkey", "o_orderkey")
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


register("s5_delete", s5_delete, """
SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")


def s6_rebuild(spark, sf_dir):
    """Events written over an older, shorter table, partitioned by type and read back."""
    path = work_path(spark, "events")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    tb.rebuild(events.filter(F.col("event_type") == "view"), path, partition_by=["event_type"])
    return tb.rebuild(events, path, partition_by=["event_type"]).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")
    )


register("s6_rebuild", s6_rebuild, "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
register("s7_index_statistics", lambda s, d: tb.index_statistics(table(s, d, "embeddings")), """
SELECT count(*) AS total_vector_count, CAST(max(len(embedding)) AS INTEGER) AS dimension, CAST(min(len(embedding)) AS INTEGER) AS least_dimension,
  count(DISTINCT vec_id) AS distinct_ids FROM embeddings""")


def s8_history(spark, sf_dir):
    """Answers of all customer questions appended to the history with their first receipts, and read back."""
    p = params(spark, sf_dir)
    unique = qa.unique_questions(p).withColumn("question_id", F.col("filter_id"))
    first = history.first_per_question(
        receipt_matches(unique, spark, sf_dir).withColumn("receipt", F.col("receipt_id").cast("string")), "receipt", "receipt_id"
    ).withColumnRenamed("question_id", "filter_id")
    kept = qa.with_filter_id(p).select("question_id", "filter_id").join(first, "filter_id").drop("filter_id")
    entries = (
        qa.results(p, receipt_facts(spark, sf_dir), item_facts(spark, sf_dir))
        .join(kept, "question_id", "left")
        .join(customer_questions(spark, sf_dir), "question_id")
        .select("question_id", F.col("text").alias("question"), F.col("reference_ts").alias("asked_at"), "answer", "confidence",
                F.col("kept").alias("receipts"))
    )
    path = work_path(spark, "history")
    history.save_history(entries, path)
    return history.load_history(spark, path).select(
        "question_id", "answer", "confidence", F.date_format("asked_at", "yyyy-MM-dd").alias("asked_day"),
        F.coalesce(F.array_join("receipts", ","), F.lit("")).alias("receipts"),
    )


register("s8_history", s8_history, _RESULT + """
, k AS (SELECT qid, receipt_id, row_number() OVER (PARTITION BY qid ORDER BY receipt_id) AS r FROM hit WHERE NOT by_item)
SELECT final.qid AS question_id, answer, CAST(confidence AS DOUBLE) AS confidence, (SELECT strftime(ref, '%Y-%m-%d') FROM latest) AS asked_day,
  coalesce((SELECT string_agg(receipt_id, ',' ORDER BY r) FROM k WHERE k.qid = (SELECT rep FROM reps WHERE reps.qid = final.qid) AND r <= 5), '') AS receipts FROM final""")


def s8_history_lists(spark, sf_dir):
    """Result records with their ranked receipts and items, saved to the history and read back."""
    p = params(spark, sf_dir)
    made = qa.full_results(p, receipt_facts(spark, sf_dir), item_facts(spark, sf_dir))
    entries = made.join(customer_questions(spark, sf_dir), "question_id").select(
        "question_id", F.col("text").alias("question"), F.col("reference_ts").alias("asked_at"), "answer", "confidence",
        F.transform("receipts", lambda r: r["receipt_id"].cast("string")).alias("receipts"), F.transform("items", lambda i: i["name"]).alias("items"),
    )
    path = work_path(spark, "history")
    history.save_history(entries, path)
    kept = history.load_history(spark, path)
    return kept.select("question_id", "answer", F.array_join("receipts", ",").alias("receipts"), F.array_join("items", ",").alias("items"))


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\pL\\pN]+'))"
_QUESTION = f"""CASE kind WHEN 0 THEN 'How much did I spend at ' || {_WHO} || ' in ' || strftime(d0, '%B') || ' 2000?'
  WHEN 1 THEN 'How many receipts from ' || {_WHO} || ' last year?' WHEN 2 THEN 'What is the average amount at ' || {_WHO} || '?'
  WHEN 3 THEN 'What is my total in ' || strftime(d0, '%B') || ' 2000?' WHEN 4 THEN 'How much have I spent on groceries at ' || {_WHO} || '?'
  WHEN 5 THEN 'Total of receipts over $200,000 from ' || {_WHO} || '?'
  WHEN 6 THEN 'Count returned items between ' || strftime(d0, '%Y-%m-%d') || ' and ' || strftime(d1 - 1, '%Y-%m-%d') || ' at ' || {_WHO}
  ELSE 'What did I buy yesterday?' END"""
_PRIORITY = """CASE o_orderpriority WHEN '1-URGENT' THEN 'pharmacy' WHEN '2-HIGH' THEN 'electronics' WHEN '3-MEDIUM' THEN 'groceries'
  WHEN '4-NOT SPECIFIED' THEN 'restaurant' WHEN '5-LOW' THEN 'coffee_shop' ELSE '' END"""
register("s8_history_lists", s8_history_lists, _RESULT + f"""
, qw AS (SELECT qid, {_WORDS.format(_QUESTION)} AS q FROM ask JOIN customer ON c_custkey = qid),
rh AS (SELECT hit.qid, hit.receipt_id, d, {_WHO} AS who, len(list_intersect(q, {_WORDS.format(f"{_WHO} || ' ' || {_PAYMENT} || ' ' || {_PRIORITY}")})) AS s
  FROM hit JOIN qw USING (qid) JOIN orders ON o_orderkey = hit.receipt_id JOIN customer ON c_custkey = o_custkey JOIN rec ON rec.receipt_id = hit.receipt_id WHERE NOT by_item),
rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, d DESC, receipt_id) AS r FROM rh),
rl AS (SELECT qid, string_agg(receipt_id, ',' ORDER BY r) AS receipts, string_agg('Receipt from ' || who, ',' ORDER BY r) AS standing FROM rr WHERE r <= 5 GROUP BY 1),
ih AS (SELECT hit.qid, hit.receipt_id, d, p_name, hit.amount, len(list_intersect(q, {_WORDS.format(f"p_name || ' ' || {_ITEM_CATEGORY} || ' ' || {_WHO}")})) AS s
  FROM hit JOIN ask ON ask.qid = hit.qid AND ask.by_item JOIN qw ON qw.qid = hit.qid JOIN rec ON rec.receipt_id = hit.receipt_id JOIN customer ON c_custkey = rec.cust JOIN part ON p_partkey = hit.pk WHERE hit.by_item),
ir AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, d DESC, receipt_id, p_name, amount) AS r FROM ih),
il AS (SELECT qid, string_agg(p_name, ',' ORDER BY r) AS items FROM ir WHERE r <= 5 GROUP BY 1)
SELECT final.qid AS question_id, answer, coalesce(receipts, '') AS receipts, coalesce(items, standing, '') AS items
FROM final JOIN reps USING (qid) LEFT JOIN rl ON rl.qid = rep LEFT JOIN il ON il.qid = rep""")


def s9_score_batch(spark, sf_dir):
    """Questions that ask for no figure may stay empty; all others must match something."""
    p = params(spark, sf_dir)
    unique = qa.unique_questions(p).withColumn("question_id", F.col("filter_id"))
    per_filter = qa.match_counts(receipt_matches(unique, spark, sf_dir)).withColumnRenamed("question_id", "filter_id")
    counts = qa.with_filter_id(p).select("question_id", "filter_id").join(per_filter, "filter_id").drop("filter_id")
    scores = history.score_batch(p, counts, p.filter(F.col("aggregation").isNull()))
    return history.score_totals(scores)


register("s9_score_batch", s9_score_batch, _ASKED + """
, s AS (SELECT ask.qid, count(receipt_id) AS m, bool_or(figure) AS figure FROM ask JOIN reps USING (qid) LEFT JOIN hit ON hit.qid = rep AND NOT hit.by_item GROUP BY 1)
SELECT count(*) AS questions, count(*) FILTER (m > 0 OR NOT figure) AS passed, count(*) FILTER (m = 0 AND figure) AS failed,
  count(*) FILTER (m = 0) AS empty FROM s""")


def st1_incremental_load(spark, sf_dir):
    """The documents table as a stream of files: taken once, headers extracted, appended; a second run adds nothing."""
    schema = table(spark, sf_dir, "documents").schema
    out, checkpoint = work_path(spark, "stream"), work_path(spark, "checkpoint")

    def headers_of(docs: DataFrame) -> DataFrame:
        clean = tx.body(tx.lines(F.col("text")))
        return docs.select("doc_id", headers.merchant(clean).alias("merchant_name"))

    for _ in range(2):
        # The table is one file or a folder of files. A filter on names would skip the files of a folder, and a stream
        # takes a plain path for a folder; a pattern stands for either.
        docs = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
        ingest.load_new(docs, out, checkpoint, headers_of).awaitTermination()
    return spark.read.schema("doc_id bigint, merchant_name string").parquet(out)


register("st1_incremental_load", st1_incremental_load, r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM documents),
h AS (SELECT doc_id, list_transform(lines[1:5], lambda x: regexp_replace(x, '(?i)\s+(STORE|SHOP|MARKET|PHARMACY|CAFE|RESTAURANT)$', '')) AS head, lines FROM l)
SELECT doc_id, coalesce(list_filter(head, lambda x: length(x) > 2)[1], nullif(lines[1], ''), 'Unknown Merchant') AS merchant_name FROM h""")


def st1_chunk_stream(spark, sf_dir):
    """Rendered receipts as a stream of files to receipts and five views; a second run and a repeated batch add nothing."""
    inbox, root, checkpoint = (work_path(spark, n) for n in ("inbox", "loaded", "checkpoint"))
    raw = rendered(spark, sf_dir).select("filename", "raw_text", F.col("filename").alias("path"), F.sha2("raw_text", 256).alias("content_sha256"))
    raw.write.parquet(inbox, compression=ingest.COMPRESSION)
    for _ in range(2):
        files = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 4).parquet(inbox)
        ingest.stream_chunks(files, root, checkpoint, **RULES).awaitTermination()
    return spark.read.parquet(f"{root}/chunks").select("chunk_type", F.md5("content").alias("digest"), F.length("chunk_id").alias("id_length"))


# Receipts whose text was lost are all alike: one of them is taken.
register("st1_chunk_stream", st1_chunk_stream, f"""
WITH gone AS ({documents_sql("SELECT filename FROM base WHERE dmg = 2")})
SELECT chunk_type, digest, id_length FROM ({TEXT_ORACLES['ch8_all_views']})
WHERE filename NOT IN (FROM gone) OR filename = (SELECT min(filename) FROM gone)""")
