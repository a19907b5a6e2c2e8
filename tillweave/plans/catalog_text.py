"""Registered queries over documents: cleaning, extraction, categories, totals, checks, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillweave.functions import fixed, text as tx
from tillweave.operators import categories as cat, chunks as ch, headers, items as it, quality, totals
from tillweave.operators.receipts import extract_receipts, with_lines
from tillweave.plans.base_sql import DOC_CATEGORIES, documents
from tillweave.plans.render import rendered
from tillweave.plans.tables import PART_ORDER, PART_RULES, SEGMENT_RULES, table

RULES = {"item_rules": PART_RULES, "merchant_rules": [], "order": PART_ORDER}


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts extracted from the rendered documents, labelled by the part-name rules."""
    return extract_receipts(rendered(spark, sf_dir), keep=("o_orderkey",), **RULES)


def _fields(*exprs):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return receipts(spark, sf_dir).select("filename", *[e() for e in exprs])

    return run


def _d(column: str, alias: str | None = None):
    return lambda: F.col(column).cast("double").alias(alias or column)


def _c(column: str):
    return lambda: F.col(column)


def _day():
    return F.date_format("transaction_date", "yyyy-MM-dd").alias("transaction_day")


QUERIES, ORACLES = {}, {}


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# --- P: document cleaning and headers ----------------------------------------------------------


def p1_clean_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text"))
    return with_lines(docs).select(
        "doc_id", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("digest")
    )


register("p1_clean_lines", p1_clean_lines, r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM documents)
SELECT doc_id, CAST(len(lines) AS INTEGER) AS n_lines, md5(array_to_string(lines, chr(10))) AS digest FROM l""")

register("p2_merchant_name", _fields(_c("merchant_name")), documents("SELECT filename, merchant_name FROM base"))
register("p3_transaction_date", _fields(_day), documents("SELECT filename, day AS transaction_day FROM base"))
register("p4_payment_method", _fields(_c("payment_method")), documents("SELECT filename, payment_method FROM base"))
register("p5_card", _fields(_c("card_network"), _c("card_last4")), documents("""
SELECT filename, CASE WHEN ok AND seg = 'MACHINERY' THEN 'visa' WHEN ok AND seg = 'BUILDING' THEN 'amex' END AS card_network,
       CASE WHEN ok AND seg IN ('MACHINERY', 'BUILDING') THEN last4 END AS card_last4 FROM base"""))
register("p6_contact", _fields(*[_c(c) for c in ("merchant_phone", "merchant_address", "merchant_city", "merchant_state", "merchant_zip")]), documents("""
SELECT filename, '(555)-010-' || last4 AS merchant_phone, address AS merchant_address,
       CASE WHEN ok THEN 'Springfield' END AS merchant_city, CASE WHEN ok THEN 'CA' END AS merchant_state,
       CASE WHEN ok AND ck % 4 <> 0 THEN CAST(ck % 1000 + 90000 AS VARCHAR) END AS merchant_zip FROM base"""))
register("p7_staff", _fields(_c("cashier")), documents("SELECT filename, CASE WHEN ok THEN 'Clerk ' || nk END AS cashier FROM base"))
register("p8_references", _fields(_c("order_number"), _c("transaction_id"), _c("store_number")), documents("""
SELECT filename, CASE WHEN ok THEN CAST(k AS VARCHAR) END AS order_number, CASE WHEN ok THEN 'TX-' || k END AS transaction_id,
       CASE WHEN ok THEN CAST(nk AS VARCHAR) END AS store_number FROM base"""))
register("p9_warranty", _fields(_c("has_warranty"), _c("warranty_text")), documents("""
SELECT filename, has_warranty, CASE WHEN has_warranty THEN 'EXTENDED WARRANTY 2YR | 30 day warranty on parts' END AS warranty_text FROM base"""))
register("p10_returns", _fields(_c("return_transaction")), documents("SELECT filename, is_return AS return_transaction FROM base"))


def p11_nested_record(spark, sf_dir):
    r = receipts(spark, sf_dir)
    return r.select(
        "filename", F.length("receipt_id").alias("id_length"), "merchant_name_norm", _day(), "payment_method",
        F.col("total_amount").cast("double").alias("total_amount"), "item_count",
        F.array_join(F.transform("items", lambda i: i["name"]), ",").alias("item_names"),
        F.array_join("categories", ",").alias("categories"), F.array_join("parse_errors", ",").alias("parse_errors"),
    )


_ERRORS = "CASE dmg WHEN 0 THEN 'no date' WHEN 1 THEN 'no total' WHEN 2 THEN 'empty text,no date,no total' ELSE '' END"
register("p11_nested_record", p11_nested_record, documents(f"""
SELECT base.filename, 64 AS id_length, merchant_norm AS merchant_name_norm, day AS transaction_day, payment_method,
       CAST(total_amount AS DOUBLE) AS total_amount, CAST(CASE WHEN ok THEN n ELSE 0 END AS INTEGER) AS item_count,
       coalesce(names, '') AS item_names, coalesce({DOC_CATEGORIES}, '') AS categories, {_ERRORS} AS parse_errors
FROM base LEFT JOIN (SELECT k, string_agg(name, ',' ORDER BY pos) AS names FROM item GROUP BY 1) USING (k)
LEFT JOIN doc_labels USING (k)"""))


# --- I: line items -----------------------------------------------------------------------------


def _items(spark, sf_dir):
    return it.explode_items(receipts(spark, sf_dir), "filename", "o_orderkey")


def i1_item_lines(spark, sf_dir):
    """Lines left after the non-item filter."""
    df = with_lines(rendered(spark, sf_dir))
    kept = F.filter("rows", lambda r: it.is_item_candidate(r["low"]))
    return df.select("filename", F.size("lines").alias("n_lines"), F.size(kept).alias("n_kept"))


# Lines: merchant, address, place, phone, day, staff, order, id, store, ruler, amounts, tender, footer, thanks.
register("i1_item_lines", i1_item_lines, documents("""
SELECT filename,
  CAST(CASE WHEN NOT ok THEN 0 ELSE
    4 + (dmg <> 0)::INT + 5 + n * (CASE WHEN k % 3 = 2 THEN 3 ELSE 1 END) + 3 * raw_warranty::INT
    + CASE WHEN dmg = 1 THEN 0 ELSE 3 + (k % 7 = 0)::INT + (k % 11 = 0)::INT + (pri = '1-URGENT')::INT END + 3 END AS INTEGER) AS n_lines,
  CAST(CASE WHEN NOT ok THEN 0 ELSE
    3 + (dmg <> 0 AND k % 4 >= 2)::INT + 2 + n * (CASE WHEN k % 3 = 2 THEN 2 ELSE 1 END) + 3 * raw_warranty::INT
    + 1
  END AS INTEGER) AS n_kept
FROM base"""))


def i2_item_lines_parsed(spark, sf_dir):
    return _items(spark, sf_dir).select(
        "filename", "item_index", "name", F.col("total_price").cast("double").alias("total_price")
    )


register("i2_item_lines_parsed", i2_item_lines_parsed, documents("""
SELECT filename, CAST(pos AS INTEGER) AS item_index, name, CAST(price AS DOUBLE) AS total_price FROM item
UNION ALL SELECT filename, NULL, NULL, NULL FROM base WHERE NOT ok"""))


def i3_clean_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    messy = F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "   "), F.lit(" ("), F.col("p_size").cast("string"), F.lit(") "))
    return part.select("p_partkey", it.clean_name(messy).alias("clean_name"))


register("i3_clean_names", i3_clean_names, "SELECT p_partkey, p_name AS clean_name FROM part")


def i4_quantities(spark, sf_dir):
    df = _items(spark, sf_dir).filter(F.col("item_index").isNotNull())
    return df.select(
        "filename", "item_index", F.col("quantity").cast("bigint").alias("quantity"),
        (F.col("unit_price") * 1000000).cast("bigint").alias("unit_micros"),
    )


register("i4_quantities", i4_quantities, documents("""
SELECT filename, CAST(pos AS INTEGER) AS item_index, q AS quantity,
       CAST((2 * CAST(price * 100 AS BIGINT) * 10000 + q) // (2 * q) AS BIGINT) AS unit_micros FROM item"""))


def i5_wrapped_items(spark, sf_dir):
    """Items of line-by-line text, counted and summed per document."""
    lines = with_lines(rendered(spark, sf_dir)).select("filename", F.posexplode("lines").alias("line_no", "line"))
    rows = it.items_from_line_rows(lines, "filename", "line_no", "line")
    return rows.groupBy("filename").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("total_price").cast("double").alias("item_sum")
    )


register("i5_wrapped_items", i5_wrapped_items, documents("""
SELECT filename, count(*) AS n_items, CAST(sum(price) AS DOUBLE) AS item_sum FROM item GROUP BY 1"""))


def i6_rejected_items(spark, sf_dir):
    """Part lines with prices set to zero or names cut to one letter are refused."""
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_type") == "PROMO", F.left("p_name", F.lit(1))).otherwise(F.col("p_name"))
    price = F.when(F.col("p_type") == "SMALL", F.lit("0.00")).when(F.col("p_type") == "LARGE", F.lit("n/a")).otherwise(
        F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    )
    parsed = part.select("p_partkey", it.parse_line(F.concat(name, F.lit("   $ "), price)).alias("i"))
    return parsed.select("p_partkey", it.is_valid(F.col("i")).alias("accepted"))


register("i6_rejected_items", i6_rejected_items,
         "SELECT p_partkey, p_type NOT IN ('PROMO', 'SMALL', 'LARGE') AS accepted FROM part")


def i7_exploded_items(spark, sf_dir):
    return _items(spark, sf_dir).groupBy("filename").agg(
        F.count("item_index").alias("n_items"), F.max("item_index").alias("last_index")
    )


register("i7_exploded_items", i7_exploded_items, documents("""
SELECT filename, CASE WHEN ok THEN n ELSE 0 END AS n_items, CAST(CASE WHEN ok THEN n - 1 END AS INTEGER) AS last_index FROM base"""))


# --- K: categories -----------------------------------------------------------------------------


def k1_item_labels(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    labels = cat.categories(F.col("p_name"), None, PART_RULES, [], PART_ORDER)
    return part.select("p_partkey", F.array_join(labels, ",").alias("labels"))


register("k1_item_labels", k1_item_labels, """
SELECT p_partkey, coalesce(nullif(array_to_string(([
  CASE WHEN p_name LIKE '%ring%' OR p_name LIKE '%bolt%' THEN 'hardware' END,
  CASE WHEN p_name LIKE '%widget%' OR p_name LIKE '%gizmo%' THEN 'gadget' END,
  CASE WHEN p_name LIKE '%anvil%' OR p_name LIKE '%ring%' THEN 'metal' END]), ','), ''), 'other') AS labels
FROM part""")


def k1_label_table(spark, sf_dir):
    """The same labels from a rule table by a hash join on keyword words."""
    part = table(spark, sf_dir, "part")
    rules = part.sparkSession.createDataFrame(
        [(c, w) for c, ws in PART_RULES for w in ws], "category string, keyword string"
    )
    return cat.categorise_by_table(part.select("p_partkey", "p_name"), "p_name", rules).select(
        "p_partkey", F.array_join("categories", ",").alias("labels")
    )


register("k1_label_table", k1_label_table, """
SELECT p_partkey, coalesce(nullif(array_to_string(([
  CASE WHEN p_name LIKE '%widget%' OR p_name LIKE '%gizmo%' THEN 'gadget' END,
  CASE WHEN p_name LIKE '%ring%' OR p_name LIKE '%bolt%' THEN 'hardware' END,
  CASE WHEN p_name LIKE '%anvil%' OR p_name LIKE '%ring%' THEN 'metal' END]), ','), ''), 'other') AS labels
FROM part""")


def k1_rule_table(spark, sf_dir):
    """A rule table with substrings and a declared order means what the expression means."""
    part = table(spark, sf_dir, "part")
    ranked = [(c, w, PART_ORDER.index(c)) for c, ws in PART_RULES for w in ws] + [("round", "o", 5), ("round", "ri", 5), ("none", "zzz", 6)]
    rules = part.sparkSession.createDataFrame(ranked, "category string, keyword string, rank int")
    return cat.categorise_by_table(part.select("p_partkey", "p_name"), "p_name", rules).select(
        "p_partkey", F.array_join("categories", ",").alias("labels")
    )


register("k1_rule_table", k1_rule_table, """
SELECT p_partkey, coalesce(nullif(array_to_string(([
  CASE WHEN p_name LIKE '%ring%' OR p_name LIKE '%bolt%' THEN 'hardware' END,
  CASE WHEN p_name LIKE '%widget%' OR p_name LIKE '%gizmo%' THEN 'gadget' END,
  CASE WHEN p_name LIKE '%anvil%' OR p_name LIKE '%ring%' THEN 'metal' END,
  CASE WHEN p_name LIKE '%o%' OR p_name LIKE '%ri%' THEN 'round' END]), ','), ''), 'other') AS labels
FROM part""")


def k2_merchant_labels(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    parents = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    df = lines.join(parents, F.col("l_orderkey") == F.col("o_orderkey"))
    labels = cat.categories(
        F.col("p_name"), F.col("c_mktsegment"), PART_RULES, SEGMENT_RULES, PART_ORDER + ["home", "industry"]
    )
    return df.groupBy(F.array_join(labels, ",").alias("labels")).agg(F.count(F.lit(1)).alias("n"))


register("k2_merchant_labels", k2_merchant_labels, """
SELECT coalesce(nullif(array_to_string(([
  CASE WHEN p_name LIKE '%ring%' OR p_name LIKE '%bolt%' THEN 'hardware' END,
  CASE WHEN p_name LIKE '%widget%' OR p_name LIKE '%gizmo%' THEN 'gadget' END,
  CASE WHEN p_name LIKE '%anvil%' OR p_name LIKE '%ring%' THEN 'metal' END,
  CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'home' END,
  CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'industry' END]), ','), ''), 'other') AS labels,
  count(*) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1""")


def k3_primary_label(spark, sf_dir):
    labels = cat.categories(F.col("p_name"), None, PART_RULES, [], ["metal", "hardware"])
    return table(spark, sf_dir, "part").select("p_partkey", F.get(labels, F.lit(0)).alias("category"))


register("k3_primary_label", k3_primary_label, """
SELECT p_partkey, CASE WHEN p_name LIKE '%anvil%' OR p_name LIKE '%ring%' THEN 'metal' WHEN p_name LIKE '%bolt%' THEN 'hardware'
  ELSE 'other' END AS category FROM part""")


def k4_receipt_labels(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    labelled = lines.select("l_orderkey", cat.categories(F.col("p_name"), None, PART_RULES, [], PART_ORDER).alias("labels"))
    return cat.categories_per_receipt(labelled, "l_orderkey", "labels", sorted(PART_ORDER) + ["other"]).select(
        "l_orderkey", "item_count", F.array_join("categories", ",").alias("categories")
    )


register("k4_receipt_labels", k4_receipt_labels, documents("""
SELECT l_orderkey, any_value(c) AS item_count, string_agg(DISTINCT label, ',' ORDER BY label) AS categories
FROM (SELECT l_orderkey, count(*) OVER (PARTITION BY l_orderkey) AS c, unnest(string_split(labels, ',')) AS label FROM li) GROUP BY 1"""))


# --- M: totals and checks ----------------------------------------------------------------------


def m1_line_amounts(spark, sf_dir):
    """The order total written in four ways and read back."""
    orders = table(spark, sf_dir, "orders")
    money = F.col("o_totalprice").cast(tx.MONEY)
    style = (F.col("o_orderkey") % 4).cast("int")
    line = (
        F.when(style == 0, F.concat(F.lit("TOTAL $"), money.cast("string")))
        .when(style == 1, F.concat(F.lit("TOTAL:   $ "), money.cast("string"), F.lit("  ")))
        .when(style == 2, F.concat(F.lit("Tax $1.00 TOTAL $"), F.format_number(money, 2)))
        .otherwise(F.concat(F.lit("Total: -$"), money.cast("string")))
    )
    return orders.select("o_orderkey", tx.amount(line).cast("double").alias("amount"))


register("m1_line_amounts", m1_line_amounts, """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN -1 ELSE 1 END * CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS amount FROM orders""")

register("m2_totals", _fields(*[_d(c) for c in totals.FIELDS]), documents("""
SELECT filename, CAST(subtotal AS DOUBLE) AS subtotal, CAST(tax_amount AS DOUBLE) AS tax_amount, CAST(tip_amount AS DOUBLE) AS tip_amount,
  CAST(delivery_fee AS DOUBLE) AS delivery_fee, CAST(total_amount AS DOUBLE) AS total_amount, CAST(discounts AS DOUBLE) AS discounts FROM base"""))


def m2_totals_by_line(spark, sf_dir):
    lines = with_lines(rendered(spark, sf_dir)).select("filename", F.posexplode("lines").alias("line_no", "line"))
    return totals.totals_from_line_rows(lines, "filename", "line_no", "line").select(
        "filename", *[F.col(c).cast("double").alias(c) for c in totals.FIELDS]
    )


register("m2_totals_by_line", m2_totals_by_line, documents("""
SELECT filename, CAST(subtotal AS DOUBLE) AS subtotal, CAST(tax_amount AS DOUBLE) AS tax_amount, CAST(tip_amount AS DOUBLE) AS tip_amount,
  CAST(delivery_fee AS DOUBLE) AS delivery_fee, CAST(total_amount AS DOUBLE) AS total_amount, CAST(discounts AS DOUBLE) AS discounts
FROM base WHERE total_amount IS NOT NULL"""))


def m3_total_check(spark, sf_dir):
    return quality.check_totals(receipts(spark, sf_dir)).select(
        "filename", F.col("expected_total").cast("double").alias("expected_total"), "total_mismatch"
    )


register("m3_total_check", m3_total_check, documents("""
, e AS (SELECT *, coalesce(subtotal, 0) + coalesce(tax_amount, 0) + coalesce(tip_amount, 0) + coalesce(delivery_fee, 0) - coalesce(discounts, 0) AS expected FROM base)
SELECT filename, CAST(expected AS DOUBLE) AS expected_total, abs(coalesce(total_amount, 0) - expected) > 1.00 AS total_mismatch FROM e"""))


def m4_item_sum_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("receipt_id"), F.col("o_totalprice").alias("subtotal"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("receipt_id"), F.col("l_extendedprice").alias("total_price"))
    return quality.check_item_sum(orders, lines).select(
        "receipt_id", F.col("item_sum").cast("double").alias("item_sum"), "item_sum_mismatch"
    )


register("m4_item_sum_check", m4_item_sum_check, """
WITH s AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS item_sum FROM lineitem GROUP BY 1)
SELECT o_orderkey AS receipt_id, CAST(item_sum AS DOUBLE) AS item_sum,
  abs(coalesce(item_sum, 0) - CAST(o_totalprice AS DECIMAL(12,2))) > 5.00 AS item_sum_mismatch
FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")


def m4_item_sum_check_nested(spark, sf_dir):
    return quality.check_item_sum_nested(receipts(spark, sf_dir)).select(
        "filename", F.col("item_sum").cast("double").alias("item_sum"), "item_sum_mismatch"
    )


register("m4_item_sum_check_nested", m4_item_sum_check_nested, documents("""
SELECT filename, CAST(CASE WHEN ok THEN raw_subtotal ELSE 0 END AS DOUBLE) AS item_sum,
  CASE WHEN dmg = 1 THEN raw_subtotal > 5 ELSE false END AS item_sum_mismatch FROM base"""))


def m5_density(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("role").alias("origin"), F.col("text"))
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("origin"), F.col("text"))
    return quality.density_report(docs.unionByName(turns), "text", "origin")


register("m5_density", m5_density, r"""
WITH a AS (SELECT lang AS origin, text FROM documents UNION ALL SELECT role, text FROM conversations),
d AS (SELECT origin, coalesce(length(regexp_replace(text, '^\s+|\s+$', '', 'g')), 0) >= 10 AS dense FROM a)
SELECT origin, count(*) FILTER (dense) AS accepted, count(*) FILTER (NOT dense) AS rejected FROM d GROUP BY 1""")


def m6_bounds(spark, sf_dir):
    return quality.violations(
        table(spark, sf_dir, "lineitem"),
        {
            "discount_outside_0_to_1": quality.outside_range(F.col("l_discount"), 0, 1),
            "discount_above_5_percent": quality.outside_range(F.col("l_discount"), 0, 0.05),
            "negative_quantity": quality.outside_range(F.col("l_quantity"), 0, None),
            "unknown_return_flag": quality.outside_domain(F.col("l_returnflag"), ["A", "N"]),
        },
    )


register("m6_bounds", m6_bounds, """
SELECT unnest(['discount_outside_0_to_1', 'discount_above_5_percent', 'negative_quantity', 'unknown_return_flag']) AS "check",
  unnest([count(*) FILTER (l_discount < 0 OR l_discount > 1), count(*) FILTER (l_discount < 0 OR l_discount > 0.05),
          count(*) FILTER (l_quantity < 0), count(*) FILTER (l_returnflag NOT IN ('A', 'N'))]) AS violations FROM lineitem""")


def m7_context_integrity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.context_integrity(docs, ["text", "lang", "quality"], "source").select(
        "source", F.round("integrity", 6).alias("integrity"), "row_count"
    )


register("m7_context_integrity", m7_context_integrity, """
SELECT source, round(avg(CASE WHEN text IS NOT NULL AND lang IS NOT NULL AND quality IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS integrity,
  count(*) AS row_count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")


# --- CH: chunk views ---------------------------------------------------------------------------


def ch1_shared_columns(spark, sf_dir):
    df = ch.with_base(table(spark, sf_dir, "orders"), "o_orderdate")
    return df.select(
        "o_orderkey", "transaction_ts", "transaction_year", "transaction_month", "transaction_day", "transaction_weekday"
    )


register("ch1_shared_columns", ch1_shared_columns, """
SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS transaction_ts, CAST(year(o_orderdate) AS INTEGER) AS transaction_year,
  CAST(month(o_orderdate) AS INTEGER) AS transaction_month, CAST(day(o_orderdate) AS INTEGER) AS transaction_day,
  CAST(isodow(o_orderdate) - 1 AS INTEGER) AS transaction_weekday FROM orders""")


def ch2_absent_fields(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select("doc_id", ch.metadata_json(["doc_id", "lang", "quality", "toxic"]).alias("metadata"))


register("ch2_absent_fields", ch2_absent_fields, """
SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '"' || coalesce(',"quality":' || quality, '')
  || coalesce(',"toxic":' || toxic, '') || '}' AS metadata FROM documents LEFT JOIN labels USING (doc_id)""")


def _view(name: str):
    def run(spark, sf_dir):
        return ch.chunk_receipts(receipts(spark, sf_dir), [name])

    return run


def ch3_summaries(spark, sf_dir):
    return _view("receipt_summary")(spark, sf_dir).select(
        "filename", "content", "item_count", "has_tip", "has_discounts", "has_delivery_fee", "has_warranty"
    )


_DAY = "coalesce(day, 'unknown')"
register("ch3_summaries", ch3_summaries, documents("""
, top AS (SELECT k, string_agg(name, ', ' ORDER BY pos) FILTER (pos < 5) || CASE WHEN count(*) > 5 THEN ', plus ' || (count(*) - 5) || ' others' ELSE '' END AS names
          FROM item GROUP BY 1)
SELECT filename, 'Receipt from ' || merchant_name || coalesce('. Date: ' || day || ' 00:00', '')
  || '. Subtotal: $' || coalesce(subtotal, 0)::DECIMAL(22,2) || '. Tax: $' || coalesce(tax_amount, 0)::DECIMAL(22,2)
  || '. Total amount: $' || coalesce(total_amount, 0)::DECIMAL(22,2) || '. Payment method: ' || payment_method
  || '. Number of items: ' || (CASE WHEN ok THEN n ELSE 0 END)
  || coalesce('. Discounts: $' || discounts, '') || coalesce('. Tip: $' || tip_amount, '') || coalesce('. Delivery fee: $' || delivery_fee, '')
  || CASE WHEN has_warranty THEN '. Warranty info: EXTENDED WARRANTY 2YR | 30 day warranty on parts' ELSE '' END
  || CASE WHEN is_return THEN '. Return transaction' ELSE '' END || coalesce('. Top items: ' || names, '') AS content,
  CAST(CASE WHEN ok THEN n ELSE 0 END AS INTEGER) AS item_count, tip_amount IS NOT NULL AS has_tip, discounts IS NOT NULL AS has_discounts,
  delivery_fee IS NOT NULL AS has_delivery_fee, has_warranty FROM base LEFT JOIN top USING (k)"""))


def ch4_items(spark, sf_dir):
    return _view("item_detail")(spark, sf_dir).select(
        "filename", "item_index", "content", "item_category", F.array_join("item_categories", ",").alias("item_categories")
    )


register("ch4_items", ch4_items, documents(f"""
SELECT filename, CAST(pos AS INTEGER) AS item_index, 'Item: ' || name || '. Price: $' || price || '. Qty: ' || q || '. Categories: '
  || replace(labels, ',', ', ') || '. Store: ' || merchant_name || '. Date: ' || {_DAY} || '.' AS content,
  string_split(labels, ',')[1] AS item_category, labels AS item_categories FROM item"""))


def ch5_category_groups(spark, sf_dir):
    return _view("category_group")(spark, sf_dir).select(
        "filename", "category", "item_count", F.col("group_total").cast("double").alias("group_total"), "content"
    )


_GROUPS = """
SELECT filename, label AS category, CAST(count(*) AS INTEGER) AS item_count, CAST(sum(price) AS DOUBLE) AS group_total,
  'Category: ' || label || '. Total: $' || sum(price)::DECIMAL(22,2) || '. Items (' || count(*) || '): '
  || string_agg(name, ', ' ORDER BY pos) || '. Store: ' || any_value(merchant_name) || '.' AS content
FROM label_rows GROUP BY 1, 2 HAVING count(*) > 1"""
register("ch5_category_groups", ch5_category_groups, documents(_GROUPS))


def ch5_category_groups_flat(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    labelled = lines.withColumn("labels", F.array("p_type"))
    return ch.category_groups_flat(labelled, "l_orderkey", "labels", "l_extendedprice").withColumn(
        "group_total", F.col("group_total").cast("double")
    )


register("ch5_category_groups_flat", ch5_category_groups_flat, """
SELECT l_orderkey, p_type AS category, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS group_total, count(*) AS item_count
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(*) > 1""")


def ch6_merchant_views(spark, sf_dir):
    return _view("merchant_info")(spark, sf_dir).select("filename", "content", "has_address", "has_phone")


register("ch6_merchant_views", ch6_merchant_views, documents("""
SELECT filename, 'Merchant: ' || merchant_name || '. Location: ' || coalesce(address, 'Unknown Address')
  || '. Total visits: 1. Last total: $' || coalesce(total_amount, 0)::DECIMAL(22,2) AS content, ok AS has_address, ok AS has_phone FROM base"""))


def ch7_payment_views(spark, sf_dir):
    return _view("payment_method")(spark, sf_dir).select("filename", "content", "has_tip", "has_discounts")


register("ch7_payment_views", ch7_payment_views, documents(f"""
SELECT filename, 'Payment: ' || payment_method || '. Store: ' || merchant_name || '. Total: $' || coalesce(total_amount, 0)::DECIMAL(22,2)
  || '. Date: ' || {_DAY} || '.' AS content, tip_amount IS NOT NULL AS has_tip, discounts IS NOT NULL AS has_discounts FROM base"""))


def ch8_all_views(spark, sf_dir):
    """Every chunk, reduced to its key columns and a digest of its text."""
    return ch.chunk_receipts(receipts(spark, sf_dir)).select(
        "filename", "chunk_type", F.md5("content").alias("digest"), F.length("chunk_id").alias("id_length")
    )


register("ch8_all_views", ch8_all_views, documents("""
, c AS (
  SELECT filename, 'receipt_summary' AS chunk_type, content FROM ({ch3})
  UNION ALL SELECT filename, 'item_detail', content FROM ({ch4})
  UNION ALL SELECT filename, 'category_group', content FROM ({ch5})
  UNION ALL SELECT filename, 'merchant_info', content FROM ({ch6})
  UNION ALL SELECT filename, 'payment_method', content FROM ({ch7}))
SELECT filename, chunk_type, md5(content) AS digest, 64 AS id_length FROM c""").replace("{ch3}", ORACLES["ch3_summaries"]).replace(
    "{ch4}", ORACLES["ch4_items"]).replace("{ch5}", ORACLES["ch5_category_groups"]).replace(
    "{ch6}", ORACLES["ch6_merchant_views"]).replace("{ch7}", ORACLES["ch7_payment_views"]))


def ch9_truncated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.md5(ch.truncate(F.col("text"))).alias("limited"), F.md5(ch.stored_content(F.col("text"))).alias("stored")
    )


register("ch9_truncated", ch9_truncated, f"""
SELECT doc_id, md5(CASE WHEN length(text) > {fixed.CONTENT_LIMIT} THEN substr(text, 1, {fixed.CONTENT_LIMIT}) || '... [TRUNCATED]' ELSE text END) AS limited,
  md5(substr(text, 1, {fixed.STORED_CONTENT_LIMIT})) AS stored FROM documents""")


def ch10_statistics(spark, sf_dir):
    stats = ch.chunk_statistics(ch.chunk_receipts(receipts(spark, sf_dir)))
    return stats.withColumn("average_chunks_per_receipt", F.round("average_chunks_per_receipt", 6))


register("ch10_statistics", ch10_statistics, """
WITH c AS ({ch8}), t AS (SELECT count(*) FILTER (chunk_type = 'receipt_summary') AS r, count(*) AS n FROM c)
SELECT chunk_type, count(*) AS chunks, any_value(t.r) AS total_receipts, any_value(t.n) AS total_chunks,
  round(any_value(t.n) / any_value(t.r), 6) AS average_chunks_per_receipt FROM c, t GROUP BY 1""".replace("{ch8}", ORACLES["ch8_all_views"]))
