"""Registered queries over questions: parameters, merchants and time phrases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillweave.functions import fixed, text as tx
from tillweave.operators import merchants as me, questions as qp, temporal as tr
from tillweave.plans import asked
from tillweave.plans.tables import plain_merchant, table

QUERIES, ORACLES = {}, {}


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _q(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _by_template(values: list, key: str = "o_orderkey") -> str:
    """The known outcome of each template, picked by key."""
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {whens} END"


def _turn(sql: str) -> str:
    """Conversation turns, evaluated by rule in SQL."""
    return f"SELECT -1 - (conv_id * 100000 + turn) AS question_id, {sql} FROM conversations"


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(w)})" for w in words) + ")"


def _rx(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {_q(p)})" for p in patterns) + ")"


def _pool(make: Callable[[Column], list[Column]]):
    """A query over all questions; the columns are built from the text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return asked.question_pool(spark, sf_dir).select("question_id", *make(F.col("text")))

    return run


# --- QP ----------------------------------------------------------------------------------------

_INTENTS = [
    "temporal", "temporal", "temporal", "merchant", "merchant", "aggregation", "category", "general", "amount", "category",
    "item_specific", "item_specific", "aggregation", "aggregation", "general", "amount", "general", "general", "aggregation", "general",
]
_METRICS = [
    "total_amount", None, None, None, "total_amount", "total_amount", None, None, None, None,
    None, None, "tip_amount", None, None, "tax_amount", None, None, None, None,
]
_AGGS = [
    "sum", "sum", None, "sum", "sum", "sum", None, None, None, "sum",
    None, None, "average", "count", "count", None, None, None, None, None,
]
_CATS = ["", "", "", "", "coffee_shop,fast_food", "restaurant,fast_food", "electronics", "pharmacy", "", "groceries",
         "", "", "", "", "", "", "", "pharmacy", "", ""]
_BASES = [
    "receipts", "receipts", "items", "receipts", "items", "items", "items", "items", "receipts", "items",
    "items", "items", "receipts", "receipts", "receipts", "receipts", "items", "items", "receipts", "receipts",
]
_L = "lower(text)"
_INTENT_SQL = "CASE " + " ".join(f"WHEN {_rx(_L, p)} THEN {_q(n)}" for n, p in fixed.INTENT_RULES) + " ELSE 'general' END"
_METRIC_SQL = (
    f"CASE WHEN contains({_L}, 'tax') THEN 'tax_amount' WHEN contains({_L}, 'tip') THEN 'tip_amount' "
    f"WHEN {_rx(_L, fixed.METRIC_WORDS)} THEN 'total_amount' END"
)
_AGG_SQL = "CASE " + " ".join(f"WHEN {_rx(_L, p)} THEN {_q(n)}" for n, p in fixed.AGGREGATION_RULES) + " END"
# Fast food follows coffee shops or restaurants, whichever is named first in the rules.
_COFFEE, _DINING = _any(_L, ["coffee shop"]), _any(_L, ["restaurant"])
_CAT_SQL = (
    "coalesce(array_to_string([" + f"CASE WHEN {_COFFEE} THEN 'coffee_shop,fast_food' END, "
    f"CASE WHEN {_DINING} THEN 'restaurant' END, CASE WHEN {_DINING} AND NOT {_COFFEE} THEN 'fast_food' END, "
    + ", ".join(f"CASE WHEN {_any(_L, w)} THEN {_q(l[0])} END" for w, l in fixed.QUESTION_CATEGORIES[2:]) + "], ','), '')"
)


def _pool_sql(name: str, known: list, turn_sql: str) -> str:
    return f"SELECT o_orderkey AS question_id, {_by_template([_q(k) for k in known])} AS {name} FROM orders UNION ALL " + _turn(
        f"{turn_sql} AS {name}"
    )


register("qp1_intent", _pool(lambda t: [qp.intent(t).alias("query_type")]), _pool_sql("query_type", _INTENTS, _INTENT_SQL))
register("qp2_metric", _pool(lambda t: [qp.metric(t).alias("metric")]), _pool_sql("metric", _METRICS, _METRIC_SQL))
register("qp3_categories", _pool(lambda t: [F.array_join(qp.categories(t), ",").alias("categories")]),
         _pool_sql("categories", _CATS, _CAT_SQL))


_PAY = [None] * 20
_PAY[13], _PAY[14], _PAY[18] = "credit", "apple_pay", "credit"
_NET = [None] * 20
_NET[13] = "visa"
_PAY_SQL = "CASE " + " ".join(f"WHEN contains({_L}, {_q(w)}) THEN {_q(l)}" for w, l in reversed(fixed.QUESTION_PAYMENTS)) + (
    f" WHEN {_any(_L, fixed.CARD_NETWORKS)} THEN 'credit' END"
)
_NET_SQL = "CASE " + " ".join(f"WHEN contains({_L}, {_q(n)}) THEN {_q(n)}" for n in reversed(fixed.CARD_NETWORKS)) + " END"
register(
    "qp4_payment",
    _pool(lambda t: [qp.payment_method(t).alias("payment_method"), qp.card_network(t).alias("card_network")]),
    f"SELECT o_orderkey AS question_id, {_by_template([_q(v) for v in _PAY])} AS payment_method, "
    f"{_by_template([_q(v) for v in _NET])} AS card_network FROM orders UNION ALL "
    + _turn(f"{_PAY_SQL} AS payment_method, {_NET_SQL} AS card_network"),
)

_FLAGGED = {"has_warranty": [10], "is_return": [13], "has_discounts": [18], "has_delivery_fee": [18], "has_tip": [12]}
register(
    "qp5_flags",
    _pool(lambda t: [c.alias(n) for n, c in qp.flags(t).items()]),
    "SELECT o_orderkey AS question_id, "
    + ", ".join(f"o_orderkey % 20 IN ({', '.join(map(str, k))}) AS {n}" for n, k in _FLAGGED.items())
    + " FROM orders UNION ALL "
    + _turn(", ".join(f"{_rx(_L, [p])} AS {n}" for n, p in fixed.FEATURE_WORDS)),
)

_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE)"
_LOW, _HIGH = ["NULL"] * 20, ["NULL"] * 20
_LOW[9], _LOW[15], _HIGH[8], _HIGH[15] = _PRICE, "10.0", _PRICE, _PRICE
_LAST = r"""list_extract(regexp_extract_all(text, '\$(\d[\d,]*(?:\.\d{2})?)', 1), -1)"""
_AT_LEAST, _AT_MOST = _any(_L, fixed.LOWER_BOUND_WORDS), _any(_L, fixed.UPPER_BOUND_WORDS)


def _bounds(t: Column) -> list[Column]:
    b = qp.amount_bounds(t)
    return [b[c].cast("double").alias(c) for c in ("min_amount", "max_amount")]


register(
    "qp6_amounts",
    _pool(_bounds),
    f"SELECT o_orderkey AS question_id, CAST({_by_template(_LOW)} AS DOUBLE) AS min_amount, CAST({_by_template(_HIGH)} AS DOUBLE) AS max_amount "
    "FROM orders UNION ALL "
    + _turn(
        f"TRY_CAST(replace(CASE WHEN {_AT_LEAST} THEN {_LAST} END, ',', '') AS DOUBLE) AS min_amount, "
        f"TRY_CAST(replace(CASE WHEN NOT {_AT_LEAST} AND {_AT_MOST} THEN {_LAST} END, ',', '') AS DOUBLE) AS max_amount"
    ),
)

_TERMS = dict(fixed.SEMANTIC_TERMS)
_EXPANDED = [""] * 20
for _i, _concepts in {
    4: ["coffee shops"], 5: ["restaurants"], 7: ["health related"], 16: ["treats"], 17: ["health related"],
}.items():
    _EXPANDED[_i] = ",".join(w for c in _concepts for w in _TERMS[c])
_TERM_SQL = "coalesce(array_to_string([" + ", ".join(
    f"CASE WHEN {_any(_L, [c] + ws)} THEN {_q(','.join(ws))} END" for c, ws in fixed.SEMANTIC_TERMS
) + "], ','), '')"
register("qp7_semantic_terms", _pool(lambda t: [F.array_join(qp.semantic_terms(t), ",").alias("semantic_terms")]),
         _pool_sql("semantic_terms", _EXPANDED, _TERM_SQL))
register("qp8_aggregation", _pool(lambda t: [qp.aggregation(t).alias("aggregation")]), _pool_sql("aggregation", _AGGS, _AGG_SQL))


def _basis(t: Column) -> list[Column]:
    return [qp.sum_basis(t, qp.metric(t), qp.intent(t), qp.categories(t)).alias("sum_basis")]


_BASIS_SQL = (
    f"CASE WHEN contains({_L}, 'tax') OR contains({_L}, 'tip') THEN 'receipts' "
    f"WHEN {_INTENT_SQL} IN ('category', 'item_specific') OR {_CAT_SQL} <> '' OR {_any(_L, fixed.ITEM_BASIS_WORDS)} THEN 'items' ELSE 'receipts' END"
)
register("qp9_sum_basis", _pool(_basis), _pool_sql("sum_basis", _BASES, _BASIS_SQL))


def qp10_parameters(spark, sf_dir):
    """All parameters of every templated question in one row, with its dates and merchants."""
    asked_ = asked.order_questions(spark, sf_dir, asked.INTENT_TEMPLATES)
    params = qp.parse_questions(asked_)
    return params.select(
        "question_id", "query_type", "metric", "aggregation", "sum_basis", "payment_method", "card_network",
        F.array_join("categories", ",").alias("categories"), F.array_join("merchants", ",").alias("merchants"),
        F.date_format("start_ts", "yyyy-MM-dd").alias("start_day"), F.date_format("end_ts", "yyyy-MM-dd").alias("end_day"),
        "month_of_year",
    )


# A question that names no category is filtered by that of its concept.
_FILTER_CATS = [*_CATS[:16], "treats", *_CATS[17:]]
_NAMED = [""] * 20
_NAMED[3] = "Austin"
_D = "CAST(o_orderdate AS DATE)"
_START = ["NULL"] * 20
_END = ["NULL"] * 20
_START[0], _END[0] = "DATE '2000-01-01'", "DATE '2000-02-01'"
_END[1] = f"make_date(year({_D}) + 1, 1, 1)"
_START[2], _END[2] = f"date_trunc('week', {_D})::DATE - 7", f"date_trunc('week', {_D})::DATE"
register("qp10_parameters", qp10_parameters, "SELECT o_orderkey AS question_id, " + ", ".join(
    f"{_by_template([_q(x) for x in v])} AS {n}" for n, v in {
        "query_type": _INTENTS, "metric": _METRICS, "aggregation": _AGGS, "sum_basis": _BASES, "payment_method": _PAY,
        "card_network": _NET, "categories": _FILTER_CATS, "merchants": _NAMED,
    }.items()
) + f", strftime(CAST({_by_template(_START)} AS DATE), '%Y-%m-%d') AS start_day, strftime(CAST({_by_template(_END)} AS DATE), '%Y-%m-%d') AS end_day, "
    "CAST(CASE WHEN o_orderkey % 20 = 1 THEN 12 END AS INTEGER) AS month_of_year FROM orders")


# --- ME ----------------------------------------------------------------------------------------


def me1_normal_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.concat(plain_merchant(), F.lit("  Inc. Shop")).alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.lit(-1) - F.col("s_suppkey"), F.concat("s_name", F.lit(" & Co Pharmacy")))
    return c.union(s).select("key", me.normalise(F.col("name")).alias("name_norm"))


register("me1_normal_names", me1_normal_names, """
SELECT c_custkey AS key, replace(lower(c_name), '#', ' ') || CASE WHEN c_custkey % 3 = 0 THEN ' store' ELSE '' END || ' inc' AS name_norm FROM customer
UNION ALL SELECT -1 - s_suppkey, replace(lower(s_name), '#', '') || ' co' FROM supplier""")


def _sentences(spark, sf_dir) -> DataFrame:
    """Sentences that name customers after prepositions, in lists, and not at all."""
    c = table(spark, sf_dir, "customer")
    who = F.translate("c_name", "#", " ")
    kind = (F.col("c_custkey") % 5).cast("int")
    text = (
        F.when(kind == 0, F.concat(F.lit("Total spent at "), who, F.lit(" in Springfield last month.")))
        .when(kind == 1, F.concat(F.lit("Ordered from "), who, F.lit(", visited Target and paid in cash!")))
        .when(kind == 2, F.concat(who, F.lit(" and Walmart or Costco, please")))
        .when(kind == 3, F.lit("How much in December 2023 at Restaurant?"))
        .otherwise(F.lit("nothing was named here"))
    )
    return c.select(F.col("c_custkey").alias("question_id"), text.alias("text"))


def me2_after_prepositions(spark, sf_dir):
    return _sentences(spark, sf_dir).select("question_id", F.array_join(me.by_preposition(F.col("text")), "|").alias("names"))


_WHO = "replace(c_name, '#', ' ')"
register("me2_after_prepositions", me2_after_prepositions, f"""
SELECT c_custkey AS question_id, CASE c_custkey % 5 WHEN 0 THEN {_WHO} || '|Springfield|' || {_WHO} WHEN 1 THEN {_WHO} || '|Target and paid'
  WHEN 3 THEN 'Restaurant|December 2023 at Restaurant' ELSE '' END AS names FROM customer""")


def me3_tokens(spark, sf_dir):
    return _sentences(spark, sf_dir).select("question_id", F.array_join(me.tokens(F.col("text")), "|").alias("tokens"))


register("me3_tokens", me3_tokens, """
SELECT c_custkey AS question_id, CASE c_custkey % 5 WHEN 0 THEN 'Total|Customer|Springfield' WHEN 1 THEN 'Ordered|Customer|Target'
  WHEN 2 THEN 'Customer|Walmart|Costco' WHEN 3 THEN 'How|December|Restaurant' ELSE '' END AS tokens FROM customer""")


def typed_names(spark, sf_dir) -> DataFrame:
    """Part names with one letter left out and the key of the part."""
    part = table(spark, sf_dir, "part")
    at = (F.col("p_partkey") % F.length("p_name")).cast("int")
    return part.select("p_partkey", "p_name", F.overlay("p_name", F.lit(""), at + 1, 1).alias("typed"))


def me4_fuzzy_match(spark, sf_dir):
    typed = typed_names(spark, sf_dir)
    corpus = me.known_names(table(spark, sf_dir, "part"), "p_name")
    best = me.best_matches(typed, corpus, "typed", "edit")
    joined = typed.withColumn("token_norm", me.normalise(F.col("typed"))).join(best, "token_norm", "left")
    return joined.select("p_partkey", F.col("name").alias("matched"), F.round("score", 6).alias("score"))


register("me4_fuzzy_match", me4_fuzzy_match, r"""
WITH t AS (SELECT p_partkey, trim(regexp_replace(substr(p_name, 1, p_partkey % length(p_name)) || substr(p_name, p_partkey % length(p_name) + 2), '\s+', ' ', 'g')) AS typed FROM part),
n AS (SELECT DISTINCT p_name AS name FROM part),
s AS (SELECT typed, name, CASE WHEN contains(name, typed) OR contains(typed, name) THEN greatest(0.9, 1.0 - levenshtein(typed, name) / greatest(length(typed), length(name)))
        ELSE 1.0 - levenshtein(typed, name) / greatest(length(typed), length(name)) END AS score FROM (SELECT DISTINCT typed FROM t), n),
b AS (SELECT typed, name, score, row_number() OVER (PARTITION BY typed ORDER BY score DESC, name) AS r FROM s WHERE score >= 0.75 - 1e-12)
SELECT p_partkey, b.name AS matched, round(CAST(b.score AS DOUBLE), 6) AS score FROM t LEFT JOIN b ON t.typed = b.typed AND r = 1""")


def me4_block_match(spark, sf_dir):
    """The same with the matching-block ratio."""
    typed = typed_names(spark, sf_dir)
    best = me.best_matches(typed, me.known_names(table(spark, sf_dir, "part"), "p_name"), "typed", "blocks")
    joined = typed.withColumn("token_norm", me.normalise(F.col("typed"))).join(best, "token_norm", "left")
    return joined.select("p_partkey", F.col("name").alias("matched"), F.round("score", 6).alias("score"))


# The longest common part of two strings, the first one in a and then in b; then the same left and right of it.
# Pairs with more edits than a quarter of their letters are out of reach.
_BLOCK = """list_max(flatten([[{'l': list_max([l FOR l IN range(0, least(length(a) - i, length(b) - j) + 2) IF substr(a, i, l) = substr(b, j, l)]),
  'i': -i, 'j': -j} FOR j IN range(1, length(b) + 1)] FOR i IN range(1, length(a) + 1)]))"""
register("me4_block_match", me4_block_match, rf"""
WITH RECURSIVE t AS (SELECT p_partkey, trim(regexp_replace(substr(p_name, 1, p_partkey % length(p_name)) || substr(p_name, p_partkey % length(p_name) + 2), '\s+', ' ', 'g')) AS typed FROM part),
n AS (SELECT DISTINCT p_name AS name FROM part),
p AS (SELECT typed, name FROM (SELECT DISTINCT typed FROM t), n WHERE levenshtein(typed, name) <= (length(typed) + length(name)) / 4.0 OR contains(name, typed) OR contains(typed, name)),
m AS (SELECT typed, name, 0 AS depth, 0::BIGINT AS l, typed AS a, name AS b FROM p
  UNION ALL SELECT typed, name, depth + 1, k.l, piece.a, piece.b FROM (SELECT *, {_BLOCK} AS k FROM m WHERE length(a) > 0 AND length(b) > 0) x,
    LATERAL (SELECT unnest([{{'a': substr(a, 1, (-k.i - 1)::INT), 'b': substr(b, 1, (-k.j - 1)::INT), 'first': true}}, {{'a': substr(a, (-k.i + k.l)::INT), 'b': substr(b, (-k.j + k.l)::INT), 'first': false}}]) AS piece) WHERE k.l > 0),
r AS (SELECT typed, name, sum(l) FILTER (WHERE depth > 0) / 2.0 AS matched FROM m GROUP BY 1, 2),
s AS (SELECT typed, name, greatest(CASE WHEN contains(name, typed) OR contains(typed, name) THEN 0.9::DOUBLE ELSE 0 END, 2 * matched::DOUBLE / (length(typed) + length(name))) AS score FROM r),
b AS (SELECT typed, name, score, row_number() OVER (PARTITION BY typed ORDER BY score DESC, name) AS r FROM s WHERE score >= 0.75 - 1e-12)
SELECT p_partkey, b.name AS matched, round(CAST(b.score AS DOUBLE), 6) AS score FROM t LEFT JOIN b ON t.typed = b.typed AND r = 1""")


def me5_known_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("merchant_name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("merchant_name"))
    return me.corpus_size(c.unionByName(s).unionByName(c))


register("me5_known_names", me5_known_names,
         "SELECT count(DISTINCT n) AS corpus_size FROM (SELECT c_name AS n FROM customer UNION ALL SELECT s_name FROM supplier)")


def me6_strategy_order(spark, sf_dir):
    """Names after prepositions, else typed part names matched against the known ones."""
    part = typed_names(spark, sf_dir)
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("spent at "), F.initcap("typed"), F.lit(" and at "), F.initcap("typed"), F.lit("."))).otherwise(
        F.initcap("typed")
    )
    asked_ = part.select(F.col("p_partkey").alias("question_id"), text.alias("text"))
    corpus = me.known_names(part, "p_name")
    found = me.extract_merchants(asked_, corpus, measure="edit")
    return found.select("question_id", F.array_join("merchants", "|").alias("names"))


_SHOWN = "array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(typed, ' ')], ' ')"
register("me6_strategy_order", me6_strategy_order, rf"""
WITH t AS (SELECT p_partkey, substr(p_name, 1, p_partkey % length(p_name)) || substr(p_name, p_partkey % length(p_name) + 2) AS typed FROM part),
n AS (SELECT DISTINCT p_name AS name FROM part),
k AS (SELECT DISTINCT typed, unnest(list_distinct([trim(typed)] || [w FOR w IN string_split(typed, ' ') IF length(w) >= 3])) AS tok FROM t),
s AS (SELECT tok, name, CASE WHEN contains(name, tok) OR contains(tok, name) THEN greatest(0.9, 1.0 - levenshtein(tok, name) / greatest(length(tok), length(name)))
        ELSE 1.0 - levenshtein(tok, name) / greatest(length(tok), length(name)) END AS score FROM (SELECT DISTINCT tok FROM k), n),
b AS (SELECT tok, name, row_number() OVER (PARTITION BY tok ORDER BY score DESC, name) AS r FROM s WHERE score >= 0.75 - 1e-12),
f AS (SELECT typed, name, min(CASE WHEN tok = trim(typed) THEN 0 ELSE instr(' ' || typed || ' ', ' ' || tok || ' ') END) AS pos FROM k JOIN b USING (tok) WHERE r = 1 GROUP BY 1, 2)
SELECT p_partkey AS question_id, CASE WHEN p_partkey % 2 = 0 THEN trim({_SHOWN}) || ' and at ' || trim({_SHOWN})
  ELSE coalesce((SELECT string_agg(name, '|' ORDER BY pos) FROM f WHERE f.typed = t.typed), '') END AS names FROM t""")


def me7_kept_names(spark, sf_dir):
    names = F.array(
        F.lit("December"), F.translate("c_name", "#", " "), F.lit("coffee shop"), F.lit("March 2000 and on"),
        F.initcap("c_mktsegment"), F.lit("Week"), F.lit("x"), F.lit("Pharmacy"),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(me.keep_names(names), "|").alias("kept"))


register("me7_kept_names", me7_kept_names, """
SELECT c_custkey, replace(c_name, '#', ' ') || '|' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS kept FROM customer""")


# --- TR ----------------------------------------------------------------------------------------


def _phrases(templates: list[str], rule, shift: int = 0):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = asked.order_questions(spark, sf_dir, templates, shift)
        r = rule(F.lower("text"), F.col("reference_ts"))
        return df.select("question_id", r.alias("r")).select(
            "question_id",
            F.date_format("r.start_ts", "yyyy-MM-dd").alias("start_day"),
            F.date_format("r.end_ts", "yyyy-MM-dd").alias("end_day"),
            F.date_format("r.end_ts", "HH:mm:ss.SSSSSS").alias("end_time"),
            F.col("r.month_of_year").alias("month_of_year"),
        )

    return run


_NEVER = ("NULL", "NULL")
_DAY0, _DAY6 = "'00:00:00.000000'", "'00:00:00.000001'"


def _range_sql(ranges: list[tuple], shift: int = 0, month: list | None = None, condition: str = "true") -> str:
    """Expected ranges per template over d (order date) and ref (reference date)."""
    n = len(ranges)
    start = " ".join(f"WHEN {i} THEN {r[0]}" for i, r in enumerate(ranges))
    end = " ".join(f"WHEN {i} THEN {r[1]}" for i, r in enumerate(ranges))
    at = " ".join(f"WHEN {i} THEN {r[2] if len(r) > 2 else _DAY0}" for i, r in enumerate(ranges))
    moy = " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(month or ["NULL"] * n))
    return f"""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + {shift} AS ref FROM orders),
r AS (SELECT o_orderkey AS question_id, CAST(CASE o_orderkey % {n} {start} END AS DATE) AS s, CAST(CASE o_orderkey % {n} {end} END AS DATE) AS e,
      CASE o_orderkey % {n} {at} END AS t, CAST(CASE o_orderkey % {n} {moy} END AS INTEGER) AS m FROM o)
SELECT question_id, strftime(s, '%Y-%m-%d') AS start_day, strftime(e, '%Y-%m-%d') AS end_day, CASE WHEN e IS NOT NULL THEN t END AS end_time,
  CASE WHEN e IS NOT NULL THEN m END AS month_of_year FROM r"""


_IF2000 = "CASE WHEN year(d) >= 2000 THEN d END"
_IF2000E = "CASE WHEN year(d) >= 2000 THEN d + 1 END"
_MON = "make_date(year(d), month(d), 1)"
register("tr1_iso_day", _phrases(asked.ISO_TEMPLATES, tr.iso_day),
         _range_sql([(_IF2000, _IF2000E), (_IF2000, _IF2000E), _NEVER, _NEVER]))
register("tr2_slash_day", _phrases(asked.SLASH_TEMPLATES, tr.slash_day), _range_sql([("d", "d + 1"), ("d", "d + 1"), _NEVER, _NEVER]))

# The reference is forty days after the order date: days without a year fall in this or last year.
_YEARLESS = "make_date(year(ref) - (CASE WHEN month(d) > month(ref) THEN 1 ELSE 0 END), month(d), day(d))"
register("tr3_textual_day", _phrases(asked.TEXTUAL_TEMPLATES, tr.textual_day, 40), _range_sql([
    (f"CASE WHEN year(d) >= 2000 THEN d ELSE {_YEARLESS} END", f"CASE WHEN year(d) >= 2000 THEN d + 1 ELSE {_YEARLESS} + 1 END"),
    (_YEARLESS, f"{_YEARLESS} + 1"), (_YEARLESS, f"{_YEARLESS} + 1"), _NEVER], 40))

_SPAN = "NULL", "CAST(make_date(year(ref), month(d), 1) + INTERVAL 1 MONTH AS DATE)"
_MONTH0 = (f"CASE WHEN year(d) >= 2000 THEN {_MON} ELSE {_SPAN[0]} END", f"CASE WHEN year(d) >= 2000 THEN CAST({_MON} + INTERVAL 1 MONTH AS DATE) ELSE {_SPAN[1]} END")
register("tr4_named_month", _phrases(asked.MONTH_TEMPLATES, tr.named_month), _range_sql(
    [_MONTH0, _SPAN, _NEVER], month=["CASE WHEN year(d) < 2000 THEN month(d) END", "month(d)", "NULL"]))

_MONDAY = "CAST(date_trunc('week', ref) AS DATE)"
_FIRST = "CAST(date_trunc('month', ref) AS DATE)"
_YEAR = "make_date(year(ref), 1, 1)"
register("tr5_relative", _phrases(asked.RELATIVE_TEMPLATES, tr.relative), _range_sql([
    ("ref", "ref", _DAY6), ("ref - 1", "ref"), (f"{_MONDAY} - 7", _MONDAY), (_MONDAY, "ref", _DAY6),
    (f"CAST({_FIRST} - INTERVAL 1 MONTH AS DATE)", _FIRST), (_FIRST, "ref", _DAY6), ("ref - 10", "ref", _DAY6), ("ref - 3", "ref", _DAY6),
    ("make_date(year(ref) - 1, 1, 1)", _YEAR), (_YEAR, "ref", _DAY6), _NEVER, ("ref - 100000", "ref", _DAY6)]))


def _quarter_sql(number: int, year: str) -> tuple:
    first = f"make_date({year}, {number * 3 - 2}, 1)"
    return first, f"CAST({first} + INTERVAL 3 MONTH AS DATE)"


_STATED = "(CASE WHEN year(d) >= 2000 THEN year(d) ELSE year(ref) END)"
register("tr6_quarter", _phrases(asked.QUARTER_TEMPLATES, tr.quarter, 200), _range_sql(
    [_quarter_sql(1, _STATED), _quarter_sql(2, "year(ref)"), _quarter_sql(3, "year(ref)"), _quarter_sql(4, _STATED), _NEVER], 200))


def _holiday_sql(name: str, year: str) -> str:
    thanks = f"(make_date({year}, 11, 1) + ((11 - isodow(make_date({year}, 11, 1))) % 7)::INT + 21)"
    return {
        "thanksgiving": thanks, "christmas": f"make_date({year}, 12, 25)", "new years": f"make_date({year}, 1, 1)",
        "new year": f"make_date({year}, 1, 1)", "black friday": f"({thanks} + 1)", "cyber monday": f"({thanks} + 4)",
        "memorial day": f"(make_date({year}, 5, 31) - (isodow(make_date({year}, 5, 31)) - 1)::INT)",
        "labor day": f"(make_date({year}, 9, 1) + ((8 - isodow(make_date({year}, 9, 1))) % 7)::INT)",
        "fourth of july": f"make_date({year}, 7, 4)", "halloween": f"make_date({year}, 10, 31)",
    }[name]


_H = asked.HOLIDAY_NAMES
register("tr7_holiday", _phrases(asked.HOLIDAY_TEMPLATES, tr.holiday), _range_sql(
    [(_holiday_sql(h, "year(ref)"), f"{_holiday_sql(h, 'year(ref)')} + 1") for h in _H]
    + [(f"{_holiday_sql(h, '2001')} - 7", _holiday_sql(h, "2001")) for h in _H]
    + [(f"{_holiday_sql(h, 'year(ref)')} + 1", f"{_holiday_sql(h, 'year(ref)')} + 8") for h in _H]
    + [(f"CAST(date_trunc('week', {_holiday_sql(h, '2000')}) AS DATE)", f"CAST(date_trunc('week', {_holiday_sql(h, '2000')}) AS DATE) + 7") for h in _H]
    + [_NEVER]))

# "since Month yyyy" before 2000 names no readable year, so the year is inferred from the reference.
_SINCE_MONTH = f"CASE WHEN year(d) >= 2000 THEN {_MON} ELSE make_date(year(ref) - (CASE WHEN month(d) > month(ref) THEN 1 ELSE 0 END), month(d), 1) END"
_BETWEEN = ("CASE WHEN year(d) >= 2000 THEN DATE '2000-01-05' END", "CASE WHEN year(d) >= 2000 THEN d + 1 END")
register("tr8_contextual", _phrases(asked.CONTEXT_TEMPLATES, tr.contextual, 40), _range_sql([
    (_IF2000, "CASE WHEN year(d) >= 2000 THEN ref END", _DAY6), (_SINCE_MONTH, "ref", _DAY6), _BETWEEN,
    ("DATE '2000-03-01'", "DATE '2000-05-01'"), ("DATE '2000-01-05'", "DATE '2001-02-04'"), _NEVER], 40))

register("tr9_rule_order", _phrases(asked.MIXED_TEMPLATES, tr.resolve), _range_sql([
    ("DATE '2000-03-01'", "DATE '2000-05-01'"), (_IF2000, _IF2000E), ("d", "d + 1"), ("d", "d + 1"), _MONTH0, ("ref - 1", "ref"),
    _quarter_sql(2, "year(ref)"), (_holiday_sql("halloween", "year(ref)"), _holiday_sql("halloween", "year(ref)") + " + 1"), _NEVER],
    month=["NULL"] * 4 + ["CASE WHEN year(d) < 2000 THEN month(d) END"] + ["NULL"] * 4))


def tr10_reference_time(spark, sf_dir):
    """Explicit settings of several forms, else the latest order."""
    orders = table(spark, sf_dir, "orders")
    kind = (F.col("o_orderkey") % 4).cast("int")
    setting = (
        F.when(kind == 0, F.date_format("o_orderdate", "yyyyMMdd"))
        .when(kind == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z")))
        .when(kind == 2, F.lit("not a time"))
    )
    asked_ = orders.select(F.col("o_orderkey").alias("question_id"), setting.alias("setting"))
    df = tr.with_reference(asked_, orders, "o_orderdate", F.col("setting"))
    return df.select("question_id", F.date_format("reference_ts", "yyyy-MM-dd HH:mm:ss").alias("reference"))


register("tr10_reference_time", tr10_reference_time, """
SELECT o_orderkey AS question_id, strftime(CASE WHEN o_orderkey % 4 < 2 THEN o_orderdate ELSE (SELECT max(o_orderdate) FROM orders) END, '%Y-%m-%d %H:%M:%S') AS reference FROM orders""")
