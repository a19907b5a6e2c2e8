"""Question text derived from the given tables: phrase templates filled from orders and customers.

Each template list is used in turn by order key, so the number of questions grows with the orders
table. ``{d}`` is the order date in ISO form, ``{us}`` month/day/year, ``{long}`` "Month d, yyyy",
``{md}`` "Month d", ``{m}`` the month name, ``{y}`` the year and ``{a}`` the order total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillweave.functions import text as tx
from tillweave.plans.tables import month_name, table
from tillweave.session import spread

INTENT_TEMPLATES = [
    "How much did I spend in January 2000?",
    "Show me all receipts from December",
    "What did I buy last week?",
    "Find all Whole Foods receipts from Austin",
    "How much have I spent at coffee shops?",
    "What's my total spending on restaurants?",
    "Show me electronics purchases",
    "What pharmacy items did I buy?",
    "Find receipts under ${a}",
    "List all groceries over ${a}",
    "Find receipts with warranty information",
    "Show me a laptop",
    "What is the average tip?",
    "Count refund receipts paid with visa",
    "How many receipts did I pay with apple pay?",
    "Tax on purchases between $10 and ${a}",
    "Show me treats I bought",
    "Find health-related purchases",
    "Which discount delivery did I get with debit and credit?",
    "Hello there",
]

ISO_TEMPLATES = ["receipts from {d}", "what happened on {d}?", "no date here", "bad day 2000-13-41"]
SLASH_TEMPLATES = ["bought on {us}", "receipts dated {us}, please", "13/45/2000 is no day", "nothing"]
TEXTUAL_TEMPLATES = ["receipts from {long}", "spent on {md}", "on {md}th", "december of nothing"]
MONTH_TEMPLATES = ["spending in {m} {y}", "show {m} receipts", "no month named"]
RELATIVE_TEMPLATES = [
    "receipts of today", "what about yesterday", "what did I buy last week", "spending this week",
    "spent last month", "total this month", "over the last 10 days", "the past 3 days",
    "all of last year", "so far this year", "some other time", "in the last 100000 days",
]
QUARTER_TEMPLATES = ["totals for Q1 {y}", "q2 spending", "Q3 of this", "how was Q4 {y}", "no quarter... quiet"]
HOLIDAY_NAMES = [
    "thanksgiving", "christmas", "new years", "new year", "black friday", "cyber monday",
    "memorial day", "labor day", "fourth of july", "halloween",
]
HOLIDAY_TEMPLATES = (
    [f"spending on {h}" for h in HOLIDAY_NAMES]
    + [f"the week before {h} 2001" for h in HOLIDAY_NAMES]
    + [f"the week after {h}" for h in HOLIDAY_NAMES]
    + [f"{h} week 2000" for h in HOLIDAY_NAMES]
    + ["no feast at all"]
)
CONTEXT_TEMPLATES = [
    "everything since {d}", "all since {m} {y}", "between 2000-01-05 and {d}", "between March and April 2000",
    "between January 5, 2000 and February 3, 2001", "between here and there",
]
MIXED_TEMPLATES = [
    "between March and April 2000", "receipts from {d}", "bought on {us}", "spent on {long}", "in {m} {y}",
    "what about yesterday", "q2 spending", "spending on halloween", "nothing in particular",
]


def fill(template: Column) -> Column:
    day = F.col("o_orderdate")
    month = month_name(F.month(day))
    values = {
        "{long}": F.concat(month, F.lit(" "), F.day(day).cast("string"), F.lit(", "), F.year(day).cast("string")),
        "{md}": F.concat(month, F.lit(" "), F.day(day).cast("string")),
        "{us}": F.date_format(day, "M/d/yyyy"),
        "{d}": F.date_format(day, "yyyy-MM-dd"),
        "{m}": month,
        "{y}": F.year(day).cast("string"),
        "{a}": F.col("o_totalprice").cast(tx.MONEY).cast("string"),
    }
    for mark, value in values.items():
        template = F.replace(template, F.lit(mark), value)
    return template


def order_questions(spark: SparkSession, sf_dir: str, templates: list[str], reference_shift: int = 0) -> DataFrame:
    """One question per order; the reference time is the order date, moved by some days."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"))
    pick = F.get(F.array(*[F.lit(t) for t in templates]), F.pmod("o_orderkey", F.lit(len(templates))).cast("int"))
    ref = F.date_add(F.col("o_orderdate").cast("date"), reference_shift).cast("timestamp_ntz")
    return orders.select(
        F.col("o_orderkey").alias("question_id"), fill(pick).alias("text"), ref.alias("reference_ts"), "o_orderdate"
    )


def turn_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a question, for text volume."""
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    key = F.lit(-1).cast("bigint") - (F.col("conv_id") * 100000 + F.col("turn"))
    return turns.select(key.alias("question_id"), "text")


def question_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = order_questions(spark, sf_dir, INTENT_TEMPLATES).select("question_id", "text")
    return asked.unionByName(turn_questions(spark, sf_dir))
