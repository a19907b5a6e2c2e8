"""The given tables and the frames derived from them that the registered queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillweave.functions import text as tx
from tillweave.operators.merchants import normalise
from tillweave.session import spread

# Category rules over the words of part names; `ring` carries two labels.
PART_RULES = [
    ("hardware", ["ring", "bolt"]),
    ("gadget", ["widget", "gizmo"]),
    ("metal", ["anvil", "ring"]),
]
PART_ORDER = ["hardware", "gadget", "metal"]

SEGMENT_RULES = [
    ("home", ["household", "furniture"]),
    ("industry", ["machinery", "building"]),
]

PAYMENT_OF_SEGMENT = {
    "HOUSEHOLD": "cash", "MACHINERY": "credit", "BUILDING": "credit",
    "AUTOMOBILE": "debit", "FURNITURE": "apple_pay",
}

CATEGORY_OF_PRIORITY = {
    "1-URGENT": "pharmacy", "2-HIGH": "electronics", "3-MEDIUM": "groceries",
    "4-NOT SPECIFIED": "restaurant", "5-LOW": "coffee_shop",
}

CATEGORY_OF_TYPE = {
    "STANDARD": "groceries", "PROMO": "restaurant", "MEDIUM": "fast_food",
    "LARGE": "coffee_shop", "SMALL": "electronics", "ECONOMY": "pharmacy",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(column: str, values: dict[str, str]) -> Column:
    out = None
    for key, value in values.items():
        out = F.when(F.col(column) == key, value) if out is None else out.when(F.col(column) == key, value)
    return out


def plain_merchant() -> Column:
    """A customer as a merchant name that can stand in a sentence."""
    return F.concat(
        F.translate("c_name", "#", " "), F.when(F.col("c_custkey") % 3 == 0, F.lit(" Store")).otherwise(F.lit(""))
    )


def receipt_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as receipts."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    df = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return df.select(
        F.col("o_orderkey").alias("receipt_id"),
        plain_merchant().alias("merchant_name"),
        normalise(plain_merchant()).alias("merchant_name_norm"),
        F.col("o_orderdate").alias("transaction_date"),
        mapped("c_mktsegment", PAYMENT_OF_SEGMENT).alias("payment_method"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "visa").when(F.col("c_mktsegment") == "BUILDING", "amex").alias("card_network"),
        F.col("o_totalprice").cast(tx.MONEY).alias("total_amount"),
        F.lit(None).cast(tx.MONEY).alias("tax_amount"),
        F.lit(None).cast(tx.MONEY).alias("tip_amount"),
        F.array(mapped("o_orderpriority", CATEGORY_OF_PRIORITY)).alias("categories"),
        F.lit(False).alias("has_warranty"),
        (F.col("o_orderstatus") == "F").alias("is_return"),
        (F.col("o_orderstatus") == "P").alias("has_discounts"),
        F.lit(False).alias("has_delivery_fee"),
        F.lit(False).alias("has_tip"),
        F.concat(F.lit("receipt_"), F.col("o_orderkey").cast("string"), F.lit(".txt")).alias("filename"),
        F.col("c_custkey"),
    )


def item_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as items that carry their receipt's columns."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    parents = receipt_facts(spark, sf_dir).drop("categories", "is_return", "has_discounts")
    # Receipts first: a filter on them leaves fewer lines to meet their parts.
    df = lines.join(parents, lines["l_orderkey"] == parents["receipt_id"]).join(
        part, lines["l_partkey"] == part["p_partkey"]
    )
    return df.select(
        *parents.columns,
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.col("l_extendedprice").cast(tx.MONEY).alias("item_price"),
        mapped("p_type", CATEGORY_OF_TYPE).alias("item_category"),
        F.array(mapped("p_type", CATEGORY_OF_TYPE)).alias("categories"),
        (F.col("l_returnflag") == "R").alias("is_return"),
        (F.col("l_discount") > 0).alias("has_discounts"),
        "l_quantity",
    )


# The month name a question uses, by month number.
def month_name(number: Column) -> Column:
    from tillweave.functions.fixed import MONTHS

    return F.get(F.array(*[F.lit(m.capitalize()) for m in MONTHS]), number - 1)


def customer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spending question per customer, eight kinds in turn; the reference is the latest order."""
    customer = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    key, who = F.col("c_custkey"), plain_merchant()
    month = F.concat(month_name((key % 12 + 1).cast("int")), F.lit(" 2000"))
    first = F.date_add(F.lit("2000-01-01").cast("date"), (key % 100).cast("int"))
    last = F.date_add(first, 180)
    kind = (key % 8).cast("int")
    text = (
        F.when(kind == 0, F.concat(F.lit("How much did I spend at "), who, F.lit(" in "), month, F.lit("?")))
        .when(kind == 1, F.concat(F.lit("How many receipts from "), who, F.lit(" last year?")))
        .when(kind == 2, F.concat(F.lit("What is the average amount at "), who, F.lit("?")))
        .when(kind == 3, F.concat(F.lit("What is my total in "), month, F.lit("?")))
        .when(kind == 4, F.concat(F.lit("How much have I spent on groceries at "), who, F.lit("?")))
        .when(kind == 5, F.concat(F.lit("Total of receipts over $200,000 from "), who, F.lit("?")))
        .when(
            kind == 6,
            F.concat(
                F.lit("Count returned items between "), first.cast("string"), F.lit(" and "),
                last.cast("string"), F.lit(" at "), who,
            ),
        )
        .otherwise(F.lit("What did I buy yesterday?"))
    )
    latest = table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).scalar()
    return customer.select(key.alias("question_id"), text.alias("text"), latest.alias("reference_ts"))
