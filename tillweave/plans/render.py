"""Receipt text rendered from the given tables: the at-scale input of the extraction job.

An order's lines become one document, so a document is as long as its order. The text uses every
layout the extractor knows: four date styles, three item layouts, five tenders, optional tip,
delivery, discount, warranty and refund lines, and one damaged document in fifty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillweave.functions import text as tx
from tillweave.plans.tables import table


def _line(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _s(column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def item_text(key: Column) -> Column:
    """One line, a counted line, or a wrapped item of three lines, by order key."""
    price = _s(F.col("l_extendedprice").cast(tx.MONEY))
    return (
        F.when(key % 3 == 0, _line(F.rpad("p_name", 28, " "), "$ ", F.lpad(price, 10, " ")))
        .when(key % 3 == 1, _line(_s(F.col("l_quantity").cast("int")), " x ", F.col("p_name"), "   $", price))
        .otherwise(_line(F.col("p_name"), "\n  SKU: ", _s("l_partkey"), "\n        $ ", price))
    )


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(filename, raw_text, o_orderkey)``, one row per order that has lines."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    # Short documents cost much work per byte, so the shuffle keeps its full number of partitions.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = (
        lines.withColumn("_text", item_text(F.col("l_orderkey")))
        .repartition(parts, "l_orderkey")
        .groupBy("l_orderkey")
        .agg(
            F.array_sort(F.collect_list(F.struct(*order, "_text", "l_returnflag"))).alias("_lines"),
            F.sum(F.col("l_extendedprice").cast(tx.MONEY)).alias("_subtotal"),
            F.bool_or(F.col("l_linestatus") == "O").alias("_warranty"),
        )
    )
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    # Narrow rows meet first, so the lines' text is shuffled by order alone, once, and stays in all of its partitions.
    parents = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    df = parents.join(body, F.col("o_orderkey") == F.col("l_orderkey"))
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    damage = F.when(k % 50 == 7, (F.floor(k / 50) % 3).cast("int"))
    total = F.col("o_totalprice").cast(tx.MONEY)
    total_text = F.when(k % 13 == 0, F.format_number(total, 2)).otherwise(_s(total))
    last4 = F.lpad(_s(c % 10000), 4, "0")
    day = (
        F.when(k % 4 == 0, _line("Date: ", F.date_format("o_orderdate", "MM/dd/yyyy"), "  Time: 10:15"))
        .when(k % 4 == 1, _line("Date: ", F.date_format("o_orderdate", "yyyy-MM-dd")))
        .when(k % 4 == 2, F.date_format("o_orderdate", "MMMM d, yyyy"))
        .otherwise(F.date_format("o_orderdate", "d MMM yyyy"))
    )
    tender = (
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", _line("CASH        $ ", total_text))
        .when(F.col("c_mktsegment") == "MACHINERY", _line("VISA ****", last4, "   $ ", total_text))
        .when(F.col("c_mktsegment") == "BUILDING", _line("Credit: American Express ending ", last4))
        .when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("DEBIT CARD"))
        .otherwise(_line("APPLE PAY   $ ", total_text))
    )
    amounts = F.concat_ws(
        "\n",
        _line("SUBTOTAL:     $ ", _s("_subtotal")),
        _line("TAX (8.5%):   $", _s(((k % 900 + 100) / 100).cast(tx.MONEY))),
        F.when(k % 7 == 0, F.lit("Delivery fee: $3.99")),
        F.when(k % 11 == 0, F.lit("Discount:   $ 2.50")),
        F.when(F.col("o_orderpriority") == "1-URGENT", _line("TIP (20%)  $", _s(((k % 500 + 100) / 100).cast(tx.MONEY)))),
        _line("TOTAL:        $", total_text),
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("  "), "c_name", F.when(c % 3 == 0, F.lit(" Store")).otherwise(F.lit(""))),
        _line(_s(c % 900 + 100), " Market Street"),
        F.when(c % 4 == 0, F.lit("Springfield, CA")).otherwise(_line("Springfield, CA ", _s(c % 1000 + 90000))),
        _line("Phone: (555)-010-", last4),
        F.lit(""),
        F.when(~F.coalesce(damage == 0, F.lit(False)), day),
        _line(F.when(k % 2 == 0, F.lit("Cashier: ")).otherwise(F.lit("Server: ")), "Clerk ", _s("c_nationkey")),
        _line(F.when(k % 2 == 0, F.lit("Order #")).otherwise(F.lit("Order #: ")), _s(k)),
        _line("Transaction ID: TX-", _s(k)),
        _line("Store #", _s("c_nationkey")),
        F.lit("-----------------"),
        F.array_join(F.transform("_lines", lambda l: l["_text"]), "\n"),
        F.when(F.col("_warranty"), F.lit("EXTENDED WARRANTY 2YR\n30 day warranty on parts\nEXTENDED WARRANTY 2YR")),
        F.lit("\t"),
        F.when(~F.coalesce(damage == 1, F.lit(False)), amounts),
        tender,
        F.when(F.get("_lines", F.lit(0))["l_returnflag"] == "R", F.lit("Refund processed")).otherwise(
            F.lit("** 30-DAY RETURN POLICY **")
        ),
        F.lit("Thank you for shopping!  "),
    )
    return df.select(
        _line("receipt_", _s(k), ".txt").alias("filename"),
        F.when(damage == 2, F.lit("\n  \n")).otherwise(text).alias("raw_text"),
        "o_orderkey",
    )
