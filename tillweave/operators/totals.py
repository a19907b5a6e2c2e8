"""Labelled amounts of receipt text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillweave.functions import text as tx

FIELDS = ["subtotal", "tax_amount", "tip_amount", "delivery_fee", "total_amount", "discounts"]


def label(low: Column) -> Column:
    """Which amount a lower-cased line states, by label priority; null for other lines."""
    delivery = low.contains("delivery fee") | (
        low.contains("delivery") & (low.contains("fee") | low.contains("charge")) & low.rlike(r"\bdelivery\b")
    )
    return (
        F.when(low.contains("subtotal"), "subtotal")
        .when(low.contains("tax"), "tax_amount")
        .when(low.contains("tip"), "tip_amount")
        .when(delivery, "delivery_fee")
        .when(low.contains("total"), "total_amount")
        .when(low.contains("discount"), "discounts")
    )


def with_totals(df: DataFrame, rows: str = "rows") -> DataFrame:
    """Adds the six amounts: per label the last non-zero one, else zero if stated, else null."""
    labelled = F.filter(
        F.transform(F.col(rows), lambda r: F.struct(label(r["low"]).alias("label"), r["line"].alias("line"))),
        lambda r: r["label"].isNotNull(),
    )
    tagged = F.transform(labelled, lambda r: F.struct(r["label"].alias("label"), tx.amount(r["line"]).alias("amount")))
    # `_amounts` is read once per field, so it stays a column of its own.
    df = df.withColumn("_amounts", F.filter(tagged, lambda t: t["amount"].isNotNull()))

    def field(name: str) -> Column:
        own = F.filter(F.col("_amounts"), lambda t: t["label"] == name)
        stated = tx.last_of(F.filter(own, lambda t: t["amount"] != 0))
        return F.coalesce(stated["amount"], tx.first_of(own)["amount"])

    return df.withColumns({name: field(name) for name in FIELDS}).drop("_amounts")


def totals_from_line_rows(rows: DataFrame, doc: str, line_no: str, line: str) -> DataFrame:
    """The same amounts from one row per line: a mergeable ``max_by`` per label, no window."""
    tagged = rows.select(
        doc, line_no, label(F.lower(line)).alias("_label"), tx.amount(F.col(line)).alias("_amount")
    ).filter(F.col("_label").isNotNull() & F.col("_amount").isNotNull())

    def field(name: str) -> Column:
        own = F.col("_label") == name
        last = F.max_by(F.when(own, F.col("_amount")), F.when(own & (F.col("_amount") != 0), F.col(line_no)))
        zero = F.max(F.when(own & (F.col("_amount") == 0), F.col("_amount")))
        return F.coalesce(last, zero).alias(name)

    return tagged.groupBy(doc).agg(*[field(n) for n in FIELDS])
