"""Raw text to typed receipts: the extraction job as one chain of narrow columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillweave.functions import fixed, text as tx
from tillweave.operators import categories as cat, headers, items as it, totals
from tillweave.operators.merchants import normalise

ITEM_COLUMNS = ["name", "quantity", "unit_price", "total_price", "category", "categories"]

RECEIPT_COLUMNS = [
    "receipt_id", "filename", "merchant_name", "merchant_name_norm", "transaction_date", "payment_method",
    "card_network", "card_last4", "subtotal", "tax_amount", "tip_amount", "delivery_fee", "discounts",
    "total_amount", "merchant_address", "merchant_city", "merchant_state", "merchant_zip", "merchant_phone",
    "cashier", "order_number", "transaction_id", "store_number", "has_warranty", "warranty_text",
    "return_transaction", "categories", "item_count", "items", "parse_errors",
]


def with_lines(raw: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds ``lines`` (stripped, no empty ones), ``body`` (joined by newlines) and ``rows`` (each
    line with its lower-cased form)."""
    df = raw.withColumn("lines", tx.lines(F.col(text)))
    df = df.withColumn("body", tx.body(F.col("lines")))
    return df.withColumn("rows", tx.rows(F.col("body")))


def extract_receipts(raw: DataFrame, keep: tuple[str, ...] = (), **category_rules) -> DataFrame:
    """``(filename, raw_text)`` to one nested receipt per document. No shuffle.

    Keys are hashes of the input, so a retried or repeated run gives the same rows. A document that
    cannot be read fully keeps its row, with the reasons in ``parse_errors``.
    """
    df = with_lines(raw)
    body = F.col("body")
    # Items depend on few lines, mostly; those are found by one scan of the text.
    df = it.with_items(df.withColumn("_rows", it.item_rows(body, F.col("rows"))), rows="_rows")
    df = totals.with_totals(df)
    df = df.withColumns(
        {
            "receipt_id": F.sha2(F.concat_ws("|", "filename", "raw_text"), 256),
            "merchant_name": headers.merchant(body),
            "transaction_date": headers.transaction_day(body).cast("timestamp_ntz"),
            "payment_method": headers.payment_method(body),
            "_card": headers.card(body),
            "merchant_phone": headers.phone(body),
            "merchant_address": headers.address(body),
            "cashier": headers.staff(body),
            "order_number": headers.order_number(body),
            "transaction_id": headers.transaction_id(body),
            "store_number": headers.store_number(body),
            "warranty_text": F.when(F.lower(body).contains("warranty"), headers.warranty_text(F.col("rows"))),
            "return_transaction": headers.is_return(body, F.col("total_amount")),
        }
    )
    df = cat.with_item_categories(df, **category_rules)
    df = df.withColumn("_place", headers.place(body, F.col("merchant_address")))
    df = df.withColumns(
        {
            "merchant_name_norm": normalise(F.col("merchant_name")),
            "card_network": headers.card_network(F.col("_card")),
            "card_last4": headers.card_last4(F.col("_card")),
            **headers.place_parts(F.col("_place")),
            "has_warranty": F.col("warranty_text").isNotNull(),
            "categories": cat.receipt_categories(F.col("items"), category_rules.get("order", fixed.CATEGORIES)),
            "item_count": F.size("items"),
            "parse_errors": parse_errors(),
        }
    )
    return df.select(*keep, *RECEIPT_COLUMNS)


def parse_errors() -> Column:
    """Reasons a document is not fully readable."""
    return F.array_compact(
        F.array(
            F.when(F.col("body") == "", F.lit("empty text")),
            F.when(F.col("transaction_date").isNull(), F.lit("no date")),
            F.when(F.col("total_amount").isNull(), F.lit("no total")),
        )
    )


def item_table(receipts: DataFrame) -> DataFrame:
    """Flat item fact keyed by ``(receipt_id, item_index)``."""
    return it.explode_items(receipts, "receipt_id").filter(F.col("item_index").isNotNull())
