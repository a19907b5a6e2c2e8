"""Five text views of every receipt, with filterable columns.

A receipt's row is exploded to one row per chunk, and a chunk's columns are written from the receipt's row after that: in
generated code, and only those that are asked for. Chunking reads the receipts once and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillweave.functions import fixed, text as tx

BASE_COLUMNS = [
    "receipt_id", "merchant_name", "merchant_name_norm", "transaction_date", "transaction_ts", "transaction_year",
    "transaction_month", "transaction_day", "transaction_weekday", "payment_method", "total_amount", "filename",
    "card_network", "card_last4", "merchant_city", "merchant_state", "merchant_zip", "is_return",
]

# Columns that only some views carry, with their types.
VIEW_COLUMNS = {
    "chunk_type": "string", "chunk_key": "string", "content": "string",
    "subtotal": tx.MONEY, "tax_amount": tx.MONEY, "item_count": "int", "categories": "array<string>",
    "has_tip": "boolean", "has_discounts": "boolean", "has_delivery_fee": "boolean", "has_warranty": "boolean",
    "discounts": tx.MONEY, "tip_amount": tx.MONEY, "delivery_fee": tx.MONEY, "warranty_text": "string",
    "merchant_address": "string", "item_index": "int", "item_name": "string", "item_category": "string",
    "item_categories": "array<string>", "item_price": tx.MONEY, "item_unit_price": "decimal(18,6)",
    "item_quantity": "decimal(12,3)", "category": "string", "group_total": "decimal(22,2)",
    "item_names": "array<string>", "has_address": "boolean", "has_phone": "boolean",
}


def dollars(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.coalesce(amount, F.lit(0)).cast("decimal(22,2)").cast("string"))


def plain_number(value: Column) -> Column:
    """A decimal without trailing zeros."""
    return F.regexp_replace(value.cast("string"), r"\.?0*$", "")


def with_base(receipts: DataFrame, ts: str = "transaction_date") -> DataFrame:
    """Adds the date parts and epoch seconds shared by every view; Monday is weekday 0."""
    day = F.col(ts)
    seconds = F.datediff(day.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + (
        F.hour(day) * 3600 + F.minute(day) * 60 + F.second(day)
    )
    return receipts.withColumns(
        {
            "transaction_ts": seconds,
            "transaction_year": F.year(day),
            "transaction_month": F.month(day),
            "transaction_day": F.day(day),
            "transaction_weekday": F.weekday(day),
        }
    )


def top_items() -> Column:
    """The first items' names as one text, and how many others there are."""
    names = F.transform(F.slice("items", 1, fixed.SUMMARY_ITEMS), lambda i: i["name"])
    more = F.size("items") - fixed.SUMMARY_ITEMS
    listed = F.when(
        more > 0, F.concat(names, F.array(F.concat(F.lit("plus "), more.cast("string"), F.lit(" others"))))
    ).otherwise(names)
    return F.array_join(listed, ", ")


def summary_content(top: Column) -> Column:
    def amount_part(title: str, column: str) -> Column:
        return F.when(F.col(column) != 0, F.concat(F.lit(f"{title}: "), dollars(F.col(column))))

    return F.concat_ws(
        ". ",
        F.concat(F.lit("Receipt from "), "merchant_name"),
        F.concat(F.lit("Date: "), F.date_format("transaction_date", "yyyy-MM-dd HH:mm")),
        F.concat(F.lit("Subtotal: "), dollars(F.col("subtotal"))),
        F.concat(F.lit("Tax: "), dollars(F.col("tax_amount"))),
        F.concat(F.lit("Total amount: "), dollars(F.col("total_amount"))),
        F.concat(F.lit("Payment method: "), "payment_method"),
        F.concat(F.lit("Number of items: "), F.size("items").cast("string")),
        amount_part("Discounts", "discounts"),
        amount_part("Tip", "tip_amount"),
        amount_part("Delivery fee", "delivery_fee"),
        F.when(F.col("has_warranty") & F.col("warranty_text").isNotNull(), F.concat(F.lit("Warranty info: "), "warranty_text"))
        .when(F.col("has_warranty"), F.lit("Warranty info present")),
        F.when(F.col("return_transaction"), F.lit("Return transaction")),
        F.when(F.size("items") > 0, F.concat(F.lit("Top items: "), top)),
    )


def summary_view(top: Column) -> dict[str, Column]:
    return dict(
        chunk_key=F.lit(""), content=summary_content(top),
        subtotal=F.col("subtotal"), tax_amount=F.col("tax_amount"), item_count=F.size("items"),
        categories=F.col("categories"), has_tip=F.col("tip_amount").isNotNull(),
        has_discounts=F.col("discounts").isNotNull(), has_delivery_fee=F.col("delivery_fee").isNotNull(),
        has_warranty=F.col("has_warranty"), discounts=F.col("discounts"), tip_amount=F.col("tip_amount"),
        delivery_fee=F.col("delivery_fee"), warranty_text=F.col("warranty_text"),
        merchant_address=F.col("merchant_address"),
    )


def _day_text() -> Column:
    return F.coalesce(F.date_format("transaction_date", "yyyy-MM-dd"), F.lit("unknown"))


def item_view(index: Column) -> dict[str, Column]:
    """One item, parent columns alongside."""
    item = F.get("items", index)
    content = F.concat(
        F.lit("Item: "), item["name"], F.lit(". Price: "), dollars(item["total_price"]),
        F.lit(". Qty: "), plain_number(item["quantity"]),
        F.lit(". Categories: "), F.array_join(item["categories"], ", "),
        F.lit(". Store: "), F.col("merchant_name"), F.lit(". Date: "), _day_text(), F.lit("."),
    )
    return dict(
        chunk_key=index.cast("string"), content=content, item_index=index,
        item_name=item["name"], item_category=item["category"], item_categories=item["categories"],
        item_price=item["total_price"], item_unit_price=item["unit_price"], item_quantity=item["quantity"],
    )


def grouped_labels() -> Column:
    """Labels held by two or more items of the receipt."""
    own = lambda label: F.filter("items", lambda i: F.array_contains(i["categories"], label))
    return F.filter("categories", lambda label: F.size(own(label)) > 1)


def category_groups(labels: Column) -> Column:
    """Total, count and names in item order of the items that hold each label."""

    def one(label: Column) -> Column:
        own = F.filter("items", lambda i: F.array_contains(i["categories"], label))
        return F.struct(
            label.alias("category"),
            F.transform(own, lambda i: i["name"]).alias("item_names"),
            F.aggregate(
                own, F.lit(0).cast("decimal(22,2)"), lambda a, i: (a + i["total_price"]).cast("decimal(22,2)")
            ).alias("group_total"),
        )

    return F.transform(labels, one)


def category_view(group: Column) -> dict[str, Column]:
    size = F.size(group["item_names"])
    content = F.concat(
        F.lit("Category: "), group["category"], F.lit(". Total: "), dollars(group["group_total"]),
        F.lit(". Items ("), size.cast("string"), F.lit("): "), F.array_join(group["item_names"], ", "),
        F.lit(". Store: "), F.col("merchant_name"), F.lit("."),
    )
    return dict(
        chunk_key=group["category"], content=content, category=group["category"], item_count=size,
        group_total=group["group_total"], item_names=group["item_names"],
    )


def category_groups_flat(
    items: DataFrame, receipt: str, labels: str, price: str
) -> DataFrame:
    """Flat form for item tables: total and count per (receipt, label), groups of two or more.

    Sums and counts only, so a receipt of any size is merged map-side and never gathered.
    """
    return (
        items.select(receipt, price, F.explode(labels).alias("category"))
        .groupBy(receipt, "category")
        .agg(F.sum(F.col(price).cast(tx.MONEY)).alias("group_total"), F.count(F.lit(1)).alias("item_count"))
        .filter(F.col("item_count") > 1)
    )


def merchant_view() -> dict[str, Column]:
    content = F.concat_ws(
        ". ",
        F.concat(F.lit("Merchant: "), "merchant_name"),
        F.concat(F.lit("Location: "), F.coalesce("merchant_address", F.lit("Unknown Address"))),
        F.lit("Total visits: 1"),
        F.concat(F.lit("Last total: "), dollars(F.col("total_amount"))),
    )
    return dict(
        chunk_key=F.lit(""), content=content,
        has_address=F.col("merchant_address").isNotNull(), has_phone=F.col("merchant_phone").isNotNull(),
    )


def payment_view() -> dict[str, Column]:
    content = F.concat(
        F.lit("Payment: "), F.col("payment_method"), F.lit(". Store: "), F.col("merchant_name"),
        F.lit(". Total: "), dollars(F.col("total_amount")), F.lit(". Date: "), _day_text(), F.lit("."),
    )
    return dict(
        chunk_key=F.lit(""), content=content,
        has_tip=F.col("tip_amount").isNotNull(), has_discounts=F.col("discounts").isNotNull(),
    )


def chunk_receipts(receipts: DataFrame, views: list[str] = fixed.CHUNK_TYPES) -> DataFrame:
    """All requested views of nested receipts, one row per chunk."""
    df = with_base(receipts).withColumn("is_return", F.when(F.col("return_transaction"), F.lit(True)))
    # What loops over items is made once per receipt, and left out by Spark where no column needs it.
    if "receipt_summary" in views:
        df = df.withColumn("_top", top_items())
    if "category_group" in views:
        df = df.withColumn("_labels", grouped_labels())
        df = df.withColumn("_groups", category_groups(F.col("_labels")))
    many = {"item_detail": "items", "category_group": "_labels"}
    kinds, before, starts = [], F.lit(0), {}
    for view in views:
        starts[view] = before
        if view in many:
            count = F.when(F.col(many[view]).isNotNull(), F.size(many[view]))
            kinds.append(F.array_repeat(F.lit(view), count))
            before = before + count
        else:
            kinds.append(F.array(F.lit(view)))
            before = before + 1
    inner = [c for c in df.columns if c not in ("chunk_type", "_place")]
    rows = df.select(*inner, F.posexplode(F.concat(*kinds)).alias("_place", "chunk_type"))
    nth = lambda view: F.col("_place") - starts[view]
    builders = {
        "receipt_summary": lambda: summary_view(F.col("_top")),
        "item_detail": lambda: item_view(nth("item_detail")),
        "category_group": lambda: category_view(F.get("_groups", nth("category_group"))),
        "merchant_info": merchant_view,
        "payment_method": payment_view,
    }
    fields = {view: builders[view]() for view in views}

    def column(name: str, type_: str) -> Column:
        own = [(view, made[name]) for view, made in fields.items() if name in made]
        value = F.coalesce(*[F.when(F.col("chunk_type") == view, v.cast(type_)) for view, v in own]) if own else F.lit(None)
        return value.cast(type_).alias(name)

    made = {n: column(n, t) for n, t in VIEW_COLUMNS.items() if n != "chunk_type"}
    key = F.sha2(F.concat_ws("|", "receipt_id", "chunk_type", made.pop("chunk_key")), 256)
    return rows.select(key.alias("chunk_id"), *BASE_COLUMNS, *[F.col("chunk_type") if n == "chunk_type" else made[n] for n in VIEW_COLUMNS if n != "chunk_key"])


def metadata_json(columns: list[str]) -> Column:
    """Chosen columns as JSON; absent values are left out, not written as null."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]))


def truncate(content: Column, limit: int = fixed.CONTENT_LIMIT, marker: str = "... [TRUNCATED]") -> Column:
    return F.when(F.length(content) > limit, F.concat(F.left(content, F.lit(limit)), F.lit(marker))).otherwise(content)


def stored_content(content: Column) -> Column:
    """What is kept beside a stored vector."""
    return F.left(content, F.lit(fixed.STORED_CONTENT_LIMIT))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Count per view plus totals and the mean number of chunks per receipt, one row per view.

    Every receipt has exactly one summary, so receipts are counted without a distinct.
    """
    per_type = chunks.groupBy("chunk_type").agg(F.count(F.lit(1)).alias("chunks"))
    # One row per chunk type from here on, so the chunks themselves are built only once.
    listed = per_type.agg(
        F.collect_list(F.struct("chunk_type", "chunks")).alias("_types"),
        F.coalesce(F.sum(F.when(F.col("chunk_type") == "receipt_summary", F.col("chunks"))), F.lit(0)).alias("total_receipts"),
        F.sum("chunks").alias("total_chunks"),
    )
    mean = F.coalesce(F.try_divide("total_chunks", "total_receipts"), F.lit(0.0))
    return listed.select(
        F.inline("_types"), "total_receipts", "total_chunks", mean.alias("average_chunks_per_receipt")
    )
