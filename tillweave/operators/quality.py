"""Data-quality checks as flag columns and mergeable counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillweave.functions import fixed, text as tx


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column).cast(tx.MONEY), F.lit(0).cast(tx.MONEY))


def check_totals(
    df: DataFrame, total: str = "total_amount", subtotal: str = "subtotal", tax: str | None = "tax_amount",
    tip: str | None = "tip_amount", fee: str | None = "delivery_fee", discount: str | None = "discounts",
    tolerance: float = fixed.TOTAL_TOLERANCE,
) -> DataFrame:
    """Adds ``expected_total`` and ``total_mismatch`` from all the parts of a receipt."""
    expected = _zero(subtotal)
    for part in (tax, tip, fee):
        if part is not None:
            expected = expected + _zero(part)
    if discount is not None:
        expected = expected - _zero(discount)
    gap = F.abs(_zero(total) - expected)
    return df.withColumn("expected_total", expected).withColumn("total_mismatch", gap > F.lit(tolerance).cast(tx.MONEY))


def check_item_sum(
    receipts: DataFrame, items: DataFrame, receipt: str = "receipt_id", subtotal: str = "subtotal",
    price: str = "total_price", tolerance: float = fixed.ITEM_SUM_TOLERANCE,
) -> DataFrame:
    """Item sum against the subtotal, from flat tables; sums merge before the shuffle."""
    sums = items.groupBy(receipt).agg(F.sum(F.col(price).cast(tx.MONEY)).alias("item_sum"))
    joined = receipts.select(receipt, subtotal).join(sums, receipt, "left")
    gap = F.abs(F.coalesce("item_sum", F.lit(0)) - F.coalesce(F.col(subtotal).cast(tx.MONEY), F.lit(0)))
    return joined.withColumn("item_sum_mismatch", gap > F.lit(tolerance).cast(tx.MONEY))


def check_item_sum_nested(receipts: DataFrame, tolerance: float = fixed.ITEM_SUM_TOLERANCE) -> DataFrame:
    """The same check on nested receipts; no shuffle."""
    total = F.aggregate(
        "items", F.lit(0).cast("decimal(22,2)"), lambda a, i: (a + i["total_price"]).cast("decimal(22,2)")
    )
    gap = F.abs(total - F.coalesce("subtotal", F.lit(0)))
    return receipts.withColumn("item_sum", total).withColumn(
        "item_sum_mismatch", gap > F.lit(tolerance).cast(tx.MONEY)
    )


def is_dense(content: Column, least: int = fixed.MIN_CONTENT) -> Column:
    """Content worth indexing: at least ten characters once stripped."""
    return F.coalesce(F.length(F.regexp_replace(content, r"^\s+|\s+$", "")) >= least, F.lit(False))


def density_report(df: DataFrame, content: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count_if(is_dense(F.col(content))).alias("accepted"),
        F.count_if(~is_dense(F.col(content))).alias("rejected"),
    )


def outside_range(column: Column, low: float | None, high: float | None) -> Column:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (column < low)
    if high is not None:
        bad = bad | (column > high)
    return F.coalesce(bad, F.lit(False))


def outside_domain(column: Column, domain: list[str]) -> Column:
    return F.coalesce(~column.isin(domain), F.lit(False))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per named check with its number of violating rows; a single pass."""
    counts = df.agg(*[F.count_if(cond).alias(name) for name, cond in checks.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])
    return counts.select(F.inline(pairs))


def context_integrity(df: DataFrame, required: list[str], *by: str) -> DataFrame:
    """Share of rows that hold every required key, with the row count."""
    present = F.lit(True)
    for key in required:
        present = present & F.col(key).isNotNull()
    return df.groupBy(*by).agg(
        F.avg(present.cast("int")).alias("integrity"), F.count(F.lit(1)).alias("row_count")
    )
