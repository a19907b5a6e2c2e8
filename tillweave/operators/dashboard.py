"""Dashboard aggregates. All group sums merge map-side, so a hot key costs one partial row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillweave.functions import fixed, text as tx


def _money(column: str) -> Column:
    return F.col(column).cast(tx.MONEY)


def global_metrics(
    receipts: DataFrame, items: DataFrame | None = None, total: str = "total_amount",
    merchant: str = "merchant_name", approximate: bool = False,
) -> DataFrame:
    """Total spend, item count, mean receipt and distinct merchants; zeros on empty input.

    Items come from their own table, or from ``item_count`` on the receipts, so that no join can
    repeat a receipt's total.
    """
    distinct = F.approx_count_distinct(merchant) if approximate else F.count_distinct(merchant)
    spend = F.coalesce(F.sum(_money(total)), F.lit(0).cast("decimal(22,2)"))
    if items is None:
        counted = F.coalesce(F.sum("item_count"), F.lit(0)).cast("bigint")
    else:
        counted = items.agg(F.count(F.lit(1)).alias("n")).scalar()
    base = receipts.agg(
        spend.alias("total_spent"),
        F.count(F.lit(1)).alias("receipt_count"),
        distinct.alias("unique_merchants"),
        *([counted.alias("total_items")] if items is None else []),
    )
    if items is not None:
        base = base.withColumn("total_items", counted)
    mean = F.coalesce(F.try_divide("total_spent", "receipt_count"), F.lit(0)).cast("decimal(22,2)")
    return base.withColumn("avg_receipt", mean)


def spend_over_time(receipts: DataFrame, ts: str = "transaction_date", total: str = "total_amount", unit: str = "day") -> DataFrame:
    """Spend per day, week (from Monday) or month, in time order; raw rows are never sorted."""
    day = F.col(ts).cast("date")
    bucket = day if unit == "day" else F.trunc(day, unit)
    return (
        receipts.groupBy(bucket.alias("period"))
        .agg(F.sum(_money(total)).alias("amount"), F.count(F.lit(1)).alias("receipt_count"))
        .orderBy("period")
    )


def spend_points(receipts: DataFrame, ts: str = "transaction_date", total: str = "total_amount") -> DataFrame:
    """The raw (date, amount) points, range-sorted across the cluster."""
    return receipts.select(F.col(ts).alias("period"), _money(total).alias("amount")).orderBy("period", "amount")


def top_merchants(receipts: DataFrame, merchant: str = "merchant_name", total: str = "total_amount", k: int = fixed.TOP_MERCHANTS) -> DataFrame:
    return (
        receipts.groupBy(merchant)
        .agg(F.sum(_money(total)).alias("total_spent"))
        .orderBy(F.desc("total_spent"), F.asc(merchant))
        .limit(k)
    )


def spend_by_category(items: DataFrame, category: str = "category", price: str = "total_price") -> DataFrame:
    return items.groupBy(F.coalesce(category, F.lit("other")).alias("category")).agg(
        F.sum(_money(price)).alias("total_spent")
    )


def merchant_visits(
    receipts: DataFrame, merchant: str = "merchant_name", ts: str = "transaction_date",
    total: str = "total_amount", receipt: str = "receipt_id",
) -> DataFrame:
    """Visits and most recent total per merchant."""
    return receipts.groupBy(merchant).agg(
        F.count(F.lit(1)).alias("visits"),
        F.max(F.struct(F.col(ts).alias("ts"), F.col(receipt).alias("id"), _money(total).alias("total")))["total"].alias("last_total"),
    )


def price_histogram(items: DataFrame, price: str, bins: int = fixed.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram between the least and the greatest value; the top edge is in the last bin."""
    value = F.col(price).cast("double")
    edges = items.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("e")).scalar()
    lo, hi = edges["lo"], edges["hi"]
    raw = F.floor(F.coalesce(F.try_divide((value - lo) * bins, hi - lo), F.lit(0.0))).cast("int") + 1
    width = (hi - lo) / bins
    return (
        items.filter(value.isNotNull())
        .select(F.least(raw, F.lit(bins)).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"bin_low": lo + width * (F.col("bin") - 1), "bin_high": lo + width * F.col("bin")})
    )


def counts_by(items: DataFrame, key: str) -> DataFrame:
    return items.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def monthly_totals(receipts: DataFrame, ts: str = "transaction_date", total: str = "total_amount") -> DataFrame:
    return receipts.groupBy(F.year(ts).alias("year"), F.month(ts).alias("month")).agg(
        F.sum(_money(total)).alias("total_spent")
    )


def items_per_receipt(items: DataFrame, receipt: str = "receipt_id") -> DataFrame:
    return items.groupBy(receipt).agg(F.count(F.lit(1)).alias("item_count"))


def above(receipts: DataFrame, threshold: float, total: str = "total_amount") -> DataFrame:
    return receipts.filter(F.col(total) > threshold)


def exact_percentile(df: DataFrame, value: str, p: float, *by: str, accuracy: int = 10_000) -> DataFrame:
    """The exact percentile of each group, with linear interpolation: the groups and ``percentile``.

    A sketch of fixed size brackets the two values looked for; then rows are counted below the bracket and by value inside
    it, and the values selected by their positions. So state grows with the bracket, a few ten-thousandths of the
    rows, and not with the distinct values. Nulls are ignored; a group without values has none.
    """
    # Groups by names of their own, so that a null group meets itself in joins; all rows together are a group, too.
    names = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    groups = [F.col(c).alias(n) for c, n in zip(by, names)] or [F.lit(0).alias("_g0")]
    rows = df.select(*groups, F.col(value).cast("double").alias("_v"))
    reach = 3.0 / accuracy
    ends = F.percentile_approx("_v", [max(0.0, p - reach), min(1.0, p + reach)], accuracy)
    stats = rows.groupBy(*names).agg(F.count("_v").alias("_n"), ends.alias("_ends"))
    stats = stats.select(*[F.col(n).alias(f"{n}s") for n in names], "_n", F.get("_ends", F.lit(0)).alias("_low"), F.get("_ends", F.lit(1)).alias("_high"))
    same = [F.col(n).eqNullSafe(F.col(f"{n}s")) for n in names]
    met = rows.filter("_v IS NOT NULL").join(stats, same)
    # Below and above the bracket a count and the value next to it suffice.
    place = F.when(F.col("_v") < F.col("_low"), -1).when(F.col("_v") > F.col("_high"), 1).otherwise(0)
    cell = F.when(place == 0, F.col("_v"))
    counted = met.groupBy(*names, "_n", place.alias("_place"), cell.alias("_cell")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
    )
    order = Window.partitionBy(*names).orderBy("_place", "_cell")
    upto = counted.withColumn("_upto", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.lit(p) * (F.col("_n") - 1)
    holds = lambda position: (F.col("_upto") > position) & (F.col("_upto") - F.col("_c") <= position)
    # The first position may be the last row below the bracket, the second one the first row above it.
    here = lambda position: F.max(F.when(holds(position), F.when(F.col("_place") < 0, F.col("_most")).otherwise(F.col("_least"))))
    outside = lambda position: holds(position) & (
        ((F.col("_place") < 0) & (F.col("_upto") - 1 > position)) | ((F.col("_place") > 0) & (F.col("_upto") - F.col("_c") < position))
    )
    missed = F.raise_error(F.lit("the sketch missed its bracket"))
    found = upto.groupBy(*names).agg(
        here(F.floor(at)).alias("_a"), here(F.ceil(at)).alias("_b"), F.max(at - F.floor(at)).alias("_part"),
        F.bool_or(outside(F.floor(at)) | outside(F.ceil(at))).alias("_missed"),
    )
    inside = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")
    exact = found.select(*names, F.when(F.col("_missed"), missed.cast("double")).otherwise(inside).alias("percentile"))
    out = stats.join(exact, same, "left")
    return out.select(*[F.col(f"{n}s").alias(c) for c, n in zip(by, names)], "percentile")


def latency_summary(df: DataFrame, value: str, *by: str, exact: bool = True) -> DataFrame:
    """Mean and 95th percentile of each group; the percentile is exact unless a sketch of fixed size is asked for."""
    if not exact:
        return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile_approx(value, 0.95, 10000).alias("p95"))
    keyed = df.select(*by, value, F.lit(0).alias("_all"))
    high = exact_percentile(keyed, value, 0.95, *by, "_all")
    high = high.select(*[F.col(c).alias(f"_h_{c}") for c in (*by, "_all")], F.col("percentile").alias("p95"))
    means = keyed.groupBy(*by, "_all").agg(F.avg(value).alias("mean"))
    same = [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in (*by, "_all")]
    return means.join(high, same).select(*by, "mean", "p95")
