"""Multi-label categories from keyword rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tillweave.functions import fixed, text as tx

Rules = list[tuple[str, list[str]]]
_BETWEEN_WORDS = r"[^\p{L}\p{N}&]+"


def categories(
    name: Column,
    merchant: Column | None = None,
    item_rules: Rules = fixed.ITEM_KEYWORDS,
    merchant_rules: Rules = fixed.MERCHANT_KEYWORDS,
    order: list[str] = fixed.CATEGORIES,
    whole_words: bool = False,
    fallback: str = "other",
) -> Column:
    """All labels whose keywords occur in the name or the merchant, in the declared order.

    Keywords are substrings by default; ``whole_words`` asks for word boundaries instead.
    """
    implied = None if merchant is None else merchant_labels(merchant, merchant_rules, whole_words)
    return _item_labels(name, implied, item_rules, merchant_rules, order, whole_words, fallback)


def _hit(low: Column, words: list[str], whole_words: bool) -> Column:
    """Whether a lower-cased text holds one of the keywords."""
    found = low.rlike(tx.any_of(tx.quoted(words), True)) if whole_words else tx.contains_any(low, words)
    return F.coalesce(found, F.lit(False))


def merchant_labels(
    merchant: Column, merchant_rules: Rules = fixed.MERCHANT_KEYWORDS, whole_words: bool = False
) -> Column:
    """Labels implied by the merchant alone."""
    if not merchant_rules:
        return F.array().cast("array<string>")
    return tx.labels_for([(_hit(F.lower(merchant), words, whole_words), label) for label, words in merchant_rules])


def _item_labels(
    name: Column, implied: Column | None, item_rules: Rules, merchant_rules: Rules, order: list[str],
    whole_words: bool, fallback: str,
) -> Column:
    by_item, by_merchant = dict(item_rules), dict(merchant_rules)

    def tagged(low: Column) -> Column:
        conditions = []
        for label in order:
            tests = [_hit(low, by_item[label], whole_words)] if label in by_item else []
            if implied is not None and label in by_merchant:
                tests.append(F.array_contains(implied, label))
            if tests:
                conditions.append((tests[0] if len(tests) == 1 else tests[0] | tests[1], label))
        return tx.labels_for(conditions)

    found = tx.let(F.lower(name), tagged)
    return tx.let(found, lambda t: F.when(F.size(t) == 0, F.array(F.lit(fallback))).otherwise(t))


def _substrings(column: Column, size: int) -> Column:
    """Distinct substrings of ``size`` letters; none of a shorter text."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(column) - size + 1, F.lit(1))), lambda i: i + size - 1 <= F.length(column))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(column, i, F.lit(size))))


def keyword_hits(names: DataFrame, name: str, keywords: DataFrame, keyword: str) -> DataFrame:
    """Pairs (name, keyword) of texts where the name holds the keyword anywhere.

    A keyword meets names on the rarest, among all names, of its three-letter substrings, so letters that most names
    share are no key; keywords of one and two letters are keys themselves. Each pair is then verified in full.
    """
    size = F.least(F.length(keyword), F.lit(3))
    sized = lambda n: F.when(size == n, _substrings(F.col(keyword), n))
    grams = keywords.filter(F.length(keyword) > 0).select(keyword, F.explode(F.coalesce(sized(3), sized(2), sized(1))).alias("_g"))
    lengths = grams.agg(F.collect_set(F.length("_g"))).scalar()  # one to three
    pieces = F.flatten(F.transform("_sizes", lambda n: F.when(n == 3, _substrings(F.col(name), 3)).when(n == 2, _substrings(F.col(name), 2)).otherwise(_substrings(F.col(name), 1))))
    held = names.withColumn("_sizes", lengths).select(name, F.explode(pieces).alias("_g"))
    counts = held.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    # Unknown grams are the rarest: their keyword is in no name and meets nothing.
    rarest = grams.join(counts, "_g", "left").groupBy(keyword).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g")).alias("_r"))
    met = rarest.select(keyword, F.col("_r._g").alias("_g")).join(held, "_g")
    return met.filter(F.col(name).contains(F.col(keyword))).select(name, keyword)


def categorise_by_table(
    names: DataFrame, name: str, rules: DataFrame, fallback: str = "other", whole_words: bool = False,
) -> DataFrame:
    """Labels from a rule table ``(category, keyword)`` too large for one expression.

    It means what the expression form means: keywords are substrings in any case, or whole words on request, in letters of
    any script; runs of blanks count as one. With a column ``rank`` labels stand in its order, else by name.
    Keywords meet the distinct names by a hash join (see ``keyword_hits``), so unrelated rows never pair up.
    """
    between = _BETWEEN_WORDS if whole_words else r"\s+"
    edge = F.lit(" " if whole_words else "")
    plain = lambda text: F.concat(edge, F.regexp_replace(F.lower(text), between, " "), edge)
    known = rules.select("category", plain(F.col("keyword")).alias("_kw"), (F.col("rank") if "rank" in rules.columns else F.lit(0)).alias("_rank"))
    distinct = names.select(F.col(name).alias("_name"), plain(F.col(name)).alias("_plain")).distinct()
    hits = keyword_hits(distinct.select("_plain").distinct(), "_plain", known.select("_kw").distinct(), "_kw")
    # At most one entry per category and name; the set is merged before the shuffle.
    found = hits.join(known, "_kw").groupBy("_plain", "category").agg(F.min("_rank").alias("_rank"))
    ordered = F.array_sort(F.collect_list(F.struct("_rank", "category")))
    labelled = found.groupBy("_plain").agg(F.transform(ordered, lambda e: e["category"]).alias("categories"))
    labelled = distinct.join(labelled, "_plain").select("_name", "categories")
    joined = names.join(labelled, names[name] == labelled["_name"], "left").drop("_name")
    return joined.withColumn("categories", F.coalesce("categories", F.array(F.lit(fallback))))


def with_item_categories(
    df: DataFrame, merchant: str = "merchant_name", items: str = "items", item_rules: Rules = fixed.ITEM_KEYWORDS,
    merchant_rules: Rules = fixed.MERCHANT_KEYWORDS, order: list[str] = fixed.CATEGORIES,
    whole_words: bool = False, fallback: str = "other",
) -> DataFrame:
    """Adds ``categories`` and the primary ``category`` to every element of the item array.

    The merchant is looked at once per receipt, not once per item.
    """
    df = df.withColumn("_implied", merchant_labels(F.col(merchant), merchant_rules, whole_words))

    def label(item: Column) -> Column:
        return _item_labels(
            item["name"], F.col("_implied"), item_rules, merchant_rules, order, whole_words, fallback
        )

    labelled = F.transform(F.col(items), lambda i: F.struct(i.alias("i"), label(i).alias("l")))
    plain = ["name", "quantity", "unit_price", "total_price"]
    flat = F.transform(
        labelled,
        lambda t: F.struct(
            *[t["i"][c].alias(c) for c in plain],
            t["l"].alias("categories"),
            F.get(t["l"], F.lit(0)).alias("category"),
        ),
    )
    return df.withColumn(items, flat).drop("_implied")


def receipt_categories(items: Column, order: list[str] = fixed.CATEGORIES) -> Column:
    """Distinct labels over a receipt's items, in the declared order, other labels after them."""
    seen = F.array_distinct(F.flatten(F.transform(items, lambda i: i["categories"])))
    known = F.array(*[F.lit(c) for c in order if c != "other"], F.lit("other"))
    return F.concat(F.array_intersect(known, seen), F.array_sort(F.array_except(seen, known)))


def categories_per_receipt(items: DataFrame, receipt: str, labels: str, order: list[str] | None = None) -> DataFrame:
    """Flat form: distinct labels, in the declared order or by name, and item count per receipt, in one aggregate.

    With an ``order`` of up to 63 labels an item's labels are bits that are merged by ``or``; without one, the sets of
    labels that items have, which the label domain bounds, are merged.
    """
    count = F.count(F.lit(1)).alias("item_count")
    if order is None or len(order) > 63:
        merged = F.array_distinct(F.flatten(F.collect_set(labels)))
        place = F.array_sort(merged) if order is None else F.concat(F.array_intersect(F.lit(order), merged), F.array_sort(F.array_except(merged, F.lit(order))))
        return items.groupBy(receipt).agg(count, place.alias("categories"))
    bit = lambda n, condition: F.when(condition, F.lit(1 << n).cast("long")).otherwise(F.lit(0).cast("long"))
    mask = reduce(lambda a, b: a + b, [bit(n, F.array_contains(labels, label)) for n, label in enumerate(order)])
    merged = items.groupBy(receipt).agg(count, F.bit_or(F.coalesce(mask, F.lit(0).cast("long"))).alias("_mask"))
    held = [F.when(F.col("_mask").bitwiseAND(1 << n) != 0, F.lit(label)) for n, label in enumerate(order)]
    return merged.select(receipt, "item_count", F.array_compact(F.array(*held)).alias("categories"))
