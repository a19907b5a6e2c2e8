"""A table of questions to a table of typed filter parameters; every column here is narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillweave.functions import fixed, text as tx
from tillweave.operators import merchants as me, temporal as tr

_DOLLARS = r"\$(\d[\d,]*(?:\.\d{2})?)"
_BETWEEN = r"between \$(\d[\d,]*(?:\.\d{2})?) and \$(\d[\d,]*(?:\.\d{2})?)"


def _found(text: Column, words: list[str]) -> Column:
    return text.rlike(tx.any_of(tx.quoted(words)))


def intent(text: Column) -> Column:
    low = F.lower(text)
    rules = [(label, tx.any_of(patterns)) for label, patterns in fixed.INTENT_RULES]
    return F.coalesce(tx.case_rules(low, rules), F.lit("general"))


def metric(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.contains("tax"), "tax_amount")
        .when(low.contains("tip"), "tip_amount")
        .when(low.rlike(tx.any_of(fixed.METRIC_WORDS)), "total_amount")
    )


def categories(text: Column) -> Column:
    low = F.lower(text)
    mapped = [
        F.when(_found(low, words), F.array(*[F.lit(l) for l in labels]))
        for words, labels in fixed.QUESTION_CATEGORIES
    ]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*mapped))))


def card_network(text: Column) -> Column:
    low = F.lower(text)
    return tx.case_rules(low, [(n, n) for n in reversed(fixed.CARD_NETWORKS)])


def payment_method(text: Column) -> Column:
    """Last listed phrase found wins; a card network alone means credit."""
    low = F.lower(text)
    stated = tx.case_rules(low, [(label, phrase) for phrase, label in reversed(fixed.QUESTION_PAYMENTS)])
    return F.coalesce(stated, F.when(card_network(text).isNotNull(), F.lit("credit")))


def flags(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    return {name: low.rlike(pattern) for name, pattern in fixed.FEATURE_WORDS}


def amount_bounds(text: Column) -> Column:
    """Struct of the amount bounds: the last dollar value, placed by its comparison word."""
    low = F.lower(text)

    def money(value: Column) -> Column:
        return F.translate(value, ",", "").try_cast(tx.MONEY)

    value = money(tx.last_of(F.regexp_extract_all(text, F.lit(_DOLLARS), F.lit(1))))
    at_least = _found(low, fixed.LOWER_BOUND_WORDS)
    at_most = ~at_least & _found(low, fixed.UPPER_BOUND_WORDS)
    both = low.rlike(_BETWEEN)
    low_end = money(F.regexp_extract(low, _BETWEEN, 1))
    high_end = money(F.regexp_extract(low, _BETWEEN, 2))
    return F.struct(
        F.when(both, low_end).when(at_least, value).alias("min_amount"),
        F.when(both, high_end).when(at_most, value).alias("max_amount"),
    )


def semantic_terms(text: Column) -> Column:
    """Keywords of every concept the text names or hints at, distinct, in rule order."""
    low = F.lower(text)
    mapped = [
        F.when(_found(low, [concept] + words), F.array(*[F.lit(w) for w in words]))
        for concept, words in fixed.SEMANTIC_TERMS
    ]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*mapped))))


def concept_categories(text: Column) -> Column:
    """Labels of every concept that the text names or hints at, distinct, in rule order."""
    low, words = F.lower(text), dict(fixed.SEMANTIC_TERMS)
    mapped = [
        F.when(_found(low, [concept] + words[concept]), F.array(*[F.lit(label) for label in labels]))
        for concept, labels in fixed.CONCEPT_CATEGORIES
    ]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*mapped))))


def filter_categories(text: Column) -> Column:
    """The categories a question names, else those of its concepts, so that sums run over the items asked for."""
    return tx.let(categories(text), lambda named: F.when(F.size(named) > 0, named).otherwise(concept_categories(text)))


def aggregation(text: Column) -> Column:
    return tx.case_rules(F.lower(text), [(l, tx.any_of(p)) for l, p in fixed.AGGREGATION_RULES])


def sum_basis(text: Column, metric_: Column, intent_: Column, categories_: Column) -> Column:
    """Whether sums run over receipts or over items."""
    return (
        F.when(F.coalesce(metric_.isin("tax_amount", "tip_amount"), F.lit(False)), "receipts")
        .when(intent_.isin("category", "item_specific") | (F.size(categories_) > 0), "items")
        .when(_found(F.lower(text), fixed.ITEM_BASIS_WORDS), "items")
        .otherwise("receipts")
    )


PARAM_COLUMNS = [
    "original_query", "query_type", "metric", "start_ts", "end_ts", "month_of_year", "merchants", "categories",
    "payment_method", "card_network", "has_warranty", "is_return", "has_discounts", "has_delivery_fee", "has_tip",
    "min_amount", "max_amount", "semantic_categories", "aggregation", "sum_basis",
]


def parse_questions(
    questions: DataFrame, corpus: DataFrame | None = None, question_id: str = "question_id",
    text: str = "text", measure: str = "blocks",
) -> DataFrame:
    """``(question_id, text, reference_ts)`` to one parameter row per question.

    Without a corpus the whole step is narrow. With one, only questions that name no merchant after
    a preposition take part in the fuzzy join.
    """
    q = F.col(text)
    df = tr.with_date_range(questions, text)
    df = me.extract_merchants(df, corpus, question_id, text, measure)
    df = df.withColumns(
        {
            "original_query": q,
            "query_type": intent(q),
            "metric": metric(q),
            "categories": filter_categories(q),
            "payment_method": payment_method(q),
            "card_network": card_network(q),
            **flags(q),
            "_amounts": amount_bounds(q),
            "semantic_categories": semantic_terms(q),
            "aggregation": aggregation(q),
        }
    )
    df = df.withColumns(
        {
            "min_amount": F.col("_amounts.min_amount"),
            "max_amount": F.col("_amounts.max_amount"),
            "sum_basis": sum_basis(q, F.col("metric"), F.col("query_type"), F.col("categories")),
        }
    )
    return df.select(question_id, *PARAM_COLUMNS)
