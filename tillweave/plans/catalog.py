"""All registered queries with their check SQL, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillweave.operators import answers, questions
from tillweave.plans import catalog_answers, catalog_questions, catalog_text
from tillweave.plans.catalog_text import receipts

_PARTS = [catalog_text, catalog_questions, catalog_answers]

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered receipts are extracted, the question is read, and the sum is audited over all matches."""
    asked = spark.range(1).select(
        F.lit(1).cast("bigint").alias("question_id"),
        F.lit("How much did I spend in March 2000?").alias("text"),
        F.lit("2001-08-01").cast("timestamp_ntz").alias("reference_ts"),
    )
    params = questions.parse_questions(asked)
    facts = receipts(spark, sf_dir).withColumns(
        {
            "is_return": F.col("return_transaction"),
            "has_discounts": F.col("discounts").isNotNull(),
            "has_delivery_fee": F.col("delivery_fee").isNotNull(),
            "has_tip": F.col("tip_amount").isNotNull(),
        }
    )
    items = facts.withColumn("_item", F.explode("items")).withColumns(
        {"item_id": F.col("receipt_id"), "item_price": F.col("_item.total_price"), "categories": F.col("_item.categories")}
    )
    return answers.audit(params, facts, items)
