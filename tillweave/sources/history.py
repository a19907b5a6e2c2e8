"""Question history as append-only JSON, and the score sheet of a batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillweave.functions import fixed

HISTORY_SCHEMA = (
    "question_id bigint, question string, asked_at timestamp_ntz, answer string, confidence double, "
    "receipts array<string>, items array<string>"
)


def save_history(entries: DataFrame, path: str) -> None:
    """Appends results, keeping the first five receipts and items of each."""
    kept = entries.withColumns(
        {c: F.slice(c, 1, fixed.HISTORY_KEEP) for c in ("receipts", "items") if c in entries.columns}
    )
    kept.write.mode("append").json(path)


def load_history(spark: SparkSession, path: str, schema: str = HISTORY_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def first_per_question(rows: DataFrame, value: str, order: str, k: int = fixed.HISTORY_KEEP) -> DataFrame:
    """The first k values per question as an array; tasks prune to k before the shuffle."""
    from tillweave.operators.answers import best_hits

    top = best_hits(rows.select("question_id", value, order), "question_id", [F.asc(order), F.asc(value)], k)
    return top.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", value))).alias("_a")).select(
        "question_id", F.transform("_a", lambda s: s[value]).alias("kept")
    )


def score_batch(questions: DataFrame, match_counts: DataFrame, known_empty: DataFrame) -> DataFrame:
    """Matches per question and whether it passes: it found something, or may be empty."""
    allowed = known_empty.select("question_id").distinct().withColumn("may_be_empty", F.lit(True))
    joined = (
        questions.select("question_id")
        .join(match_counts, "question_id", "left")
        .join(allowed, "question_id", "left")
    )
    n = F.coalesce("n_matches", F.lit(0))
    may = F.coalesce("may_be_empty", F.lit(False))
    return joined.select("question_id", n.alias("n_matches"), ((n > 0) | may).alias("passed"))


def score_totals(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.count_if(F.col("n_matches") == 0).alias("empty"),
    )
