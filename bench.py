"""Times the headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillweave.operators import chunks, questions, receipts as rc  # noqa: E402
from tillweave.plans import asked, catalog, catalog_text  # noqa: E402
from tillweave.plans.render import rendered  # noqa: E402
from tillweave.session import build_session, work_path  # noqa: E402

DIRECT = [
    "k2_merchant_labels", "k4_receipt_labels", "m4_item_sum_check", "ch5_category_groups_flat", "me4_fuzzy_match",
    "tr9_rule_order", "qa2_any_flag", "qa3_receipt_predicates", "qa4_audit", "da1_global_metrics", "da2_spend_over_time",
    "da3_top_merchants", "da4_category_spend", "da5_merchant_visits", "da6_price_histogram", "da9_monthly_totals",
    "da11_latency", "v3_filtered_top_k", "v4_top_k_many", "s4_upsert", "s5_delete",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        out = action()
        seconds[name] = round(time.perf_counter() - start, 3)
        return out

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    # The flagship path, stage by stage: text, receipts, chunks, question parameters.
    raw_path, receipt_path = work_path(spark, "raw"), work_path(spark, "receipts")
    timed("render_and_land", lambda: rendered(spark, sf_dir).write.parquet(raw_path))
    raw = spark.read.parquet(raw_path)
    count = raw.count()
    timed("extract_receipts", lambda: rc.extract_receipts(raw, **catalog_text.RULES).write.parquet(receipt_path))
    stored = spark.read.parquet(receipt_path)
    timed("chunk_receipts", lambda: run(chunks.chunk_receipts(stored)))
    pool = asked.order_questions(spark, sf_dir, asked.INTENT_TEMPLATES)
    asked_count = pool.count()
    timed("parse_questions", lambda: run(questions.parse_questions(pool)))
    for name in DIRECT:
        timed(name, lambda: run(catalog.QUERIES[name](spark, sf_dir)))

    print(
        json.dumps(
            {
                "metric": "total wall time of the headline jobs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "receipts_per_sec": round(count / seconds["extract_receipts"]),
                "chunked_receipts_per_sec": round(count / seconds["chunk_receipts"]),
                "questions_per_sec": round(asked_count / seconds["parse_questions"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
