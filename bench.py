"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from registry import inputs  # noqa: E402
from registry.spark_queries import QUERIES  # noqa: E402

HEADLINE = (
    "intent_decisions",
    "clean_text",
    "conversation_pairs",
    "label_conversations",
    "escalate",
    "golden_sample",
    "term_stats",
    "tfidf_index",
    "retrieve_topk",
    "score_batch_keywords",
    "audit_rollup",
    "judge_means",
    "classification_report",
    "baseline_comparison",
    "spearman",
    "metrics_summary",
    "stratified_sample",
    "audit_window",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("carewise-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    # the shared inputs of the queries are built first; their time counts in the total, in no query's
    start = time.perf_counter()
    inputs.pairs(spark, sf_dir)
    inputs.scored_table(spark, sf_dir)
    preparation = round(time.perf_counter() - start, 3)
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(preparation + sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "preparation": preparation,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
