"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from corpusloom.plans import catalog

HEADLINE = (
    "lead_compression", "normalize_metric_text", "word_counts", "regex_tokens", "sentence_split", "lead_predictions", "curate", "quality_flags", "issue_report", "source_dedup",
    "duplicate_sources", "exact_leakage", "prediction_audit", "completeness", "eval_summary", "rouge_1", "rouge_2", "rouge_l", "compression_ratio", "length_stats_nearest", "spearman",
    "stratified_sample", "split_801010", "blind_mapping", "candidate_tasks", "paired_bootstrap", "paired_systems", "weighted_kappa", "row_cosine", "token_dataset", "beam_rerank", "verdict_normalize",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["lead_compression"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not a query's time
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
