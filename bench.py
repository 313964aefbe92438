"""Headline queries at one scale: prints one JSON line of seconds by query."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from attestor.plans.catalogue import QUERIES

NAMES = ("sentence_split", "child_chunks", "claims_extract", "claims_distinct_limit", "page_line_clean", "fact_score", "bm25_scores", "semantic_scores", "hybrid_topk", "nli_best_evidence", "verify_flagship", "verdict_summary", "density_map", "vector_topk")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "12g", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
