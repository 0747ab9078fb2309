"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "domain_sentiment",
    "l4_fill",
    "v1_domain_view",
    "b1_resumable_batches",
    "s13_publish_index",
    "t2_text_search",
    "t2_text_search_one",
    "t3_vector_search",
    "j5_vector_match",
    "j6_zero_shot_pairs",
    "a7_class_tfidf",
    "w3_top_words",
    "tm3_cluster_rest",
    "tm9_topic_distribution",
    "f16_highlight",
    "s3_load_with_key",
    "j2_update_matched",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from voxsift import checks
    from voxsift.checks.common import search_index

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("voxsift-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = checks.queries()

    def run(name: str) -> float:
        started = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    # the JVM and the Python workers are started before anything is timed
    spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    run("t3_vector_search")
    started = time.perf_counter()
    search_index(spark, SF_DIR)  # the searches read an index that is there already
    times = {"index_build": round(time.perf_counter() - started, 3)}
    wanted = sys.argv[1:] or HEADLINE
    times.update({name: run(name) for name in wanted})
    print(
        json.dumps(
            {
                "metric": "total_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
