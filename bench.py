"""Prints one JSON line with the headline queries' seconds: the median of three runs after a warm-up."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parent) + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = ["trending", "window_deltas", "topic_aggregates", "contribution_delta", "topic_relevance", "emerging", "centrality_repository", "components", "developer_bridges", "related_repositories", "quality_rollup"]


def main() -> None:
    from pyspark.sql import SparkSession

    from observatory.plans.queries import QUERIES
    from observatory.shared import clear

    directory, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
            clear(spark)
        runs = runs[1:]  # the first one warms up
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(directory).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
