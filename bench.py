"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query runs once
on the sf0.001 tables beside BENCH_SF_DIR before it is timed, so that the times show the work on the
data and not the start of the JVM; the output says whether such tables were found.
"""

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

from rillwatch.plans.catalogue import QUERIES
from rillwatch.session import SETTINGS

HEADLINE = (
    "rolling_anomalies",
    "frames_to_alerts",
    "decode_frames",
    "microflow_aggregate",
    "traffic_aggregate",
    "packet_traffic",
    "traffic_by_host_and_protocol",
    "parse_flows",
    "raw_traffic",
    "drop_late",
    "rolling_anomalies_by_host",
    "rolling_sample_60",
    "expanding_stats",
    "stream_traffic_aggregate",
    "stream_rolling_anomalies",
)


def run(spark: SparkSession, name: str, sf_dir: str) -> None:
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warmed = os.path.isdir(warm_dir)

    timings = {}
    for name in HEADLINE:
        if warmed:
            run(spark, name, warm_dir)
        started = time.perf_counter()
        run(spark, name, sf_dir)
        timings[name] = round(time.perf_counter() - started, 3)
        print(name, timings[name], file=sys.stderr)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale.group(1)) if scale else None,
                "warmed": warmed,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
