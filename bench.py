"""Time the headline queries and print one JSON line.

Each headline query runs once to warm up and then BENCH_REPEATS times; the
median wall time counts, plan building and staging included.  Results go to Spark's no-op
sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from registry.queries import all_queries
from seasonloom.session import RECOMMENDED

HEADLINE = [
    "pitch_tracking",
    "ucl_injury",
    "season_rollup",
    "survival_cohort",
    "injury_rate_year_level",
    "velo_injury_cohort",
    "baseline_risk",
    "surgeries_by_year_level",
    "pitch_enriched",
    "pitch_model_data",
    "km_by_role",
]
# Iterative fits run many jobs each; they run once, in the JVM the others warmed up.
FITS = ["cox_fit", "velo_decay_fixed"]


def _session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("seasonloom-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="seasonloom-bench-"))
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def _seconds(spark: SparkSession, name: str, folder: str) -> float:
    started = time.perf_counter()
    all_queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = _session(os.environ.get("BENCH_CPUS", "8"))
    times: dict[str, float] = {}
    for name in HEADLINE:
        _seconds(spark, name, folder)
        runs = [_seconds(spark, name, folder) for _ in range(repeats)]
        times[name] = round(statistics.median(runs), 3)
    for name in FITS:
        times[name] = round(_seconds(spark, name, folder), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_wall_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
