"""Times every registered query and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the cores and BENCH_RUNS the timed runs, of which
the median counts. Each query is run once before. Nothing is cached between runs.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from weekpulse.queries import QUERIES
from weekpulse.session import build_session


def run_once(spark, query, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - start
    spark.catalog.clearCache()
    return seconds


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "weekpulse-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="weekpulse-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, query in QUERIES.items():
        run_once(spark, query, folder)
        seconds[name] = round(
            statistics.median(run_once(spark, query, folder) for _ in range(runs)), 4
        )
    result = {
        "metric": "total median time of all registered queries",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
