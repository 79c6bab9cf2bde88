"""How the main report grows: the event feed copied many times, for both forms of the comparison.

    python bench_scaling.py [copies] [runs]

Copies shift user ids, so that users grow with events, and a third of all events is given to one
user. The copy is written once to a new folder under the system's temporary folder.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import functions as F

from weekpulse import Report
from weekpulse.queries import SPEC
from weekpulse.session import build_session
from weekpulse.sources.events import CUSTOMERS, EVENTS, events_to_fact
from weekpulse.sources.fact import DAY, read_fact, write_fact

SOURCE = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def copied(spark, folder: str, copies: int) -> None:
    numbers = F.sequence(F.lit(0), F.lit(copies - 1))
    customers = spark.read.parquet(f"{SOURCE}/customer.parquet")
    users = customers.count()
    events = spark.read.schema(EVENTS).parquet(f"{SOURCE}/events.parquet")
    shifted = events.select("*", F.explode(numbers).alias("copy")).select(
        "event_id",
        "ts",
        F.when(F.col("event_id") % 3 == 0, 0)
        .otherwise(F.col("user_id") + F.col("copy") * users)
        .alias("user_id"),
        "event_type",
        "value",
        "props",
    )
    # Enough files for the two periods to keep all cores busy, as they would at full size.
    shifted.repartitionByRange(128, "ts").sortWithinPartitions("ts").write.option(
        "parquet.block.size", 16 * 1024 * 1024
    ).parquet(f"{folder}/events.parquet")
    customers.select("*", F.explode(numbers).alias("copy")).select(
        (F.col("c_custkey") + F.col("copy") * users).alias("c_custkey"), "c_mktsegment"
    ).write.parquet(f"{folder}/customer.parquet")


def main() -> None:
    copies = int(sys.argv[1]) if len(sys.argv) > 1 else 200
    runs = int(sys.argv[2]) if len(sys.argv) > 2 else 3
    spark = build_session(
        "weekpulse-scaling",
        **{
            "spark.master": f"local[{os.environ.get('BENCH_CPUS', '8')}]",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": "16",
            # One file per task. Spark would otherwise put the few files of the two periods in two.
            "spark.sql.files.maxPartitionBytes": "2m",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="run-")
    copied(spark, folder, copies)
    events = spark.read.schema(EVENTS).parquet(f"{folder}/events.parquet")
    customers = spark.read.schema(CUSTOMERS).parquet(f"{folder}/customer.parquet")
    write_fact(events_to_fact(events, customers), f"{folder}/fact")

    def feed():
        return events_to_fact(events, customers, SPEC)

    def table():
        return read_fact(spark, path=f"{folder}/fact", spec=SPEC, day_column=DAY)

    cases = {
        "events": (feed, Report.summary),
        "events, full outer join": (feed, Report.summary_by_join),
        "fact by day": (table, Report.summary),
        "fact by day, full outer join": (table, Report.summary_by_join),
        "fact by day, hourly cube": (table, Report.hourly),
    }
    seconds = {}
    for name, (fact, result) in cases.items():
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            result(Report(fact(), SPEC)).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"events": events.count(), "copies": copies, "seconds": seconds}))
    spark.stop()


if __name__ == "__main__":
    main()
