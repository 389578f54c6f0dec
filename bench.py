"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores. Each query runs once
to warm up and then three times; the best time counts. Results go to the ``noop`` sink, so
every row is computed and nothing reaches the driver.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from pollwright.catalog import ballot_queries, files, modelling, power, results  # noqa: F401  (they register)
from pollwright.catalog.fixtures import Tables
from pollwright.catalog.registry import QUERIES
from pollwright.plans import control
from pollwright.session import tune

HEADLINE = [
    "votes_by_year_state",
    "merge_keep_latest_house",
    "align_nearest",
    "interpolate_monthly",
    "fix_unopposed",
    "pivot_vote_shares",
    "borda_count",
    "condorcet",
    "instant_runoff",
    "mixture_log_density",
]
REPLICATES = 200


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pollwright-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)

    runs = {name: QUERIES[name] for name in HEADLINE}
    # The lotteries at the replicate count of a full run.
    runs["house_control_200"] = lambda s, d: control.house_control(Tables(s, d).house, REPLICATES)
    runs["senate_control_200"] = lambda s, d: control.senate_control(Tables(s, d).senate, REPLICATES)
    runs["elector_lottery_200"] = lambda s, d: control.elector_lottery(
        Tables(s, d).president, Tables(s, d).house, REPLICATES
    )

    times = {}
    for name, run in runs.items():
        best = float("inf")
        for attempt in range(4):
            start = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
