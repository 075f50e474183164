"""Seconds per registered query at ``$BENCH_SF_DIR``, on ``local[$BENCH_CPUS]``; one JSON line.

Each query runs twice, declared anew, with all columns and rows computed; the second run counts, so
that JVM start-up and first-time code generation stay out of the figures.
"""

from __future__ import annotations

import json
import os
import time

from ward_analytics.plans.queries import REGISTRY
from ward_analytics.session import local_session


def seconds(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", cpus=int(os.environ.get("BENCH_CPUS", "8")), memory="16g")
    chosen = os.environ.get("BENCH_QUERIES", "").split(",")
    times = {}
    for name, query in REGISTRY.items():
        if chosen != [""] and name not in chosen:
            continue
        run = lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds(run)
        times[name] = seconds(run)
    spark.stop()
    print(
        json.dumps({
            "metric": "total_query_seconds",
            "value": round(sum(times.values()), 3),
            "unit": "sec",
            "queries": times,
            "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        })
    )


if __name__ == "__main__":
    main()
