"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the local cores. Each
query is executed in full through a no-op sink, so nothing is gathered on the driver. A figure is the
median of three warm runs after a first one that compiles code.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from signalops.plans.suite import QUERIES
from signalops.session import local_session

# Left out of the default run: grids of many Spark ML fits, which measure the fit count.
SLOW = {"ml_grid"}
WARM = 3


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or [n for n in QUERIES if n not in SLOW]
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    QUERIES["run_counts"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for n in names:
        try:
            runs = []
            for _ in range(1 + WARM):
                t = time.perf_counter()
                QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - t)
                spark.catalog.clearCache()
            seconds[n] = round(statistics.median(runs[1:]), 3)
        except Exception as e:
            print(f"{n}: {type(e).__name__}: {e}", file=sys.stderr)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
