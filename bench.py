"""Benchmark: wall time of every registered query at one scale factor.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (optional comma list).  Each query is run to completion with the
``noop`` sink (every column computed, nothing collected) after one warm-up
query.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from spendwatch.plans.catalog import REGISTRY
    from spendwatch.session import get_session
    from spendwatch.sources import tables

    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus), extra={"spark.driver.memory": "16g"})
    names = only or list(REGISTRY)
    # warm-up: JVM, Parquet readers, codegen caches
    REGISTRY["ingest_metering"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    tables.drop_stages(spark)
    spark.stop()


if __name__ == "__main__":
    main()
