"""Benchmark: run the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (every row is
computed, nothing is collected to the driver). Binding the driver tables
(the customer sequence, written once) is timed separately as
``bind_tables``. Before timing, every query runs once untimed on the
smallest driver folder (``BENCH_WARMUP_DIR``, default the sf0.001 sibling;
empty to skip) so JIT compilation of Spark's own code is not billed to the
first queries. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from kartlens.plans import registry  # noqa: E402
from kartlens.session import local_session  # noqa: E402

# The thirteen reference steps, then the variants and dashboard data.
HEADLINE = [
    "global_repurchase_cycle",
    "repurchase_cycle_by_product",
    "repurchase_cycle_by_department",
    "repurchase_lift_by_product",
    "repurchase_lift_by_department",
    "global_order_size",
    "order_size_by_product",
    "order_size_by_department",
    "order_size_lift_by_product",
    "order_size_lift_by_department",
    "copurchase_pairs",
    "copurchase_share",
    "product_behavior_export",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    ncpu = os.cpu_count() if cpus == "*" else int(cpus)
    # One shuffle partition per core: local data is small and AQE coalesces further.
    spark = local_session(cpus, shuffle_partitions=max(ncpu, 4), app="kartlens-bench")
    queries = registry.queries()
    names = only.split(",") if only else HEADLINE + [k for k in queries if k not in HEADLINE]

    warm_dir = os.environ.get("BENCH_WARMUP_DIR", os.path.join(os.path.dirname(sf_dir), "sf0.001"))
    warmed = bool(warm_dir) and os.path.isdir(warm_dir) and warm_dir.rstrip("/") != sf_dir
    if warmed:
        for name in names:
            queries[name](spark, warm_dir).write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}
    t0 = time.perf_counter()
    registry.tables_for(spark, sf_dir)
    timings["bind_tables"] = round(time.perf_counter() - t0, 3)

    for name in names:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)

    headline = [n for n in HEADLINE if n in timings]
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "headline_value": round(sum(timings[n] for n in headline) + timings["bind_tables"], 3),
                "queries": timings,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
                "warmup": os.path.basename(warm_dir.rstrip("/")) if warmed else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
