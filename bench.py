"""Benchmark the named capacity queries.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1), runs on
``local[$BENCH_CPUS]`` (default 8) and prints one JSON line.

Method (as the reference's benchmark): the fact is built and written once
(timed separately as ``fact_build_sec``), one untimed pass over all queries
warms the JVM, then each query gets 1 warm-up and 3 timed runs; the figure is the mean wall time with the result fetched
to the driver. ``value`` is the sum of the per-query means on the columnar
(partitioned Parquet) fact. As the reference's benchmark compares a row store
with a column store, the same catalogue is also timed on a row-layout copy
(CSV, no partitions) and both copies' storage is reported
(``BENCH_ROW_LAYOUT=0`` skips this).
"""

from __future__ import annotations

import datetime as dt
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wingspan import schemas as S  # noqa: E402
from wingspan.plans import catalog as Q  # noqa: E402
from wingspan.plans import rollups  # noqa: E402
from wingspan.plans.fixture import fact_path, flights, rollup_path  # noqa: E402
from wingspan.session import build_session, scratch_path  # noqa: E402
from wingspan.sources import profile, raw, sinks  # noqa: E402

AS_OF = dt.date(2001, 8, 1)
HEADLINE = [
    "top_10_hubs",
    "regional_capacity",
    "underserved_routes",
    "capacity_trends",
    "distance_analysis",
    "hub_concentration",
    "regional_flow_matrix",
    "capacity_trend_series",
    "month_over_month",
]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", app="wingspan-bench", shuffle_partitions=cpus, driver_memory="16g")

    t0 = time.perf_counter()
    fact = flights(spark, sf_dir)
    fact_rows = fact.count()
    build = time.perf_counter() - t0

    # JIT warm-up of the engine (a long-running service is warm): untimed
    # passes over the catalogue before anything is timed. No results are
    # cached anywhere; every timed run re-executes its whole plan.
    passes = int(os.environ.get("BENCH_WARMUP_PASSES", "1"))
    for _ in range(passes):
        for key in HEADLINE:
            params = {"regions": REGIONS} if key == "regional_flow_matrix" else {}
            Q.run(key, flights(spark, sf_dir), AS_OF, **params).collect()

    def time_all(frame) -> tuple[dict[str, float], dict[str, int]]:
        timings: dict[str, float] = {}
        rows: dict[str, int] = {}
        for key in HEADLINE:
            params = {"regions": REGIONS} if key == "regional_flow_matrix" else {}

            def once() -> int:
                return len(Q.run(key, frame(), AS_OF, **params).collect())

            rows[key] = once()  # warm-up
            samples = []
            for _ in range(runs):
                t = time.perf_counter()
                once()
                samples.append(time.perf_counter() - t)
            timings[key] = round(statistics.mean(samples), 4)
        return timings, rows

    timings, rows = time_all(lambda: flights(spark, sf_dir))

    # Q1 and Q4 from their monthly bitmaps, and what a job that does next to nothing takes here.
    bases = {n: rollup_path(spark, sf_dir, n) for n in ("HUBS", "TRENDS")}

    def mean_of(once) -> float:
        once()
        samples = []
        for _ in range(runs):
            t = time.perf_counter()
            once()
            samples.append(time.perf_counter() - t)
        return round(statistics.mean(samples), 4)

    rollup = {
        "top_10_hubs": mean_of(lambda: rollups.top_10_hubs(flights(spark, sf_dir), bases["HUBS"], AS_OF).collect()),
        "capacity_trends": mean_of(lambda: rollups.capacity_trends(flights(spark, sf_dir), bases["TRENDS"], AS_OF).collect()),
        "job_floor": mean_of(lambda: spark.range(10).count()),
    }

    # The reference compares a row store with a column store: the same
    # catalogue on the fact's row-layout copy (its enriched CSV format, no
    # partitions) and the storage of both copies.
    extra = {}
    if os.environ.get("BENCH_ROW_LAYOUT", "1") == "1":
        row_path = scratch_path(spark, "bench-row-layout")
        sinks.write_fact_csv(fact, row_path)
        row_fact = raw.read_fact_csv(spark, row_path)
        row_timings, _ = time_all(lambda: row_fact)
        col_p = profile.table_profile(spark, fact_path(spark, sf_dir), "parquet", "columnar", schema=S.FACT)
        row_p = profile.table_profile(spark, row_path, "csv", "row", schema=S.FACT_CSV, options={"header": "true"})
        storage = profile.compare_storage(row_p, col_p).first()
        extra = {
            "row_layout_queries": row_timings,
            "row_layout_total_sec": round(sum(row_timings.values()), 4),
            "columnar_speedup": round(sum(row_timings.values()) / sum(timings.values()), 2),
            "storage_mb": {"row": storage["row_total_mb"], "columnar": storage["col_total_mb"],
                           "ratio": storage["compression_ratio"]},
        }

    sf = os.path.basename(sf_dir).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "named_query_total_mean_sec",
                "value": round(sum(timings.values()), 4),
                "unit": "sec",
                "queries": timings,
                "rollup_queries": rollup,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "rows": rows,
                "fact_rows": fact_rows,
                "fact_build_sec": round(build, 3),
                "spark": spark.version,
                "master": f"local[{cpus}]",
                "method": f"{passes} warm-up pass(es) over all queries, then per query 1 warm-up + mean of {runs} runs, result collected",
                **extra,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
