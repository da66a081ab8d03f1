"""Headline queries at one scale, one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set it up."""

from __future__ import annotations

import json
import os
import time

from grainwise.plans import load
from grainwise.session import local_session

# One query per family of the reference's own timings.
HEADLINE = (
    "summary_stats", "frequency", "top_n", "distribution", "cross_tab_count", "group_compare", "pareto",
    "concentration", "ranking_shift", "calendar_coverage_month", "trend", "seasonality_month", "period_compare",
    "growth_decomposition", "correlation", "bivariate", "driver_analysis", "mix_shift", "changepoint",
    "outliers_global", "correlated_shift", "kruskal", "ci_mean", "eta_squared", "sample_adequacy",
    "repeat_behaviour", "cohort_retention", "describe_dataset", "profile_table", "clean_plan", "validation_report",
    "key_verify", "exact_copies", "load_csv_typed",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("OFF")
    catalogue = load()
    # Start the JVM's compilers on a query that is not timed.
    catalogue["scope_counts"].run(spark, folder).collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            began = time.perf_counter()
            catalogue[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
