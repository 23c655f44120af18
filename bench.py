"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed in full through the ``noop`` sink (no collection to the driver),
three times: ``queries`` holds the faster of runs 2 and 3 (steady state), ``cold_queries``
the first, which includes whole-stage code generation for that query shape.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scorebook.session import local_session  # noqa: E402

HEADLINE = [
    "metrics",              # A1-A8 + A21: flagship per-condition table
    "per_class_metrics",
    "parse_labels",         # L0-L6 over whole documents
    "mcnemar",              # M1-M5 via bitmask Gram matrices
    "bootstrap_cis",        # B1, 2,000 replicates per condition
    "calibration",          # A17-A21
    "roc_macro_grid",       # F7 / J9
    "cost_summary",
    "batch_inference",      # D1
    "full_analysis",        # E1 end to end: every analysis table
]


def full_analysis(spark, sf_dir):
    from scorebook.plans.analysis import run_full_analysis
    from scorebook.sources.fixtures import eval_results
    a = run_full_analysis(eval_results(spark, sf_dir))
    return [a.metrics, a.per_class_metrics, a.confusion_cells, a.bootstrap_cis,
            a.mcnemar_results, a.calibration, a.reliability], a.release


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus)), app="scorebook-bench")
    from scorebook.plans import registry
    spark.range(1000).selectExpr("sum(id)").collect()       # JVM warm-up
    cold, warm = {}, {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            spark.catalog.clearCache()      # no run is served from tables an earlier one kept
            # first run pays code generation; then steady state
            t0 = time.perf_counter()
            if name == "full_analysis":
                tables, done = full_analysis(spark, sf_dir)
                for df in tables:
                    df.write.format("noop").mode("overwrite").save()
                done()
            else:
                registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - t0, 3))
        cold[name], warm[name] = runs[0], min(runs[1:])
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_warm", "value": round(sum(warm.values()), 3),
                      "unit": "sec", "queries": warm, "sf": sf,
                      "cold_queries": cold, "cold_total": round(sum(cold.values()), 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
