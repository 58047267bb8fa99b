"""Bench: wall time of the headline queries at one scale factor.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
Each query is materialised with the ``noop`` sink (full computation, nothing collected), once as
warm-up and then BENCH_RUNS times; the median is reported. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spendsignals.plans.catalog import queries  # noqa: E402
from spendsignals.session import local_session  # noqa: E402

HEADLINE = {
    "q01_transactions": "s01_read_transactions",
    "q02_engineered": "p10_engineered_table",
    "q03_user_risk": "a06_user_risk_profile",
    "q04_significance": "t05_significance_table",
    "q05_compare_models": "x12_compare_models",
    "q06_threshold_sweep": "x06_threshold_sweep",
    "q07_next_txn_dataset": "m16_next_txn_dataset",
    "q08_at_risk": "m17_at_risk_users",
    "q09_nudges": "p26_full_nudge",
    "q10_block_folds": "m15_block_folds",
}


def run_once(spark, fn, sf_dir: str) -> float:
    spark.catalog.clearCache()      # every run starts from the tables
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = os.environ.get("BENCH_ONLY")
    spark = local_session(cpus, shuffle_partitions=max(8, cpus))
    qs = queries()
    out = {}
    for short, name in HEADLINE.items():
        if only and short not in only.split(","):
            continue
        run_once(spark, qs[name], sf_dir)
        out[short] = round(statistics.median(run_once(spark, qs[name], sf_dir) for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median_wall", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus, "spark": spark.version, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
