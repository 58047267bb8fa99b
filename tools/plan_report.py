"""Write PLANS.md: for each headline query, the shuffles, broadcasts, windows and scans of the
executed (adaptive) plan. Usage: python tools/plan_report.py [sf_dir] > PLANS.md"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from spendsignals.plans.catalog import queries  # noqa: E402
from spendsignals.session import local_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    qs = queries()
    print("# PLANS\n")
    print(f"Executed plans of the headline queries at `{os.path.basename(sf)}`, local[8], AQE on (final adaptive plan")
    print("after running with the `noop` sink). Eager helper jobs (hot-key detection, checkpoints of")
    print("scored rows, user-grain tables, range buckets, rank selection) run before and are not part of these plans.\n")
    print("| query | shuffle exchanges | broadcasts | window ops | scans (columns read) |")
    print("|---|---|---|---|---|")
    for short, name in HEADLINE.items():
        df = qs[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles = re.findall(r"Exchange (hashpartitioning\([^)]*\)|rangepartitioning|SinglePartition|RoundRobinPartitioning)", plan)
        kinds = {}
        for s in shuffles:
            k = s.split("(")[0] + ("(" + s.split("(")[1].split("#")[0] + ")" if "(" in s else "")
            kinds[k] = kinds.get(k, 0) + 1
        scans = re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\][^\n]*?Location: InMemoryFileIndex\(\d+ paths\)\[file:[^\]]*/([^/\]]+)\]", plan)
        windows = len(re.findall(r"(?<![A-Za-z])Window \[", plan))
        scan_txt = "; ".join(f"{t}: {len(c.split(','))}" for c, t in scans) or "checkpoint"
        print(f"| {short} (`{name}`) | {sum(kinds.values())}: " + ", ".join(f"{k} x{v}" for k, v in kinds.items())
              + f" | {plan.count('BroadcastExchange')} | {windows} | {scan_txt} |")
    spark.stop()


if __name__ == "__main__":
    main()
