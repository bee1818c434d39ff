"""Summarize the final physical plan of every registered query (after AQE).

Usage: python scripts/plan_report.py [sf_dir] > plan_table.md

Counts shuffles, reused exchanges, broadcasts, join and aggregate strategies,
and scans with pushed filters, from the plan each query actually ran.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from changeflow.plans.registry import QUERIES  # noqa: E402
from changeflow.session import build_session  # noqa: E402

MARKS = {
    "shuffles": r"\bExchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)",
    "reused": r"\bReusedExchange\b",
    "broadcasts": r"\bBroadcastExchange\b",
    "SMJ": r"\bSortMergeJoin\b",
    "BHJ": r"\bBroadcastHashJoin\b",
    "hash agg": r"\bHashAggregate\b",
    "sort agg": r"\bSortAggregate\b",
    "object agg": r"\bObjectHashAggregate\b",
    "top-k": r"\bTakeOrderedAndProject\b",
    "scans": r"\bFileScan parquet\b",
    "pushed scans": r"PushedFilters: \[(?!\])",
}


def final_plan(df) -> str:
    """The plan AQE settled on: the query's own execution (collect) records it."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    print("| query | " + " | ".join(MARKS) + " |")
    print("|---|" + "---|" * len(MARKS))
    for name, fn in QUERIES.items():
        if name.startswith("stream_"):
            continue
        plan = final_plan(fn(spark, sf))
        counts = [len(re.findall(p, plan)) for p in MARKS.values()]
        print(f"| {name} | " + " | ".join(str(c) for c in counts) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
