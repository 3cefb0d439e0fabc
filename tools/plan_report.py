"""Summarise the physical plans of registered queries.

usage: python tools/plan_report.py [sf_dir] [name ...]
For each query: shuffle exchanges, broadcasts, nested-loop joins, Python
evaluation nodes, windows, sorts and whole-stage-codegen spans of the final
physical plan as planned (before adaptive re-optimisation).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sigfolio.plans.registry import QUERIES, load_all  # noqa: E402
from sigfolio.session import build_session  # noqa: E402

NODES = {
    "shuffle": r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)",
    "broadcast": r"BroadcastExchange",
    "bhj": r"BroadcastHashJoin",
    "smj": r"SortMergeJoin",
    "bnlj": r"BroadcastNestedLoopJoin",
    "python": r"(FlatMapGroupsInPandas|MapInPandas|ArrowEvalPython|BatchEvalPython)",
    "window": r"\bWindow\b",
    "reused": r"ReusedExchange",
}


def summary(df) -> dict:
    # the physical plan before adaptive re-optimisation (AQE may still
    # coalesce, reuse or switch joins at run time)
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {k: len(re.findall(p, plan)) for k, p in NODES.items()}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    load_all()
    spark = build_session("local[8]")
    print("| query | shuffles | reused | broadcasts | BHJ | SMJ | BNLJ | Python | windows |")
    print("|---|---|---|---|---|---|---|---|---|")
    for name in names or sorted(QUERIES):
        s = summary(QUERIES[name](spark, sf))
        print(f"| {name} | {s['shuffle']} | {s['reused']} | {s['broadcast']} | {s['bhj']} | {s['smj']} | {s['bnlj']} | "
              f"{s['python']} | {s['window']} |")
    spark.stop()


if __name__ == "__main__":
    main()
