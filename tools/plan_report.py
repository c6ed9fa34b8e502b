"""Summarise the executed physical plan of each headline query.

usage: python tools/plan_report.py [sf_dir] > PLANS.md

Each query is executed on its own into the no-op sink, and its adaptive plan is scanned for shuffles, broadcasts,
join strategies, scans (with their pushed filters) and reused exchanges.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from ledgerlens.catalog import QUERIES, present  # noqa: E402
from ledgerlens.plans.context import Marts  # noqa: E402
from ledgerlens.session import build_session  # noqa: E402


def nodes(plan):
    """Physical operators of an executed plan, descending into adaptive query
    stages."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
        return
    if name.endswith("QueryStageExec"):  # shuffle, broadcast and result stages
        yield from nodes(plan.plan())
        return
    yield name, plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def summarise(plan) -> dict:
    ops = list(nodes(plan))
    count = lambda n: sum(1 for k, _ in ops if k == n)
    keys = set()
    for k, node in ops:
        if k == "ShuffleExchangeExec":
            part = node.outputPartitioning().toString()
            keys.add(re.sub(r"#\d+L?", "", part).replace("hashpartitioning(", "").rsplit(",", 1)[0])
    scans, pushed = [], False
    for k, node in ops:
        if k == "FileSourceScanExec":
            text = node.toString()
            t = re.search(r"/([a-z]+)\.parquet", text)
            cols = len(node.output().toList().toString().split(","))
            scans.append((t.group(1) if t else "?", cols))
            pushed = pushed or ("o_orderdate" in text and "PushedFilters: [" in text and "GreaterThanOrEqual(o_orderdate" in text)
    return {
        "shuffles": count("ShuffleExchangeExec"),
        "shuffle_keys": sorted(keys),
        "broadcasts": count("BroadcastExchangeExec"),
        "bhj": count("BroadcastHashJoinExec"),
        "smj": count("SortMergeJoinExec"),
        "windows": count("WindowExec"),
        "reused": count("ReusedExchangeExec"),
        "scans": scans,
        "pushed_dates": pushed,
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=16)
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `python tools/plan_report.py {sf_dir}` on local[8] with 16 shuffle partitions. "
          "Each query is run in full and its final plan is read: joins that found a small side have become "
          "broadcasts, equal exchanges are reused. "
          "Shuffle keys are hash-partitioning keys of exchanges; scans list table and number of columns "
          "read. Totals that a scalar subquery brings are planned apart and not counted here.\n")
    print("| Query | Shuffles | Shuffle keys | Reused | Broadcasts (BHJ) | SMJ | Windows | Parquet scans (table:cols) | Dates pushed |")
    print("|---|---|---|---|---|---|---|---|---|")
    for key in HEADLINE:
        df = present(QUERIES[key](Marts.load(spark, sf_dir)))
        query = df._jdf.queryExecution()
        query.toRdd().count()  # runs this very plan, so that it is final
        s = summarise(query.executedPlan())
        scans = ", ".join(f"{t}:{n}" for t, n in s["scans"]) or "-"
        print(f"| `{key}` | {s['shuffles']} | {'; '.join(s['shuffle_keys'])} | {s['reused']} | {s['broadcasts']} ({s['bhj']}) | "
              f"{s['smj']} | {s['windows']} | {scans} | {'yes' if s['pushed_dates'] else '-'} |")
    spark.stop()


if __name__ == "__main__":
    main()
