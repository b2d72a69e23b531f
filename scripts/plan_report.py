"""Summarise the physical plan of every registered query (exchanges, joins,
windows, scans with their read schema and pushed filters) into docs/PLANS.md."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict:
    return {
        "exchanges": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "sorts": len(re.findall(r"\bSort \[", plan)),
        "nlj": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
        "scans": sorted(set(re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\]", plan))),
        "pushed": sorted(set(x for x in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if x)),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from spendwatch.plans.catalog import REGISTRY
    from spendwatch.session import get_session
    from spendwatch.sources import tables

    spark = get_session("local[8]", shuffle_partitions=8)
    lines = ["# Physical plans of the registered queries", "",
             f"Generated by `scripts/plan_report.py` at `{sf}` (before AQE re-planning). A query's stages, which it writes",
             "and reads back, come before it as `query / stage`; the stored runs (`runs`) are made once, by the first",
             "query that reads them.", "",
             "| query or stage | exchanges | BHJ | SMJ | nested-loop / cartesian | windows | sorts |",
             "| --- | --- | --- | --- | --- | --- | --- |"]
    detail = []

    def add(name, plan):
        s = summarise(plan)
        lines.append(f"| {name} | {s['exchanges']} | {s['bhj']} | {s['smj']} | {s['nlj']} | {s['windows']} | {s['sorts']} |")
        if s["scans"] or s["pushed"]:
            detail.append(f"### {name}\n")
            detail.extend(f"* scan columns: `{sc[:200]}`" for sc in s["scans"][:6])
            detail.extend(f"* pushed filters: `{p[:200]}`" for p in s["pushed"][:4])
            detail.append("")

    for name, fn in REGISTRY.items():
        tables.STAGE_PLANS = []
        df = fn(spark, sf)
        for stage, plan in tables.STAGE_PLANS:
            add(f"{name} / {stage}", plan)
        add(name, df._jdf.queryExecution().executedPlan().toString())
    tables.drop_stages(spark)
    out = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(out, "w") as f:
        f.write("\n".join(lines + ["", "## Scans", ""] + detail) + "\n")
    print("\n".join(lines))
    spark.stop()


if __name__ == "__main__":
    main()
