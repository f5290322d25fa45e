"""Summarise the physical plans of registered queries.

Usage: python tools/plan_summary.py [sf_dir] [name ...]

For each query prints the number of shuffle exchanges, broadcast exchanges,
window operators, Python (Arrow) stages and the columns every Parquet scan
reads, from ``explain("formatted")`` text — the quick check that filters
and projections reach the scans and that no unexpected shuffle appears.
Queries whose builder writes intermediate tables (index, checkpoints) run
those writes while the plan is built.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def summarise(text: str) -> dict:
    return {
        "shuffles": len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)", text)),
        "broadcasts": text.count("BroadcastExchange"),
        "windows": len(re.findall(r"\bWindow \[", text)),
        "python": len(re.findall(r"MapInPandas|ArrowEvalPython|FlatMapGroupsInPandas", text)),
        "scans": sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", text))),
    }


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and os.path.isdir(args[0]):
        sf_dir, args = args[0], args[1:]
    from quarry.plans import load_all
    from quarry.session import build_session
    reg = load_all()
    spark = build_session("plans", 8)
    for name in args or list(reg):
        df = reg[name][0](spark, sf_dir)
        s = summarise(plan_text(df))
        print(f"{name:24s} shuffles={s['shuffles']:2d} broadcasts={s['broadcasts']:2d} windows={s['windows']:2d} "
              f"python={s['python']}")
        for sc in s["scans"]:
            print(f"{'':24s} scan {sc[:110]}")


if __name__ == "__main__":
    main()
