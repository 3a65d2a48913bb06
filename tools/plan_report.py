"""Summarise the physical plans of the headline queries.

For every query: shuffles (Exchange hashpartitioning / rangepartitioning /
single), broadcasts, join strategies, windows and which aggregate
implementation Spark chose. Prints a markdown table (the source of
PLANS.md). Plans are taken before execution (AQE may still turn a
sort-merge join into a broadcast at run time when a side turns out small).

usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402

PATTERNS = {
    "shuffles": r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)",
    "broadcasts": r"BroadcastExchange",
    "SMJ": r"SortMergeJoin",
    "BHJ": r"BroadcastHashJoin",
    "BNLJ": r"BroadcastNestedLoopJoin",
    "windows": r"\bWindow \[",
    "win-group-limit": r"WindowGroupLimit",
    "hash-agg": r"\bHashAggregate\(",
    "sort-agg": r"\bSortAggregate\(",
    "obj-hash-agg": r"ObjectHashAggregate\(",
    "python": r"(ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas)",
}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from cadenza.registry import QUERIES
    from cadenza.session import local_session

    spark = local_session()
    extra = ["like_tag_match_filtered", "index_with_langid", "stream_scoreboard_final"]
    names = [n for n in HEADLINE + extra if n in QUERIES and not n.startswith("stream_")]
    print("| query | " + " | ".join(PATTERNS) + " |")
    print("| --- | " + " | ".join("---" for _ in PATTERNS) + " |")
    for name in names:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        counts = [len(re.findall(p, plan)) for p in PATTERNS.values()]
        print(f"| `{name}` | " + " | ".join(str(c) for c in counts) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
