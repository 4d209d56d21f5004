"""Print the physical plan tree of registered queries (the operator tree
of ``explain("formatted")``) plus a per-query summary: shuffles, broadcast
joins, nested-loop joins (must be none) and Python evaluation.

usage: python tools/show_plans.py [sf_dir] [query ...]  > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    wanted = sys.argv[2:]
    from jobsift.plans.catalog import queries
    from jobsift.session import get_session
    spark = get_session("local[8]", shuffle_partitions=16)
    print(f"# Physical plans ({os.path.basename(sf_dir)}, local[8], AQE on; initial plans)\n")
    print("| query | shuffles | broadcast joins | sort-merge joins | nested-loop joins | python |")
    print("|---|---|---|---|---|---|")
    trees = {}
    for name, fn in sorted(queries().items()):
        if wanted and name not in wanted:
            continue
        p = plan_text(fn(spark, sf_dir))
        count = lambda pat: len(re.findall(pat, p))
        print(f"| {name} | {count(r'\(\d+\) Exchange')} | {count(r'\(\d+\) BroadcastHashJoin')} | "
              f"{count(r'\(\d+\) SortMergeJoin')} | "
              f"{count(r'\(\d+\) (BroadcastNestedLoopJoin|CartesianProduct)')} | "
              f"{count(r'\(\d+\) (ArrowEvalPython|BatchEvalPython)')} |")
        trees[name] = p.split("\n\n\n")[0]
    for name, tree in trees.items():
        print(f"\n## {name}\n\n```\n{tree.strip()}\n```")


if __name__ == "__main__":
    main()
