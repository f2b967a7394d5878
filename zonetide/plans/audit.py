"""Count what matters in every physical plan.

    python -m zonetide.plans.audit [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import contextlib
import io
import re
import sys

from zonetide.plans.catalog import REGISTRY, run
from zonetide.session import local_session

PATTERNS = {
    "exchanges": r"Exchange (?:hash|range)",
    "single": r"Exchange SinglePartition",
    "smj": r"SortMergeJoin",
    "bhj": r"BroadcastHashJoin",
    "nested_loop": r"BroadcastNestedLoopJoin|CartesianProduct",
    "python": r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas|InArrow",
    "group_limit": r"WindowGroupLimit",
}


def plan_text(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def audit(df) -> dict[str, int]:
    text = plan_text(df)
    return {name: len(re.findall(p, text, re.M)) for name, p in PATTERNS.items()}


def main(argv: list[str]) -> None:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session("audit")
    for name in REGISTRY:
        if len(argv) > 2 and not any(name.startswith(p) for p in argv[2:]):
            continue
        counts = audit(run(name, spark, sf_dir))
        print(f"{name:34} " + " ".join(f"{k}={n}" for k, n in counts.items() if n), flush=True)


if __name__ == "__main__":
    main(sys.argv)
