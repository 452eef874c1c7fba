"""Write the physical plan trees of the headline queries (plus scan details) to PLANS.md.

usage: python tools/explain_plans.py [sf_dir] [out]
The queries are planned, not run (materialisation steps inside a query do run).
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from yieldnorm.plans import queries as Q  # noqa: E402
from yieldnorm.session import local_session  # noqa: E402

TREE = re.compile(r"^[ :+|-]*[A-Za-z].*\(\d+\)$")
DETAIL = re.compile(r"^(ReadSchema|PushedFilters|Location)\b")


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    lines = buf.getvalue().splitlines()
    tree = [ln for ln in lines if TREE.match(ln) and not ln.startswith("(")]
    scans = []
    current = None
    for ln in lines:
        m = re.match(r"^\((\d+)\) Scan parquet", ln)
        if m:
            current = m.group(1)
        elif current and DETAIL.match(ln):
            if ln.startswith("Location"):
                ln = "Location: " + ln.rsplit("/", 1)[-1].rstrip("]")
            scans.append(f"({current}) {ln}")
        elif not ln.strip():
            current = None
    return "\n".join(tree) + "\n\n" + "\n".join(scans)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    out = sys.argv[2] if len(sys.argv) > 2 else os.path.join(os.path.dirname(os.path.dirname(__file__)), "PLANS.md")
    spark = local_session(8)
    parts = [f"# Physical plans of the headline queries\n\nGenerated by `tools/explain_plans.py` at `{sf_dir}` "
             "(AQE initial plans; materialised tables appear as parquet scans of the checkpoint folder).\n"]
    sections, summary = [], ["| query | shuffles | broadcasts | sort-merge joins | scans |", "| --- | --- | --- | --- | --- |"]
    for name in HEADLINE:
        df = Q.QUERIES[name](spark, sf_dir)
        doc = (Q.QUERIES[name].__doc__ or "").strip().splitlines()
        text = plan_text(df)
        sections.append(f"## {name}\n\n{doc[0] if doc else ''}\n\n```\n{text}\n```\n")
        shuffles = text.count("Exchange (") - text.count("BroadcastExchange (")
        scans = Counter(re.sub(r"-[0-9a-f]{32}$", "", ln.split("Location: ", 1)[1])
                        for ln in text.splitlines() if "Location: " in ln)
        scan_s = ", ".join(f"{k} x{v}" if v > 1 else k for k, v in sorted(scans.items()))
        summary.append(f"| {name} | {shuffles} | {text.count('BroadcastExchange (')} | "
                       f"{text.count('SortMergeJoin')} | {scan_s} |")
    parts.append("\n".join(summary) + "\n\nScans named `station_years`, `mapping`, `fact_*`, `model_table` read "
                 "tables materialised earlier in the same query (small, in the checkpoint folder).\n")
    with open(out, "w") as fh:
        fh.write("\n".join(parts + sections))
    print("wrote", out)


if __name__ == "__main__":
    main()
