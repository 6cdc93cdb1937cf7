"""Summarise the physical plans of the registered queries into PLANS.md.

usage: python tools/plan_report.py [sf_dir] > PLANS.md
Per query: shuffle exchanges, broadcast exchanges, Python-worker nodes, sorts
and every parquet scan with its pushed filters and read schema (column pruning).
Counts come from the executed adaptive plan's initial form (formatted explain).
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SKIP = {"tree_attributions", "logistic", "decision_tree", "random_forest", "approval", "default_pd", "interest_rf",
        "segments", "isolation_forest", "score", "runs_view", "feature_importance", "detect_columns",
        "score_stream", "kpi_stream", "kpi_stream_windowed", "score_requests", "score_stream_models",
        "v1_predictions", "v1_comparison", "v1_summary", "v1_report", "v1_roc"}


def main() -> None:
    from riskline.plans.registry import QUERIES
    from riskline.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_report.py` on `{sf}` (local mode, AQE on). Model and streaming queries are")
    print("omitted (their plans are Spark ML transforms / stream sinks). `shuffles` counts hash/range/single")
    print("exchanges; `broadcasts` broadcast exchanges; `python` Arrow/pandas worker nodes.\n")
    print("| query | shuffles | broadcasts | python | sorts | scans (pushed filters; read schema) |")
    print("|---|---|---|---|---|---|")
    for name, fn in QUERIES.items():
        if name in SKIP:
            continue
        df = fn(spark, sf)
        txt = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        tree = txt.split("\n\n")[0]
        shuffles = len(re.findall(r"(?<![A-Za-z])Exchange \(\d+\)", tree))
        broadcasts = len(re.findall(r"BroadcastExchange \(\d+\)", tree))
        python = tree.count("ArrowEvalPython") + tree.count("FlatMapGroupsInPandas") + tree.count("MapInPandas")
        sorts = len(re.findall(r"(?<![A-Za-z])Sort \(\d+\)", tree))
        scans = []
        for m in re.finditer(r"Scan parquet[^\n]*\n(?:[^\n]*\n){0,8}?(?:PushedFilters: (\[[^\n]*\])\n)?ReadSchema: (struct<[^\n]*>)", txt):
            cols = re.findall(r"(\w+):", m.group(2))
            scans.append(f"{m.group(1) or '[]'}; {len(cols)} cols: {', '.join(cols[:8])}{'…' if len(cols) > 8 else ''}")
        print(f"| {name} | {shuffles} | {broadcasts} | {python} | {sorts} | {'<br>'.join(sorted(set(scans)))} |")


if __name__ == "__main__":
    main()
