"""List plan features of registered queries that deserve a look.

usage: python tools/plans.py [--sf 0.001] [name-part ...]
"""

from __future__ import annotations

import argparse
import pathlib
import re
import sys

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from incidentlab.catalog import QUERIES  # noqa: E402
from incidentlab.session import build_session  # noqa: E402

PATTERNS = {
    "cartesian": r"CartesianProduct", "nested loop": r"BroadcastNestedLoopJoin",
    "python": r"PythonUDF|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas",
    "global window": r"\n[^\n]*\bWindow \[[^\n]*\n[^\n]*\n[^\n]*Exchange SinglePartition",
}


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.001")
    args.add_argument("parts", nargs="*")
    opts = args.parse_args()
    spark = build_session(master="local[8]", shuffle_partitions=8, spark__ui__enabled="false", spark__driver__memory="8g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in QUERIES.items():
        if opts.parts and not any(p in name for p in opts.parts):
            continue
        text = plan_text(fn(spark, f"/root/testdata/sf{opts.sf}"))
        found = [label for label, pattern in PATTERNS.items() if re.search(pattern, text)]
        print(f"{name}: exchanges={len(re.findall('Exchange hashpartitioning', text))} {' '.join(found)}", flush=True)


if __name__ == "__main__":
    main()
