"""Run registered queries beside their SQL twins and report differences.

usage: python tools/check.py [--sf 0.01] [name-part ...]
"""

from __future__ import annotations

import argparse
import pathlib
import sys
import time
import traceback

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from incidentlab.catalog import ORACLES, QUERIES  # noqa: E402
from incidentlab.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def rows_of(frame: pd.DataFrame) -> tuple[list[str], list[tuple[str, ...]]]:
    """Columns by name, values as text, rows sorted."""
    columns = sorted(frame.columns)

    def text(v: object) -> str:
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return "NULL"
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return str(v)
        return repr(float(v)) if isinstance(v, (int, float)) else str(v)

    return columns, sorted(tuple(text(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def compare(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """None when equal, else the first difference."""
    (ca, ra), (cb, rb) = rows_of(ours), rows_of(theirs)
    if ca != cb:
        return f"columns {ca} != {cb}"
    if len(ra) != len(rb):
        return f"rows {len(ra)} != {len(rb)}"
    differing = [(a, b) for a, b in zip(ra, rb) if a != b]
    if differing:
        return f"{len(differing)} of {len(ra)} rows differ; columns {ca}; first {differing[0]}"
    kinds = [(c, str(ours[c].dtype), str(theirs[c].dtype)) for c in ca if str(ours[c].dtype) != str(theirs[c].dtype)
             and not {str(ours[c].dtype), str(theirs[c].dtype)} <= {"object", "str", "string"}]
    return f"dtype note {kinds}" if kinds else None


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("parts", nargs="*")
    opts = args.parse_args()
    folder = f"/root/testdata/sf{opts.sf}"
    spark = build_session(master="local[8]", shuffle_partitions=8, spark__ui__enabled="false", spark__driver__memory="12g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name, fn in QUERIES.items():
        if opts.parts and not any(p in name for p in opts.parts):
            continue
        start = time.time()
        try:
            ours = fn(spark, folder).toPandas()
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name}: {type(error).__name__}: {str(error)[:700]}")
            if opts.parts:
                traceback.print_exc()
            continue
        took = time.time() - start
        if name not in ORACLES:
            print(f"rows {name}: {len(ours)} rows, {took:.2f}s")
            continue
        try:
            problem = compare(ours, con.execute(ORACLES[name]).df())
        except Exception as error:
            problem = f"oracle: {type(error).__name__}: {str(error)[:500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {name}: {len(ours)} rows, {took:.2f}s {problem or ''}", flush=True)
    print("problems:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
