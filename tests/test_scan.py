"""The exponential mean as a scan against its recursion, on long, short and broken series."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from incidentlab.columns import Columns
from incidentlab.operators import scan, temporal
from incidentlab.operators.scale import global_row_number, settle

COLS = Columns()
SCHEMA = "unit string, year int, month int, v double"


def recursion(values, span=6):
    """Mean before each value, row by row."""
    alpha, mean, weight, out = 2 / (span + 1), None, 1.0, []
    for x in values:
        out.append(mean)
        if x is None:
            weight = weight * (1 - alpha) if mean is not None else 1.0
        elif mean is None:
            mean, weight = x, 1.0
        else:
            old = weight * (1 - alpha)
            mean, weight = (mean * old + alpha * x) / (old + alpha), 1.0
    return out


def same(got, want, tolerance):
    return len(got) == len(want) and all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=tolerance, abs_tol=1e-9))
                                         for a, b in zip(got, want))


def means(spark, series, parts=5):
    rows = [(unit, 1 + i // 12, 1 + i % 12, x) for unit, values in series.items() for i, x in enumerate(values)]
    random.Random(4).shuffle(rows)
    frame = temporal.ema(spark.createDataFrame(rows, SCHEMA).repartition(parts), ["unit"], "v", cols=COLS)
    got = {}
    for r in sorted(frame.collect(), key=lambda r: (r.unit is not None, r.unit or "", r.year, r.month)):
        got.setdefault(r.unit, []).append(r.ema_6m)
    return got


def test_series_of_all_lengths_equal_the_recursion(spark):
    rng = random.Random(7)
    value = lambda: None if rng.random() < 0.3 else rng.uniform(-50, 1000)
    series = {f"u{n:04d}": [value() for _ in range(n)] for n in (1, 2, 3, 31, 32, 33, 64, 100, 500)}
    series |= {"nulls": [None] * 70, "late": [None] * 40 + [3.0, None, 5.0] + [None] * 60 + [1.0, 2.0], "flat": [7.0] * 90, None: [1.0, 2.0, 4.0]}
    got = means(spark, series)
    for unit, values in series.items():
        assert same(got[unit], recursion(values), 1e-12), unit


def test_one_long_series_is_spread_over_tasks(spark):
    frame = spark.range(40_000).select(F.lit("u").alias("unit"), (F.col("id") / 12).cast("int").alias("year"),
                                       (F.col("id") % 12 + 1).cast("int").alias("month"),
                                       F.when(F.col("id") % 11 > 0, (F.xxhash64("id") % 1000).cast("double")).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = settle(temporal.ema(frame, ["unit"], "v", cols=COLS))
        sizes = [r["count"] for r in held.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = sorted(held.collect(), key=lambda r: (r.year, r.month))
    assert same([r.ema_6m for r in got], recursion([r.v for r in got]), 1e-11)
    assert len(sizes) >= 4 and max(sizes) < 20_000  # neighbouring blocks of blocks stay together


def test_prefixes_of_any_associative_step(spark):
    """Strings joined: the order of all rows before shows whole."""
    rows = [(i, chr(97 + i * 7 % 26)) for i in range(150)]
    frame = global_row_number(spark.createDataFrame(rows, "i int, c string").repartition(4), ["i"], "at").withColumn("at", F.col("at") - 1)
    got = {r.i: r.p for r in scan.prefixes(frame, "at", F.struct("c"), lambda a, b: F.struct(F.concat(a["c"], b["c"]).alias("c")), "p", 150, 4).collect()}
    whole = "".join(c for _, c in rows)
    assert got[0] is None and all(got[i].c == whole[:i] for i in range(1, 150))


def test_empty_table(spark):
    assert temporal.ema(spark.createDataFrame([], SCHEMA), ["unit"], "v", cols=COLS).count() == 0
