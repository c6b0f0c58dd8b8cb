"""The building blocks that keep operators distributed, against their plain counterparts."""

from __future__ import annotations

import math
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from incidentlab import fixtures as fx
from incidentlab.operators import allocate, scale, spatial


def test_global_row_number_equals_one_window(spark, data):
    df = fx.table(spark, data, "orders").select("o_orderkey", F.round("o_totalprice", -5).alias("v"))
    order = [F.col("v").desc(), F.col("o_orderkey").asc()]
    ours = scale.global_row_number(df, order, "r")
    plain = df.withColumn("r", F.row_number().over(Window.orderBy(*order)).cast("long"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect()))


def test_global_row_number_with_one_hot_value(spark):
    df = spark.range(5000).withColumn("v", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11))
    ranks = [r["r"] for r in scale.global_row_number(df, [F.col("v"), F.col("id")], "r").orderBy("v", "id").collect()]
    assert ranks == list(range(1, 5001))


def test_global_row_number_empty(spark):
    assert scale.global_row_number(spark.range(0), ["id"], "r").count() == 0


@pytest.mark.parametrize("values", [
    list(range(1001)), list(range(1000)), [5] * 400 + list(range(600)), [1, 1, 1, 2], [float(i % 17) for i in range(997)],
    [0.5, 0.25] * 300 + [9.0],
])
def test_median_is_exact(spark, values):
    df = spark.createDataFrame([(float(v), None if i % 7 == 0 else float(-v)) for i, v in enumerate(values)], "a double, b double")
    got = scale.exact_medians(df, ["a", "b"])
    assert got["a"] == statistics.median(values)
    assert got["b"] == statistics.median([-float(v) for i, v in enumerate(values) if i % 7 != 0])


def test_median_of_many_distinct_values(spark):
    df = spark.range(200_001).select(((F.col("id") * 7919) % 200_003).cast("double").alias("v"))
    rows = sorted((i * 7919) % 200_003 for i in range(200_001))
    assert scale.exact_medians(df, ["v"])["v"] == float(rows[100_000])


EDGES = [0.0, -0.0, 5e-324, 1e-310, 2.0 ** -1022, 1e-300, 1.0, 1.0 + 2.0 ** -52, 2.0, 3.0, 2.0 ** 53, 1e300, 1.7976931348623157e308, float("inf")]


def test_codes_order_as_numbers(spark):
    """The bits of the number, next to every power of two as well."""
    values = sorted({*EDGES, *(-v for v in EDGES), *(s * math.nextafter(2.0 ** e, to) for e in range(-1073, 1024, 7) for to in (0.0, math.inf) for s in (1, -1)),
                     *(2.0 ** e for e in range(-1074, 1024, 11))})
    got = {r.v: r.c for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", scale.order_code(F.col("v")).alias("c")).collect()}
    codes = [got[v] for v in values]
    assert codes == sorted(codes) and len(set(codes)) == len(values)
    assert all(scale.code_value(got[v]) == v for v in values)
    nan = spark.createDataFrame([(float("nan"),), (None,)], "v double").select(scale.order_code(F.col("v")).alias("c")).collect()
    assert nan[0].c > max(codes) and nan[1].c is None


def test_median_takes_the_same_passes_for_any_data(spark, monkeypatch):
    frames = [spark.range(999).select(F.lit(3.5).alias("v")), spark.range(1000).select((F.col("id") % 2).cast("double").alias("v")),
              spark.range(1001).select((F.xxhash64("id") / 1e5).alias("v"))]
    want = [3.5, 0.5, statistics.median([r.v for r in frames[2].collect()])]
    passes = []
    collect = type(frames[0]).collect
    monkeypatch.setattr(type(frames[0]), "collect", lambda self: passes.append(1) or collect(self))
    for frame, middle in zip(frames, want):
        passes.clear()
        assert scale.exact_medians(frame, ["v"], {"v": frame.count()})["v"] == middle
        assert len(passes) == 4


def test_median_of_nothing_is_null(spark):
    assert scale.exact_medians(spark.createDataFrame([(None,)], "v double"), ["v"]) == {"v": None}


def test_top_k_per_group_equals_one_window(spark, data):
    df = fx.table(spark, data, "lineitem").select("l_returnflag", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_partkey", "l_linenumber"]
    ours = scale.top_k_per_group(df, ["l_returnflag"], order, 10, "r", "l_orderkey", salts=5)
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("l_returnflag").orderBy(*order))).filter("r <= 10")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect()))


def test_capped_sample_cuts_map_side(spark, data):
    plan = allocate.capped_sample(fx.inc(spark, data).select("id", "unit"), ["unit"], "id", 5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 4


def test_joins_with_totals_start_no_job_and_broadcast_when_run(spark, data):
    tracker = spark.sparkContext.statusTracker()
    members, incidents = fx.unit_year(spark, data), fx.inc(spark, data)
    spark.sparkContext.setJobGroup("planning", "no job while a plan is built")
    built = [allocate.apportion(members.withColumns({"t": F.lit(100), "s": F.lit(0.1)}), ["state"], "unit", "t", "s"),
             allocate.share_score(members.selectExpr("*", "n as a"), ["state"], {"a": 1.0}),
             spatial.crosswalk(members.select(F.col("unit").alias("name")).distinct(),
                               members.select(F.col("unit").alias("name"), F.lit("x").alias("source"), F.lit(True).alias("approximate"))),
             spatial.attach_unit_features(incidents, members)]
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for frame in built:
        frame.collect()
        assert "BroadcastHashJoin" in frame._jdf.queryExecution().executedPlan().toString()
