"""Incident-shaped views over the star-schema test tables.

Each function takes ``(spark, folder)``. The tables hold no nulls, so the
views with gaps blank some values by rule; no view drops rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import COLUMNS
from .operators import panel
from .operators.scale import settle


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def inc(spark: SparkSession, folder: str) -> DataFrame:
    """One incident per order, placed by the customer's nation and region."""
    orders, customer, nation, region = (table(spark, folder, t) for t in ("orders", "customer", "nation", "region"))
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == nation.n_nationkey)
        .join(region, F.col("n_regionkey") == region.r_regionkey)
        .select(
            F.col("o_orderkey").alias("id"), F.col("n_name").alias("unit"), F.col("r_name").alias("state"),
            F.col("n_nationkey").alias("unit_key"), F.col("o_orderdate").alias("dt"),
            F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
            F.quarter("o_orderdate").alias("quarter"), F.col("c_mktsegment").alias("category"),
            F.concat(F.lit("PS-"), F.lpad((F.col("c_custkey") % 47 + 1).cast("string"), 3, "0")).alias("station"),
            F.col("o_totalprice").alias("loss"), F.lit(1.0).alias("weight"),
            F.col("o_orderpriority").alias("channel"),
        )
    )


def inc_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """``inc`` with gaps: loss, category, a flag, and a column that is 80 % null."""
    i = F.col("id")
    return inc(spark, folder).select(
        "id", "unit", "state", "year", "month",
        F.when(i % 17 != 0, F.col("loss")).alias("loss"),
        F.when(i % 23 != 0, F.col("category")).alias("category"),
        F.when(i % 19 != 0, F.col("month").isin(10, 11, 1)).alias("festival"),
        F.when(i % 5 == 0, F.col("loss") / 2).alias("sparse"),
    )


def pts(spark: SparkSession, folder: str) -> DataFrame:
    """``inc`` with coordinates; rows with id % 101 = 0 carry the 0/0 placeholder."""
    i = F.col("id")
    lat = F.when(i % 101 == 0, F.lit(0.0)).otherwise(8 + (i * 7919 % 29000) / F.lit(1000.0))
    lon = F.when(i % 101 == 0, F.lit(0.0)).otherwise(69 + (i * 104729 % 28000) / F.lit(1000.0))
    return inc(spark, folder).withColumns({"lat": lat, "lon": lon})


def unit_month(spark: SparkSession, folder: str) -> DataFrame:
    return panel.unit_month_panel(inc(spark, folder), COLUMNS).withColumn("n", F.col("weight").cast("long"))


def unit_year(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly counts per unit, a table of its own; every fifth unit has no population."""
    keyed = inc(spark, folder).groupBy("state", "unit", "unit_key", "year").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("loss"), 2).alias("loss"))
    return settle(keyed.withColumn(
        "population", F.when(F.col("unit_key") % 5 != 0, (100000 + 37000 * F.col("unit_key")).cast("long"))))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Nations of one region are neighbours; the nation with key 7 has none."""
    nation = table(spark, folder, "nation")
    a, b = nation.alias("a"), nation.alias("b")
    return (
        a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey")))
        .filter((F.col("a.n_nationkey") != 7) & (F.col("b.n_nationkey") != 7))
        .select(F.col("a.n_name").alias("src"), F.col("b.n_name").alias("dst"))
    )


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """A 6-degree rectangle per nation on a 5 x 5 grid, as a closed ring."""
    k = F.col("n_nationkey")
    x0, y0 = 68.0 + 6.0 * (k % 5), 6.0 + 6.0 * F.floor(k / 5)
    corner = lambda dx, dy: F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))
    ring = F.array(corner(0, 0), corner(6, 0), corner(6, 6), corner(0, 6), corner(0, 0))
    return (
        table(spark, folder, "nation")
        .select(F.col("n_name").alias("name"), k.alias("key"), F.col("n_regionkey").alias("region_key"),
                x0.alias("x0"), y0.alias("y0"))
        .select("name", "key", "region_key", ring.alias("ring"))
    )


def plots(spark: SparkSession, folder: str) -> DataFrame:
    """A rectangle per customer, of seven widths and five heights, as a closed ring."""
    k = F.col("c_custkey")
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0"))
    return (
        table(spark, folder, "customer")
        .select(F.col("c_name").alias("name"), k.alias("key"), (69 + (k * 7919 % 28000) / F.lit(1000.0)).alias("x0"),
                (8 + (k * 104729 % 29000) / F.lit(1000.0)).alias("y0"))
        .withColumns({"x1": F.col("x0") + (F.col("key") % 7 + 1) / F.lit(8.0), "y1": F.col("y0") + (F.col("key") % 5 + 1) / F.lit(16.0)})
        .select("name", "key", ring.alias("ring"))
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Unit-months with a stand-in prediction ``p``, a table of its own."""
    return settle(unit_month(spark, folder).withColumn("p", F.col("loss") / 1000))


def ev(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def requests(events: DataFrame) -> DataFrame:
    """Event rows (batch or stream) as web requests."""
    kind, i = F.col("event_type"), F.col("event_id")
    path = (
        F.when(kind == "signup", F.when(i % 2 == 0, "/api/auth/register").otherwise("/api/auth/login"))
        .when(kind == "purchase", F.when(i % 3 == 0, "/api/reports/generate").otherwise("/api/reports/download/7"))
        .when(kind == "error", F.when(i % 4 == 0, "/ws/dashboard").otherwise("/api/auth/logout"))
        .when(kind == "click", F.lit("/api/items"))
        .otherwise(F.lit("/api/dashboard"))
    )
    method = (
        F.when(kind == "signup", "POST").when((kind == "purchase") & (i % 3 == 0), "POST")
        .when(kind == "click", F.element_at(F.array(*map(F.lit, ("POST", "PUT", "PATCH", "DELETE"))),
                                            (i % 4 + 1).cast("int")))
        .otherwise("GET")
    )
    host = F.concat(F.lit("10.0.0."), (F.col("user_id") % 20).cast("string"))
    return events.select(
        "event_id", "ts", "value",
        F.when(i % 3 != 0, F.col("user_id")).alias("user_id"),
        path.alias("path"), method.alias("method"),
        F.when(i % 10 < 7, 200).otherwise(401).alias("status"),
        F.when(i % 5 == 0, F.concat(F.lit(" 172.16.0."), (F.col("user_id") % 9).cast("string"), F.lit(" , 10.1.1.1")))
        .when(i % 5 == 1, F.lit("")).alias("forwarded"),
        F.when(i % 7 != 0, host).alias("host"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("department"),
        F.when(k % 20 == 0, "admin").when(k % 20 <= 3, "officer").otherwise("analyst").alias("role"),
        F.when(k % 9 == 4, "inactive").otherwise("active").alias("status"),
        (k % 50 == 7).alias("is_deleted"),
    )


def reports(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending")
        .otherwise("failed").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"),
    )
