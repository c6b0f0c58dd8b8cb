"""T: sorted and top-k lists, alerts and the dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import reports
from ..functions.scalar import rounded
from .registry import query, rnd
from .storage import hot_cells, scores

R = rnd


def _latest(ranked):
    return ranked.select("unit", "state", "year", "month", "risk_score", "priority_rank", F.col("p").alias("predicted_count"))


@query("t1_rankings_units", f"""
SELECT unit, year, month, {R('raw_score', 2)} AS risk_score, priority_rank FROM score ORDER BY priority_rank LIMIT 20""", "score")
def t1(spark, d):
    return reports.rankings(scores(spark, d), "priority_rank", 20).select("unit", "year", "month", "risk_score", "priority_rank")


@query("t1_rankings_cells", f"""
SELECT cell, year, month, {R('raw_score', 2)} AS risk_score FROM cell_hot WHERE hotspot_rank <= 20""", "cell_hot")
def t1_cells(spark, d):
    return reports.rankings(hot_cells(spark, d), "hotspot_rank", 20).select("cell", "year", "month", "risk_score")


_ALERTS = f"""
SELECT 'high_risk_district' AS type, CASE WHEN s >= 85 THEN 'critical' ELSE 'high' END AS severity, 'High risk in ' || unit AS title,
  'Risk score ' || CAST(CAST(round(CAST(s AS DECIMAL(18, 4)), 1) AS DECIMAL(18, 1)) AS VARCHAR) || ' (rank #' || CAST(priority_rank AS VARCHAR) || ')' AS description, unit AS subject, s AS score
FROM (SELECT *, {R('raw_score', 2)} AS s FROM score WHERE priority_rank <= 3) WHERE s >= 75
UNION ALL
SELECT 'hotspot', 'high', 'Hotspot detected at ' || cell, 'Score ' || CAST(CAST(round(CAST(s AS DECIMAL(18, 4)), 1) AS DECIMAL(18, 1)) AS VARCHAR) || ' (rank #' || CAST(hotspot_rank AS VARCHAR) || ')', cell, s
FROM (SELECT *, {R('raw_score', 2)} AS s FROM cell_hot WHERE hotspot_rank <= 5) WHERE s >= 80"""


@query("t2_alerts", _ALERTS, "score cell_hot")
def t2(spark, d):
    return reports.alerts(scores(spark, d), hot_cells(spark, d))


@query("t3_order_by", "SELECT unit, year, n, loss FROM unit_year", "unit_year")
def t3(spark, d):
    return reports.order_by(fx.unit_year(spark, d).select("unit", "year", "n", "loss"), "n", False, ["unit", "year"])


@query("t4_top_features", f"""
WITH f AS (SELECT p_type AS feature, avg(p_retailprice) AS m FROM part GROUP BY p_type)
SELECT feature, {R('m', 4)} AS importance, CAST(row_number() OVER (ORDER BY round(m, 4) DESC, feature) AS INTEGER) AS rank FROM f
ORDER BY rank LIMIT 5""")
def t4(spark, d):
    means = fx.table(spark, d, "part").groupBy(F.col("p_type").alias("feature")).agg(
        rounded(F.avg("p_retailprice"), 4).alias("importance"))
    return reports.top_features(means, 5)


@query("t5_dashboard", f"""
WITH alert AS ({_ALERTS})
SELECT 'metrics' AS part, CAST(1 AS BIGINT) AS rows, {R('avg(round(raw_score, 2))', 2)} AS score FROM score
UNION ALL SELECT 'top_units', CAST(count(*) AS BIGINT), {R('sum(s)', 2)} FROM (SELECT round(raw_score, 2) AS s FROM score WHERE priority_rank <= 10)
UNION ALL SELECT 'top_hotspots', CAST(count(*) AS BIGINT), {R('sum(s)', 2)} FROM (SELECT round(raw_score, 2) AS s FROM cell_hot WHERE hotspot_rank <= 10)
UNION ALL SELECT 'alerts', CAST(count(*) AS BIGINT), {R('sum(score)', 2)} FROM alert""", "score cell_hot")
def t5(spark, d):
    parts = reports.dashboard(_latest(scores(spark, d)), hot_cells(spark, d))
    score = {"metrics": "average_risk_score", "top_units": "risk_score", "top_hotspots": "risk_score", "alerts": "score"}
    out = None
    for name, frame in parts.items():
        row = frame.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"), rounded(F.sum(score[name]), 2).alias("score"))
        out = row if out is None else out.unionByName(row)
    return out
