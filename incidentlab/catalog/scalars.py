"""F: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import geo, scalar as sc
from ..operators import access, risk
from ..plans import enrich
from .joins import unit_year_chain
from ..functions.scalar import rounded
from .registry import query, rnd

R = rnd


@query("f1_seasonal", f"""
SELECT unit, year, month, {R('sin(2 * pi() * month / 12)')} AS month_sin, {R('cos(2 * pi() * month / 12)')} AS month_cos,
  {R('sin(2 * pi() * quarter / 4)')} AS quarter_sin, {R('cos(2 * pi() * quarter / 4)')} AS quarter_cos FROM unit_month""", "unit_month")
def f1(spark, d):
    df = fx.unit_month(spark, d)
    new = sc.seasonal_columns(df.columns)
    return df.select("unit", "year", "month", *[(rounded(c, 6) + F.lit(0.0)).alias(n) for n, c in new.items()])


@query("f2_haversine", f"""
SELECT id, {R('2 * 6371 * asin(least(1, sqrt(a)))', 2)} AS km FROM (
  SELECT id, pow(sin(radians(23 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(23)) * pow(sin(radians(82 - lon) / 2), 2) AS a FROM pts)""",
       "pts")
def f2(spark, d):
    return fx.pts(spark, d).select("id", sc.haversine_km("lat", "lon", F.lit(23.0), F.lit(82.0)).alias("km"))


@query("f3_rate_100k", f"""
SELECT state, unit, year, {R('CASE WHEN population > 0 THEN CAST(n AS DOUBLE) / population * 100000 END')} AS rate,
  {R('n / (population + CAST(1e-6 AS DOUBLE)) * 100000')} AS smoothed FROM unit_year""", "unit_year")
def f3(spark, d):
    return fx.unit_year(spark, d).select(
        "state", "unit", "year", rounded(sc.rate_100k("n", "population"), 6).alias("rate"),
        rounded(sc.rate_100k_smoothed("n", "population"), 6).alias("smoothed"))


@query("f4_risk_index", "SELECT state, unit, year, risk_index FROM uy_risk", "uy_risk")
def f4(spark, d):
    near = enrich.unit_year_neighbours(unit_year_chain(spark, d), fx.edges(spark, d), "n")
    return risk.with_risk_index(near, "n", "rate_100k", "growth_rate", "neighbor_risk").select("state", "unit", "year", "risk_index")


@query("f5_density_proxies", f"""
SELECT id, {R('''coalesce(profile, CASE coalesce(tier, 'mid') WHEN 'high' THEN CAST(0.6 AS DOUBLE) WHEN 'low' THEN CAST(0.25 AS DOUBLE)
  ELSE CAST(0.4 AS DOUBLE) END * CASE WHEN urban = 'Urban' THEN CAST(1.2 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END)''', 3)} AS commercial_density,
  nullif(density, 0) AS urban_density FROM (
  SELECT id, CASE WHEN state = 'ASIA' THEN 'high' WHEN state = 'AFRICA' THEN 'low' WHEN state = 'EUROPE' THEN 'mid' END AS tier,
    CASE WHEN unit_key % 2 = 0 THEN 'Urban' ELSE 'Rural' END AS urban,
    CASE WHEN unit_key = 8 THEN CAST(0.95 AS DOUBLE) END AS profile, CASE WHEN state = 'ASIA' THEN CAST(unit_key * 1000 - 8000 AS DOUBLE) END AS density
  FROM inc)""", "inc")
def f5(spark, d):
    k = F.col("unit_key")
    df = fx.inc(spark, d).select(
        "id", F.when(F.col("state") == "ASIA", "high").when(F.col("state") == "AFRICA", "low")
        .when(F.col("state") == "EUROPE", "mid").alias("tier"),
        F.when(k % 2 == 0, "Urban").otherwise("Rural").alias("urban"), F.when(k == 8, 0.95).alias("profile"),
        F.when(F.col("state") == "ASIA", k * 1000 - 8000).alias("density"))
    return risk.density_proxies(df, "tier", "urban", "profile", "density").select("id", "commercial_density", "urban_density")


@query("f6_pass_through", f"""
SELECT unit, year, {R('neighbor_risk')} AS neighbor_density, CAST(0 AS DOUBLE) AS weekend_ratio, CAST(0 AS DOUBLE) AS night_ratio,
  CAST(0 AS DOUBLE) AS office_hour_ratio FROM uy_near""", "uy_near")
def f6(spark, d):
    near = enrich.unit_year_neighbours(unit_year_chain(spark, d), fx.edges(spark, d), "n")
    out = risk.pass_through_features(near)
    return out.select("unit", "year", rounded("neighbor_density", 6).alias("neighbor_density"), "weekend_ratio", "night_ratio", "office_hour_ratio")


@query("f7_risk_band", f"""
SELECT unit, year, month, CASE WHEN s >= 80 THEN 'critical' WHEN s >= 60 THEN 'high' WHEN s >= 40 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN s >= 80 THEN '#ef4444' WHEN s >= 60 THEN '#f97316' WHEN s >= 40 THEN '#eab308' ELSE '#10b981' END AS colour,
  {R('6 + s / 10', 4)} AS marker FROM (SELECT *, round(raw_score, 2) AS s FROM score)""", "score")
def f7(spark, d):
    from .storage import scores

    return scores(spark, d).select("unit", "year", "month", sc.risk_band("risk_score").alias("band"),
                                   sc.risk_colour("risk_score").alias("colour"),
                                   rounded(sc.marker_size("risk_score"), 4).alias("marker"))


@query("f8_display", """
SELECT id, CASE WHEN loss IS NULL THEN 'N/A' ELSE format('{:,.2f}', loss) END AS number,
  CASE WHEN loss IS NULL THEN 'N/A' ELSE printf('%.2f%%', loss) END AS percent,
  CASE WHEN loss IS NULL THEN 'N/A' WHEN abs(loss) >= 1e6 THEN CAST(CAST(round(CAST(loss / 1e6 AS DECIMAL(18, 8)), 1) AS DECIMAL(18, 1)) AS VARCHAR) || 'M' WHEN abs(loss) >= 1e3 THEN CAST(CAST(round(CAST(loss / 1e3 AS DECIMAL(18, 5)), 1) AS DECIMAL(18, 1)) AS VARCHAR) || 'K'
       ELSE printf('%.0f', loss) END AS compact FROM inc_nulls""", "inc_nulls")
def f8(spark, d):
    return fx.inc_nulls(spark, d).select("id", sc.display_number("loss", 2).alias("number"),
                                         sc.display_percent("loss", 2).alias("percent"), sc.display_compact("loss").alias("compact"))


@query("f9_age_text", """
SELECT event_id, CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || 's ago' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ago'
  WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ago' ELSE CAST(s // 86400 AS VARCHAR) || 'd ago' END AS age FROM (
  SELECT event_id, CAST(epoch(TIMESTAMP '2024-01-31 00:00:00') AS BIGINT) - CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM ev)""", "ev")
def f9(spark, d):
    return fx.ev(spark, d).select("event_id", sc.age_text("ts", F.lit("2024-01-31 00:00:00")).alias("age"))


@query("f10_safe_name", r"""
SELECT id, regexp_replace(t, '[^\p{L}\p{N}._-]', '', 'g')[1:50] AS name FROM (
  SELECT id, unit || ' / ' || category || ': weekly report (v1.' || CAST(id AS VARCHAR) || ') of ' || station || ' for the whole year' AS t FROM inc)""",
       "inc")
def f10(spark, d):
    text = F.concat("unit", F.lit(" / "), "category", F.lit(": weekly report (v1."), F.col("id").cast("string"), F.lit(") of "),
                    "station", F.lit(" for the whole year"))
    return fx.inc(spark, d).select("id", sc.safe_name(text).alias("name"))


@query("f11_codes", """
SELECT id, 'INC-' || CAST(year AS VARCHAR) || '-' || lpad(CAST(id AS VARCHAR), 8, '0') AS incident,
  'PS-' || upper(state[1:3]) || '-' || lpad(CAST(id % 47 + 1 AS VARCHAR), 3, '0') AS station,
  upper(state[1:2]) || '-' || upper(unit[1:3]) AS admin FROM inc""", "inc")
def f11(spark, d):
    return fx.inc(spark, d).select("id", sc.incident_id("year", "id").alias("incident"),
                                   sc.station_id("state", "id").alias("station"), sc.admin_code("state", "unit").alias("admin"))


@query("f12_cell_index", "SELECT id, cell FROM cells", "cells")
def f12(spark, d):
    return fx.pts(spark, d).select("id", geo.cell_index("lat", "lon", 6).alias("cell"))


@query("f13_cell_boundary", """
WITH c AS (SELECT DISTINCT cell, cq, cr FROM cells),
p AS (SELECT cell, k, CAST(0.5 AS DOUBLE) * (sqrt(3) * cq + sqrt(3) / 2 * cr) + CAST(0.5 AS DOUBLE) * cos(radians(60 * (k % 6) - 30)) AS x,
  CAST(0.5 AS DOUBLE) * 1.5 * cr + CAST(0.5 AS DOUBLE) * sin(radians(60 * (k % 6) - 30)) AS y FROM c, range(0, 7) t(k))
SELECT cell, CAST(k AS INTEGER) AS corner, round(x, 6) + CAST(0 AS DOUBLE) AS lng, round(y, 6) + CAST(0 AS DOUBLE) AS lat FROM p""", "cells")
def f13(spark, d):
    cells = fx.pts(spark, d).select(geo.cell_index("lat", "lon", 6).alias("cell")).distinct()
    corners = cells.select("cell", F.posexplode(geo.cell_boundary("cell")).alias("corner", "p"))
    return corners.select("cell", "corner", (rounded(F.col("p")[0], 6) + F.lit(0.0)).alias("lng"),
                          (rounded(F.col("p")[1], 6) + F.lit(0.0)).alias("lat"))


@query("f14_report_lifecycle", """
WITH log AS (SELECT l_orderkey AS report_id, l_shipdate AS moment, l_linenumber AS seq, CASE WHEN l_linenumber = 1 THEN 'created'
    WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'downloaded' WHEN l_linestatus = 'F' THEN 'completed' ELSE 'started' END AS event,
    l_partkey AS tie FROM lineitem),
s AS (SELECT *, CASE event WHEN 'created' THEN 'pending' WHEN 'started' THEN 'processing' WHEN 'completed' THEN 'completed'
    WHEN 'failed' THEN 'failed' END AS state FROM log),
last AS (SELECT report_id, state FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY moment DESC, seq DESC,
    list_position(['pending', 'processing', 'failed', 'completed'], state) DESC) AS r FROM s WHERE state IS NOT NULL) WHERE r = 1)
SELECT s.report_id, any_value(last.state) AS status, CAST(count(*) FILTER (WHERE event = 'failed') AS BIGINT) AS retry_count,
  CAST(count(*) FILTER (WHERE event = 'downloaded') AS BIGINT) AS download_count,
  strftime(min(moment) FILTER (WHERE event = 'created') + INTERVAL 7 DAY, '%Y-%m-%d') AS expires
FROM s LEFT JOIN last ON last.report_id = s.report_id GROUP BY s.report_id""")
def f14(spark, d):
    li = fx.table(spark, d, "lineitem")
    event = (
        F.when(F.col("l_linenumber") == 1, "created").when(F.col("l_returnflag") == "R", "failed")
        .when(F.col("l_returnflag") == "A", "downloaded").when(F.col("l_linestatus") == "F", "completed").otherwise("started"))
    log = li.select(F.col("l_orderkey").alias("report_id"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("seq"),
                    event.alias("event"))
    return access.report_lifecycle(log).select("report_id", "status", "retry_count", "download_count",
                                               F.date_format("expires_at", "yyyy-MM-dd").alias("expires"))
