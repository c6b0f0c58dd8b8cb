"""A: aggregations and report sections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.geo import ring_centroid
from ..operators import panel, reports, risk, spatial, temporal
from ..functions.scalar import calendar_flags
from ..operators.reports import pearson
from ..plans import enrich
from ..sources import io
from .joins import unit_year_chain
from ..functions.scalar import rounded
from .registry import query, rnd
from .storage import hot_cells, scores

R = rnd


@query("a1_unit_month_panel", f"""
SELECT unit, state, year, month, quarter_ AS quarter, loss, weight, {R('lat')} AS lat, {R('lon')} AS lon,
       {R('weekend')} AS "Is_Weekend" FROM (
  SELECT unit, state, year, month, CAST((month - 1) // 3 + 1 AS INTEGER) AS quarter_, round(sum(loss), 2) AS loss,
    sum(weight) AS weight, avg(lat) AS lat, avg(lon) AS lon, avg(CAST(isodow(dt) >= 6 AS INTEGER)) AS weekend
  FROM pts GROUP BY unit, state, year, month)""", "pts")
def a1(spark, d):
    df = fx.pts(spark, d).withColumn("Is_Weekend", calendar_flags("dt")["is_weekend"])
    out = panel.unit_month_panel(df)
    return out.withColumns({c: rounded(c, 6) for c in ("lat", "lon", "Is_Weekend")})


@query("a2_cell_month_panel", f"""
SELECT cell, year, month, crime_count, {R('latitude')} AS latitude, {R('longitude')} AS longitude FROM cell_month""", "cell_month")
def a2(spark, d):
    from ..functions.geo import cell_index

    df = panel.cell_month_panel(fx.pts(spark, d).withColumn("cell", cell_index("lat", "lon", 6)))
    return df.withColumns({c: rounded(c, 6) for c in ("latitude", "longitude")})


@query("a3_top_units", f"""
SELECT unit, {R('m', 4)} AS risk_score FROM (SELECT unit, avg(n) AS m FROM unit_month GROUP BY unit)
ORDER BY m DESC, unit LIMIT 20""", "unit_month")
def a3(spark, d):
    return reports.top_units(fx.unit_month(spark, d), ["risk_score", "risk_index", "n"])


_TREND = f"""trend AS (SELECT unit, {R('recent', 2)} AS recent_avg, {R('earlier', 2)} AS earlier_avg,
    {R('change', 2)} AS change_pct, CASE WHEN change > 5 THEN 'increasing' WHEN change < -5 THEN 'decreasing' ELSE 'stable' END
    AS direction FROM (SELECT *, (recent - earlier) / (earlier + 1) * 100 AS change FROM (
  SELECT unit, avg(n) FILTER (WHERE i > c - 3) AS recent, avg(n) FILTER (WHERE i <= 3) AS earlier FROM (
    SELECT unit, n, row_number() OVER (PARTITION BY unit ORDER BY year, month) AS i, count(*) OVER (PARTITION BY unit) AS c
    FROM unit_month) WHERE c >= 2 GROUP BY unit)))"""


@query("a4_unit_trend", f"WITH {_TREND} SELECT * FROM trend", "unit_month")
def a4(spark, d):
    return reports.unit_trend(fx.unit_month(spark, d), "n")


@query("a5_growth_stats", f"""
SELECT year, {R('avg(growth_rate)', 4)} AS mean, {R('stddev_samp(growth_rate)', 4)} AS std, {R('min(growth_rate)', 4)} AS min,
       {R('max(growth_rate)', 4)} AS max FROM uy_feat GROUP BY year""", "uy_feat")
def a5(spark, d):
    return reports.growth_stats(unit_year_chain(spark, d))


@query("a6_monthly_profile", f"SELECT month, {R('avg(n)', 2)} AS value FROM unit_month GROUP BY month", "unit_month")
def a6(spark, d):
    return reports.monthly_profile(fx.unit_month(spark, d), "n")


@query("a7_quarterly_profile", f"""
WITH q AS (SELECT quarter, avg(n) AS m FROM unit_month GROUP BY quarter)
SELECT quarter, {R('m', 2)} AS value, (SELECT quarter FROM q ORDER BY m DESC, quarter LIMIT 1) AS peak_quarter FROM q""",
       "unit_month")
def a7(spark, d):
    return reports.quarterly_profile(fx.unit_month(spark, d), "n")


def _last(column: str) -> str:
    return f"(SELECT {column} FROM um_roll WHERE {column} IS NOT NULL ORDER BY year DESC, month DESC, unit DESC LIMIT 1)"


@query("a8_moving_average_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R(f'avg({c})', 2)} AS mean, {R(_last(c), 2)} AS latest FROM um_roll"
    for c in ("rolling_mean_3m", "rolling_mean_6m")), "um_roll")
def a8(spark, d):
    return reports.moving_average_summary(temporal.rolling(fx.unit_month(spark, d), ["unit"], "n"))


@query("a9_growth_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R(f'avg({c})', 4)} AS mean, {R(f'stddev_samp({c})', 4)} AS std, {R(_last(c), 4)} AS latest FROM um_roll"
    for c in ("crime_growth", "momentum", "acceleration")), "um_roll")
def a9(spark, d):
    return reports.growth_summary(temporal.growth_features(fx.unit_month(spark, d), ["unit"], "n"))


@query("a10_category_share", f"""
SELECT category, CAST(count(*) AS BIGINT) AS count,
       {R('count(*) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM inc_nulls WHERE category IS NOT NULL)', 2)} AS pct
FROM inc_nulls WHERE category IS NOT NULL GROUP BY category""", "inc_nulls")
def a10(spark, d):
    return reports.category_share(fx.inc_nulls(spark, d))


@query("a11_station_load", f"""
SELECT CAST(count(*) AS BIGINT) AS total_stations, {R('avg(l)', 2)} AS mean_load, {R('max(l)', 2)} AS max_load,
       {R('min(l)', 2)} AS min_load FROM (SELECT station, sum(loss) AS l FROM inc GROUP BY station)""", "inc")
def a11(spark, d):
    return reports.station_load(fx.inc(spark, d))


@query("a11_station_load_rows", f"""
SELECT CAST(count(*) AS BIGINT) AS total_stations, {R('avg(l)', 2)} AS mean_load, CAST(max(l) AS DOUBLE) AS max_load,
       CAST(min(l) AS DOUBLE) AS min_load FROM (SELECT station, count(*) AS l FROM inc GROUP BY station)""", "inc")
def a11_rows(spark, d):
    return reports.station_load(fx.inc(spark, d).drop("loss")).withColumns(
        {c: F.col(c).cast("double") for c in ("max_load", "min_load")})


@query("a12_unit_ranking", f"""
SELECT CAST(row_number() OVER (ORDER BY m DESC, unit) AS BIGINT) AS rank, unit, {R('m', 4)} AS score
FROM (SELECT unit, avg(n) AS m FROM unit_month GROUP BY unit)""", "unit_month")
def a12(spark, d):
    return reports.unit_ranking(fx.unit_month(spark, d), ["risk_index", "n"])


@query("a13_hotspot_summary", f"""
SELECT CAST(count(*) AS BIGINT) AS total_hotspots, {R('avg(s)', 2)} AS mean_risk_score, {R('max(s)', 2)} AS max_risk_score,
       (SELECT cell FROM cell_hot WHERE hotspot_rank = 1) AS top_hotspot
FROM (SELECT round(raw_score, 2) AS s FROM cell_hot)""", "cell_hot")
def a13(spark, d):
    return reports.hotspot_summary(hot_cells(spark, d))


_INFLUENCE = " UNION ALL ".join(
    f"SELECT state, '{c}' AS feature, {R(f'corr(n, {c})', 4)} AS correlation, {R(f'avg({c})', 4)} AS mean FROM uy_near GROUP BY state"
    for c in ("neighbor_risk", "spatial_lag"))


@query("s9_report_influence", _INFLUENCE, "uy_near")
def s9_influence(spark, d):
    """A report document per state (its neighbour influence as a JSON map), read back into rows."""
    near = enrich.unit_year_neighbours(unit_year_chain(spark, d), fx.edges(spark, d), "n")
    part = lambda c: F.struct(rounded(pearson("n", c), 4).alias("correlation"), rounded(F.avg(c), 4).alias("mean")).alias(c)
    found = near.groupBy("state").agg(part("neighbor_risk"), part("spatial_lag"))
    documents = found.select("state", F.to_json(F.struct("neighbor_risk", "spatial_lag")).alias("doc"))
    return io.influence_rows(documents, "doc", ["state"])


@query("s9_report_rankings", f"""
SELECT state, CAST(row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, unit) AS INTEGER) AS rank, unit AS district,
  CAST(count(*) AS DOUBLE) AS score FROM inc GROUP BY state, unit""", "inc")
def s9_rankings(spark, d):
    """A report document per state (its units in order as a JSON list), read back into rows."""
    units = fx.inc(spark, d).groupBy("state", "unit").agg(F.count(F.lit(1)).cast("double").alias("score"))
    rank = F.row_number().over(Window.partitionBy("state").orderBy(F.col("score").desc(), "unit"))
    entry = F.struct(rank.alias("rank"), F.col("unit").alias("district"), "score")
    documents = units.select("state", entry.alias("e")).groupBy("state").agg(F.to_json(F.array_sort(F.collect_list("e"))).alias("doc"))
    return io.ranking_rows(documents, "doc", ["state"])


@query("a14_neighbor_influence", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R(f'corr(n, {c})', 4)} AS correlation, {R(f'avg({c})', 4)} AS mean FROM uy_near"
    for c in ("neighbor_risk", "spatial_lag")), "uy_near")
def a14(spark, d):
    near = enrich.unit_year_neighbours(unit_year_chain(spark, d), fx.edges(spark, d), "n")
    return reports.neighbor_influence(near, "n")


@query("a14_clusters", f"""
SELECT unit AS district, {R('m', 4)} AS score FROM (SELECT unit, avg(risk_index) AS m FROM uy_risk GROUP BY unit)
ORDER BY m DESC, unit LIMIT 10""", "uy_risk")
def a14_clusters(spark, d):
    uy = enrich.enrich_unit_year(fx.unit_year(spark, d), fx.edges(spark, d), "n")
    return reports.top_units(uy, ["risk_index"], 10).select(F.col("unit").alias("district"), F.col("risk_score").alias("score"))


@query("a15_dashboard_metrics", f"""
SELECT {R('sum(loss)', 2)} AS total_count, {R('avg(loss)', 2)} AS avg_count, CAST(count(DISTINCT unit) AS BIGINT) AS total_units,
  (SELECT string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) FROM (SELECT DISTINCT year FROM inc)) AS years_covered,
  CAST(count(DISTINCT category) AS BIGINT) AS categories,
  (SELECT unit FROM score ORDER BY round(raw_score, 2) DESC, unit LIMIT 1) AS top_unit,
  (SELECT {R('max(raw_score)', 2)} FROM score) AS top_score,
  (SELECT CAST(count(*) AS BIGINT) FROM cell_hot) AS hotspot_count,
  (SELECT {R('avg(round(raw_score, 2))', 2)} FROM cell_hot) AS avg_hotspot_score,
  (SELECT category FROM inc GROUP BY category ORDER BY count(*) DESC, category LIMIT 1) AS top_category FROM inc""",
       "inc score cell_hot")
def a15(spark, d):
    out = reports.dashboard_metrics(fx.inc(spark, d), scores(spark, d), hot_cells(spark, d), "loss")
    return out.withColumn("years_covered", F.array_join("years_covered", ","))


@query("a16_year_month_series", f"""
SELECT year, month, {R('avg(n)', 4)} AS value, CAST(count(*) AS BIGINT) AS rows, CAST(make_date(year, month, 1) AS VARCHAR) AS date
FROM unit_month GROUP BY year, month""", "unit_month")
def a16(spark, d):
    return reports.year_month_series(fx.unit_month(spark, d), "n").withColumn("date", F.col("date").cast("string"))


@query("a17_overall_direction", f"""
WITH {_TREND}
SELECT CASE WHEN up > down THEN 'up' WHEN down > up THEN 'down' ELSE 'stable' END AS direction, percentage_change FROM (
  SELECT count(*) FILTER (WHERE direction = 'increasing') AS up, count(*) FILTER (WHERE direction = 'decreasing') AS down,
         {R('avg(change_pct)', 4)} AS percentage_change FROM trend)""", "unit_month")
def a17(spark, d):
    return reports.overall_direction(reports.unit_trend(fx.unit_month(spark, d), "n"))


@query("a18_half_year_direction", f"""
WITH m AS (SELECT month, round(avg(n), 2) AS v FROM unit_month GROUP BY month),
k AS (SELECT v, row_number() OVER (ORDER BY month) AS i, greatest(1, count(*) OVER () // 2) AS half FROM m),
h AS (SELECT avg(v) FILTER (WHERE i <= half) AS a, coalesce(avg(v) FILTER (WHERE i > half), 0) AS b FROM k)
SELECT CASE WHEN b > a * CAST(1.02 AS DOUBLE) THEN 'up' WHEN b < a * CAST(0.98 AS DOUBLE) THEN 'down' ELSE 'stable' END AS direction,
  CASE WHEN b > a * CAST(1.02 AS DOUBLE) OR b < a * CAST(0.98 AS DOUBLE) THEN {R('abs(b - a) / a * 100', 2)} ELSE CAST(0 AS DOUBLE) END
  AS percentage_change FROM h""", "unit_month")
def a18(spark, d):
    return reports.half_year_direction(reports.monthly_profile(fx.unit_month(spark, d), "n"))


_MONTHS = "['January','February','March','April','May','June','July','August','September','October','November','December']"


@query("a19_month_pattern", f"""
WITH m AS (SELECT month, round(avg(n), 2) AS value FROM unit_month GROUP BY month)
SELECT month, {_MONTHS}[month] AS month_name, value,
       {_MONTHS}[(SELECT month FROM m ORDER BY value DESC, month LIMIT 1)] AS peak_month FROM m""", "unit_month")
def a19(spark, d):
    return reports.month_pattern(reports.monthly_profile(fx.unit_month(spark, d), "n"))


@query("a20_kpi", f"""
SELECT {R('sum(p)', 2)} AS total_predicted, {R('avg(round(raw_score, 2))', 2)} AS average_risk_score,
  CAST(count(*) FILTER (WHERE round(raw_score, 2) >= 75) AS BIGINT) AS high_risk_units,
  (SELECT CAST(count(*) AS BIGINT) FROM cell_hot) AS hotspot_count FROM score""", "score cell_hot")
def a20(spark, d):
    count = hot_cells(spark, d).agg(F.count(F.lit(1))).scalar()
    return reports.kpi(scores(spark, d), count, predicted="p")


@query("a21_unit_year_table", """
SELECT state, unit, year, arg_min(loss, id) AS loss, arg_min(category, id) AS category FROM inc GROUP BY state, unit, year""", "inc")
def a21(spark, d):
    return panel.unit_year_table(fx.inc(spark, d), ["loss", "category"])


@query("a22_category_by_focus", """
SELECT category, CAST(count(*) FILTER (WHERE state = 'ASIA') AS BIGINT) AS focus,
       CAST(count(*) FILTER (WHERE state <> 'ASIA') AS BIGINT) AS rest FROM inc GROUP BY category""", "inc")
def a22(spark, d):
    return reports.category_by_focus(fx.inc(spark, d), F.col("state") == "ASIA")


@query("a23_histogram", f"""
WITH s AS (SELECT min(loss) AS lo, max(loss) AS hi, avg(loss) AS mean FROM inc_nulls),
b AS (SELECT CAST(least(floor((loss - lo) / (hi - lo) * 40) + 1, 40) AS INTEGER) AS bin FROM inc_nulls, s WHERE loss IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(g AS INTEGER) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS n, {R("lo + (hi - lo) / 40 * (g - 1)", 6)} AS lower,
       {R("lo + (hi - lo) / 40 * g", 6)} AS upper, {R("mean", 6)} AS mean
FROM range(1, 41) t(g) LEFT JOIN c ON c.bin = g, s""", "inc_nulls")
def a23(spark, d):
    out = reports.histogram(fx.inc_nulls(spark, d), "loss", 40)
    return out.withColumns({c: rounded(c, 6) for c in ("lower", "upper", "mean")})


@query("a24_density_grid", """
WITH good AS (SELECT lat, lon FROM pts WHERE lat <> 0 AND lon <> 0),
s AS (SELECT min(lat) AS a0, max(lat) AS a1, min(lon) AS o0, max(lon) AS o1 FROM good)
SELECT bx, "by", CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CAST(least(floor((lon - o0) * 80 / (o1 - o0)) + 1, 80) AS INTEGER) AS bx,
         CAST(least(floor((lat - a0) * 80 / (a1 - a0)) + 1, 80) AS INTEGER) AS "by" FROM good, s) GROUP BY bx, "by" """, "pts")
def a24(spark, d):
    from ..operators.clean import valid_coordinates

    return reports.density_grid(valid_coordinates(fx.pts(spark, d)), 80)


_CORR = ("n", "population", "rate_100k", "trend_3y", "growth_rate", "historical_growth", "expected_growth")


@query("a25_correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})', 6)} AS r FROM uy_feat" for a in _CORR for b in _CORR), "uy_feat")
def a25(spark, d):
    return reports.correlation_matrix(unit_year_chain(spark, d), _CORR).withColumn("r", rounded("r", 6))


@query("a26_own_vs_neighbor", f"""
SELECT state, unit, year, {R('coalesce(rate_100k, CAST(n AS DOUBLE))')} AS own,
       {R('coalesce(spatial_lag, neighbor_risk)')} AS lag FROM uy_near""", "uy_near")
def a26(spark, d):
    near = enrich.unit_year_neighbours(unit_year_chain(spark, d), fx.edges(spark, d), "n")
    out = reports.own_vs_neighbor(near, "n", "rate_100k", "spatial_lag", "neighbor_risk")
    return out.withColumns({c: rounded(c, 6) for c in ("own", "lag")})


@query("a27_bbox", "SELECT min(x0) AS min_lon, min(y0) AS min_lat, max(x1) AS max_lon, max(y1) AS max_lat FROM plots", "plots")
def a27(spark, d):
    return spatial.bbox(fx.plots(spark, d))


@query("a28_ring_centroid", f"SELECT name, {R('(3 * x0 + 2 * x1) / 5')} AS x, {R('(3 * y0 + 2 * y1) / 5')} AS y FROM plots", "plots")
def a28(spark, d):
    return fx.plots(spark, d).select("name", ring_centroid("ring").alias("c")).select(
        "name", rounded("c.x", 6).alias("x"), rounded("c.y", 6).alias("y"))


@query("a29_fit_error", f"""
SELECT {R('sqrt(avg(e * e))', 4)} AS rmse, {R('avg(abs(e))', 4)} AS mae,
  {R('1 - sum(e * e) / (var_pop(a) * count(a))', 4)} AS r2,
  {R('avg(abs(CASE WHEN a <> 0 THEN e / a END)) * 100', 4)} AS mape, CAST(count(*) AS BIGINT) AS rows
FROM (SELECT CAST(n AS DOUBLE) - weight * m AS e, CAST(n AS DOUBLE) AS a FROM (
  SELECT n, weight, CAST(0.9 AS DOUBLE) AS m FROM unit_month))""", "unit_month")
def a29(spark, d):
    df = fx.unit_month(spark, d).select(F.col("n").cast("double").alias("a"), (F.col("weight") * 0.9).alias("p"))
    return reports.fit_error(df, "a", "p")


@query("a30_residuals", f"""
WITH s AS (SELECT least(min(n), min(p / 150)) AS lo, greatest(max(n), max(p / 150)) AS hi FROM scored)
SELECT unit, year, month, {R('p / 150')} AS predicted, {R('n - p / 150')} AS residual, {R('lo')} AS axis_min, {R('hi')} AS axis_max
FROM scored, s""", "scored")
def a30(spark, d):
    df = fx.scored(spark, d).withColumn("guess", F.col("p") / 150)
    out = reports.residuals(df, ["unit", "year", "month"], "n", "guess")
    return out.withColumns({c: rounded(c, 6) for c in ("predicted", "residual", "axis_min", "axis_max")})
