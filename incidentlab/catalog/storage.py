"""S: sources, sinks and shaping of artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.geo import cell_index
from ..operators import clean, panel, reports, risk
from ..operators.scale import settle
from ..session import new_table_dir
from ..sources import io, profile
from ..functions.scalar import rounded
from .registry import query, rnd

R = rnd


def hot_cells(spark, d, top_n: int | None = None):
    """The hotspot ranking table of the fixture points, resolution 6."""
    celled = fx.pts(spark, d).withColumn("cell", cell_index("lat", "lon", 6))
    cells = settle(panel.cell_month_panel(celled))
    return settle(risk.hotspots(cells, "crime_count", ["cell", "year", "month"], top_n).withColumn(
        "predicted_count", F.col("crime_count")))


def scores(spark, d):
    """Unit-months with score and rank."""
    return risk.score_0_100(fx.scored(spark, d), "p", ["unit", "year", "month"])


@query("s1_read_incidents", "SELECT o_orderkey AS id, o_custkey AS customer, o_totalprice AS loss FROM orders")
def s1(spark, d):
    return io.read_incidents(spark, f"{d}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("loss"))


_PROFILE_TYPES = (("id", "bigint", "numeric"), ("unit", "string", "categorical"), ("state", "string", "categorical"),
                  ("year", "int", "numeric"), ("month", "int", "numeric"), ("loss", "double", "numeric"),
                  ("category", "string", "categorical"), ("festival", "boolean", "bool"), ("sparse", "double", "numeric"))
_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, '{k}' AS kind, CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
    f"{R(f'(count(*) - count({c})) * CAST(100 AS DOUBLE) / count(*)', 2)} AS null_pct FROM inc_nulls"
    for c, t, k in _PROFILE_TYPES)


@query("s2_profile", _PROFILE_SQL, "inc_nulls")
def s2(spark, d):
    return profile.profile(fx.inc_nulls(spark, d))


@query("s2_top_missing", f"SELECT * FROM ({_PROFILE_SQL}) WHERE null_count > 0 ORDER BY null_count DESC, \"column\" LIMIT 15",
       "inc_nulls")
def s2_top(spark, d):
    return profile.top_missing(fx.inc_nulls(spark, d))


@query("s3_write_panel", "SELECT unit, state, year, month, quarter, loss, n FROM unit_month", "unit_month")
def s3(spark, d):
    path = new_table_dir(spark, "unit_month")
    frame = fx.unit_month(spark, d).drop("weight")
    io.write_panel(frame, path)
    return spark.read.schema(frame.schema).parquet(path).select("unit", "state", "year", "month", "quarter", "loss", "n")


@query("s4_ranked_csv", f"""
SELECT priority_rank, unit, year, month, {R('raw_score', 2)} AS risk_score,
       CAST(round(raw_score, 2) >= 75 AS INTEGER) AS is_high FROM score""", "score")
def s4(spark, d):
    path = new_table_dir(spark, "ranking_csv")
    ranked = scores(spark, d).select("priority_rank", "unit", "year", "month", "risk_score",
                                     (F.col("risk_score") >= 75).alias("is_high"))
    io.write_ranked_csv(ranked, path, ["priority_rank"])
    return spark.read.schema("priority_rank long, unit string, year int, month int, risk_score double, is_high int").option(
        "header", True).csv(path)


@query("s5_sections_json", f"""
SELECT 'monthly' AS section, CAST(month AS VARCHAR) AS key, {R('avg(n)', 2)} AS value FROM unit_month GROUP BY month
UNION ALL SELECT 'categories', category, CAST(count(*) AS DOUBLE) FROM inc GROUP BY category
UNION ALL SELECT 'stations', 'all', CAST(count(DISTINCT station) AS DOUBLE) FROM inc""", "unit_month inc")
def s5(spark, d):
    """The lines of three sections, read back."""
    um, incidents = fx.unit_month(spark, d), fx.inc(spark, d)
    lines = io.section_lines({"monthly": reports.monthly_profile(um, "n"), "categories": reports.category_share(incidents),
                              "stations": reports.station_load(incidents)})
    field = lambda name: F.get_json_object("json", f"$.{name}")
    return lines.select("section", F.coalesce(field("month"), field("category"), F.lit("all")).alias("key"),
                        F.coalesce(field("value"), field("count"), field("total_stations")).cast("double").alias("value"))


_FEATURE = "struct<type:string, geometry:struct<type:string, coordinates:array<array<array<double>>>>, " \
           "properties:struct<h3_index:string, risk_score:double, rank:int, predicted_crime_count:double>>"
_FEATURE_SQL = f"""SELECT cell AS h3_index, {R('raw_score', 2)} AS risk_score, CAST(hotspot_rank AS INTEGER) AS rank,
  {R('crime_count', 2)} AS predicted, CAST(7 AS INTEGER) AS corners FROM cell_hot"""


def _feature_columns(df, feature):
    p = F.col(feature)["properties"]
    return df.select(p["h3_index"].alias("h3_index"), p["risk_score"].alias("risk_score"), p["rank"].alias("rank"),
                     rounded(p["predicted_crime_count"], 2).alias("predicted"), F.size(F.col(feature)["geometry"]["coordinates"][0]).alias("corners"))


@query("s6_to_geojson", _FEATURE_SQL, "cell_hot")
def s6(spark, d):
    """Every feature line, read back."""
    lines = io.to_geojson(hot_cells(spark, d))
    return _feature_columns(lines.select(F.from_json("feature", _FEATURE).alias("f")), "f")


@query("s6_feature_collection", f"SELECT f.*, (SELECT CAST(count(*) AS INTEGER) FROM cell_hot) AS total FROM ({_FEATURE_SQL}) f WHERE rank <= 500", "cell_hot")
def s6_document(spark, d):
    """The one document of the first 500 cells, read back with the count of all."""
    document = f"struct<features:array<{_FEATURE}>, metadata:struct<total_hotspots:int>>"
    read = io.feature_collection(hot_cells(spark, d)).select(F.from_json("document", document).alias("d"))
    rows = read.select(F.explode("d.features").alias("f"), F.col("d.metadata.total_hotspots").alias("total"))
    return rows.select("total", "f").select("total", "f.*").select("total", F.struct("properties", "geometry").alias("f")).select(
        "f.properties.h3_index", "f.properties.risk_score", "f.properties.rank",
        rounded("f.properties.predicted_crime_count", 2).alias("predicted"), F.size(F.col("f.geometry.coordinates")[0]).alias("corners"), "total")


@query("s7_read_geojson", f"""
SELECT 'Feature' AS type, 'Polygon' AS geometry_type, cell AS h3_cell, {R('raw_score', 2)} AS hotspot_score,
       CAST(hotspot_rank AS DOUBLE) AS rank, CAST(7 AS BIGINT) AS vertices FROM cell_hot""", "cell_hot")
def s7(spark, d):
    path = new_table_dir(spark, "geojson")
    io.feature_collections(hot_cells(spark, d)).write.text(path)
    p = F.col("properties")
    return io.read_geojson(spark, path, multi_line=False).select(
        "type", "geometry_type", p["h3_cell"].alias("h3_cell"), p["hotspot_score"].cast("double").alias("hotspot_score"),
        p["rank"].cast("double").alias("rank"), F.size(F.col("polygons")[0][0]).cast("long").alias("vertices"))


@query("s7_read_feature_lines", f"""
SELECT cell AS h3_cell, {R('raw_score', 2)} AS hotspot_score, CAST(hotspot_rank AS DOUBLE) AS rank FROM cell_hot""", "cell_hot")
def s7_lines(spark, d):
    path = new_table_dir(spark, "features")
    io.export({"geojson": io.to_geojson(hot_cells(spark, d))}, "geojson", path)
    p = F.col("properties")
    return io.read_geojson(spark, path, lines=True).select(
        p["h3_cell"].alias("h3_cell"), p["hotspot_score"].cast("double").alias("hotspot_score"), p["rank"].cast("double").alias("rank"))


@query("s8_normalize_columns", f"""
SELECT unit AS district, {R('raw_score', 2)} AS risk_score, priority_rank AS risk_rank, CAST(NULL AS VARCHAR) AS state,
       CASE WHEN month <> 5 THEN {R('p', 3)} END AS predicted_crime_count FROM score""", "score")
def s8(spark, d):
    raw = scores(spark, d).select(
        F.col("unit").alias("District"), F.col("risk_score").alias("Risk_Score"),
        F.col("priority_rank").alias("Priority_Rank"),
        F.when(F.col("month") == 5, "n/a").otherwise(F.col("p").cast("string")).alias("Predicted_Crime_Count"))
    return io.normalize_columns(raw).withColumn("predicted_crime_count", rounded("predicted_crime_count", 3))


@query("s9_json_map_rows", """
SELECT event_id, key, CAST(json_extract_string(props, '$.' || key) AS DOUBLE) AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""")
def s9(spark, d):
    return io.json_map_rows(fx.table(spark, d, "events"), "props", ["event_id"])


@query("s9_report_months", f"""
SELECT unit, month, {R('avg(n)', 2)} AS value FROM unit_month GROUP BY unit, month""", "unit_month")
def s9_months(spark, d):
    """A report document per unit (its monthly means as a JSON map), read back into rows."""
    means = fx.unit_month(spark, d).groupBy("unit", "month").agg(rounded(F.avg("n"), 2).alias("v"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("month").cast("string"), "v")))
    documents = means.groupBy("unit").agg(F.to_json(entries).alias("monthly_trends"))
    return io.month_rows(documents, "monthly_trends", ["unit"])


@query("s9_report_categories", f"""
SELECT state, category AS name, CAST(count(*) AS BIGINT) AS count,
       {R('count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER (PARTITION BY state)', 2)} AS pct
FROM inc GROUP BY state, category""", "inc")
def s9_categories(spark, d):
    counts = fx.inc(spark, d).groupBy("state", "category").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("state").agg(F.sum("count").alias("t"))
    rows = counts.join(totals, "state").select(
        "state", "category", F.struct("count", rounded(F.col("count") * 100.0 / F.col("t"), 2).alias("pct")).alias("v"))
    documents = rows.groupBy("state").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("category", "v")))).alias("doc"))
    return io.category_rows(documents, "doc", ["state"])


@query("s9_report_trends", f"""
WITH k AS (SELECT unit, n, row_number() OVER (PARTITION BY unit ORDER BY year, month) AS i, count(*) OVER (PARTITION BY unit) AS c FROM unit_month),
t AS (SELECT unit, avg(n) FILTER (WHERE i > c - 3) AS r, avg(n) FILTER (WHERE i <= 3) AS e FROM k WHERE c >= 2 GROUP BY unit),
p AS (SELECT unit, (r - e) / (e + 1) * 100 AS x FROM t)
SELECT unit, CASE WHEN x > 5 THEN 'increasing' WHEN x < -5 THEN 'decreasing' ELSE 'stable' END AS direction, {R('x', 2)} AS change_pct FROM p""",
       "unit_month")
def s9_trends(spark, d):
    """One report document of all unit trends per state, read back into rows."""
    trends = reports.unit_trend(fx.unit_month(spark, d), "n")
    states = fx.inc(spark, d).select("state", "unit").distinct()
    entry = F.struct("unit", F.struct("direction", "change_pct").alias("v"))
    documents = trends.join(states, "unit").groupBy("state").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("crime_trends"))
    return io.trend_rows(documents, "crime_trends").select("unit", "direction", "change_pct")


@query("s10_report_payload", f"""
SELECT priority_rank, unit, year, month, {R('raw_score', 2)} AS risk_score FROM score""", "score")
def s10(spark, d):
    ranked = scores(spark, d).select("priority_rank", "unit", "year", "month", "risk_score")
    return io_payload(ranked)["rankings"]


def io_payload(ranked):
    return reports.report_payload("risk_ranking", ranked, ranked, ranked, ranked, {})


@query("s11_export_csv", f"""
SELECT priority_rank, unit, year, month, {R('raw_score', 2)} AS risk_score FROM score""", "score")
def s11(spark, d):
    path = new_table_dir(spark, "export")
    ranked = scores(spark, d).select("priority_rank", "unit", "year", "month", "risk_score")
    io.export(io_payload(ranked), "csv", path)
    return spark.read.schema("priority_rank long, unit string, year int, month int, risk_score double").option(
        "header", True).csv(path)


@query("s11_export_json", f"""
SELECT unit, {R('recent', 2)} AS recent_avg FROM (
  SELECT unit, avg(n) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY year DESC, month DESC) AS i,
    count(*) OVER (PARTITION BY unit) AS c FROM unit_month) WHERE i <= 3 AND c >= 2 GROUP BY unit)""", "unit_month")
def s11_json(spark, d):
    path = new_table_dir(spark, "export")
    io.export({"trends": reports.unit_trend(fx.unit_month(spark, d), "n")}, "json", path)
    return spark.read.schema("unit string, recent_avg double").json(f"{path}/trends")


@query("s12_summary_table", f"""
WITH means AS (SELECT unit, avg(n) AS m FROM unit_month GROUP BY unit),
top AS (SELECT unit, {R('m', 4)} AS risk_score FROM means ORDER BY m DESC, unit LIMIT 5),
months AS (SELECT month, {R('avg(n)', 2)} AS value FROM unit_month GROUP BY month)
SELECT 'top_units' AS section, unit, risk_score, {', '.join(f'CAST(NULL AS VARCHAR) AS m{i}' for i in range(1, 11))} FROM top
UNION ALL
SELECT 'months', NULL, NULL, {', '.join(f"CAST(max(CASE WHEN month = {i} THEN value END) AS VARCHAR)" for i in range(1, 11))}
FROM months""", "unit_month")
def s12(spark, d):
    um = fx.unit_month(spark, d)
    months = reports.monthly_profile(um, "n").select(F.concat(F.lit("m"), F.col("month")).alias("key"), "value", "month")
    return reports.summary_table({"top_units": (reports.top_units(um, ["n"]), [F.col("risk_score").desc(), "unit"])},
                                 {"months": (months, ["month"])})


@query("s13_dictionary", "SELECT * FROM (VALUES ('station', 'string', 'categorical'), ('channel', 'string', 'categorical')) AS v(\"column\", dtype, kind)")
def s13(spark, d):
    """A dictionary of two composite names, written from the profile of the table and read back."""
    incidents = fx.inc(spark, d)
    known = profile.profile(incidents).filter(~F.col("column").isin("channel", "station"))
    rows = known.groupBy(F.col("kind").alias("Data_Source_Type")).agg(
        F.array_join(F.array_sort(F.collect_list("column")), "/").alias("Column")).select(
        "Column", "Data_Source_Type", F.concat(F.lit("All "), F.col("Data_Source_Type")).alias("Description"))
    path = new_table_dir(spark, "dictionary")
    rows.write.option("header", True).csv(path)
    return io.undocumented(incidents, io.read_dictionary(spark, path)).select("column", "dtype", "kind")


@query("s14_artifact_freshness", """
SELECT artifact, loaded, rows, age_seconds, coalesce(age_seconds > 900, TRUE) AS stale FROM (
  SELECT 'events' AS artifact, count(*) > 0 AS loaded, CAST(count(*) AS BIGINT) AS rows,
         CAST(epoch(TIMESTAMP '2024-01-31 00:00:00' - max(ts)) AS DOUBLE) AS age_seconds FROM
         (SELECT date_trunc('second', ts) AS ts FROM events)
  UNION ALL
  SELECT 'orders', count(*) > 0, CAST(count(*) AS BIGINT),
         CAST(epoch(TIMESTAMP '2024-01-31 00:00:00' - max(o_orderdate)) AS DOUBLE) FROM orders)""")
def s14(spark, d):
    return io.artifact_freshness(
        {"events": (fx.ev(spark, d), "ts"), "orders": (fx.table(spark, d, "orders"), "o_orderdate")},
        F.lit("2024-01-31 00:00:00")).withColumn("age_seconds", F.col("age_seconds").cast("double"))
