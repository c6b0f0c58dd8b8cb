"""C: cleaning, projection, filters and predicates; U: combining splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import scalar as sc
from ..operators import access, clean, temporal
from ..functions.scalar import rounded
from ..sources import profile
from .registry import query, rnd
from .storage import hot_cells, scores

R = rnd


@query("c1_with_calendar", """
SELECT id, CAST(year(t) AS DOUBLE) AS year, CAST(month(t) AS DOUBLE) AS month, CAST(quarter(t) AS DOUBLE) AS quarter,
       CAST(week(t) AS DOUBLE) AS week
FROM (SELECT id, CASE WHEN id % 29 <> 0 THEN dt END AS t FROM inc)""", "inc")
def c1(spark, d):
    text = F.when(F.col("id") % 29 == 0, "not a date").otherwise(F.col("dt").cast("string"))
    df = clean.with_calendar(fx.inc(spark, d).select("id", text.alias("dt")))
    return df.select("id", *[F.col(c).cast("double").alias(c) for c in ("year", "month", "quarter", "week")])


@query("c2_drop_sparse", """
SELECT id, unit, state, year, month, loss, category, CAST(festival AS VARCHAR) AS festival FROM inc_nulls""", "inc_nulls")
def c2(spark, d):
    return clean.drop_sparse(fx.inc_nulls(spark, d)).withColumn("festival", F.col("festival").cast("string"))


@query("c3_impute_median", f"""
SELECT id, {R('coalesce(loss, (SELECT median(loss) FROM inc_nulls))', 3)} AS loss,
       {R('coalesce(sparse, (SELECT median(sparse) FROM inc_nulls))', 3)} AS sparse FROM inc_nulls""", "inc_nulls")
def c3(spark, d):
    out = clean.impute_median(fx.inc_nulls(spark, d).select("id", "loss", "sparse"))
    return out.select("id", rounded("loss", 3).alias("loss"), rounded("sparse", 3).alias("sparse"))


@query("c4_impute_mode", """
SELECT id, coalesce(category, (SELECT category FROM inc_nulls WHERE category IS NOT NULL
                               GROUP BY category ORDER BY count(*) DESC, category LIMIT 1)) AS category,
       'Unknown' AS nothing FROM inc_nulls""", "inc_nulls")
def c4(spark, d):
    df = fx.inc_nulls(spark, d).select("id", "category", F.lit(None).cast("string").alias("nothing"))
    return clean.impute_mode(df)


@query("c5_fill_bool_false", "SELECT id, coalesce(festival, FALSE) AS festival FROM inc_nulls", "inc_nulls")
def c5(spark, d):
    return clean.fill_bool_false(fx.inc_nulls(spark, d)).select("id", "festival")


@query("c2_c5_handle_missing", f"""
SELECT id, unit, state, year, month, {R('coalesce(loss, (SELECT median(loss) FROM inc_nulls))', 3)} AS loss,
  coalesce(category, (SELECT category FROM inc_nulls WHERE category IS NOT NULL
                      GROUP BY category ORDER BY count(*) DESC, category LIMIT 1)) AS category,
  coalesce(festival, FALSE) AS festival FROM inc_nulls""", "inc_nulls")
def c2_c5(spark, d):
    return clean.handle_missing(fx.inc_nulls(spark, d)).withColumn("loss", rounded("loss", 3))


@query("c6_valid_coordinates", """
SELECT id, lat, lon FROM pts WHERE lat IS NOT NULL AND lon IS NOT NULL AND lat <> 0 AND lon <> 0""", "pts")
def c6(spark, d):
    return clean.valid_coordinates(fx.pts(spark, d)).select("id", "lat", "lon")


_SPLITS = {"train": (1996, 1997, 1998), "val": (1999,), "test": (2000, 2001)}


@query("c7_temporal_split", """
SELECT id, year, CASE WHEN year IN (1996, 1997, 1998) THEN 'train' WHEN year = 1999 THEN 'val'
                      WHEN year IN (2000, 2001) THEN 'test' END AS split FROM inc""", "inc")
def c7(spark, d):
    return clean.with_split(fx.inc(spark, d), **_SPLITS).select("id", "year", "split")


@query("u1_combine_splits", """
SELECT id, year, CASE WHEN year IN (1996, 1997, 1998) THEN 'train' WHEN year = 1999 THEN 'val' ELSE 'test' END AS split
FROM inc WHERE year BETWEEN 1996 AND 2001""", "inc")
def u1(spark, d):
    return clean.combine_splits(clean.temporal_split(fx.inc(spark, d).select("id", "year"), **_SPLITS))


@query("c8_calendar_flags", """
SELECT id, isodow(dt) >= 6 AS is_weekend, month IN (10, 11, 1) AS is_festival_month, quarter,
  CAST(week(dt) AS INTEGER) AS week, strftime(dt, '%a') AS day_of_week,
  least(CASE WHEN month = 2 THEN 28 WHEN month IN (4, 6, 9, 11) THEN 30 ELSE 31 END, CAST(id % 31 + 1 AS INTEGER)) AS day
FROM inc""", "inc")
def c8(spark, d):
    return fx.inc(spark, d).withColumns(sc.calendar_flags("dt")).select(
        "id", "is_weekend", "is_festival_month", "quarter", "week", "day_of_week",
        sc.clamp_day("month", (F.col("id") % 31 + 1).cast("int")).alias("day"))


@query("c9_time_of_day", """
SELECT event_id, CASE WHEN h < 6 THEN 'Night' WHEN h < 12 THEN 'Morning' WHEN h < 17 THEN 'Afternoon'
  WHEN h < 21 THEN 'Evening' ELSE 'Night' END AS time_of_day, h < 6 OR h >= 22 AS is_night,
  h BETWEEN 9 AND 18 AS is_office_hour FROM (SELECT event_id, hour(ts) AS h FROM ev)""", "ev")
def c9(spark, d):
    return fx.ev(spark, d).withColumns(sc.hour_flags("ts")).select("event_id", "time_of_day", "is_night", "is_office_hour")


@query("c10_search", """
SELECT id, category, station FROM (SELECT id, CASE WHEN id % 23 <> 0 THEN category END AS category, station FROM inc)
WHERE contains(lower(coalesce(category, '')), 'build') OR contains(lower(coalesce(station, '')), 'build')""", "inc")
def c10(spark, d):
    df = fx.inc(spark, d).select("id", F.when(F.col("id") % 23 != 0, F.col("category")).alias("category"), "station")
    return clean.search(df, ["category", "station"], "BuIlD")


@query("c11_lookup", """
SELECT id, unit, year, month FROM (SELECT id, unit, year, month FROM inc WHERE lower(unit) = 'nation_7')
ORDER BY year, month, id LIMIT 1""", "inc")
def c11(spark, d):
    return clean.lookup(fx.inc(spark, d), "unit", "NaTion_7", ["year", "month", "id"]).select("id", "unit", "year", "month")


@query("c12_filter_rankings", f"""
SELECT unit, year, month, {R('raw_score', 2)} AS risk_score FROM score
WHERE state = 'ASIA' AND round(raw_score, 2) BETWEEN 20 AND 60 AND year = 1997""", "score")
def c12(spark, d):
    return clean.filter_rankings(scores(spark, d), state="ASIA", min_risk=20, max_risk=60, year=1997).select(
        "unit", "year", "month", "risk_score")


@query("c12_filter_hotspots", f"""
SELECT cell, year, month, {R('raw_score', 2)} AS risk_score FROM cell_hot
WHERE round(raw_score, 2) >= 30 AND longitude BETWEEN 72 AND 90 AND latitude BETWEEN 10 AND 30""", "cell_hot")
def c12_cells(spark, d):
    return clean.filter_hotspots(hot_cells(spark, d), 30, (72, 10, 90, 30)).select("cell", "year", "month", "risk_score")


@query("c13_feature_columns", """
SELECT feature FROM (
  SELECT 'id' AS feature, avg(CAST(id IS NULL AS INTEGER)) AS s FROM inc_nulls UNION ALL
  SELECT 'year', avg(CAST(year IS NULL AS INTEGER)) FROM inc_nulls UNION ALL
  SELECT 'month', avg(CAST(month IS NULL AS INTEGER)) FROM inc_nulls UNION ALL
  SELECT 'loss', avg(CAST(loss IS NULL AS INTEGER)) FROM inc_nulls UNION ALL
  SELECT 'sparse', avg(CAST(sparse IS NULL AS INTEGER)) FROM inc_nulls) WHERE s < 0.5 AND feature <> 'id'""", "inc_nulls")
def c13(spark, d):
    table = fx.inc_nulls(spark, d)
    names = clean.feature_columns(table, exclude=["id"])
    return profile.profile(table).filter(F.col("column").isin(names)).select(F.col("column").alias("feature"))


@query("c14_fill_features", """
SELECT unit, year, month, CAST(coalesce(lag(n, 1) OVER w, 0) AS DOUBLE) AS n_lag_1,
       CAST(coalesce(lag(n, 2) OVER w, 0) AS DOUBLE) AS n_lag_2
FROM unit_month WINDOW w AS (PARTITION BY unit ORDER BY year, month)""", "unit_month")
def c14(spark, d):
    df = temporal.lags(fx.unit_month(spark, d), ["unit"], "n", 2)
    return clean.fill_features(df, ["n_lag_1", "n_lag_2"]).select("unit", "year", "month", "n_lag_1", "n_lag_2")


@query("c15_clamp", """
SELECT id, CASE WHEN loss IS NOT NULL THEN greatest(CAST(20000 AS DOUBLE), least(CAST(150000 AS DOUBLE), loss)) END AS loss
FROM inc_nulls""", "inc_nulls")
def c15(spark, d):
    return fx.inc_nulls(spark, d).select("id", sc.clamp("loss", 20000, 150000).alias("loss"))


@query("c16_first_available_column", "SELECT id, coalesce(sparse, loss) AS value FROM inc_nulls", "inc_nulls")
def c16(spark, d):
    return fx.inc_nulls(spark, d).select("id", sc.first_of("sparse", "loss").alias("value"))


@query("c16_first_available_table", """
SELECT unit, year, month, n FROM unit_month""", "unit_month")
def c16_table(spark, d):
    um = fx.unit_month(spark, d).select("unit", "year", "month", "n")
    return clean.first_available(um.filter(F.col("n") < 0), um)


@query("c17_page", """
SELECT id, user_id, status FROM reports WHERE status = 'completed' ORDER BY created_at DESC, id LIMIT 25 OFFSET 50""",
       "reports")
def c17(spark, d):
    return access.page(fx.reports(spark, d), 50, 25, "created_at", "id", {"status": "completed"}).select(
        "id", "user_id", "status")


@query("c17_page_users", """
SELECT id, name, role FROM users WHERE NOT is_deleted AND role = 'officer' ORDER BY name DESC, id LIMIT 20 OFFSET 10""",
       "users")
def c17_users(spark, d):
    return access.page(fx.users(spark, d), 10, 20, "name", "id", {"role": "officer"}).select("id", "name", "role")


_AS_OF = "1998-06-01 00:00:00"


@query("c18_expire_reports", f"""
SELECT id, CASE WHEN expires_at < TIMESTAMP '{_AS_OF}' AND status IN ('completed', 'pending', 'processing')
                THEN 'expired' ELSE status END AS status FROM reports""", "reports")
def c18(spark, d):
    return access.expire_reports(fx.reports(spark, d), F.lit(_AS_OF).cast("timestamp_ntz")).select("id", "status")


@query("c18_drop_expired", f"SELECT id FROM reports WHERE expires_at >= TIMESTAMP '{_AS_OF}'", "reports")
def c18_cache(spark, d):
    return access.drop_expired(fx.reports(spark, d), F.lit(_AS_OF).cast("timestamp_ntz")).select("id")


@query("c18_expiry_counts", f"""
SELECT 'cache' AS target, CAST(count(*) AS BIGINT) AS rows FROM reports WHERE expires_at < TIMESTAMP '{_AS_OF}' UNION ALL
SELECT 'reports', CAST(count(*) AS BIGINT) FROM reports WHERE expires_at < TIMESTAMP '{_AS_OF}'
  AND status IN ('completed', 'pending', 'processing')""", "reports")
def c18_counts(spark, d):
    r = fx.reports(spark, d)
    return access.expiry_counts(r, r, F.lit(_AS_OF).cast("timestamp_ntz"))


@query("c18_soft_delete", "SELECT id, is_deleted OR status = 'inactive' AS is_deleted FROM users", "users")
def c18_delete(spark, d):
    return access.soft_delete(fx.users(spark, d), F.col("status") == "inactive").select("id", "is_deleted")


_ACTION = """CASE WHEN contains(path, '/auth/login') THEN CASE WHEN status = 200 THEN 'login' ELSE 'login_failed' END
  WHEN contains(path, '/auth/logout') THEN 'logout' WHEN contains(path, '/auth/register') THEN 'register'
  WHEN contains(path, '/reports/generate') AND method = 'POST' THEN 'report_generate'
  WHEN contains(path, '/reports/download') THEN 'report_download' WHEN contains(path, '/ws/') THEN 'websocket_connect'
  WHEN method = 'POST' THEN 'create' WHEN method = 'DELETE' THEN 'delete' WHEN method IN ('PUT', 'PATCH') THEN 'update'
  ELSE 'read' END"""


@query("c19_classify_requests", f"SELECT event_id, {_ACTION} AS action FROM requests", "requests")
def c19(spark, d):
    return access.classify_requests(fx.requests(fx.ev(spark, d))).select("event_id", "action")


@query("c20_client_ip", "SELECT event_id, ip_address FROM request_ip", "request_ip")
def c20(spark, d):
    return fx.requests(fx.ev(spark, d)).select("event_id", sc.client_ip("forwarded", "host").alias("ip_address"))


@query("c21_update_allowed", """
SELECT id, name, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'officer' ELSE role END AS role,
       CASE WHEN id % 3 = 0 THEN 'inactive' ELSE status END AS status, department FROM users""", "users")
def c21(spark, d):
    users = fx.users(spark, d).select("id", "name", "role", "status", "department")
    third = F.col("id") % 3 == 0
    changes = users.select(
        "id", F.lit("renamed").alias("name"),
        F.when(third, F.when(F.col("id") % 2 == 0, "officer").otherwise("emperor")).alias("role"),
        F.when(third, "inactive").alias("status"))
    return access_update(users, changes)


def access_update(users, changes):
    return clean.update_allowed(users, changes, "id", ("role", "status", "department"),
                                {"role": ("admin", "officer", "analyst"), "status": ("active", "inactive", "suspended")})
