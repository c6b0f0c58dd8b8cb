"""J: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.geo import ring_centroid
from ..operators import access, clean, spatial
from ..plans import enrich
from ..functions.scalar import rounded
from .registry import query, rnd

R = rnd


def unit_year_chain(spark, d):
    return enrich.unit_year_rates(fx.unit_year(spark, d), "n")


_SIX = ("rate_100k", "trend_3y", "growth_rate", "historical_growth", "expected_growth", "neighbor_risk", "spatial_lag", "local_moran")


@query("j1_attach_unit_features", f"""
WITH v AS (SELECT *, coalesce(rate_100k, CAST(n AS DOUBLE)) AS v FROM uy_risk),
z AS (SELECT *, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS z FROM v),
nz AS (SELECT src, year, avg(z) AS nz FROM edges JOIN z ON dst = unit GROUP BY src, year),
m AS (SELECT z.*, z.z * nz.nz AS local_moran, count(*) OVER y AS of_year, rank() OVER (PARTITION BY z.year ORDER BY risk_index) AS up,
  rank() OVER (PARTITION BY z.year ORDER BY risk_index DESC) AS down, count(*) OVER (PARTITION BY z.year, risk_index) AS ties,
  min(trend_3y) OVER y AS lo, max(trend_3y) OVER y AS hi, avg(growth_rate) OVER u AS gm, stddev_samp(growth_rate) OVER u AS gs
  FROM z LEFT JOIN nz ON nz.src = z.unit AND nz.year = z.year WINDOW y AS (PARTITION BY z.year), u AS (PARTITION BY state, unit))
SELECT i.id, i.unit, i.year, m.n AS unit_count, {', '.join(f"{R('m.' + c)} AS {c}" for c in _SIX)}, m.risk_index AS risk_index,
  m.risk_index AS nearby_hotspot_score, {R('(up + (ties - 1) / 2) / of_year', 4)} AS risk_percentile, down AS risk_rank,
  {R('coalesce((trend_3y - lo) / nullif(hi - lo, 0), 0)', 4)} AS trend_score,
  CASE WHEN gs = 0 THEN 0 ELSE {R('abs((growth_rate - gm) / gs)', 4)} END AS anomaly_score
FROM inc i LEFT JOIN m ON i.state = m.state AND i.unit = m.unit AND i.year = m.year""", "uy_risk edges inc")
def j1(spark, d):
    """All fifteen unit-year features on every incident."""
    out = enrich.enrich_incidents(fx.inc(spark, d).select("id", "state", "unit", "year"), fx.unit_year(spark, d), fx.edges(spark, d), "n")
    return out.drop("state").withColumns({c: rounded(c, 6) for c in _SIX})


@query("j2_neighbor_mean", f"SELECT unit, year, {R('neighbor_risk')} AS neighbor_risk FROM uy_near", "uy_near")
def j2(spark, d):
    return spatial.neighbor_mean(fx.unit_year(spark, d), fx.edges(spark, d), "n").select(
        "unit", "year", rounded("neighbor_risk", 6).alias("neighbor_risk"))


@query("j3_spatial_lag", f"SELECT unit, year, {R('spatial_lag')} AS spatial_lag FROM uy_near", "uy_near")
def j3(spark, d):
    return spatial.spatial_lag(unit_year_chain(spark, d), fx.edges(spark, d), "rate_100k").select(
        "unit", "year", rounded("spatial_lag", 6).alias("spatial_lag"))


@query("j4_local_moran", f"""
WITH base AS (SELECT unit, year, coalesce(rate_100k, CAST(n AS DOUBLE)) AS b FROM uy_feat),
z AS (SELECT unit, year, (b - (SELECT avg(b) FROM base)) / (SELECT stddev_samp(b) FROM base) AS z FROM base),
nz AS (SELECT src, year, avg(z) AS nz FROM edges JOIN z ON dst = unit GROUP BY src, year)
SELECT z.unit, z.year, {R('z.z * nz.nz')} AS local_moran FROM z LEFT JOIN nz ON z.unit = nz.src AND z.year = nz.year""",
       "uy_feat edges")
def j4(spark, d):
    return spatial.local_moran_proxy(unit_year_chain(spark, d), fx.edges(spark, d), "rate_100k", "n").select(
        "unit", "year", rounded("local_moran", 6).alias("local_moran"))


_GAPS = """WITH gaps AS (SELECT a.name AS src, b.name AS dst, greatest(a.x0 - b.x1, b.x0 - a.x1, 0) AS dx,
  greatest(a.y0 - b.y1, b.y0 - a.y1, 0) AS dy FROM plots a JOIN plots b ON a.key <> b.key)"""


@query("j5_adjacency", f"{_GAPS} SELECT src, dst FROM gaps WHERE dx <= 0.021 AND dy <= 0.021", "plots")
def j5(spark, d):
    return spatial.adjacency(fx.plots(spark, d), 0.0105)


@query("j5_adjacency_rings", f"{_GAPS} SELECT src, dst FROM gaps WHERE sqrt(dx * dx + dy * dy) <= 0.021", "plots")
def j5_rings(spark, d):
    return spatial.adjacency(fx.plots(spark, d), 0.0105, exact=True)


@query("j6_point_in_polygon", """
SELECT p.id, b.name FROM pts p JOIN boxes b ON p.lon >= b.x0 AND p.lon < b.x1 AND p.lat >= b.y0 AND p.lat < b.y1""",
       "pts boxes")
def j6(spark, d):
    return spatial.point_in_polygon(fx.pts(spark, d), fx.boxes(spark, d)).select("id", "name")


@query("j6_outside_claimed", f"""
SELECT tested, outside, {R('CAST(outside AS DOUBLE) / tested')} AS failure_share FROM (
  SELECT CAST(count(*) AS BIGINT) AS tested, CAST(count(*) FILTER (WHERE NOT
    (lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1)) AS BIGINT) AS outside
  FROM pts JOIN boxes ON unit = name)""", "pts boxes")
def j6_outside(spark, d):
    return spatial.outside_claimed(fx.pts(spark, d), fx.boxes(spark, d), 0.0).withColumn(
        "failure_share", rounded("failure_share", 6))


def _mapping(spark, d):
    """Sources of every third customer: its own old name, and for every sixth a second one."""
    k, name = F.col("c_custkey"), F.col("c_name")
    entry = lambda prefix, approximate: F.struct(
        name.alias("name"), F.concat(F.lit(prefix), name).alias("source"), approximate.alias("approximate"))
    both = F.array(entry("OLD ", k % 2 == 1), entry("ALT ", F.lit(True)))
    sources = F.when(k % 6 == 0, both).when(k % 3 == 0, F.slice(both, 1, 1))
    return fx.table(spark, d, "customer").select(F.inline(sources))


@query("j7_crosswalk", """
SELECT c_name AS name, CASE WHEN c_custkey % 6 = 0 THEN 'ALT ' || c_name || ',OLD ' || c_name
  WHEN c_custkey % 3 = 0 THEN 'OLD ' || c_name ELSE c_name END AS sources, c_custkey % 3 = 0 AS approximate FROM customer""")
def j7(spark, d):
    units = fx.table(spark, d, "customer").select(F.col("c_name").alias("name"))
    return spatial.crosswalk(units, _mapping(spark, d)).withColumn("sources", F.array_join("sources", ","))


@query("j8_unresolved", "SELECT c_name AS name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 6 <> 0")
def j8(spark, d):
    units = fx.table(spark, d, "customer").select(F.col("c_name").alias("name"))
    polys = fx.plots(spark, d).select(
        F.when((F.col("key") % 6) == 0, F.concat(F.lit("ALT "), "name")).otherwise(F.col("name")).alias("name"), "ring")
    return spatial.unresolved(spatial.crosswalk(units, _mapping(spark, d)), polys)


@query("j9_attach_centroid", f"""
SELECT id, unit, {R('x0 + 2.4')} AS cx, {R('y0 + 2.4')} AS cy FROM inc JOIN boxes ON unit = name WHERE region_key <> 2""",
       "inc boxes")
def j9(spark, d):
    centroids = fx.boxes(spark, d).filter(F.col("region_key") != 2).select(
        F.col("name").alias("unit"), ring_centroid("ring").alias("c")).select(
        "unit", rounded("c.x", 6).alias("cx"), rounded("c.y", 6).alias("cy"))
    return spatial.attach_centroid(fx.inc(spark, d).select("id", "unit"), centroids, "unit")


@query("j10_lookup_default", """
SELECT id, state, CASE WHEN state IN ('ASIA', 'EUROPE') THEN 'high' WHEN state = 'AFRICA' THEN 'low' ELSE 'mid' END AS tier
FROM inc""", "inc")
def j10(spark, d):
    dim = fx.table(spark, d, "region").filter(F.col("r_name").isin("ASIA", "EUROPE", "AFRICA")).select(
        F.col("r_name").alias("state"), F.when(F.col("r_name") == "AFRICA", "low").otherwise("high").alias("tier"))
    return spatial.lookup_default(fx.inc(spark, d).select("id", "state"), dim, "state", "tier", "mid")


# user 20 is an admin, 1 an officer, 5 an analyst; 7 a deleted analyst, 207 neither; 1507 does not exist
_WATCHERS = (20, 1, 5, 7, 107, 999999)


def _seen(kind: str, everything: str, own: str, roles: str, alive: str) -> str:
    return " UNION ALL ".join(f"""
SELECT '{kind}' AS kind, CAST({u} AS BIGINT) AS uid, CAST(count(*) AS BIGINT) AS rows,
       CAST(coalesce(sum(id), 0) AS BIGINT) AS id_sum FROM {everything} t
WHERE ({own} = {u}{'' if kind == 'users' else f' AND EXISTS (SELECT 1 FROM users WHERE id = {u})'})
   OR EXISTS (SELECT 1 FROM users WHERE id = {u} AND role IN ({roles}) {alive})""" for u in _WATCHERS)


@query("j11_visible_rows", _seen("users", "users", "t.id", "'admin', 'officer'", "AND NOT is_deleted") + " UNION ALL "
       + _seen("reports", "reports", "t.user_id", "'admin', 'officer'", "") + " UNION ALL "
       + _seen("audit", "reports", "t.user_id", "'admin'", ""), "users reports")
def j11(spark, d):
    users, reports = fx.users(spark, d), fx.reports(spark, d)
    out = None
    for kind, table in (("users", users), ("reports", reports), ("audit", reports)):
        for uid in _WATCHERS:
            part = access.visible_rows(table, users, uid, kind).agg(
                F.lit(kind).alias("kind"), F.lit(uid).cast("long").alias("uid"), F.count(F.lit(1)).alias("rows"),
                F.coalesce(F.sum("id"), F.lit(0)).alias("id_sum"))
            out = part if out is None else out.unionByName(part)
    return out


@query("j12_upsert", """
WITH target AS (SELECT 'u' || CAST(id AS VARCHAR) AS cache_key, 'analytics' AS cache_type, department AS payload,
    role AS source, CAST(id % 4 AS BIGINT) AS hit_count, TIMESTAMP '2024-01-01 00:00:00' AS expires_at FROM users),
changes AS (SELECT 'u' || CAST(user_id * 12 AS VARCHAR) AS cache_key, event_type AS cache_type, props AS payload,
    CASE WHEN event_id % 3 = 0 THEN event_type END AS source, CAST(60 + event_id % 7 AS INTEGER) AS ttl_seconds, ts, event_id FROM ev),
c AS (SELECT cache_key, count(*) AS cnt, arg_max(payload, event_id) AS payload, arg_max(ttl_seconds, event_id) AS ttl_seconds,
    max(ts) AS ts, arg_max(source, event_id) FILTER (WHERE source IS NOT NULL) AS source, arg_min(cache_type, event_id) AS cache_type
  FROM changes GROUP BY cache_key)
SELECT coalesce(t.cache_key, c.cache_key) AS cache_key, coalesce(t.cache_type, c.cache_type) AS cache_type,
  CASE WHEN c.cnt IS NOT NULL THEN c.payload ELSE t.payload END AS payload, coalesce(c.source, t.source) AS source,
  CAST(CASE WHEN t.cache_key IS NOT NULL THEN t.hit_count + coalesce(c.cnt, 0) ELSE c.cnt - 1 END AS BIGINT) AS hit_count,
  CAST(CASE WHEN c.cnt IS NOT NULL THEN c.ts + to_seconds(c.ttl_seconds) ELSE t.expires_at END AS VARCHAR)[1:19] AS expires_at
FROM target t FULL OUTER JOIN c ON t.cache_key = c.cache_key""", "users ev")
def j12(spark, d):
    day = F.lit("2024-01-01 00:00:00").cast("timestamp")
    target = fx.users(spark, d).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("cache_key"), F.lit("analytics").alias("cache_type"),
        F.col("department").alias("payload"), F.length("department").alias("payload_size"), F.col("role").alias("source"),
        F.lit(300).alias("ttl_seconds"), day.alias("expires_at"), day.alias("last_refreshed_at"),
        (F.col("id") % 4).alias("hit_count"))
    changes = fx.ev(spark, d).select(
        F.concat(F.lit("u"), (F.col("user_id") * 12).cast("string")).alias("cache_key"), F.col("event_type").alias("cache_type"),
        F.col("props").alias("payload"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("source"),
        (60 + F.col("event_id") % 7).cast("int").alias("ttl_seconds"), F.col("ts").alias("changed_at"), "event_id")
    merged = access.upsert(target, changes, "cache_key", ["changed_at", "event_id"])
    return merged.select("cache_key", "cache_type", "payload", "source", "hit_count",
                         F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))
