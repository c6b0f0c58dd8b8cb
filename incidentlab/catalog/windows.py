"""W: window features, ranks, scores, allocation and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.geo import cell_index
from ..operators import allocate, panel, risk, spatial, temporal
from ..operators.scale import settle
from ..plans import enrich
from .joins import unit_year_chain
from ..functions.scalar import rounded
from .registry import query, rnd
from .storage import hot_cells

R = rnd
_KEY = ["unit", "year", "month"]


def _um(spark, d):
    return fx.unit_month(spark, d).select("unit", "state", "year", "month", "quarter", "n")


def _rounded(df, *columns: str, keys=tuple(_KEY), digits: int = 6):
    return df.select(*keys, *[rounded(F.col(c).cast("double"), digits).alias(c) for c in columns])


@query("w1_lags", "SELECT unit, year, month, " + ", ".join(
    f"CAST(lag(n, {k}) OVER w AS DOUBLE) AS n_lag_{k}" for k in range(1, 13))
    + " FROM unit_month WINDOW w AS (PARTITION BY unit ORDER BY year, month)", "unit_month")
def w1(spark, d):
    return _rounded(temporal.lags(_um(spark, d), ["unit"], "n"), *[f"n_lag_{k}" for k in range(1, 13)])


_ROLL = ", ".join(f"{R(f'avg(n) OVER w{s}')} AS rolling_mean_{s}m, {R(f'coalesce(stddev_samp(n) OVER w{s}, 0)')} AS rolling_std_{s}m"
                  for s in (3, 6, 12))
_ROLL_W = ", ".join(f"w{s} AS (PARTITION BY unit ORDER BY year, month ROWS BETWEEN {s} PRECEDING AND 1 PRECEDING)" for s in (3, 6, 12))


@query("w2_rolling", f"SELECT unit, year, month, {_ROLL} FROM unit_month WINDOW {_ROLL_W}", "unit_month")
def w2(spark, d):
    return _rounded(temporal.rolling(_um(spark, d), ["unit"], "n"),
                    *[f"rolling_{s}_{w}m" for w in (3, 6, 12) for s in ("mean", "std")])


_EMA = """WITH RECURSIVE s AS (SELECT unit, year, month, CAST(n AS DOUBLE) AS x,
    row_number() OVER (PARTITION BY unit ORDER BY year, month) AS i FROM unit_month),
e AS (SELECT unit, i, x AS v FROM s WHERE i = 1 UNION ALL
      SELECT s.unit, s.i, e.v * (1 - CAST(2 AS DOUBLE) / 7) + s.x * (CAST(2 AS DOUBLE) / 7)
      FROM e JOIN s ON s.unit = e.unit AND s.i = e.i + 1)"""


@query("w3_ema", f"{_EMA} SELECT s.unit, s.year, s.month, {R('e.v')} AS ema_6m FROM s LEFT JOIN e ON e.unit = s.unit AND e.i = s.i - 1",
       "unit_month")
def w3(spark, d):
    return _rounded(temporal.ema(_um(spark, d), ["unit"], "n"), "ema_6m")


@query("w4_growth", f"SELECT unit, year, month, {R('crime_growth')} AS crime_growth FROM um_growth", "um_growth")
def w4(spark, d):
    return _rounded(temporal.growth(_um(spark, d), ["unit"], "n"), "crime_growth")


@query("w5_momentum", f"SELECT unit, year, month, {R('momentum')} AS momentum FROM um_momentum", "um_momentum")
def w5(spark, d):
    return _rounded(temporal.momentum(temporal.growth(_um(spark, d), ["unit"], "n"), ["unit"]), "momentum")


@query("w6_acceleration", f"SELECT unit, year, month, {R('acceleration')} AS acceleration FROM um_accel", "um_accel")
def w6(spark, d):
    return _rounded(temporal.growth_features(_um(spark, d), ["unit"], "n"), "acceleration")


_UY = ("state", "unit", "year")


def _uy_query(name: str, column: str, view: str, build):
    query(name, f"SELECT state, unit, year, {R(column)} AS {column} FROM {view}", view)(
        lambda spark, d: _rounded(build(fx.unit_year(spark, d)), column, keys=_UY))


_uy_query("w7_trend3", "trend_3y", "uy_feat", lambda df: temporal.trend3(df, "n"))
_uy_query("w8_yoy_pct", "growth_rate", "uy_feat", lambda df: temporal.yoy_pct(df, "n"))
_uy_query("w9_historical_growth", "historical_growth", "uy_feat", lambda df: temporal.historical_growth(temporal.yoy_pct(df, "n")))
_uy_query("w10_expected_growth", "expected_growth", "uy_feat", lambda df: temporal.expected_growth(temporal.yoy_pct(df, "n")))


def _risk(spark, d):
    near = enrich.unit_year_neighbours(unit_year_chain(spark, d), fx.edges(spark, d), "n")
    return settle(risk.with_risk_index(near, "n", "rate_100k", "growth_rate", "neighbor_risk"))


@query("w11_risk_percentile", f"""
SELECT state, unit, year, {R('(r + (same - 1) / CAST(2 AS DOUBLE)) / total', 4)} AS risk_percentile FROM (
  SELECT *, rank() OVER (PARTITION BY year ORDER BY risk_index) AS r, count(*) OVER (PARTITION BY year, risk_index) AS same,
         count(*) OVER (PARTITION BY year) AS total FROM uy_risk)""", "uy_risk")
def w11(spark, d):
    return risk.rank_within_year(_risk(spark, d)).select("state", "unit", "year", "risk_percentile")


@query("w12_risk_rank", """
SELECT state, unit, year, CAST(rank() OVER (PARTITION BY year ORDER BY risk_index DESC) AS BIGINT) AS risk_rank FROM uy_risk""",
       "uy_risk")
def w12(spark, d):
    return risk.rank_within_year(_risk(spark, d)).select("state", "unit", "year", "risk_rank")


@query("w13_trend_score", f"""
SELECT state, unit, year, {R('CASE WHEN hi > lo THEN (trend_3y - lo) / (hi - lo) ELSE 0 END', 4)} AS trend_score FROM (
  SELECT *, min(trend_3y) OVER (PARTITION BY year) AS lo, max(trend_3y) OVER (PARTITION BY year) AS hi FROM uy_feat)""", "uy_feat")
def w13(spark, d):
    return risk.with_trend_score(unit_year_chain(spark, d)).select("state", "unit", "year", "trend_score")


@query("w14_anomaly_score", f"""
SELECT state, unit, year, {R('abs(CASE WHEN sd = 0 THEN 0 ELSE (growth_rate - mean) / sd END)', 4)} AS anomaly_score FROM (
  SELECT *, avg(growth_rate) OVER (PARTITION BY state, unit) AS mean, stddev_samp(growth_rate) OVER (PARTITION BY state, unit) AS sd
  FROM uy_feat)""", "uy_feat")
def w14(spark, d):
    return risk.with_anomaly_score(unit_year_chain(spark, d)).select("state", "unit", "year", "anomaly_score")


@query("w15_z_score", f"""
WITH b AS (SELECT state, unit, year, coalesce(rate_100k, CAST(n AS DOUBLE)) AS b FROM uy_feat)
SELECT state, unit, year, {R('(b - (SELECT avg(b) FROM b)) / (SELECT stddev_samp(b) FROM b)')} AS z FROM b""", "uy_feat")
def w15(spark, d):
    df = spatial.with_z_score(unit_year_chain(spark, d), F.coalesce("rate_100k", F.col("n").cast("double")))
    return _rounded(df, "z", keys=_UY)


@query("w16_score_0_100", f"SELECT unit, year, month, {R('raw_score', 2)} AS risk_score, priority_rank FROM score", "score")
def w16(spark, d):
    return risk.score_0_100(fx.scored(spark, d), "p", _KEY).select(*_KEY, "risk_score", "priority_rank")


@query("w17_confidence", f"""
WITH s AS (SELECT median(p) AS med, stddev_pop(p) AS sd FROM scored)
SELECT unit, year, month, {R('least(greatest(1 - abs(p - med) / (sd * 3 + CAST(1e-6 AS DOUBLE)), 0), 1)', 4)} AS confidence
FROM scored, s""", "scored")
def w17(spark, d):
    return risk.with_confidence(fx.scored(spark, d), "p").select(*_KEY, "confidence")


@query("w16_w17_risk_scores", f"""
WITH s AS (SELECT median(p) AS med, stddev_pop(p) AS sd FROM scored)
SELECT unit, year, month, {R('raw_score', 2)} AS risk_score, priority_rank,
  {R('least(greatest(1 - abs(p - med) / (sd * 3 + CAST(1e-6 AS DOUBLE)), 0), 1)', 4)} AS confidence FROM score, s""", "score")
def w16_w17(spark, d):
    return risk.risk_scores(fx.scored(spark, d), "p", _KEY).select(*_KEY, "risk_score", "priority_rank", "confidence")


@query("w18_hotspots", f"""
SELECT cell, year, month, crime_count, {R('raw_score', 2)} AS risk_score, hotspot_rank FROM cell_hot""", "cell_hot")
def w18(spark, d):
    return hot_cells(spark, d).select("cell", "year", "month", "crime_count", "risk_score", F.col("hotspot_rank").cast("long").alias("hotspot_rank"))


def _shares(spark, d):
    """Members of each region with the inputs of a share score, from the customer table."""
    nation, customer = fx.table(spark, d, "nation"), fx.table(spark, d, "customer")
    members = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_regionkey").alias("parent"), F.col("n_name").alias("unit"), F.col("n_nationkey").alias("k")).agg(
        F.count(F.lit(1)).alias("people"))
    return members.select("parent", "unit", "people", (F.col("people") * 1000).alias("population"),
                          (F.col("people") / (F.col("k") + 3)).alias("density"),
                          ((F.col("k") * 7 % 10 + 1) / 10.0).alias("commercial"),
                          F.when(F.col("k") % 5 == 0, 1.0).when(F.col("k") % 5 == 1, 0.6).otherwise(0.0).alias("capital"))


_MEMBERS = """members AS (SELECT n_regionkey AS parent, n_name AS unit, n_nationkey AS k, count(*) AS people
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_name, n_nationkey),
inputs AS (SELECT parent, unit, people, people * 1000 AS population, CAST(people AS DOUBLE) / (k + 3) AS density,
  CAST(k * 7 % 10 + 1 AS DOUBLE) / 10 AS commercial, CAST(CASE WHEN k % 5 = 0 THEN 1 WHEN k % 5 = 1 THEN 0.6 ELSE 0 END AS DOUBLE) AS capital
  FROM members),
raw AS (SELECT *, CAST(0.55 AS DOUBLE) * population / sum(population) OVER p + CAST(0.20 AS DOUBLE) * density / sum(density) OVER p
  + CAST(0.15 AS DOUBLE) * commercial / sum(commercial) OVER p
  + CAST(0.10 AS DOUBLE) * coalesce(capital / nullif(sum(capital) OVER p, 0), 0) AS score FROM inputs
  WINDOW p AS (PARTITION BY parent)),
shares AS (SELECT parent, unit, score / sum(score) OVER (PARTITION BY parent) AS share FROM raw),
rounded AS (SELECT parent, unit, round(share, 6) AS share FROM shares)"""


@query("w20_share_score", f"WITH {_MEMBERS} SELECT parent, unit, {R('share')} AS share FROM shares")
def w20(spark, d):
    return allocate.share_score(_shares(spark, d), ["parent"]).select("parent", "unit", rounded("share", 6).alias("share"))


@query("w19_apportion", f"""
WITH {_MEMBERS}, t AS (SELECT c_r AS parent, count(*) AS total FROM (
  SELECT n_regionkey AS c_r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY c_r),
own AS (SELECT r.parent, unit, total, share, CAST(round(total * share) AS BIGINT) AS v,
    row_number() OVER (PARTITION BY r.parent ORDER BY share DESC, unit) AS i, count(*) OVER (PARTITION BY r.parent) AS c
  FROM rounded r JOIN t ON r.parent = t.parent)
SELECT parent, unit, CAST(CASE WHEN i = c THEN total - coalesce(sum(v) FILTER (WHERE i < c) OVER (PARTITION BY parent), 0) ELSE v END AS BIGINT)
  AS allocated FROM own""")
def w19(spark, d):
    totals = fx.inc(spark, d).join(fx.table(spark, d, "nation"), F.col("unit") == F.col("n_name")).groupBy(
        F.col("n_regionkey").alias("parent")).agg(F.count(F.lit(1)).alias("total"))
    shares = allocate.share_score(_shares(spark, d), ["parent"]).withColumn("share", rounded("share", 6)).join(totals, "parent")
    return allocate.apportion(shares, ["parent"], "unit", "total", "share").select("parent", "unit", "allocated")


@query("w21_project_total", """
WITH k AS (SELECT unit, arg_min(n, year) AS v0, arg_max(n, year) AS v1, min(year) AS y0, max(year) AS y1 FROM unit_year GROUP BY unit),
a AS (SELECT k.*, CAST(y AS INTEGER) AS year FROM k, (SELECT unnest([1996, 1998, 2000, 2001, 2002, 2003, 2004]) AS y)),
r AS (SELECT *, greatest(CAST(-0.15 AS DOUBLE), least(CAST(0.35 AS DOUBLE),
        pow(CAST(v1 AS DOUBLE) / v0, CAST(1 AS DOUBLE) / (y1 - y0)) - 1)) AS rate FROM a)
SELECT r.unit, r.year, coalesce(CAST(u.n AS DOUBLE), greatest(0, round(v1 * pow(1 + rate, r.year - y1)))) AS n
FROM r LEFT JOIN unit_year u ON u.unit = r.unit AND u.year = r.year""", "unit_year")
def w21(spark, d):
    return allocate.project_total(fx.unit_year(spark, d), ["unit"], "year", "n", (1996, 1998, 2000, 2001, 2002, 2003, 2004))


@query("w22_capped_sample", f"""
SELECT id, unit, year, {R('total / CAST(least(40, total) AS DOUBLE)', 4)} AS sample_weight FROM (
  SELECT id, unit, year, row_number() OVER (PARTITION BY state, unit, year ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) AS r,
         count(*) OVER (PARTITION BY state, unit, year) AS total FROM inc) WHERE r <= 40""", "inc")
def w22(spark, d):
    df = fx.inc(spark, d).select("id", "state", "unit", "year")
    return allocate.capped_sample(df, ["state", "unit", "year"], "id", 40).select("id", "unit", "year", "sample_weight")


@query("w23_category_mix", f"""
WITH b AS (SELECT unit, category, CAST(count(*) AS DOUBLE) AS c FROM inc WHERE year <= 1996 GROUP BY unit, category),
k AS (SELECT unit, category, c / sum(c) OVER (PARTITION BY unit) AS base, CAST(length(category) - 8 AS DOUBLE) / 20 AS growth,
  CASE WHEN category = 'MACHINERY' THEN 1998 ELSE 1996 END AS intro, CASE WHEN length(unit) > 6 THEN CAST(1.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS boost FROM b),
y AS (SELECT k.*, CAST(y AS INTEGER) AS year FROM k, range(1996, 2002) t(y)),
w AS (SELECT *, (CASE WHEN year < intro THEN 0 ELSE base * pow(1 + growth, year - 1996) END)
  * (CASE WHEN category = 'BUILDING' THEN boost ELSE 1 END) AS w FROM y)
SELECT unit, year, category, {R('coalesce(w / nullif(sum(w) OVER (PARTITION BY unit, year), 0), 0)')} AS share FROM w""", "inc")
def w23(spark, d):
    base = fx.inc(spark, d).filter(F.col("year") <= 1996).groupBy("unit", "category").agg(F.count(F.lit(1)).cast("double").alias("c"))
    totals = base.groupBy("unit").agg(F.sum("c").alias("t"))
    mix = base.join(totals, "unit").select(
        "unit", "category", (F.col("c") / F.col("t")).alias("base"), ((F.length("category") - 8) / 20.0).alias("growth"),
        F.when(F.col("category") == "MACHINERY", 1998).otherwise(1996).alias("intro_year"),
        F.when((F.col("category") == "BUILDING") & (F.length("unit") > 6), 1.5).alias("boost"))
    return allocate.category_mix(mix, range(1996, 2002), first_year=1996).withColumn("share", rounded("share", 6))
