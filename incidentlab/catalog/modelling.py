"""M: features, models, validation folds, explanations and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import explain, models
from ..operators.scale import settle
from ..session import new_table_dir
from ..functions.scalar import rounded
from .registry import query, rnd

R = rnd
_KEY = ["unit", "year", "month"]
_MODELS: dict[tuple, object] = {}

_PANEL_FEATURES = ("n_lag_1", "n_lag_12", "rolling_mean_3m", "rolling_std_6m", "month_sin", "crime_growth", "momentum",
                   "acceleration", "neighbor_density", "weekend_ratio")


def risk_panel(spark, d):
    return models.build_risk_features(fx.unit_month(spark, d).drop("loss", "weight"), "n")


@query("m1_build_risk_features", f"""
SELECT unit, year, month, CAST(lag(n, 1) OVER w AS DOUBLE) AS n_lag_1, CAST(lag(n, 12) OVER w AS DOUBLE) AS n_lag_12,
  {R('avg(n) OVER w3')} AS rolling_mean_3m, {R('coalesce(stddev_samp(n) OVER w6, 0)')} AS rolling_std_6m,
  {R('sin(2 * pi() * month / 12)')} AS month_sin, {R('crime_growth')} AS crime_growth, {R('momentum')} AS momentum,
  {R('acceleration')} AS acceleration, CAST(0 AS DOUBLE) AS neighbor_density, CAST(0 AS DOUBLE) AS weekend_ratio
FROM um_accel WINDOW w AS (PARTITION BY unit ORDER BY year, month),
  w3 AS (PARTITION BY unit ORDER BY year, month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  w6 AS (PARTITION BY unit ORDER BY year, month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""", "um_accel")
def m1(spark, d):
    return risk_panel(spark, d).select(*_KEY, *[(rounded(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c) for c in _PANEL_FEATURES])


def cell_panel(spark, d):
    return models.build_cell_features(fx.pts(spark, d))


@query("m2_build_cell_features", f"""
SELECT cell, year, month, crime_count, {R('lag(crime_count) OVER w', 2)} AS lag_1,
  {R('avg(crime_count) OVER w3', 4)} AS rolling_mean_3m FROM cell_month
WINDOW w AS (PARTITION BY cell ORDER BY year, month),
  w3 AS (PARTITION BY cell ORDER BY year, month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""", "cell_month")
def m2(spark, d):
    return cell_panel(spark, d).select("cell", "year", "month", "crime_count", rounded("crime_count_lag_1", 2).alias("lag_1"),
                                       rounded("rolling_mean_3m", 4).alias("rolling_mean_3m"))


_FIT = ["n_lag_1", "n_lag_2", "n_lag_3", "n_lag_12", "rolling_mean_3m", "rolling_mean_12m", "rolling_std_6m", "ema_6m",
        "month_sin", "month_cos", "crime_growth", "momentum"]


def _kept(spark, name, d, fit):
    """A model fitted once for each application and folder: several queries ask for the same one."""
    key = (spark.sparkContext.applicationId, name, d)
    if key not in _MODELS:
        _MODELS[key] = fit()
    return _MODELS[key]


def _fitted(spark, d):
    """The risk model of the documented settings: learns up to 1999, stops by the year 2000."""
    def fit():
        panel = risk_panel(spark, d).filter(F.col("year") <= 2000).withColumn("is_val", F.col("year") == 2000)
        return models.fit_risk(panel, _FIT, "n", "is_val")
    return _kept(spark, "risk", d, fit)


def _better(df, target):
    """Rows, rows with a prediction, and whether the error is smaller than that of the mean."""
    error = F.col(target) - F.col(models.PREDICTION)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(models.PREDICTION).alias("predicted"),
                  (F.sum(error * error) < F.var_pop(target) * F.count(target)).alias("better_than_mean"))


@query("m3_fit_risk", "SELECT count(*) AS rows, count(*) AS predicted, true AS better_than_mean FROM unit_month", "unit_month")
def m3(spark, d):
    return _better(models.predict(_fitted(spark, d), risk_panel(spark, d), _FIT), "n")


_CELL_FIT = ["crime_count_lag_1", "crime_count_lag_2", "rolling_mean_3m", "ema_6m", "month_sin", "month_cos"]


def _cell_model(spark, d):
    def fit():
        panel = cell_panel(spark, d).filter(F.col("year") <= 2000).withColumn("is_val", F.col("year") == 2000)
        return models.fit_hotspot(panel, _CELL_FIT, validation="is_val")
    return _kept(spark, "cells", d, fit)


_LIST_SQL = """SELECT count(*) AS rows, count(*) AS ranks, CAST(1 AS BIGINT) AS first, count(*) AS last, CAST(0 AS DOUBLE) AS low,
  CAST(100 AS DOUBLE) AS high, CAST(0 AS BIGINT) AS out_of_order FROM """


def _ranked(df, rank):
    """A ranked list in one row: rows, ranks, score limits, and neighbours whose scores rise."""
    scored = settle(df.select(F.col(rank).cast("long").alias(rank), "risk_score"))
    before = scored.select((F.col(rank) + 1).alias(rank), F.col("risk_score").alias("_before"))
    return scored.join(before, rank, "left").withColumn("_up", F.col("_before") < F.col("risk_score")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(rank).alias("ranks"), F.min(rank).alias("first"), F.max(rank).alias("last"),
        F.min("risk_score").alias("low"), F.max("risk_score").alias("high"), F.count_if("_up").alias("out_of_order"))


@query("m4_fit_hotspot", _LIST_SQL + "cell_month", "cell_month")
def m4(spark, d):
    return _ranked(models.score_cells(_cell_model(spark, d), cell_panel(spark, d), _CELL_FIT), "hotspot_rank")


@query("m5_score_units", _LIST_SQL + "unit_month", "unit_month")
def m5(spark, d):
    return _ranked(models.score_units(_fitted(spark, d), risk_panel(spark, d), _FIT), "priority_rank")


@query("m6_fold_sizes", """
WITH c AS (SELECT count(*) AS n FROM unit_month), k AS (SELECT n, CAST(f AS INTEGER) AS fold, n // 6 AS t FROM c, range(1, 6) r(f)),
s AS (SELECT fold, t, n - (6 - fold) * t AS start FROM k),
o AS (SELECT row_number() OVER (ORDER BY year, month, unit) - 1 AS i FROM unit_month)
SELECT fold, CAST(count(*) FILTER (WHERE i < start - 1) AS BIGINT) AS train_size,
       CAST(count(*) FILTER (WHERE i >= start AND i < start + t) AS BIGINT) AS test_size FROM s, o GROUP BY fold""", "unit_month")
def m6(spark, d):
    ordered = models.ordered_rows(fx.unit_month(spark, d), ["year", "month", "unit"])
    return models.fold_sizes(ordered, models.time_folds(ordered.count()))


@query("m6_cross_validate", """
WITH c AS (SELECT count(*) AS n FROM unit_month), k AS (SELECT n, CAST(f AS INTEGER) AS fold, n // 6 AS t FROM c, range(1, 6) r(f))
SELECT fold, t AS rows, n - (6 - fold) * t - 1 AS train_size, t AS test_size, CAST(5 AS INTEGER) AS n_splits, n AS total_samples,
  true AS has_errors FROM k
UNION ALL SELECT 0, CAST(sum(t) AS BIGINT), 0, 0, 5, max(n), true FROM k""", "unit_month")
def m6_cv(spark, d):
    errors = models.cross_validate(risk_panel(spark, d), ["year", "month", "unit"], _FIT, "n")
    found = F.col("rmse").isNotNull() & F.col("mae").isNotNull() & (F.col("rmse") >= F.col("mae"))
    size = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)  # noqa: E731  the pooled row has no sizes of its own
    return errors.select("fold", "rows", size("train_size"), size("test_size"), "n_splits", "total_samples", found.alias("has_errors"))


@query("m7_evaluate", "SELECT count(*) AS rows, true AS has_errors FROM unit_month WHERE year > 2000", "unit_month")
def m7(spark, d):
    errors = models.evaluate(_fitted(spark, d), risk_panel(spark, d).filter(F.col("year") > 2000), _FIT, "n")
    return errors.select("rows", ((F.col("rmse") >= F.col("mae")) & F.col("r2").isNotNull() & (F.col("mape") >= 0)).alias("has_errors"))


@query("m8_gain_importance", "SELECT feature, CAST(100 AS DOUBLE) AS total_pct, true AS from_0_to_100 FROM (VALUES "
       + ", ".join(f"('{c}')" for c in _FIT) + ") AS v(feature)")
def m8(spark, d):
    """The named features, whose shares are percentages of the whole."""
    gains = explain.gain_importance(spark, _fitted(spark, d), _FIT)
    total = gains.agg(F.sum("importance_pct")).scalar()
    return gains.select("feature", F.round(total, 0).alias("total_pct"), F.col("importance_pct").between(0, 100).alias("from_0_to_100"))


_ROW = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_WEIGHTS = {"l_quantity": 1.5, "l_discount": -40.0, "l_tax": 25.0}


def _rows(spark, d):
    li = fx.table(spark, d, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    return li.withColumn("row", F.concat_ws("|", *[F.col(c).cast("string") for c in (*_ROW, "day")]))


def _linear(spark, d):
    return explain.linear_attributions(_rows(spark, d), "row", _WEIGHTS, 10.0)


_PHI = "WITH phi AS (" + " UNION ALL ".join(
    f"SELECT concat_ws('|', {', '.join(_ROW)}, CAST(l_shipdate AS DATE)) AS row, '{c}' AS feature, {c} AS value, "
    f"CAST({w} AS DOUBLE) * ({c} - (SELECT avg({c}) FROM lineitem)) AS phi FROM lineitem" for c, w in _WEIGHTS.items()) + ")"


@query("m9_global_attribution", f"""{_PHI}
SELECT feature, {R('m')} AS mean_abs, {R('m * 100 / sum(m) OVER ()', 2)} AS importance_pct
FROM (SELECT feature, avg(abs(phi)) AS m FROM phi GROUP BY feature)""")
def m9(spark, d):
    return explain.global_attribution(_linear(spark, d)).withColumn("mean_abs", rounded("mean_abs", 6))


@query("m10_linear_attributions", f"""{_PHI}
SELECT row, feature, {R('phi')} AS phi, {R('10 + (SELECT 1.5 * avg(l_quantity) - 40 * avg(l_discount) + 25 * avg(l_tax) FROM lineitem)')} AS base
FROM phi""")
def m10(spark, d):
    return _linear(spark, d).select("row", "feature", (rounded("phi", 6) + F.lit(0.0)).alias("phi"), rounded("base", 6).alias("base"))


@query("m10_sampled_attributions", "SELECT count(*) AS rows, CAST(12 AS BIGINT) AS features, CAST(0 AS BIGINT) AS empty FROM unit_month", "unit_month")
def m10_sampled(spark, d):
    """Every unit-month is explained on all features against the background of 100 rows: explained rows, features, missing values."""
    panel = risk_panel(spark, d).withColumn("row", F.concat_ws("|", *_KEY))
    phi = explain.sampled_attributions(panel, models.background_sample(panel, "row"), _fitted(spark, d), _FIT, "row")
    return phi.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("phi").isNull()).alias("empty")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("n").alias("features"), F.sum("empty").alias("empty"))


@query("m11_local_drivers", f"""{_PHI}
SELECT row, side, CAST(row_number() OVER (PARTITION BY row, side ORDER BY abs(phi) DESC, feature) AS INTEGER) AS position, feature,
  {R('phi', 4)} AS phi, {R('value', 4)} AS value
FROM (SELECT *, CASE WHEN phi > 0 THEN 'positive' ELSE 'negative' END AS side FROM phi WHERE phi <> 0)
QUALIFY position <= 5""")
def m11(spark, d):
    return explain.local_drivers(explain.linear_attribution_rows(_rows(spark, d), "row", _WEIGHTS, 10.0), "row")


_UNIT_PHI = f"""WITH m AS (SELECT unit, avg(n) AS n, avg(loss) / 100000 AS loss, avg(month) AS month FROM unit_month GROUP BY unit),
phi AS (SELECT unit, 'n' AS feature, 2 * (n - (SELECT avg(n) FROM m)) AS phi FROM m UNION ALL
  SELECT unit, 'loss', 3 * (loss - (SELECT avg(loss) FROM m)) FROM m UNION ALL
  SELECT unit, 'month', -1 * (month - (SELECT avg(month) FROM m)) FROM m)"""


def _unit_phi(spark, d):
    means = fx.unit_month(spark, d).groupBy("unit").agg(F.avg("n").alias("n"), (F.avg("loss") / 100000).alias("loss"),
                                                        F.avg("month").alias("month"))
    return explain.linear_attributions(means, "unit", {"n": 2.0, "loss": 3.0, "month": -1.0})


@query("m12_unit_drivers", f"""{_UNIT_PHI}
SELECT feature, {R('abs(phi)')} AS importance, CASE WHEN phi > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM phi WHERE lower(unit) = 'nation_11' ORDER BY abs(phi) DESC, feature LIMIT 10""", "unit_month")
def m12(spark, d):
    phi = _unit_phi(spark, d)
    return explain.unit_drivers(phi, "unit", "Nation_11", explain.global_attribution(phi)).withColumn("importance", rounded("importance", 6))


@query("m12_unit_drivers_fallback", f"""{_UNIT_PHI}
SELECT feature, {R('avg(abs(phi))')} AS importance, CAST(NULL AS VARCHAR) AS direction FROM phi GROUP BY feature""", "unit_month")
def m12_fallback(spark, d):
    phi = _unit_phi(spark, d)
    return explain.unit_drivers(phi, "unit", "Atlantis", explain.global_attribution(phi)).withColumn("importance", rounded("importance", 6))


@query("m13_cluster", """
SELECT state = 'ASIA' AS focus, count(*) AS rows, CAST(CASE WHEN state = 'ASIA' THEN 0 ELSE -1 END AS INTEGER) AS lowest,
       CAST(CASE WHEN state = 'ASIA' THEN 7 ELSE -1 END AS INTEGER) AS highest FROM inc GROUP BY ALL""", "inc")
def m13(spark, d):
    named = models.cluster(fx.pts(spark, d).select("id", "state", "lat", "lon"), F.col("state") == "ASIA", ["lat", "lon"])
    return named.groupBy((F.col("state") == "ASIA").alias("focus")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("cluster_id").alias("lowest"), F.max("cluster_id").alias("highest"))


@query("m14_save_load", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS different FROM unit_month", "unit_month")
def m14(spark, d):
    """Rows, and rows whose prediction differs after the model was written and read."""
    path, panel = new_table_dir(spark, "model"), settle(risk_panel(spark, d))
    models.save_model(_fitted(spark, d), path)
    before, after = (models.predict(m, panel, _FIT).select(*_KEY, F.col(models.PREDICTION).alias(n))
                     for m, n in ((_fitted(spark, d), "p"), (models.load_model(path), "q")))
    return before.join(after, _KEY).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("p").eqNullSafe(F.col("q"))).alias("different"))


@query("m15_background_sample", "SELECT id, unit, loss FROM inc ORDER BY md5('42|' || CAST(id AS VARCHAR)), id LIMIT 100", "inc")
def m15(spark, d):
    return models.background_sample(fx.inc(spark, d).select("id", "unit", "loss"), "id")
