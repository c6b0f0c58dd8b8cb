"""Whole flows, sinks, models and plan shapes."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from incidentlab import fixtures as fx
from incidentlab.operators import explain, models, reports
from incidentlab.operators.models import BoostSettings
from incidentlab.plans import enrich, report, train
from incidentlab.sources import io
from incidentlab.streaming import jobs

QUICK = BoostSettings(trees=5, learning_rate=0.3, depth=3, min_rows=2)
YEARS = train.Years((1995, 1996, 1997, 1998), (1999,), (2000, 2001))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def trained(spark, data, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("train"))
    incidents = fx.pts(spark, data).drop("unit_key")
    return out, train.train(incidents, out, YEARS, risk=QUICK, cells=QUICK, folds=3)


def test_train_writes_rankings_models_and_report(spark, trained):
    out, frames = trained
    back = spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/predictions")
    assert back.count() == frames["predictions"].count() > 0
    assert spark.read.json(f"{out}/report/metrics").first()["rows"] > 0
    assert io.read_geojson(spark, f"{out}/hotspots_geojson", lines=True).count() == frames["hotspots"].count()
    assert models.load_model(f"{out}/models/risk").stages[-1].getNumTrees > 0


def test_scores_and_ranks_hold_their_ranges(trained):
    p = trained[1]["predictions"]
    n = p.count()
    row = p.agg(F.min("risk_score"), F.max("risk_score"), F.min("confidence"), F.max("confidence"),
                F.countDistinct("priority_rank"), F.max("priority_rank")).first()
    assert row[0] == 0 and row[1] == 100 and 0 <= row[2] <= row[3] <= 1 and row[4] == row[5] == n


def test_cross_validation_pools_all_folds(trained):
    rows = {r["fold"]: r["rows"] for r in trained[1]["cross_validation"].collect()}
    assert set(rows) == {0, 1, 2, 3} and rows[0] == rows[1] + rows[2] + rows[3]


def test_report_has_its_sections_and_a_summary(spark, trained):
    sections = {k.removeprefix("report."): v for k, v in trained[1].items() if k.startswith("report.")}
    assert {"top_risk_districts", "crime_trends", "monthly_trends", "seasonality", "moving_averages", "rolling_growth",
            "crime_category_distribution", "station_load", "risk_rankings", "hotspot_trends"} <= set(sections)
    table = report.summary(sections)
    assert {r["section"] for r in table.select("section").distinct().collect()} == set(sections)


def test_predict_with_a_saved_model(spark, data, trained):
    incidents = fx.pts(spark, data).drop("unit_key")
    units = train.unit_features(train.prepare(incidents), YEARS)
    features = [c for c in models.load_model(f"{trained[0]}/models/risk").stages[0].getInputCols()]
    scored, error = train.predict(incidents, models.load_model(f"{trained[0]}/models/risk"), features, YEARS)
    assert scored.count() == units.filter("split = 'test'").count() and error.first()["rmse"] >= 0


def test_sampled_attributions_add_up_to_the_change_from_background(spark, data):
    panel = models.build_risk_features(fx.unit_month(spark, data).drop("loss", "weight"), "n").withColumn(
        "row", F.concat_ws("|", "unit", "year", "month"))
    features = ["n_lag_1", "rolling_mean_3m", "month_sin"]
    model = models.fit_risk(panel, features, "n", settings=QUICK)
    background = models.background_sample(panel, "row", 1)  # one row: the base is its prediction
    phi = explain.sampled_attributions(panel, background, model, features, "row", permutations=3)
    base = models.predict(model, background, features).first()[models.PREDICTION]
    total = phi.groupBy("row").agg(F.sum("phi").alias("s"), F.count("phi").alias("k"))
    both = models.predict(model, panel, features).join(total, "row").select(
        F.abs(F.col(models.PREDICTION) - base - F.col("s")).alias("d"), "k")
    worst = both.agg(F.max("d"), F.min("k"), F.max("k"), F.count("d")).first()
    assert worst[0] < 1e-9 and worst[1] == worst[2] == len(features) and worst[3] == panel.count()


def test_clusters(spark, data):
    out = models.cluster(fx.pts(spark, data), F.col("state") == "ASIA", ["lat", "lon"], k=3)
    kinds = {(r["state"] == "ASIA", r["cluster_id"]) for r in out.select("state", "cluster_id").distinct().collect()}
    assert kinds == {(False, -1), (True, 0), (True, 1), (True, 2)}
    assert "cluster_id" in models.ensure_cluster(fx.inc(spark, data)).columns


def test_enrichment_keeps_every_incident(spark, data):
    incidents = fx.inc(spark, data)
    out = enrich.enrich_incidents(incidents, fx.unit_year(spark, data), fx.edges(spark, data), "n")
    assert out.count() == incidents.count() and set(enrich.FEATURES) <= set(out.columns)
    assert out.filter(F.col("risk_index").isNull()).count() == 0


def test_panel_write_prunes_years(spark, data, tmp_path):
    path = str(tmp_path / "panel")
    frame = fx.unit_month(spark, data)
    io.write_panel(frame, path)
    back = spark.read.parquet(path)
    assert back.count() == frame.count()
    assert "PartitionFilters: [isnotnull(year" in plan_of(back.filter("year = 1996"))


def test_exports(spark, data, tmp_path):
    ranked = fx.unit_year(spark, data).select("unit", "year", "n")
    io.export({"metrics": ranked.limit(1), "rankings": ranked}, "csv", str(tmp_path / "c"))
    io.export({"rankings": ranked}, "json", str(tmp_path / "j"))
    io.export({"rankings": ranked}, "geojson", str(tmp_path / "g"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == ranked.count()
    assert spark.read.json(str(tmp_path / "j/rankings")).count() == ranked.count()
    assert spark.read.text(str(tmp_path / "g")).count() == 0
    with pytest.raises(ValueError):
        io.export({"rankings": ranked}, "pdf", str(tmp_path / "p"))


@pytest.mark.parametrize("kind,names", [
    ("dashboard_summary", {"metrics", "top_districts"}), ("risk_ranking", {"rankings"}), ("hotspot_analysis", {"rankings", "geojson"}),
    ("analytics_report", {"a", "b"}), ("other", {"generated_at"})])
def test_report_payloads(spark, kind, names):
    df = spark.createDataFrame([(1, 1)], "priority_rank int, hotspot_rank int")
    assert set(reports.report_payload(kind, df, df, df, df, {"a": df, "b": df})) == names


def test_stream_in_many_batches_equals_batch(spark, data, tmp_path):
    events = fx.table(spark, data, "events")
    source = str(tmp_path / "in")
    events.repartitionByRange(6, "ts").write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source).withColumn(
        "ts", F.col("ts").cast("timestamp"))
    live = jobs.update_table(jobs.live_metrics(stream, 86400, ["event_type"], "value", late="60 days"), ["window_start", "event_type"], "live")
    twin = jobs.live_metrics(fx.ev(spark, data), 86400, ["event_type"], "value")
    pick = lambda df: sorted((r["window_start"], r["event_type"], r["n"]) for r in df.collect())
    assert pick(live) == pick(twin)
    latest = jobs.update_table(jobs.latest_by_key(stream, "user_id", "value", "ts", "event_id"), ["user_id"], "latest")
    assert sorted(map(tuple, latest.collect())) == sorted(
        map(tuple, jobs.latest_by_key(fx.ev(spark, data), "user_id", "value", "ts", "event_id").collect()))


def test_windowed_latest_equals_latest(spark, data):
    events = fx.ev(spark, data)
    merged = jobs.merge_latest(jobs.latest_in_windows(events, "user_id", "value", "ts", "event_id", 3600), "user_id")
    assert sorted(map(tuple, merged.collect())) == sorted(
        map(tuple, jobs.latest_by_key(events, "user_id", "value", "ts", "event_id").collect()))


def test_unlimited_paths_are_not_counted(spark):
    df = spark.createDataFrame([("/health", 1), ("/x", 1), ("/x", 1)], "path string, user_id int").withColumns(
        {"ts": F.lit("2024-01-01 00:00:01").cast("timestamp"), "forwarded": F.lit(None).cast("string"), "host": F.lit(None).cast("string")})
    assert [(r["identifier"], r["n"], r["remaining"]) for r in jobs.request_counts(df, 1).collect()] == [("user:1", 2, 0)]


def test_panel_features_share_one_window_exchange(spark, data):
    text = plan_of(models.build_risk_features(fx.unit_month(spark, data), "n"))
    assert len(re.findall(r"Exchange hashpartitioning\(unit", text)) == 1  # the windows'; the panel was settled for the scan
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_filters_and_columns_reach_the_scan(spark, data):
    text = plan_of(reports.category_by_focus(fx.inc(spark, data).filter(F.col("loss") > 1000), F.col("state") == "ASIA"))
    assert "GreaterThan(o_totalprice,1000.0)" in text and "o_orderpriority" not in text


def test_role_checks_do_not_join(spark, data):
    from incidentlab.operators import access

    text = plan_of(access.visible_rows(fx.reports(spark, data), fx.users(spark, data), 20, "reports"))
    assert "Join" not in text
