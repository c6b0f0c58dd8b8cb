"""Empty groups, single rows, ties, constant columns, exact band edges."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from incidentlab.functions import geo, scalar as sc
from incidentlab.operators import access, allocate, clean, explain, models, panel, quality, reports, risk, spatial, temporal
from incidentlab.sources import io, profile


def series(spark, rows):
    return spark.createDataFrame(rows, "unit string, year int, month int, x double")


def values(df, *columns, order=("unit", "year", "month")):
    return [tuple(r) for r in df.orderBy(*order).select(*columns).collect()]


def test_one_row_group_has_no_past(spark):
    df = temporal.temporal_features(series(spark, [("a", 2020, 1, 5.0)]), ["unit"], "x")
    row = df.first()
    assert row["x_lag_1"] is None and row["ema_6m"] is None and row["rolling_mean_3m"] is None
    assert row["rolling_std_3m"] == 0 and row["crime_growth"] == 0 and row["momentum"] == 0 and row["acceleration"] == 0


def test_rolling_leaves_current_row_out(spark):
    df = series(spark, [("a", 2020, m, float(m)) for m in range(1, 6)])
    assert values(temporal.rolling(df, ["unit"], "x", (3,)), "rolling_mean_3m") == [(None,), (1.0,), (1.5,), (2.0,), (3.0,)]


def test_ema_equals_recursion_beyond_its_frame(spark):
    n, alpha = 400, 2 / 7
    df = series(spark, [("a", 1900 + i // 12, i % 12 + 1, float((i * 37) % 101)) for i in range(n)])
    got = [r[0] for r in values(temporal.ema(df, ["unit"], "x"), "ema_6m")]
    e, want = None, [None]
    for i in range(n - 1):
        x = float((i * 37) % 101)
        e = x if e is None else e * (1 - alpha) + x * alpha
        want.append(e)
    assert got[0] is None
    assert all(abs(a - b) < 1e-12 * max(1, abs(b)) for a, b in zip(got[1:], want[1:]))


def test_ema_span_one_is_the_previous_value(spark):
    df = series(spark, [("a", 2020, m, float(m)) for m in range(1, 4)])
    assert values(temporal.ema(df, ["unit"], "x", span=1), "ema_1m") == [(None,), (1.0,), (2.0,)]


def test_growth_with_denominator_zero_is_zero(spark):
    df = series(spark, [("a", 2020 + i // 12, i % 12 + 1, -1.0 if i == 0 else 4.0) for i in range(13)])
    assert values(temporal.growth(df, ["unit"], "x"), "crime_growth")[-1] == (0.0,)


def test_yoy_from_zero(spark):
    df = spark.createDataFrame([("s", "a", 1, 0), ("s", "a", 2, 0), ("s", "a", 3, 4)], "state string, unit string, year int, n long")
    got = values(temporal.yoy_pct(df, "n"), "growth_rate", order=("year",))
    assert got == [(0.0,), (0.0,), (None,)]


def test_percentile_uses_average_rank_and_min_rank_on_ties(spark):
    df = spark.createDataFrame([("a", 1, 0.1), ("b", 1, 0.5), ("c", 1, 0.5), ("d", 1, 0.9)], "unit string, year int, risk_index double")
    got = {r["unit"]: (r["risk_percentile"], r["risk_rank"]) for r in risk.rank_within_year(df).collect()}
    assert got == {"a": (0.25, 4), "b": (0.625, 2), "c": (0.625, 2), "d": (1.0, 1)}


def test_constant_columns(spark):
    df = spark.createDataFrame([("a", "a", 1, 3.0, 3.0), ("b", "b", 1, 3.0, 3.0)], "state string, unit string, year int, trend_3y double, p double")
    assert {r["trend_score"] for r in risk.with_trend_score(df).collect()} == {0.0}
    assert {r["risk_score"] for r in risk.score_0_100(df, "p", ["unit"]).collect()} == {0.0}
    assert {r["z"] for r in spatial.with_z_score(df, "p").collect()} == {0.0}
    assert reports.correlation_matrix(df, ["trend_3y", "p"]).filter("r is not null").count() == 0
    assert [r["n"] for r in reports.histogram(df, "p", 3).orderBy("bin").collect()] == [2, 0, 0]


def test_ranks_are_a_permutation_and_ties_go_by_key(spark):
    df = spark.createDataFrame([(f"u{i:03d}", float(i % 4)) for i in range(50)], "unit string, p double")
    rows = risk.score_0_100(df, "p", ["unit"]).orderBy("priority_rank").collect()
    assert [r["priority_rank"] for r in rows] == list(range(1, 51))
    assert [(-r["p"], r["unit"]) for r in rows] == sorted((-r["p"], r["unit"]) for r in rows)
    assert rows[0]["risk_score"] == 100.0 and rows[-1]["risk_score"] == 0.0


def test_confidence_of_one_row(spark):
    assert risk.with_confidence(spark.createDataFrame([(4.0,)], "p double"), "p").first()["confidence"] == 1.0


@pytest.mark.parametrize("score,band", [(39.99, "low"), (40.0, "medium"), (60.0, "high"), (79.99, "high"), (80.0, "critical"), (None, None)])
def test_band_edges(spark, score, band):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(sc.risk_band("s")).first()[0] == band


@pytest.mark.parametrize("value,expected", [(0.0, 1), (4.999, 40), (5.0, 41), (10.0, 80)])
def test_histogram_edges(spark, value, expected):
    assert spark.range(1).select(reports.bin_of(F.lit(value), F.lit(0.0), F.lit(10.0), 80)).first()[0] == expected


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-9.0,), (9.0,)], "v double")
    assert [r[0] for r in df.select(sc.clamp("v", -1, 1)).collect()] == [None, -1.0, 1.0]


def test_alert_levels(spark):
    units = spark.createDataFrame([("a", 85.0, 1), ("b", 75.0, 2), ("c", 74.9, 3), ("d", 99.0, 4)], "unit string, risk_score double, priority_rank int")
    cells = spark.createDataFrame([("x", 80.0, 1), ("y", 79.9, 2)], "cell string, risk_score double, hotspot_rank int")
    got = [(r["subject"], r["severity"], r["description"]) for r in reports.alerts(units, cells).collect()]
    assert sorted(got) == [("a", "critical", "Risk score 85.0 (rank #1)"), ("b", "high", "Risk score 75.0 (rank #2)"),
                           ("x", "high", "Score 80.0 (rank #1)")]


def test_mode_takes_smallest_and_unknown(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "c string, e string")
    assert {tuple(r) for r in clean.impute_mode(df).collect()} == {("a", "Unknown"), ("b", "Unknown")}


def test_drop_sparse_at_exactly_half_keeps(spark):
    df = spark.createDataFrame([(1, None, None), (2, 5, None), (3, None, 1), (4, 6, None)], "k int, half int, more int")
    assert clean.drop_sparse(df).columns == ["k", "half"]


def test_median_of_integers_is_not_truncated(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert sorted(r[0] for r in clean.impute_median(df).collect()) == [1.0, 1.5, 2.0]


def test_calendar_only_adds_what_is_missing(spark):
    df = spark.createDataFrame([("2024-12-30", 1999), ("bad", 1998)], "dt string, year int")
    rows = clean.with_calendar(df).orderBy("year").collect()
    assert (rows[0]["month"], rows[0]["week"], rows[0]["year"]) == (None, None, 1998)
    assert (rows[1]["month"], rows[1]["quarter"], rows[1]["week"], rows[1]["year"]) == (12, 4, 1, 1999)


def test_first_available(spark):
    a, b = spark.range(3), spark.range(10, 12)
    assert clean.first_available(a, b).count() == 3
    assert clean.first_available(a.filter("id < 0"), b).count() == 2


def test_apportion_sums_exactly(spark):
    rows = [("p", f"m{i}", 1000, s) for i, s in enumerate([0.333, 0.333, 0.334])] + [("q", "only", 7, 1.0)]
    df = spark.createDataFrame(rows, "parent string, member string, total long, share double")
    got = {r["member"]: r["allocated"] for r in allocate.apportion(df, ["parent"], "member", "total", "share").collect()}
    assert got["m0"] + got["m1"] + got["m2"] == 1000 and got["m2"] == 334 and got["only"] == 7


def test_share_score_sums_to_one_with_an_empty_column(spark):
    df = spark.createDataFrame([("p", "a", 1, 2.0, 3.0, 0.0), ("p", "b", 3, 1.0, 1.0, 0.0)],
                               "parent string, unit string, population long, density double, commercial double, capital double")
    total = sum(r["share"] for r in allocate.share_score(df, ["parent"]).collect())
    assert abs(total - 1) < 1e-12


def test_projection_limits(spark):
    df = spark.createDataFrame([("up", 2021, 100), ("up", 2023, 900), ("zero", 2021, 0), ("zero", 2023, 50), ("one", 2023, 8)],
                               "unit string, year int, n long")
    got = {(r["unit"], r["year"]): r["n"] for r in allocate.project_total(df, ["unit"], "year", "n", (2021, 2024)).collect()}
    assert got[("up", 2021)] == 100 and got[("up", 2024)] == round(900 * 1.35)
    assert got[("zero", 2024)] == 50 and got[("one", 2024)] == 8 and got[("one", 2021)] == 8


def test_category_mix_before_first_year(spark):
    df = spark.createDataFrame([("u", "a", 0.5, 0.0, 2021, None), ("u", "b", 0.5, 0.0, 2023, None)],
                               "unit string, category string, base double, growth double, intro_year int, boost double")
    got = {(r["year"], r["category"]): r["share"] for r in allocate.category_mix(df, (2021, 2023)).collect()}
    assert got == {(2021, "a"): 1.0, (2021, "b"): 0.0, (2023, "a"): 0.5, (2023, "b"): 0.5}


def brute_contains(ring, x, y):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


RINGS = {
    "star": [(0, 0), (4, 1), (8, 0), (7, 4), (8, 8), (4, 7), (0, 8), (1, 4), (0, 0)],
    "tri": [(10, 0), (14, 0), (12, 5), (10, 0)],
    "sliver": [(8.5, 0), (9.5, 0), (9.5, 9), (8.5, 9), (8.5, 0)],
}


def rings(spark, shapes):
    rows = [(n, [(float(x), float(y)) for x, y in r]) for n, r in shapes.items()]
    return spark.createDataFrame(rows, "name string, ring array<struct<x:double,y:double>>")


def test_point_in_polygon_equals_brute_force(spark):
    points = [(i, (i * 37 % 150) / 10 + 0.013, (i * 53 % 90) / 10 + 0.017) for i in range(600)]
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    got = {(r["id"], r["name"]) for r in spatial.point_in_polygon(df, rings(spark, RINGS)).collect()}
    assert got == {(i, n) for i, x, y in points for n, r in RINGS.items() if brute_contains(r, x, y)}


def test_point_in_polygon_with_shapes_of_all_sizes(spark):
    shapes = {f"s{i}": [(i * 0.7, 0.1 * i), (i * 0.7 + w, 0.1 * i), (i * 0.7 + w, 0.1 * i + w), (i * 0.7, 0.1 * i + w), (i * 0.7, 0.1 * i)]
              for i, w in enumerate((0.01, 0.2, 3.0, 40.0, 500.0))}
    points = [(i, (i * 37 % 500) / 100 + 0.0013, (i * 53 % 400) / 100 + 0.0017) for i in range(400)]
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    got = {(r["id"], r["name"]) for r in spatial.point_in_polygon(df, rings(spark, shapes)).collect()}
    assert got == {(i, n) for i, x, y in points for n, r in shapes.items() if brute_contains(r, x, y)}
    assert spatial.point_in_polygon(df, rings(spark, shapes).limit(0)).count() == 0


def test_exchange_names_flow_through_panel_and_features(spark):
    from incidentlab.sources.schema import INCIDENT_COLUMNS as names, incident_schema

    base = {f.name: None for f in incident_schema().fields}
    rows = [{**base, "Incident_ID": str(i), "District": "d", "State": "s", "Year": 2021 + i // 12, "Month": i % 12 + 1,
             "Crime_Count_District": 10 + i, "Sample_Weight": 1.0, "Is_Weekend": i % 2 == 0, "Crime_Rate_100k": 2.0,
             "Neighbor_District_Risk": 7.0} for i in range(14)]
    df = spark.createDataFrame([tuple(r[f.name] for f in incident_schema().fields) for r in rows], incident_schema())
    panel_rows = panel.unit_month_panel(df, names, extra_means=["Neighbor_District_Risk"])
    out = models.build_risk_features(panel_rows, "Crime_Count_District", names).orderBy("Year", "Month").collect()
    assert len(incident_schema().fields) == 56
    assert [r["weekend_ratio"] for r in out[:2]] == [1.0, 0.0]
    assert out[0]["population_rate"] == 2.0 and out[0]["neighbor_density"] == 7.0
    assert out[12]["crime_growth"] == 12 / 11 and out[13]["Crime_Count_District_lag_1"] == 22


def test_tolerance_reaches_over_the_edge(spark):
    df = spark.createDataFrame([(1, 9.55, 4.0), (2, 9.75, 4.0)], "id int, lon double, lat double")
    got = spatial.point_in_polygon(df, rings(spark, {"sliver": RINGS["sliver"]}), tol=0.1).collect()
    assert [r["id"] for r in got] == [1]


def test_adjacency_equals_brute_force_over_mixed_sizes(spark):
    shapes = {}
    for i in range(120):
        side = (0.1, 0.7, 3.0, 20.0)[i % 4]
        x, y = (i * 71 % 400) / 10, (i * 37 % 300) / 10
        shapes[f"b{i:03d}"] = [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]
    tol = 0.05
    box = {n: (r[0][0], r[0][1], r[2][0], r[2][1]) for n, r in shapes.items()}
    want = {(a, b) for a in box for b in box if a != b
            and box[a][0] - box[b][2] <= 2 * tol and box[b][0] - box[a][2] <= 2 * tol
            and box[a][1] - box[b][3] <= 2 * tol and box[b][1] - box[a][3] <= 2 * tol}
    got = {(r["src"], r["dst"]) for r in spatial.adjacency(rings(spark, shapes), tol).collect()}
    assert got == want


def test_exact_adjacency_drops_boxes_that_only_overlap_as_boxes(spark):
    shapes = {"corner": [(0, 0), (10, 0), (0, 10), (0, 0)], "far": [(9, 9), (10, 9), (10, 10), (9, 10), (9, 9)],
              "inner": [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)], "bar": [(-1, 4), (11, 4), (11, 4.5), (-1, 4.5), (-1, 4)]}
    box = {(r["src"], r["dst"]) for r in spatial.adjacency(rings(spark, shapes), 0.01).collect()}
    exact = {(r["src"], r["dst"]) for r in spatial.adjacency(rings(spark, shapes), 0.01, exact=True).collect()}
    assert ("corner", "far") in box and ("corner", "far") not in exact
    assert {("corner", "inner"), ("corner", "bar"), ("bar", "corner")} <= exact


def test_cells_hold_their_points_and_rings_close(spark):
    df = spark.range(500).select("id", (F.col("id") % 29 + 8.37).alias("lat"), (F.col("id") * 7 % 28 + 69.11).alias("lon"))
    df = df.withColumn("cell", geo.cell_index("lat", "lon", 6)).withColumn("b", geo.cell_boundary("cell"))
    ring = F.transform("b", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    out = df.select(geo.ring_contains(ring, "lon", "lat").alias("inside"), F.size("b").alias("n"),
                    (F.abs(F.col("b")[0][0] - F.col("b")[6][0]) < 1e-9).alias("closed")).collect()
    assert all(r["inside"] and r["n"] == 7 and r["closed"] for r in out)
    assert spark.range(1).select(geo.cell_index(F.lit(None).cast("double"), F.lit(70.0), 6)).first()[0] is None


def test_bbox_of_nothing(spark):
    assert tuple(spatial.bbox(rings(spark, RINGS).limit(0)).first()) == (0.0, 0.0, 0.0, 0.0)
    empty = spark.createDataFrame([("e", [])], "name string, ring array<struct<x:double,y:double>>")
    assert tuple(empty.select(geo.ring_centroid("ring")).first()[0]) == (0.0, 0.0)


def test_no_neighbours_is_null(spark):
    uy = spark.createDataFrame([("s", "a", 1, 5), ("s", "b", 1, 7), ("s", "c", 1, 9)], "state string, unit string, year int, n long")
    edges = spark.createDataFrame([("a", "b"), ("a", "ghost"), ("b", "a")], "src string, dst string")
    got = {r["unit"]: r["neighbor_risk"] for r in spatial.neighbor_mean(uy, edges, "n").collect()}
    assert got == {"a": 7.0, "b": 5.0, "c": None}


def test_fit_error_without_nonzero_actuals(spark):
    row = reports.fit_error(spark.createDataFrame([(0.0, 1.0), (0.0, -1.0)], "a double, p double"), "a", "p").first()
    assert (row["rmse"], row["mae"], row["r2"], row["mape"]) == (1.0, 1.0, None, None)


def test_half_year_direction_of_one_month(spark):
    df = spark.createDataFrame([(3, 10.0)], "month int, value double")
    assert reports.half_year_direction(df).first()["direction"] == "down"


def test_unit_trend_leaves_single_rows_out(spark):
    df = series(spark, [("a", 2020, 1, 1.0), ("b", 2020, 1, 1.0), ("b", 2020, 2, 9.0)])
    assert [(r["unit"], r["direction"]) for r in reports.unit_trend(df, "x").collect()] == [("b", "stable")]


def test_folds_are_ordered_and_disjoint():
    folds = models.time_folds(100, 5, 2)
    assert [f.test_to - f.test_from for f in folds] == [16] * 5 and folds[-1].test_to == 100
    assert all(f.train_rows == f.test_from - 2 for f in folds)
    assert all(a.test_to == b.test_from for a, b in zip(folds, folds[1:]))
    with pytest.raises(ValueError):
        models.time_folds(7)


def test_linear_attributions_add_up(spark, data):
    li = spark.read.parquet(f"{data}/lineitem.parquet").limit(500).withColumn("row", F.monotonically_increasing_id()).cache()
    w = {"l_quantity": 1.5, "l_discount": -40.0}
    phi = explain.linear_attributions(li, "row", w, 3.0).groupBy("row").agg((F.sum("phi") + F.max("base")).alias("p"))
    both = phi.join(li, "row").select((F.col("p") - (3 + 1.5 * F.col("l_quantity") - 40 * F.col("l_discount"))).alias("d"))
    assert both.agg(F.max(F.abs("d"))).first()[0] < 1e-9


def test_gathered_attributions_give_the_same_drivers(spark):
    long = spark.createDataFrame([(1, "a", 2.0, 0.5), (1, "b", 1.0, -0.5), (1, "c", 1.0, 0.0)], "k int, feature string, value double, phi double")
    got = explain.local_drivers(explain.gathered(long, "k"), "k").collect()
    assert [(r["side"], r["position"], r["feature"]) for r in got] == [("positive", 1, "a"), ("negative", 1, "b")]


def test_unique_counts_nulls_as_one_value(spark):
    one = spark.createDataFrame([(1,), (None,)], "v int")
    two = spark.createDataFrame([(1,), (None,), (None,)], "v int")
    assert quality.run_checks(one, [quality.unique("v")]).first()["passed"]
    assert not quality.run_checks(two, [quality.unique("v")]).first()["passed"]


def test_checks_on_an_empty_table_do_not_fail(spark):
    df = spark.createDataFrame([], "v double, c string")
    out = quality.run_checks(df, [quality.unique("v"), quality.within("v", 0, 1), quality.long_tailed("v"), quality.filled("v")])
    assert [r["passed"] for r in out.collect()] == [True, True, False, False]
    assert [r["null_pct"] for r in profile.profile(df).collect()] == [0.0, 0.0]


def test_lifecycle(spark):
    at = dt.datetime(2024, 1, 1)
    log = [(1, 1, at, "created"), (1, 2, at, "started"), (1, 3, at, "failed"), (1, 4, at, "started"), (1, 5, at, "completed"),
           (1, 6, at, "downloaded"), (1, 7, at, "downloaded"), (2, 1, at, "created")]
    df = spark.createDataFrame(log, "report_id int, seq int, at timestamp, event string")
    got = {r["report_id"]: (r["status"], r["retry_count"], r["download_count"]) for r in access.report_lifecycle(df).collect()}
    assert got == {1: ("completed", 1, 2), 2: ("pending", 0, 0)}


def test_upsert_applies_changes_in_order(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    old = spark.createDataFrame([("k", "risk", "old", 3, "src", 300, at(0), at(0), 4)],
                                "cache_key string, cache_type string, payload string, payload_size int, source string, ttl_seconds int, "
                                "expires_at timestamp, last_refreshed_at timestamp, hit_count long")
    new = spark.createDataFrame([("k", "x", "p1", "s1", 60, at(1)), ("k", "x", "p22", None, 90, at(2)), ("n", "t1", "q", None, 10, at(3)),
                                 ("n", "t2", "qq", "late", 20, at(4))],
                                "cache_key string, cache_type string, payload string, source string, ttl_seconds int, changed_at timestamp")
    got = {r["cache_key"]: r for r in access.upsert(old, new, "cache_key", ["changed_at"]).collect()}
    k, n = got["k"], got["n"]
    assert (k["cache_type"], k["payload"], k["payload_size"], k["source"], k["hit_count"]) == ("risk", "p22", 3, "s1", 6)
    assert (n["cache_type"], n["payload"], n["source"], n["hit_count"]) == ("t1", "qq", "late", 1)
    assert k["expires_at"] == at(2) + dt.timedelta(seconds=90)


def test_read_incidents_falls_back_to_csv(spark, data, tmp_path):
    part = spark.read.parquet(f"{data}/region.parquet")
    part.write.option("header", True).csv(str(tmp_path / "region.csv"))
    got = io.read_incidents(spark, str(tmp_path / "region.parquet"), part.schema)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, part.collect()))
    with pytest.raises(FileNotFoundError):
        io.read_incidents(spark, str(tmp_path / "nothing.parquet"))


def test_geojson_without_features(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type": "FeatureCollection"}')
    assert io.read_geojson(spark, str(tmp_path)).count() == 0


def test_unreadable_cell_becomes_its_point(spark):
    df = spark.createDataFrame([("nonsense", 1.5, 2.5, 9.0)], "cell string, latitude double, longitude double, risk_score double")
    assert io.to_features(df).select("geometry.coordinates").first()[0] == [[[2.5, 1.5]]]


def test_panel_takes_extra_means(spark):
    df = spark.createDataFrame([("s", "a", 1, 1, 2.0, 4.0), ("s", "a", 1, 1, 3.0, 6.0)], "state string, unit string, year int, month int, loss double, extra double")
    row = panel.unit_month_panel(df, extra_means=["extra"]).first()
    assert (row["loss"], row["extra"], row["quarter"]) == (5.0, 5.0, 1)


def test_report_json_readers(spark):
    df = spark.createDataFrame([('{"Near": {"correlation": 0.3, "mean": 5}}', '[{"rank": 1, "district": "a", "score": 9.5}]', "broken")],
                               "influence string, ranks string, bad string")
    assert [tuple(r) for r in io.influence_rows(df, "influence").collect()] == [("Near", 0.3, 5.0)]
    assert [tuple(r) for r in io.ranking_rows(df, "ranks").collect()] == [(1, "a", 9.5)]
    assert io.month_rows(df, "bad").count() == 0
