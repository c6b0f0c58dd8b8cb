"""Nothing is cut: whole histories, whole rankings, whole shapes, folder tables, rows with gaps."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from incidentlab import fixtures as fx
from incidentlab.operators import allocate, risk, spatial, temporal
from incidentlab.sources import io
from incidentlab.streaming import jobs

OUTER = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
HOLE = [(4, 4), (4, 6), (6, 6), (6, 4), (4, 4)]
FAR = [(20, 0), (23, 0), (20, 3), (20, 0)]
RINGS = "name string, ring array<struct<x double, y double>>"


def ring(points):
    return [(float(x), float(y)) for x, y in points]


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_folder_tables(spark, data, tmp_path, files):
    fx.table(spark, data, "events").repartition(files).write.parquet(str(tmp_path / "events.parquet"))
    for folder in (str(tmp_path), data):
        got = jobs.append_table(jobs.read_stream(spark, folder, "events"), "copy")
        assert got.count() == fx.table(spark, data, "events").count()
    with pytest.raises(Exception):
        jobs.read_stream(spark, str(tmp_path), "absent")


@pytest.mark.parametrize("first,rest", [(1e25, 1.0), (1e9, 0.0)])
def test_ema_keeps_a_dominant_start(spark, first, rest):
    n, alpha = 141, 2 / 7
    rows = [("a", 1900 + i // 12, i % 12 + 1, first if i == 0 else rest) for i in range(n)]
    got = temporal.ema(spark.createDataFrame(rows, "unit string, year int, month int, x double"), ["unit"], "x").orderBy("year", "month").collect()
    e = first
    for _ in range(n - 2):
        e = e * (1 - alpha) + rest * alpha
    assert abs(got[-1]["ema_6m"] - e) <= 1e-9 * e


def test_ema_null_keeps_its_place(spark):
    rows = [("a", 2020, m, v) for m, v in enumerate([4.0, None, 8.0, 1.0], 1)]
    got = [r["ema_6m"] for r in temporal.ema(spark.createDataFrame(rows, "unit string, year int, month int, x double"), ["unit"], "x").orderBy("month").collect()]
    a = 2 / 7
    old = (1 - a) ** 2
    assert got[0] is None and got[1:3] == [4.0, 4.0] and abs(got[3] - (4 * old + 8 * a) / (old + a)) < 1e-12


def test_hotspots_rank_every_cell(spark):
    cells = spark.range(1200).select(F.col("id").cast("string").alias("cell"), F.lit(2020).alias("year"), F.lit(1).alias("month"),
                                     (F.col("id") % 700).cast("double").alias("p"))
    ranked = risk.hotspots(cells, "p", ["cell", "year", "month"])
    assert sorted(r[0] for r in ranked.select("hotspot_rank").collect()) == list(range(1, 1201))
    first = risk.hotspots(cells, "p", ["cell", "year", "month"], 30).orderBy("hotspot_rank").select("cell").collect()
    assert first == ranked.orderBy("hotspot_rank").limit(30).select("cell").collect()
    document = json.loads(io.feature_collection(ranked.withColumn("risk_score", F.lit(1.0)), 10).first()[0])
    assert len(document["features"]) == 10 and document["metadata"]["total_hotspots"] == 1200


def test_parts_and_holes_are_one_shape(spark):
    polys = spark.createDataFrame([("a", ring(OUTER)), ("a", ring(HOLE)), ("a", ring(FAR)), ("b", ring([(30, 30), (31, 30), (31, 31), (30, 30)]))], RINGS)
    points = spark.createDataFrame([(1, "a", 5.0, 5.0), (2, "a", 1.0, 1.0), (3, "a", 20.5, 0.5), (4, "a", 22.9, 2.9), (5, "b", 30.9, 30.5)],
                                   "id int, unit string, lon double, lat double")
    assert {(r["id"], r["name"]) for r in spatial.point_in_polygon(points, polys).collect()} == {(2, "a"), (3, "a"), (5, "b")}
    row = spatial.outside_claimed(points, polys, 0.0).first()
    assert (row["tested"], row["outside"]) == (5, 2)


def test_adjacency_of_parts(spark):
    square = lambda x, y, w: ring([(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)])
    polys = spark.createDataFrame([("A", square(0, 0, 1)), ("A", square(1, 0, 40)), ("B", square(0, 1, 1)), ("B", square(41, 0, 2))], RINGS)
    got = spatial.adjacency(polys, 0.01, exact=True).collect()
    assert sorted(map(tuple, got)) == [("A", "B"), ("B", "A")]


def test_distance_to_the_centre_of_area(spark):
    polys = spark.createDataFrame([("a", ring([(0, 0), (4, 0), (4, 0), (4, 2), (0, 2), (0, 0)])), ("t", ring([(0, 0), (3, 0), (0, 3), (0, 0)]))], RINGS)
    points = spark.createDataFrame([("a", 2.0, 1.0), ("t", 1.0, 1.0), ("none", 1.0, 1.0)], "unit string, lon double, lat double")
    got = {r["unit"]: r["distance_to_centre_km"] for r in spatial.distance_to_centre(points, polys).collect()}
    assert got["none"] is None and abs(got["a"]) < 1e-6 and abs(got["t"]) < 1e-6


def test_every_geometry_kind_keeps_its_coordinates(spark, tmp_path):
    shapes = {"Point": [1, 2], "MultiPoint": [[1, 2], [3, 4]], "LineString": [[0, 0], [1, 1]], "MultiLineString": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]],
              "Polygon": [OUTER, HOLE], "MultiPolygon": [[OUTER, HOLE], [FAR]], "Odd": 7}
    features = [{"type": "Feature", "geometry": {"type": k, "coordinates": v}, "properties": {"name": k}} for k, v in shapes.items()]
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    read = io.read_geojson(spark, str(tmp_path / "f.geojson"), {})
    got = {r["geometry_type"]: r["polygons"] for r in read.collect()}
    parts = {k: [len(p) for p in v] if v else v for k, v in got.items()}
    assert parts == {"Point": [1], "MultiPoint": [1], "LineString": [1], "MultiLineString": [2], "Polygon": [2], "MultiPolygon": [2, 1], "Odd": None}
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 20.5, 0.5)], "id int, lon double, lat double")
    hits = spatial.point_in_polygon(points, io.shape_rings(read.filter("geometry_type = 'MultiPolygon'"), "name"))
    assert sorted(r["id"] for r in hits.collect()) == [2, 3]


def test_rows_without_a_year(spark):
    rows = [("s", "a", 2020, 1.0), ("s", "a", 2021, 3.0), ("s", "b", 2021, 5.0), ("s", "b", None, 9.0)]
    df = spark.createDataFrame(rows, "state string, unit string, year int, trend_3y double")
    got = {(r["unit"], r["year"]): r["trend_score"] for r in risk.with_trend_score(df).collect()}
    assert got == {("a", 2020): 0.0, ("a", 2021): 0.0, ("b", 2021): 1.0, ("b", None): 0.0}
    known = spark.createDataFrame([("a", 2020, 10.0), ("a", 2020, 12.0), ("a", None, 99.0), ("b", None, 1.0)], "k string, year int, v double")
    assert {tuple(r) for r in allocate.project_total(known, ["k"], "year", "v", [2020, 2021]).collect()} == {("a", 2020, 12.0), ("a", 2021, 12.0)}
