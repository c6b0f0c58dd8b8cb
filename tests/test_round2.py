"""Whole results where an earlier version gave less."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from incidentlab.catalog import QUERIES, modelling
from incidentlab.sources import io


@pytest.mark.parametrize("name, rows", [("v4_sign", 2), ("v10_long_tailed", 1)])
def test_checks_are_returned(spark, data, name, rows):
    assert QUERIES[name](spark, data).count() == rows


def test_feature_collections_hold_a_block_of_ranks_each(spark, tmp_path):
    cells = spark.range(1, 24).select(F.concat(F.lit("6:"), "id", F.lit(":0")).alias("cell"), F.col("id").alias("hotspot_rank"),
                                      F.lit(1.0).alias("risk_score"))
    documents = [json.loads(r.document) for r in io.feature_collections(cells, 10).collect()]
    ranks = sorted([f["properties"]["rank"] for f in d["features"]] for d in documents)
    assert ranks == [list(range(1, 11)), list(range(11, 21)), list(range(21, 24))]
    assert {d["metadata"]["total_hotspots"] for d in documents} == {23}
    path = str(tmp_path / "blocks")
    io.feature_collections(cells, 10).write.text(path)
    read = io.read_geojson(spark, path, multi_line=False)
    assert sorted(int(r.rank) for r in read.select(F.col("properties")["rank"].alias("rank")).collect()) == list(range(1, 24))


def test_ranked_compares_neighbours_without_a_one_task_window(spark):
    rows = [(1, 9.0), (2, 7.0), (3, 8.0), (4, 8.0), (5, None), (6, 1.0)]
    found = modelling._ranked(spark.createDataFrame(rows, "place int, risk_score double"), "place")
    assert tuple(found.first()) == (6, 6, 1, 6, 1.0, 9.0, 1)
    assert "Window" not in found._jdf.queryExecution().toString()
