"""Boosted models: documented settings, the stop by held-out rows, folds side by side, errors on held-out years."""

from __future__ import annotations

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from incidentlab.catalog import modelling
from incidentlab.operators import models
from incidentlab.operators.models import BoostSettings, best_round

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def noisy(spark):
    """A target with a step, a slope and noise; a quarter of the rows is held out."""
    rows = spark.range(1200).select(
        F.col("id").alias("row"), (F.col("id") % 17).cast("double").alias("a"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 10).alias("b"),
        F.when(F.col("id") % 5 > 0, F.pmod(F.xxhash64("id", F.lit(2)), F.lit(7)).cast("double")).alias("c"))
    noise = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1000)) / 250 - 2
    return rows.withColumn("y", F.when(F.col("a") > 8, 10.0).otherwise(0.0) + 2 * F.col("b") + noise).withColumn("held", F.col("row") % 4 == 0)


@pytest.mark.parametrize("errors, patience, found", [
    ([5, 4, 3, 4, 5], 2, (3, True)), ([5, 4, 3, 4, 5], 3, (3, False)), ([1, 2, 3], 2, (1, True)), ([3, 2, 1], 2, (3, False)),
    ([3, 3, 3], 2, (1, True)), ([4, 5, 3, 9, 9, 1], 2, (3, True)), ([2.0], 50, (1, False))])
def test_round_to_stop_at(errors, patience, found):
    assert best_round(errors, patience) == found


def test_documented_stop_is_fifty_rounds():
    assert models.RISK_BOOST == BoostSettings(500, 0.05, 7, 0.8, 0.8, 20, 42, 50) and models.CELL_BOOST.depth == 6
    falling = [100 - i for i in range(60)]
    assert best_round([*falling, *[41.5] * 50], 50) == (60, True)
    assert best_round([*falling, *[41.5] * 49], 50) == (60, False)
    assert best_round([*falling, *[41.5] * 49, 40.0], 50) == (110, False)


def test_cut_model_is_that_of_a_shorter_run(noisy):
    long, short = (models.fit_risk(noisy, FEATURES, "y", settings=BoostSettings(trees=n, depth=3, learning_rate=0.2)) for n in (12, 5))
    cut = models.first_trees(long.stages[-1], 5)
    assert cut.getNumTrees == 5 and cut.treeWeights == short.stages[-1].treeWeights
    both = models.predict(short, noisy, FEATURES).withColumnRenamed(models.PREDICTION, "short")
    both = cut.transform(short.stages[0].transform(both.fillna(0.0, FEATURES)))
    assert both.where(F.col(models.PREDICTION) != F.col("short")).count() == 0


def test_model_keeps_the_trees_up_to_the_smallest_error(noisy):
    settings = BoostSettings(trees=40, depth=6, learning_rate=0.6, min_rows=1, patience=5)
    model = models.fit_risk(noisy, FEATURES, "y", "held", settings).stages[-1]
    assembler, data = models._assembled(noisy, FEATURES, "y", "held")
    whole = models._boosted(data.where("NOT held"), settings)
    errors = whole.evaluateEachIteration(data.where("held"), "squared")
    keep, stopped = best_round(errors, 5)
    assert stopped and 1 <= keep < 40 and model.getNumTrees == keep
    assert min(errors[:keep + 5]) == errors[keep - 1]


def test_folds_side_by_side_equal_folds_one_by_one(noisy):
    settings = BoostSettings(trees=6, depth=3, learning_rate=0.3)
    runs = [{tuple(r) for r in models.cross_validate(noisy, ["row"], FEATURES, "y", settings, 4, 2, parallel).collect()} for parallel in (4, 1)]
    assert runs[0] == runs[1] and {r[-1] for r in runs[0]} == {1200}


def test_every_fold_is_fitted_with_the_documented_settings(spark, data, monkeypatch):
    fit, asked = models._boosted, []

    def spy(rows, settings):
        asked.append(settings)
        return fit(rows, BoostSettings(trees=1, depth=1))

    monkeypatch.setattr(models, "_boosted", spy)
    modelling.m6_cv(spark, data)
    assert asked == 5 * [BoostSettings()]


def test_errors_on_held_out_years(spark, data):
    """The risk model explains years it has not seen; far better than their mean, and no worse than 1.5 x the error of its stop year."""
    model, panel = modelling._fitted(spark, data), modelling.risk_panel(spark, data)
    stop, later = (models.evaluate(model, panel.where(years), modelling._FIT, "n").first() for years in ("year = 2000", "year > 2000"))
    assert later.r2 > 0.75 and stop.r2 > 0.75
    assert later.mae <= later.rmse <= 1.5 * stop.rmse
    assert 2 <= model.stages[-1].getNumTrees <= 500


def stepped(spark, partitions):
    """Features of few values, so that every booster has the same splits to choose from."""
    rows = spark.range(0, 1800, 1, partitions).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") * 7919 % 23).cast("double").alias("b"))
    rows = rows.withColumn("_label", 4 * F.col("a") + F.when(F.col("b") > 9, F.col("b") * F.col("b")).otherwise(-3 * F.col("a")))
    return VectorAssembler(inputCols=["a", "b"], outputCol="_features").transform(rows)


PLAIN = BoostSettings(trees=6, depth=4, learning_rate=0.3, row_share=1.0, feature_share=1.0)


def predictions(model, rows):
    return {(r.a, r.b): r.p for r in model.transform(rows).select("a", "b", F.col(models.PREDICTION).alias("p")).collect()}


@pytest.mark.parametrize("partitions", [1, 3])
def test_trees_equal_those_of_spark_ml(spark, partitions):
    """Without random draws, however the rows are dealt."""
    rows = stepped(spark, partitions)
    ours = models._boosted(rows, PLAIN)
    theirs = GBTRegressor(featuresCol="_features", labelCol="_label", predictionCol=models.PREDICTION, maxIter=6, stepSize=0.3, maxDepth=4,
                          minInstancesPerNode=20, seed=42).fit(rows)
    got, want = predictions(ours, rows), predictions(theirs, rows)
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-6)
    assert ours.treeWeights == theirs.treeWeights and ours.evaluateEachIteration(rows, "squared") == pytest.approx(theirs.evaluateEachIteration(rows, "squared"))


def test_jobs_of_a_fit_do_not_grow_with_its_trees(spark):
    rows, tracker, jobs = stepped(spark, 2), spark.sparkContext.statusTracker(), []
    for trees in (2, 30):
        spark.sparkContext.setJobGroup(f"fit-{trees}", "boosting")
        models._boosted(rows, BoostSettings(trees=trees, depth=3))
        jobs.append(len(tracker.getJobIdsForGroup(f"fit-{trees}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] < 30


def test_labels_without_a_value_are_refused(spark):
    with pytest.raises(Exception, match="NULL or NaN"):
        models._boosted(stepped(spark, 1).withColumn("_label", F.when(F.col("a") > 3, F.col("_label"))), PLAIN)


def test_frames_of_more_rows_than_a_task_keeps_go_to_spark_ml(spark, monkeypatch):
    rows = stepped(spark, 3)
    whole = predictions(models._boosted(rows, PLAIN), rows)
    monkeypatch.setattr(models, "ROWS_IN_ONE_TASK", 1799)
    monkeypatch.setattr(models, "grow_trees", lambda *_: pytest.fail("too many rows for a task"))
    spread = predictions(models._boosted(rows, PLAIN), rows)
    assert max(abs(whole[k] - spread[k]) for k in spread) < 1e-6


def test_panel_does_not_grow_with_the_orders(spark, data, tmp_path):
    """What the risk model learns from is units by months: copies of orders and customers add no row, so a fit stays one task's work."""
    for name in ("nation", "region"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    copies = spark.range(4).select((F.col("id") * 10_000_000).alias("shift"))
    for name, keys in (("orders", ("o_orderkey", "o_custkey")), ("customer", ("c_custkey",))):
        rows = spark.read.parquet(f"{data}/{name}.parquet").crossJoin(copies)
        rows.withColumns({k: F.col(k) + F.col("shift") for k in keys}).drop("shift").write.parquet(str(tmp_path / f"{name}.parquet"))
    panel, larger = modelling.risk_panel(spark, data), modelling.risk_panel(spark, str(tmp_path))
    assert panel.count() == larger.count() <= models.ROWS_IN_ONE_TASK
    assert larger.agg(F.sum("n")).first()[0] == 4 * panel.agg(F.sum("n")).first()[0]
