"""Feature building, boosted regression, time-ordered validation and clustering."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import COLUMNS, SETTINGS, Columns
from ..functions.geo import cell_index
from ..session import new_table_dir
from .boosting import grow_trees
from .clean import fill_features
from .panel import cell_month_panel
from .reports import fit_error
from .risk import hotspots, pass_through_features, population_rate, risk_scores
from .scale import global_row_number, settle
from .temporal import temporal_features

PREDICTION = "prediction"
ROWS_A_TASK = 50_000
#: Up to so many rows a model is grown in one task (see boosting); more are spread over the cluster, with jobs for every tree level.
ROWS_IN_ONE_TASK = 250_000


@dataclass(frozen=True)
class BoostSettings:
    """Defaults of the boosted regressors (the cell model uses depth 6)."""

    trees: int = 500
    learning_rate: float = 0.05
    depth: int = 7
    row_share: float = 0.8
    feature_share: float = 0.8
    min_rows: int = 20
    seed: int = 42
    patience: int = 50


RISK_BOOST = BoostSettings()
CELL_BOOST = BoostSettings(depth=6)


def build_risk_features(panel: DataFrame, target: str, cols: Columns = COLUMNS) -> DataFrame:
    """M1. Temporal features, flag ratios, neighbour density and rate on the unit-month panel."""
    df = temporal_features(panel, [cols.unit], target, cols)
    return population_rate(pass_through_features(df), target, cols.population)


def build_cell_features(points: DataFrame, resolution: int = SETTINGS.cell_resolution,
                        cols: Columns = COLUMNS) -> DataFrame:
    """M2. Hex cells, the cell-month panel, and temporal features per cell."""
    celled = points.withColumn(cols.cell, cell_index(cols.lat, cols.lon, resolution))
    return temporal_features(cell_month_panel(celled, cols), [cols.cell], "crime_count", cols)


def best_round(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """Trees to keep by their validation errors, and whether ``patience`` rounds without a better one have passed."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(model: GBTRegressionModel, keep: int) -> GBTRegressionModel:
    """The model cut off after its first ``keep`` trees, which are the trees a shorter run would have grown.

    Spark ML has no method for this, so the saved form of the model is cut: its metadata, one row a tree, the nodes by tree.
    """
    spark = SparkSession.active()
    whole, cut = new_table_dir(spark, "boosted"), new_table_dir(spark, "boosted")
    model.write().save(whole)
    metadata = json.loads(spark.read.text(f"{whole}/metadata").first()[0]) | {"numTrees": keep}
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.text(f"{cut}/metadata")
    spark.read.parquet(f"{whole}/treesMetadata").where(F.col("_1") < keep).write.parquet(f"{cut}/treesMetadata")
    spark.read.parquet(f"{whole}/data").where(F.col("treeID") < keep).write.parquet(f"{cut}/data")
    return GBTRegressionModel.load(cut)


def _assembled(df: DataFrame, features: Sequence[str], target: str, *more: str) -> tuple[VectorAssembler, DataFrame]:
    """Feature vectors and labels, kept in the cluster's memory and disk in partitions worth a task: they are read more than once."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    data = settle(fill_features(df, features).select(*features, F.col(target).cast("double").alias("_label"), *more))
    return assembler, assembler.transform(data.repartition(max(1, -(-data.count() // ROWS_A_TASK)))).persist()


def _boosted(rows: DataFrame, settings: BoostSettings) -> GBTRegressionModel:
    booster = GBTRegressor(
        featuresCol="_features", labelCol="_label", predictionCol=PREDICTION, maxIter=settings.trees,
        stepSize=settings.learning_rate, maxDepth=settings.depth, subsamplingRate=settings.row_share,
        featureSubsetStrategy=str(settings.feature_share), minInstancesPerNode=settings.min_rows, seed=settings.seed)
    return grow_trees(rows, booster) if rows.count() <= ROWS_IN_ONE_TASK else booster.fit(rows)


def _fit(df: DataFrame, features: Sequence[str], target: str, settings: BoostSettings,
         validation: str | None) -> PipelineModel:
    if validation is not None:
        df = df.withColumn("_held", F.coalesce(F.col(validation), F.lit(False)))
    assembler, data = _assembled(df, features, target, *(["_held"] if validation is not None else []))
    try:
        if validation is None:
            return PipelineModel([assembler, _boosted(data, settings)])
        model = _boosted(data.filter(~F.col("_held")), settings)  # every tree is grown once; the errors tell how many to keep
        keep, _ = best_round(model.evaluateEachIteration(data.filter("_held"), "squared"), settings.patience)
        return PipelineModel([assembler, first_trees(model, keep) if keep < settings.trees else model])
    finally:
        data.unpersist()


def fit_risk(df: DataFrame, features: Sequence[str], target: str, validation: str | None = None,
             settings: BoostSettings = RISK_BOOST) -> PipelineModel:
    """M3. Boosted regression of the target. With a ``validation`` flag it learns from the other rows and keeps the trees up to the
    smallest validation error after which ``patience`` more brought no smaller one."""
    return _fit(df, features, target, settings, validation)


def fit_hotspot(df: DataFrame, features: Sequence[str], target: str = "crime_count", validation: str | None = None,
                settings: BoostSettings = CELL_BOOST) -> PipelineModel:
    """M4. The same on cell-months."""
    return _fit(df, features, target, settings, validation)


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(fill_features(df, features)).drop("_features")


def score_units(model: PipelineModel, df: DataFrame, features: Sequence[str], cols: Columns = COLUMNS) -> DataFrame:
    """M5. Predictions with score, rank and confidence, keys carried."""
    keys = [cols.unit, *cols.time]
    scored = risk_scores(predict(model, df, features).select(*keys, PREDICTION), PREDICTION, keys)
    return scored.withColumn("predicted_count", F.round(PREDICTION, 2)).drop(PREDICTION)


def score_cells(model: PipelineModel, df: DataFrame, features: Sequence[str], top_n: int | None = SETTINGS.top_hotspots,
                cols: Columns = COLUMNS) -> DataFrame:
    """M5 on cells, then W18."""
    keys = [cols.cell, *cols.time]
    predicted = settle(predict(model, df, features).select(*keys, "latitude", "longitude", PREDICTION))
    return hotspots(predicted, PREDICTION, keys, top_n).withColumn("predicted_count", F.round(PREDICTION, 2)).drop(PREDICTION)


@dataclass(frozen=True)
class Fold:
    """Rows 0..train_rows-1 train, rows test_from..test_to-1 test."""

    number: int
    train_rows: int
    test_from: int
    test_to: int


def time_folds(n: int, splits: int = SETTINGS.cv_splits, gap: int = SETTINGS.cv_gap) -> list[Fold]:
    """M6. Expanding folds over ``n`` ordered rows; ``gap`` rows before each test block are left out."""
    splits = min(splits, n // 5)
    if splits < 2:
        raise ValueError(f"{n} rows are too few for two folds")
    size = n // (splits + 1)
    starts = [n - (splits - i) * size for i in range(splits)]
    if starts[0] - gap <= 0:
        raise ValueError("the gap leaves no training rows in the first fold")
    return [Fold(i + 1, s - gap, s, s + size) for i, s in enumerate(starts)]


def ordered_rows(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """M6. Row position from 0 in ``order``, over range partitions."""
    return global_row_number(df, order, "_row").withColumn("_row", F.col("_row") - 1)


def fold_sizes(ordered: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """M6. Train and test rows of each fold as counted in the data."""
    r = F.col("_row")
    counts = ordered.agg(*[c for f in folds for c in (
        F.count_if(r < f.train_rows).alias(f"a{f.number}"),
        F.count_if((r >= f.test_from) & (r < f.test_to)).alias(f"b{f.number}"))])
    rows = [F.struct(F.lit(f.number).alias("fold"), F.col(f"a{f.number}").alias("train_size"),
                     F.col(f"b{f.number}").alias("test_size")) for f in folds]
    return counts.select(F.inline(F.array(*rows)))


def cross_validate(df: DataFrame, order: Sequence[Column | str], features: Sequence[str], target: str,
                   settings: BoostSettings = RISK_BOOST, splits: int = SETTINGS.cv_splits, gap: int = SETTINGS.cv_gap,
                   parallel_folds: int = SETTINGS.cv_splits) -> DataFrame:
    """M6. Error and sizes per fold and pooled (fold 0), with the number of folds and of all rows.

    All folds train on one table of feature vectors, each on the rows before its test block. Their fits run side by side
    (``parallel_folds`` at a time), since a small fit takes few of the slots.
    """
    ordered = settle(ordered_rows(df, order))
    total = ordered.count()
    folds = time_folds(total, splits, gap)
    assembler, data = _assembled(ordered, features, target, "_row")
    row = F.col("_row")

    def fitted(fold: Fold) -> PipelineModel:
        return PipelineModel([assembler, _boosted(data.filter(row < fold.train_rows), settings)])

    try:
        with ThreadPoolExecutor(parallel_folds) as pool:
            models = list(pool.map(inheritable_thread_target(df.sparkSession)(fitted), folds))
    finally:
        data.unpersist()
    tested: DataFrame | None = None
    for f, model in zip(folds, models):
        block = ordered.filter((row >= f.test_from) & (row < f.test_to))
        out = predict(model, block, features).select(F.lit(f.number).alias("fold"), F.col(target), PREDICTION)
        tested = out if tested is None else tested.unionByName(out)
    tested = settle(tested)
    per_fold = fit_error(tested, target, PREDICTION, ["fold"])
    pooled = fit_error(tested, target, PREDICTION).withColumn("fold", F.lit(0))
    return per_fold.unionByName(pooled).join(fold_sizes(ordered, folds), "fold", "left").withColumns({
        "n_splits": F.lit(len(folds)), "total_samples": F.lit(total).cast("long")})


def evaluate(model: PipelineModel, df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """M7. Error of a model on a held-out frame."""
    return fit_error(predict(model, df, features), target, PREDICTION)


def cluster(df: DataFrame, focus: Column, columns: Sequence[str], k: int = 8, seed: int = 42,
            name: str = "cluster_id") -> DataFrame:
    """M13. k-means labels 0..k-1 on the focus rows, -1 on all others."""
    inside = F.coalesce(focus, F.lit(False))
    focus_rows = df.filter(inside)
    model = Pipeline(stages=[
        VectorAssembler(inputCols=list(columns), outputCol="_point"),
        KMeans(featuresCol="_point", predictionCol=name, k=k, seed=seed),
    ]).fit(focus_rows)
    return model.transform(focus_rows).drop("_point").unionByName(df.filter(~inside).withColumn(name, F.lit(-1)))


def ensure_cluster(df: DataFrame, name: str = "cluster_id") -> DataFrame:
    """M13, pass-through: keep an existing label, else -1."""
    return df if name in df.columns else df.withColumn(name, F.lit(-1))


def save_model(model: PipelineModel, path: str) -> None:
    """M14."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """M14."""
    return PipelineModel.load(path)


def background_sample(df: DataFrame, key: str, n: int = SETTINGS.background_rows, seed: str = "42") -> DataFrame:
    """M15. ``n`` rows in the order of a hash of the key: the same rows in every run, a bounded top-k."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key).limit(n)
