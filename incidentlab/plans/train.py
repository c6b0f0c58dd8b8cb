"""The training and prediction flows: incident rows to models, rankings and reports on disk."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import COLUMNS, SETTINGS, Columns
from ..operators import clean, explain, models, panel as panels
from ..operators.models import CELL_BOOST, RISK_BOOST, BoostSettings
from ..operators.scale import settle
from ..sources import io
from . import report


@dataclass(frozen=True)
class Years:
    """Which years train, validate and test."""

    train: tuple[int, ...] = SETTINGS.train_years
    val: tuple[int, ...] = SETTINGS.val_years
    test: tuple[int, ...] = SETTINGS.test_years


def prepare(incidents: DataFrame, cols: Columns = COLUMNS) -> DataFrame:
    """Calendar columns, then gaps handled."""
    return clean.handle_missing(clean.with_calendar(incidents, cols))


def unit_features(incidents: DataFrame, years: Years, cols: Columns = COLUMNS) -> DataFrame:
    """The featured unit-month panel with its split label.

    Features are built once over all years: they look back only, so nothing
    leaks from later splits.
    """
    panel = panels.unit_month_panel(incidents, cols)
    featured = models.build_risk_features(panel, cols.target, cols)
    return settle(clean.with_split(featured, years.train, years.val, years.test, cols))


def _train_and_validate(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split").isin("train", "val")).withColumn("is_val", F.col("split") == "val")


def train(incidents: DataFrame, out: str, years: Years = Years(), cols: Columns = COLUMNS,
          risk: BoostSettings = RISK_BOOST, cells: BoostSettings = CELL_BOOST,
          folds: int = SETTINGS.cv_splits, exclude: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Fit both models, score, explain and report; everything is written under ``out``.

    Returns the metrics, predictions, hotspots, importance and report frames.
    """
    spark = incidents.sparkSession
    rows = settle(prepare(incidents, cols))
    units = unit_features(rows, years, cols)
    features = clean.feature_columns(units.drop("split"), [cols.target, cols.weight, *exclude])
    model = models.fit_risk(_train_and_validate(units), features, cols.target, "is_val", risk)
    models.save_model(model, f"{out}/models/risk")

    test = units.filter(F.col("split") == "test")
    metrics = models.evaluate(model, test, features, cols.target)
    cv = models.cross_validate(units.filter(F.col("split") != "test"), [*cols.time, cols.unit], features, cols.target, risk, folds)
    predictions = settle(models.score_units(model, units, features, cols))

    located = clean.valid_coordinates(rows, cols)
    cell_rows = settle(clean.with_split(models.build_cell_features(located, cols=cols), years.train, years.val, years.test, cols))
    cell_features = clean.feature_columns(cell_rows.drop("split"), ["crime_count"])
    cell_model = models.fit_hotspot(_train_and_validate(cell_rows), cell_features, validation="is_val", settings=cells)
    models.save_model(cell_model, f"{out}/models/hotspot")
    hot = settle(models.score_cells(cell_model, cell_rows, cell_features, cols=cols))

    importance = explain.gain_importance(spark, model, features)
    sections = report.analytics_sections(rows, units, cols.target, predictions, hot, cols)

    io.write_ranked_csv(predictions, f"{out}/predictions", ["priority_rank"])
    io.write_ranked_csv(hot, f"{out}/hotspots", ["hotspot_rank"])
    io.export({"geojson": io.to_geojson(hot)}, "geojson", f"{out}/hotspots_geojson")
    io.write_sections_json({**sections, "metrics": metrics, "cross_validation": cv, "importance": importance}, f"{out}/report")
    return {"metrics": metrics, "cross_validation": cv, "predictions": predictions, "hotspots": hot,
            "importance": importance, **{f"report.{k}": v for k, v in sections.items()}}


def predict(incidents: DataFrame, model: PipelineModel, features: Sequence[str], years: Years = Years(),
            cols: Columns = COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Scores and error of the test years under a saved model."""
    units = unit_features(settle(prepare(incidents, cols)), years, cols).filter(F.col("split") == "test")
    return models.score_units(model, units, features, cols), models.evaluate(model, units, features, cols.target)
