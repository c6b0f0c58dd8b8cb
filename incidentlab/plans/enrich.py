"""The enrichment flow: incident rows to unit-year features and back onto the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import COLUMNS, Columns
from ..functions.scalar import rate_100k
from ..operators import risk, spatial, temporal
from ..operators.scale import settle

FEATURES = ("unit_count", "rate_100k", "trend_3y", "growth_rate", "historical_growth", "expected_growth", "neighbor_risk",
            "spatial_lag", "local_moran", "risk_index",
            "nearby_hotspot_score", "risk_percentile", "risk_rank", "trend_score", "anomaly_score")


def unit_year_rates(unit_year: DataFrame, count: str, cols: Columns = COLUMNS) -> DataFrame:
    """Yearly series features and the rate per 100,000."""
    return temporal.yearly_features(unit_year, count, cols).withColumn("rate_100k", rate_100k(count, cols.population))


def unit_year_neighbours(unit_year: DataFrame, edges: DataFrame, count: str, cols: Columns = COLUMNS) -> DataFrame:
    """Neighbour mean and spatial lag from one pass over the edges."""
    other = unit_year.select(F.col(cols.unit).alias("dst"), cols.year, F.col(count).alias("_n"), "rate_100k")
    near = (
        other.join(edges, "dst").groupBy(F.col("src").alias(cols.unit), cols.year)
        .agg(F.avg("_n").alias("neighbor_risk"), F.avg("rate_100k").alias("spatial_lag"))
    )
    return unit_year.join(near, [cols.unit, cols.year], "left")


def enrich_unit_year(unit_year: DataFrame, edges: DataFrame, count: str, cols: Columns = COLUMNS) -> DataFrame:
    """All unit-year features: series, rate, neighbours, index, ranks, trend and anomaly scores.

    Later steps read the table several times, so it is settled after the
    series and after the neighbour features: the incidents behind it are
    scanned once.
    """
    df = settle(unit_year_rates(unit_year, count, cols))
    df = unit_year_neighbours(df, edges, count, cols)
    df = settle(spatial.local_moran_proxy(df, edges, "rate_100k", count, cols))
    df = risk.with_risk_index(df, count, "rate_100k", "growth_rate", "neighbor_risk")
    df = risk.rank_within_year(df, "risk_index", cols)
    return risk.with_anomaly_score(risk.with_trend_score(df, "trend_3y", cols), "growth_rate", cols)


def enrich_incidents(incidents: DataFrame, unit_year: DataFrame, edges: DataFrame, count: str,
                     cols: Columns = COLUMNS) -> DataFrame:
    """The unit-year features on every incident."""
    enriched = enrich_unit_year(unit_year, edges, count, cols).withColumns(
        {"unit_count": F.col(count), "nearby_hotspot_score": F.col("risk_index")})
    features = settle(enriched.select(*cols.unit_year_keys, *FEATURES))
    return spatial.attach_unit_features(incidents, features, cols)
