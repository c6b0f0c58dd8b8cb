"""The analytics report: twelve sections over incidents, their panel, scores and hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import COLUMNS, Columns
from ..operators import reports


def analytics_sections(incidents: DataFrame, panel: DataFrame, target: str, scores: DataFrame | None = None,
                       cells: DataFrame | None = None, cols: Columns = COLUMNS) -> dict[str, DataFrame]:
    """Section name to frame; a section whose inputs are missing is left out.

    ``panel`` is the unit-month panel with its features, ``scores`` the scored
    unit-months, ``cells`` the hotspot ranking. Every section aggregates its
    input map-side first, so each costs one pass and one small shuffle.
    """
    have = set(panel.columns)
    ranked = panel if scores is None else scores
    order = ["risk_score", "risk_index", target]
    out = {
        "top_risk_districts": reports.top_units(ranked, order, cols=cols),
        "crime_trends": reports.unit_trend(panel, target, cols),
        "monthly_trends": reports.monthly_profile(panel, target, cols),
        "seasonality": reports.quarterly_profile(panel, target, cols),
        "moving_averages": reports.moving_average_summary(panel, cols) if "rolling_mean_3m" in have else None,
        "rolling_growth": reports.growth_summary(panel, cols) if "crime_growth" in have else None,
        "growth_rates": reports.growth_stats(incidents, cols=cols) if "growth_rate" in incidents.columns else None,
        "crime_category_distribution": reports.category_share(incidents, cols) if cols.category in incidents.columns else None,
        "station_load": reports.station_load(incidents, cols) if cols.station in incidents.columns else None,
        "risk_rankings": reports.unit_ranking(ranked, order, cols) if {"risk_score", "risk_index"} & set(ranked.columns) else None,
        "hotspot_trends": reports.hotspot_summary(cells) if cells is not None else None,
        "neighbor_influence": reports.neighbor_influence(incidents, target)
        if {"neighbor_risk", "spatial_lag", "neighbor_density"} & set(incidents.columns) else None,
    }
    return {name: df for name, df in out.items() if df is not None}


def summary(sections: dict[str, DataFrame]) -> DataFrame:
    """The flat summary of a report: list sections by rank, map sections by key."""
    lists, maps = {}, {}
    for name, df in sections.items():
        if name in ("top_risk_districts", "risk_rankings"):
            key = "rank" if "rank" in df.columns else None
            lists[name] = (df, [key] if key else [F.col("risk_score").desc(), df.columns[0]])
        else:
            key = df.columns[0]
            rest = F.to_json(F.struct(*df.columns[1:]))
            maps[name] = (df.select(F.concat(F.lit(f"{key}="), F.col(key).cast("string")).alias("key"), rest.alias("value")), ["key"])
    return reports.summary_table(lists, maps)
