"""Risk index, ranks and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import COLUMNS, SETTINGS, Columns
from ..functions.scalar import clamp, col, lookup_map, rate_100k_smoothed, rounded
from .scale import exact_medians, global_row_number, settle, with_stats

# Fixed values.
INDEX_WEIGHTS = {"rate": 0.5, "growth": 0.3, "neighbor": 0.2}
GROWTH_LIMITS = (-0.5, 2.0)
RATE_SCALE = 50.0
COUNT_SCALE = 1000.0
TIER_DENSITY = {"high": 0.6, "mid": 0.4, "low": 0.25}
DEFAULT_TIER = "mid"
URBAN_FACTOR, RURAL_FACTOR = 1.2, 0.6
# End of fixed values.


def with_risk_index(df: DataFrame, count: str, rate: str, growth: str, neighbor: str,
                    name: str = "risk_index") -> DataFrame:
    """F4. Weighted rate, growth and neighbour terms, cut to 0..1, four decimals."""
    df = with_stats(df, "_stats", df.agg(F.max(count).cast("double").alias("top")))
    scale = F.when(F.coalesce("_stats.top", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("_stats.top"))
    rate_term = F.least(F.coalesce(F.col(rate), F.col(count) / COUNT_SCALE) / RATE_SCALE, F.lit(1.0))
    growth_term = F.greatest(clamp(growth, *GROWTH_LIMITS), F.lit(0.0))
    neighbor_term = F.coalesce(F.col(neighbor), F.lit(0.0)) / scale
    w = INDEX_WEIGHTS
    total = w["rate"] * rate_term + w["growth"] * growth_term + w["neighbor"] * neighbor_term
    return df.withColumn(name, rounded(clamp(total, 0, 1), 4)).drop("_stats")


def rank_within_year(df: DataFrame, value: str = "risk_index", cols: Columns = COLUMNS) -> DataFrame:
    """W11 and W12. Average-rank percentile and descending min-rank within the year.

    Ranks are worked out on the distinct values of a year with their counts
    (at most 10,001 for an index of four decimals), never on the rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(cols.year, value).agg(F.count(F.lit(1)).alias("_n"))
    year = Window.partitionBy(cols.year)
    upto, total = F.sum("_n").over(year.orderBy(value)), F.sum("_n").over(year)
    n = F.col("_n")
    ranks = counts.select(
        cols.year, value,
        rounded((upto - n + (n + 1) / 2) / total, 4).alias("risk_percentile"),
        (total - upto + 1).alias("risk_rank"),
    )
    return df.join(ranks, [cols.year, value], "left")


def with_trend_score(df: DataFrame, value: str = "trend_3y", cols: Columns = COLUMNS) -> DataFrame:
    """W13. Min-max within the year, a constant year gives 0.

    The limits of all years travel as one small map (one entry per year). Rows
    without a year have no limits and get 0.
    """
    limits = df.filter(F.col(cols.year).isNotNull()).groupBy(cols.year).agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("m"))
    by_year = limits.agg(F.map_from_entries(F.collect_list(F.struct(cols.year, "m"))).alias("limits"))
    own = F.try_element_at(F.col("_stats.limits"), F.col(cols.year))
    scaled = F.try_divide(F.col(value) - own["lo"], F.nullif(own["hi"] - own["lo"], F.lit(0.0)))
    df = with_stats(df, "_stats", by_year)
    return df.withColumn("trend_score", rounded(F.coalesce(scaled, F.lit(0.0)), 4)).drop("_stats")


def with_anomaly_score(df: DataFrame, growth: str = "growth_rate", cols: Columns = COLUMNS) -> DataFrame:
    """W14. Absolute standard score of growth in the unit's own history (one row per year)."""
    unit = Window.partitionBy(*cols.unit_keys)
    mean, sd = F.avg(growth).over(unit), F.stddev_samp(growth).over(unit)
    z = F.when(sd == 0, F.lit(0.0)).otherwise((F.col(growth) - mean) / F.nullif(sd, F.lit(0.0)))
    return df.withColumn("anomaly_score", rounded(F.abs(z), 4))


# --- scores over predictions -------------------------------------------------


def _with_score(df: DataFrame, prediction: str) -> DataFrame:
    df = with_stats(df, "_stats", df.agg(F.min(prediction).alias("lo"), F.max(prediction).alias("hi")))
    low, high = F.col("_stats.lo"), F.col("_stats.hi")
    share = F.try_divide(F.col(prediction) - low, F.nullif(high - low, F.lit(0.0)))
    return df.withColumn("risk_score", rounded(F.coalesce(share * 100, F.lit(0.0)), 2)).drop("_stats")


def score_0_100(df: DataFrame, prediction: str, keys: Sequence[str], rank: str = "priority_rank") -> DataFrame:
    """W16. Min-max score with two decimals and rank 1..n, ties broken by ``keys``."""
    scored = _with_score(df, prediction)
    return global_row_number(scored, [F.col(prediction).desc(), *[F.col(k).asc() for k in keys]], rank)


def with_confidence(df: DataFrame, prediction: str) -> DataFrame:
    """W17. 1 at the median prediction, falling to 0 three deviations away."""
    median = exact_medians(df, [prediction])[prediction]
    df = with_stats(df, "_stats", df.agg(F.stddev_pop(prediction).alias("sd"), F.count(prediction).alias("n")))
    sd = F.when(F.col("_stats.n") > 1, F.col("_stats.sd")).otherwise(F.lit(1.0))
    off = F.abs(F.col(prediction) - F.lit(median)) / (sd * 3 + F.lit(1e-6))
    return df.withColumn("confidence", rounded(clamp(1 - off, 0, 1), 4)).drop("_stats")


def risk_scores(df: DataFrame, prediction: str, keys: Sequence[str]) -> DataFrame:
    """W16 and W17 together; the predictions are computed once."""
    df = settle(df)
    return score_0_100(with_confidence(df, prediction), prediction, keys)


def hotspots(df: DataFrame, prediction: str, keys: Sequence[str], top_n: int | None = SETTINGS.top_hotspots) -> DataFrame:
    """W18. All cells with score and rank by prediction, or the first ``top_n`` (a bounded top-k, no full sort)."""
    scored = _with_score(df, prediction)
    order = [F.col(prediction).desc(), *[F.col(k).asc() for k in keys]]
    if top_n is None:
        return global_row_number(scored, order, "hotspot_rank").withColumn("hotspot_rank", F.col("hotspot_rank").cast("int"))
    return scored.orderBy(*order).limit(top_n).withColumn(
        "hotspot_rank", F.row_number().over(Window.orderBy(*order)))


# --- proxies -----------------------------------------------------------------


def density_proxies(df: DataFrame, tier: str, urban: str, profile: str, density: str) -> DataFrame:
    """F5. Commercial density from a profile value or the tier, urban density where known."""
    base = F.coalesce(F.element_at(lookup_map(TIER_DENSITY), F.coalesce(F.col(tier), F.lit(DEFAULT_TIER))),
                      F.lit(TIER_DENSITY[DEFAULT_TIER]))
    factor = F.when(F.col(urban) == "Urban", URBAN_FACTOR).otherwise(RURAL_FACTOR)
    return df.withColumns({
        "commercial_density": rounded(F.coalesce(F.col(profile), base * factor), 3),
        "urban_density": F.nullif(F.col(density).cast("double"), F.lit(0.0)),
    })


# Panel column <- source columns in any case, the first one present wins.
PASS_THROUGH = {
    "neighbor_density": ("neighbor_risk", "neighbor_district_risk", "spatial_lag"),
    "weekend_ratio": ("is_weekend",),
    "night_ratio": ("is_night",),
    "office_hour_ratio": ("is_office_hour",),
}
RATE_COLUMNS = ("rate_100k", "crime_rate_100k")
# End of fixed values.


def pass_through_features(df: DataFrame) -> DataFrame:
    """F6. Neighbour density and flag ratios copied from the first column present, else 0.0."""
    return df.withColumns({
        name: F.lit(0.0) if found is None else F.col(found).cast("double")
        for name, found in ((name, _first_named(df, sources)) for name, sources in PASS_THROUGH.items())})


def _first_named(df: DataFrame, names: Sequence[str]) -> str | None:
    present = {c.lower(): c for c in df.columns}
    return next((present[n] for n in names if n in present), None)


def population_rate(df: DataFrame, target: str, population: str = "population") -> DataFrame:
    """F3, panel form: an existing rate, else target per 100,000, else 0.0."""
    rate = _first_named(df, RATE_COLUMNS)
    if rate is not None:
        value = col(rate)
    elif population in df.columns and target in df.columns:
        value = rate_100k_smoothed(target, population)
    else:
        value = F.lit(0.0)
    return df.withColumn("population_rate", value)
