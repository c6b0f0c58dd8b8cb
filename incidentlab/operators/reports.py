"""Report sections, dashboards and ranked lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import COLUMNS, SETTINGS, Columns
from ..functions.scalar import col, month_name, rounded
from .scale import global_row_number, with_stats

# Fixed values.
TREND_LIMIT_PCT = 5.0
HALF_YEAR_UP, HALF_YEAR_DOWN = 1.02, 0.98
UNIT_ALERT, UNIT_ALERT_CRITICAL, UNIT_ALERT_ROWS = 75, 85, 3
CELL_ALERT, CELL_ALERT_ROWS = 80, 5
REPORT_TYPES = ("dashboard_summary", "risk_ranking", "hotspot_analysis", "analytics_report")
# End of fixed values.


def _first_present(df: DataFrame, names: Sequence[str]) -> str:
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of {list(names)} is a column")


def top_units(df: DataFrame, scores: Sequence[str], k: int = SETTINGS.top_units, cols: Columns = COLUMNS) -> DataFrame:
    """A3. Units by mean score, the first of ``scores`` that exists; a bounded top-k."""
    score = _first_present(df, scores)
    means = df.groupBy(cols.unit).agg(F.avg(score).alias("_m"))
    return means.orderBy(F.col("_m").desc(), cols.unit).limit(k).select(
        cols.unit, rounded("_m", 4).alias("risk_score"))


def unit_trend(panel: DataFrame, target: str, cols: Columns = COLUMNS) -> DataFrame:
    """A4. Last three against first three rows of each unit's panel series; single-row units drop out.

    Both ends are marked in one pass; the input has one row per unit and month.
    """
    unit = Window.partitionBy(cols.unit)
    ahead = F.row_number().over(unit.orderBy(*cols.time))
    rows = F.count(F.lit(1)).over(unit)
    marked = panel.select(cols.unit, F.col(target).alias("_x"), ahead.alias("_i"), rows.alias("_n"))
    recent = F.avg(F.when(F.col("_i") > F.col("_n") - 3, F.col("_x")))
    earlier = F.avg(F.when(F.col("_i") <= 3, F.col("_x")))
    change = F.try_divide(F.col("_r") - F.col("_e"), F.col("_e") + 1) * 100
    return (
        marked.filter(F.col("_n") >= 2).groupBy(cols.unit).agg(recent.alias("_r"), earlier.alias("_e"))
        .withColumn("_c", change)
        .select(
            cols.unit, rounded("_r", 2).alias("recent_avg"), rounded("_e", 2).alias("earlier_avg"),
            rounded("_c", 2).alias("change_pct"),
            F.when(F.col("_c") > TREND_LIMIT_PCT, "increasing").when(F.col("_c") < -TREND_LIMIT_PCT, "decreasing")
            .otherwise("stable").alias("direction"))
    )


def growth_stats(df: DataFrame, growth: str = "growth_rate", cols: Columns = COLUMNS) -> DataFrame:
    """A5. Mean, sample deviation, least and greatest growth per year."""
    return df.groupBy(cols.year).agg(
        rounded(F.avg(growth), 4).alias("mean"), rounded(F.stddev_samp(growth), 4).alias("std"),
        rounded(F.min(growth), 4).alias("min"), rounded(F.max(growth), 4).alias("max"))


def monthly_profile(df: DataFrame, target: str, cols: Columns = COLUMNS) -> DataFrame:
    """A6. Mean target per calendar month."""
    return df.groupBy(cols.month).agg(rounded(F.avg(target), 2).alias("value"))


def quarterly_profile(df: DataFrame, target: str, cols: Columns = COLUMNS) -> DataFrame:
    """A7. Mean target per quarter and the quarter with the (first) greatest mean."""
    means = df.groupBy(cols.quarter).agg(F.avg(target).alias("_m"))
    peak = means.agg(F.max_by(cols.quarter, F.struct("_m", -F.col(cols.quarter)))).scalar()
    return means.select(cols.quarter, rounded("_m", 2).alias("value"), peak.alias("peak_quarter"))


def _summaries(df: DataFrame, columns: Sequence[str], digits: int, order: Sequence[str], with_std: bool) -> DataFrame:
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(*order))
    stats = df.agg(*[
        F.struct(
            F.lit(c).alias("feature"), rounded(F.avg(c), digits).alias("mean"),
            *([rounded(F.stddev_samp(c), digits).alias("std")] if with_std else []),
            rounded(F.max_by(c, at(c)), digits).alias("latest")).alias(c)
        for c in columns if c in df.columns])
    return stats.select(F.inline(F.array(*stats.columns)))


def moving_average_summary(df: DataFrame, cols: Columns = COLUMNS,
                           columns: Sequence[str] = ("rolling_mean_3m", "rolling_mean_6m")) -> DataFrame:
    """A8. Mean and last non-null value (by year, month, unit) of the rolling means."""
    return _summaries(df, columns, 2, [*cols.time, cols.unit], with_std=False)


def growth_summary(df: DataFrame, cols: Columns = COLUMNS,
                   columns: Sequence[str] = ("crime_growth", "momentum", "acceleration")) -> DataFrame:
    """A9. Mean, deviation and last value of the growth features."""
    return _summaries(df, columns, 4, [*cols.time, cols.unit], with_std=True)


def category_share(df: DataFrame, cols: Columns = COLUMNS) -> DataFrame:
    """A10. Count and percentage per category, most frequent first."""
    counts = df.filter(F.col(cols.category).isNotNull()).groupBy(cols.category).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").cast("double")).scalar()
    return counts.withColumn("pct", rounded(F.col("count") * 100 / total, 2)).orderBy(F.col("count").desc(), cols.category)


def station_load(df: DataFrame, cols: Columns = COLUMNS) -> DataFrame:
    """A11. Number of stations and mean, greatest and least load (target sum, or rows without a target)."""
    load = F.sum(cols.target) if cols.target in df.columns else F.count(F.lit(1))
    loads = df.filter(F.col(cols.station).isNotNull()).groupBy(cols.station).agg(load.alias("_l"))
    return loads.agg(
        F.count("_l").alias("total_stations"), rounded(F.avg("_l"), 2).alias("mean_load"),
        rounded(F.max("_l"), 2).alias("max_load"), rounded(F.min("_l"), 2).alias("min_load"))


def unit_ranking(df: DataFrame, scores: Sequence[str], cols: Columns = COLUMNS) -> DataFrame:
    """A12. Rank 1..n of the units on mean score; ties go by name."""
    means = df.groupBy(cols.unit).agg(F.avg(_first_present(df, scores)).alias("_m"))
    ranked = global_row_number(means, [F.col("_m").desc(), F.col(cols.unit).asc()], "rank")
    return ranked.select("rank", cols.unit, rounded("_m", 4).alias("score"))


def hotspot_summary(df: DataFrame, cell: str = "cell", score: str = "risk_score", rank: str = "hotspot_rank") -> DataFrame:
    """A13. Number, mean and greatest score, and the first cell by rank."""
    return df.agg(
        F.count(F.lit(1)).alias("total_hotspots"), rounded(F.avg(score), 2).alias("mean_risk_score"),
        rounded(F.max(score), 2).alias("max_risk_score"), F.min_by(cell, rank).alias("top_hotspot"))


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation over rows where both sides are present; NULL when one side is constant."""
    both = col(a).isNotNull() & col(b).isNotNull()
    x, y = F.when(both, col(a).cast("double")), F.when(both, col(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def neighbor_influence(df: DataFrame, target: str, columns: Sequence[str] = (
        "neighbor_risk", "spatial_lag", "neighbor_density")) -> DataFrame:
    """A14. Correlation of the target with each neighbour column present, and the column's mean."""
    stats = df.agg(*[
        F.struct(F.lit(c).alias("feature"), rounded(pearson(target, c), 4).alias("correlation"),
                 rounded(F.avg(c), 4).alias("mean")).alias(c)
        for c in columns if c in df.columns])
    return stats.select(F.inline(F.array(*stats.columns)))


def dashboard_metrics(df: DataFrame, scores: DataFrame, cells: DataFrame, target: str, cols: Columns = COLUMNS,
                      score: str = "risk_score") -> DataFrame:
    """A15. One row of headline numbers; three aggregates, joined as values rather than rows.

    Distinct units, years and categories are counted on the grouped table, so
    a unit with most of the rows is summed map-side first.
    """
    grouped = df.groupBy(cols.unit, cols.year, cols.category).agg(
        F.sum(target).alias("_s"), F.count(target).alias("_c"), F.count(F.lit(1)).alias("_n"))
    by_category = grouped.filter(F.col(cols.category).isNotNull()).groupBy(cols.category).agg(F.sum("_n").alias("_n"))
    top = by_category.agg(F.min_by(cols.category, F.struct(-F.col("_n"), F.col(cols.category)))).scalar()
    best = scores.agg(F.min_by(cols.unit, F.struct(-F.col(score), F.col(cols.unit))).alias("unit"),
                      rounded(F.max(score), 2).alias("score"))
    hot = cells.agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(score), 2).alias("mean"))
    metrics = grouped.agg(
        rounded(F.sum("_s"), 2).alias("total_count"), rounded(F.sum("_s") / F.sum("_c"), 2).alias("avg_count"),
        F.countDistinct(cols.unit).alias("total_units"),
        F.array_sort(F.collect_set(cols.year)).alias("years_covered"),
        F.countDistinct(cols.category).alias("categories"),
    )
    return with_stats(with_stats(metrics, "_best", best), "_hot", hot).withColumns({
        "top_unit": F.col("_best.unit"), "top_score": F.col("_best.score"), "hotspot_count": F.col("_hot.n"),
        "avg_hotspot_score": F.col("_hot.mean"), "top_category": top,
    }).drop("_best", "_hot")


def year_month_series(df: DataFrame, target: str, cols: Columns = COLUMNS) -> DataFrame:
    """A16. Mean target and row count per (year, month) with the first day of the month."""
    return df.groupBy(*cols.time).agg(rounded(F.avg(target), 4).alias("value"), F.count(F.lit(1)).alias("rows")).withColumn(
        "date", F.make_date(cols.year, cols.month, F.lit(1)))


def overall_direction(trends: DataFrame) -> DataFrame:
    """A17. Majority of the unit directions and the mean change."""
    up, down = F.count_if(F.col("direction") == "increasing"), F.count_if(F.col("direction") == "decreasing")
    return trends.agg(
        F.when(up > down, "up").when(down > up, "down").otherwise("stable").alias("direction"),
        rounded(F.avg("change_pct"), 4).alias("percentage_change"))


def half_year_direction(profile: DataFrame, cols: Columns = COLUMNS, value: str = "value") -> DataFrame:
    """A18. Mean of the first half of the monthly profile against the second.

    ``profile`` has one row per calendar month, so its window spans 12 rows.
    """
    everything = Window.partitionBy()
    marked = profile.select(
        F.col(value).alias("_v"), F.row_number().over(everything.orderBy(cols.month)).alias("_i"),
        F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(everything) / 2)).alias("_half"))
    first = F.avg(F.when(F.col("_i") <= F.col("_half"), F.col("_v")))
    second = F.coalesce(F.avg(F.when(F.col("_i") > F.col("_half"), F.col("_v"))), F.lit(0.0))
    a, b = F.col("_a"), F.col("_b")
    change = F.try_divide(F.abs(b - a), a) * 100
    return marked.agg(first.alias("_a"), second.alias("_b")).select(
        F.when(b > a * HALF_YEAR_UP, "up").when(b < a * HALF_YEAR_DOWN, "down").otherwise("stable").alias("direction"),
        F.when((b > a * HALF_YEAR_UP) | (b < a * HALF_YEAR_DOWN), rounded(change, 2)).otherwise(0.0)
        .alias("percentage_change"))


def month_pattern(profile: DataFrame, cols: Columns = COLUMNS, value: str = "value") -> DataFrame:
    """A19. Named months in order and the name of the (first) peak month."""
    peak = profile.agg(F.max_by(cols.month, F.struct(F.col(value), -F.col(cols.month)))).scalar()
    return profile.select(F.col(cols.month), month_name(cols.month).alias("month_name"), value,
                          month_name(peak).alias("peak_month"))


def kpi(scores: DataFrame, hotspot_count: Column, predicted: str = "predicted_count", score: str = "risk_score",
        limit: float = UNIT_ALERT) -> DataFrame:
    """A20. Total predicted, hotspots, mean score, units at or above the alert score."""
    return scores.agg(
        rounded(F.sum(predicted), 2).alias("total_predicted"), rounded(F.avg(score), 2).alias("average_risk_score"),
        F.count_if(F.col(score) >= limit).alias("high_risk_units"),
    ).withColumn("hotspot_count", hotspot_count)


def category_by_focus(df: DataFrame, focus: Column, cols: Columns = COLUMNS) -> DataFrame:
    """A22. Rows per category in the focus group and in the rest."""
    inside = F.coalesce(focus, F.lit(False))
    return df.groupBy(cols.category).agg(F.count_if(inside).alias("focus"), F.count_if(~inside).alias("rest"))


def bin_of(value: Column | str, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 1..bins, the last one closed; a constant column falls in bin 1."""
    v = col(value).cast("double")
    return F.when(v.isNotNull(), F.when(low == high, F.lit(1)).otherwise(
        F.least(F.width_bucket(v, low, high, F.lit(bins)), F.lit(bins)).cast("int")))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """A23. Count per equal-width bin with its edges and the overall mean; empty bins are kept."""
    stats = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"), F.avg(value).alias("mean"))
    low, high = F.col("_s.lo"), F.col("_s.hi")
    counts = (
        with_stats(df.select(value), "_s", stats).select(bin_of(value, low, high, bins).alias("bin"))
        .filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    )
    all_bins = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    width = (high - low) / bins
    return with_stats(all_bins.join(counts, "bin", "left"), "_s", stats).select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"), (low + width * (F.col("bin") - 1)).alias("lower"),
        (low + width * F.col("bin")).alias("upper"), F.col("_s.mean").alias("mean"))


def density_grid(df: DataFrame, bins: int = 80, cols: Columns = COLUMNS) -> DataFrame:
    """A24. Points per cell of a ``bins`` x ``bins`` grid over the bounding box; empty cells are left out."""
    stats = df.agg(*[f(c).cast("double").alias(n) for c, f, n in (
        (cols.lat, F.min, "a0"), (cols.lat, F.max, "a1"), (cols.lon, F.min, "o0"), (cols.lon, F.max, "o1"))])
    return (
        with_stats(df.select(cols.lat, cols.lon), "_s", stats)
        .select(bin_of(cols.lat, F.col("_s.a0"), F.col("_s.a1"), bins).alias("by"),
                bin_of(cols.lon, F.col("_s.o0"), F.col("_s.o1"), bins).alias("bx"))
        .filter(F.col("bx").isNotNull() & F.col("by").isNotNull())
        .groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A25. All pairs in one aggregate, pairwise complete; both triangles and the diagonal."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    stats = df.agg(*[pearson(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            rows.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"_{i}").alias("r")))
    return stats.select(F.inline(F.array(*rows)))


def own_vs_neighbor(unit_year: DataFrame, count: str, rate: str, lag: str, neighbor: str,
                    cols: Columns = COLUMNS) -> DataFrame:
    """A26. Own rate (else count) beside the spatial lag (else neighbour mean), one row per unit-year."""
    return unit_year.select(
        *cols.unit_year_keys, F.coalesce(F.col(rate), F.col(count).cast("double")).alias("own"),
        F.coalesce(F.col(lag), F.col(neighbor)).alias("lag"))


def fit_error(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """A29. RMSE, MAE, R2 and MAPE (percent, over non-zero actuals) from one aggregate, four decimals."""
    a, e = F.col(actual), F.col(actual) - F.col(predicted)
    sse, sst = F.sum(e * e), F.var_pop(a) * F.count(a)
    return df.groupBy(*by).agg(
        rounded(F.sqrt(F.avg(e * e)), 4).alias("rmse"), rounded(F.avg(F.abs(e)), 4).alias("mae"),
        rounded(1 - F.try_divide(sse, F.nullif(sst, F.lit(0.0))), 4).alias("r2"),
        rounded(F.avg(F.abs(F.try_divide(e, F.nullif(a, F.lit(0.0))))) * 100, 4).alias("mape"),
        F.count(F.lit(1)).alias("rows"))


def residuals(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """A30. Actual minus predicted per row, with the limits of the diagonal."""
    limits = df.agg(F.least(F.min(actual), F.min(predicted)).alias("lo"), F.greatest(F.max(actual), F.max(predicted)).alias("hi"))
    return with_stats(df, "_s", limits).select(
        *keys, F.col(predicted).alias("predicted"), (F.col(actual) - F.col(predicted)).alias("residual"),
        F.col("_s.lo").alias("axis_min"), F.col("_s.hi").alias("axis_max"))


# --- ranked lists ------------------------------------------------------------


def rankings(df: DataFrame, rank: str, n: int = 10) -> DataFrame:
    """T1. The first ``n`` rows by rank."""
    return df.orderBy(F.col(rank).asc()).limit(n)


def alerts(units: DataFrame, cells: DataFrame, cols: Columns = COLUMNS, cell: str = "cell") -> DataFrame:
    """T2. Alerts among the first three units and the first five cells."""
    def rows(df: DataFrame, kind: str, name: str, rank: str, title: str, text: str, severity: Column) -> DataFrame:
        return df.select(
            F.lit(kind).alias("type"), severity.alias("severity"),
            F.format_string(title, F.col(name)).alias("title"),
            F.format_string(text, F.col("risk_score"), F.col(rank).cast("int")).alias("description"),
            F.col(name).alias("subject"), F.col("risk_score").alias("score"))

    level = F.when(F.col("risk_score") >= UNIT_ALERT_CRITICAL, "critical").otherwise("high")
    top_rows = rankings(units, "priority_rank", UNIT_ALERT_ROWS).filter(F.col("risk_score") >= UNIT_ALERT)
    top_cells = rankings(cells, "hotspot_rank", CELL_ALERT_ROWS).filter(F.col("risk_score") >= CELL_ALERT)
    return rows(top_rows, "high_risk_district", cols.unit, "priority_rank", "High risk in %s",
                "Risk score %.1f (rank #%d)", level).unionByName(
        rows(top_cells, "hotspot", cell, "hotspot_rank", "Hotspot detected at %s", "Score %.1f (rank #%d)", F.lit("high")))


def order_by(df: DataFrame, column: str, ascending: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """T3. The table sorted on any column."""
    c = F.col(column)
    return df.orderBy(c.asc() if ascending else c.desc(), *tie)


def top_features(df: DataFrame, n: int = SETTINGS.display_features, importance: str = "importance") -> DataFrame:
    """T4. Features by importance with rank 1..n (one row per feature comes in)."""
    order = [F.col(importance).desc(), F.col("feature").asc()]
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def dashboard(units: DataFrame, cells: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """T5. Metrics, first units, first cells and alerts, as four frames."""
    hotspot_count = cells.agg(F.count(F.lit(1))).scalar()
    return {"metrics": kpi(units, hotspot_count), "top_units": rankings(units, "priority_rank", n),
            "top_hotspots": rankings(cells, "hotspot_rank", n), "alerts": alerts(units, cells)}


def report_payload(kind: str, metrics: DataFrame, units: DataFrame, cells: DataFrame, geojson: DataFrame,
                   sections: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """S10. The frames of a report type; an unknown type holds only its time of making."""
    if kind == "dashboard_summary":
        return {"metrics": metrics, "top_districts": rankings(units, "priority_rank", SETTINGS.top_units)}
    if kind == "risk_ranking":
        return {"rankings": units.orderBy("priority_rank")}
    if kind == "hotspot_analysis":
        return {"rankings": cells.orderBy("hotspot_rank"), "geojson": geojson}
    if kind == "analytics_report":
        return dict(sections)
    return {"generated_at": units.sparkSession.range(1).select(F.current_timestamp().alias("generated_at"))}


def summary_table(lists: Mapping[str, tuple[DataFrame, Sequence[Column | str]]],
                  maps: Mapping[str, tuple[DataFrame, Sequence[Column | str]]]) -> DataFrame:
    """S12. One flat table: five rows of each list section, one row of ten keys of each map section.

    Each section comes with its order; map sections have (key, value). Only
    the ten key names of a map section reach the driver.
    """
    parts: list[DataFrame] = []
    for name, (df, order) in lists.items():
        parts.append(df.orderBy(*order).limit(5).withColumn("section", F.lit(name)))
    for name, (df, order) in maps.items():
        head = df.orderBy(*order).limit(10)
        keys = [str(r["key"]) for r in head.select("key").collect()]
        text = F.substring(F.col("value").cast("string"), 1, 100)
        cells = [F.max(F.when(F.col("key").cast("string") == k, text)).alias(k) for k in keys]
        parts.append(head.agg(F.lit(name).alias("section"), *cells))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
