"""Lag, rolling, exponential and growth features over panels.

All windows of one panel share one specification, so a chain of these
operators costs one exchange and one sort; the exponential mean is a scan of
its own. Offsets count rows, not calendar
months. A group is one unit (or cell) of a panel, hence at most one row per
month of the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..columns import COLUMNS, SETTINGS, Columns
from ..functions.scalar import seasonal_columns
from .scale import global_row_number, settle
from .scan import prefixes


def series(group: Sequence[str], cols: Columns = COLUMNS) -> WindowSpec:
    return Window.partitionBy(*group).orderBy(*cols.time)


def lags(df: DataFrame, group: Sequence[str], target: str, max_lag: int = SETTINGS.max_lag,
         cols: Columns = COLUMNS) -> DataFrame:
    """W1. ``<target>_lag_1`` .. ``<target>_lag_<max_lag>``."""
    w = series(group, cols)
    return df.withColumns({f"{target}_lag_{k}": F.lag(target, k).over(w) for k in range(1, max_lag + 1)})


def rolling(df: DataFrame, group: Sequence[str], target: str, windows: Sequence[int] = SETTINGS.rolling_windows,
            cols: Columns = COLUMNS) -> DataFrame:
    """W2. Mean and sample deviation of the previous ``w`` rows, the current one left out."""
    new: dict[str, Column] = {}
    for size in windows:
        w = series(group, cols).rowsBetween(-size, -1)
        new[f"rolling_mean_{size}m"] = F.avg(target).over(w)
        new[f"rolling_std_{size}m"] = F.coalesce(F.stddev_samp(target).over(w), F.lit(0.0))
    return df.withColumns(new)


def _observed(key: Sequence[str], value: Column) -> Column:
    """One row as an element of the EMA scan: its series, and the map it applies to the mean.

    ``first`` and ``last`` are the series of the first and last row of a run of rows, ``one`` tells whether it is a single series.
    The rest describes the rows of the last series: ``some`` whether a value was seen, ``lead`` the rows before the first value,
    ``x`` that value, ``tail`` the rows after the last one; the first mean m becomes ``decay`` * m + ``gain``.
    """
    series_of, seen = F.struct(*key), value.isNotNull()
    return F.struct(series_of.alias("first"), series_of.alias("last"), F.lit(True).alias("one"), seen.alias("some"),
                    F.when(seen, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("lead"), F.coalesce(value, F.lit(0.0)).alias("x"),
                    F.lit(1.0).alias("decay"), F.lit(0.0).alias("gain"), F.lit(0).cast("long").alias("tail"))


def _followed(alpha: float):
    """Two neighbouring runs of rows as one."""
    def combine(a: Column, b: Column) -> Column:
        on = b["one"] & a["last"].eqNullSafe(b["first"])  # b goes on with the series that a ends in
        # a value after k rows without one meets a mean whose weight has fallen k + 1 times
        old = F.pow(F.lit(1 - alpha), (a["tail"] + b["lead"] + 1).cast("double"))
        share = old / (old + alpha)
        both, meets = on & a["some"], on & a["some"] & b["some"]
        return F.struct(
            a["first"].alias("first"), b["last"].alias("last"), (a["one"] & on).alias("one"), (b["some"] | both).alias("some"),
            F.when(both, a["lead"]).when(on, a["lead"] + b["lead"]).otherwise(b["lead"]).alias("lead"),
            F.when(both, a["x"]).otherwise(b["x"]).alias("x"),
            F.when(meets, b["decay"] * share * a["decay"]).when(both, a["decay"]).otherwise(b["decay"]).alias("decay"),
            F.when(meets, b["decay"] * (share * a["gain"] + (1 - share) * b["x"]) + b["gain"]).when(both, a["gain"]).otherwise(b["gain"]).alias("gain"),
            F.when(both & ~b["some"], a["tail"] + b["lead"]).otherwise(b["tail"]).alias("tail"))

    return combine


def ema(df: DataFrame, group: Sequence[str], target: str, span: int = SETTINGS.ema_span,
        cols: Columns = COLUMNS) -> DataFrame:
    """W3. Exponential mean of all previous rows, first row NULL.

    A NULL keeps its place: the mean stays, and the weight of what came before
    it falls by one more step. Every run of rows is an affine map of the mean
    before it, so the table is numbered as a whole, runs of rows are combined
    in blocks, and blocks hand over to blocks (``prefixes``): memory does not
    grow with a series, and a long one is spread over many tasks.
    """
    numbered = global_row_number(settle(df), [*group, *cols.time], "_row").withColumn("_row", F.col("_row") - 1)
    held = prefixes(numbered, "_row", _observed(group, F.col(target).cast("double")), _followed(2.0 / (span + 1)), "_before", numbered.count())
    past = F.col("_before")
    known = past.isNotNull() & past["last"].eqNullSafe(F.struct(*group)) & past["some"]
    return held.withColumn(f"ema_{span}m", F.when(known, past["decay"] * past["x"] + past["gain"])).drop("_row", "_before")


def growth(df: DataFrame, group: Sequence[str], target: str, lag: int = 12, cols: Columns = COLUMNS) -> DataFrame:
    """W4. (x - x[-12]) / (x[-12] + 1), 0 without a value twelve rows back."""
    before = F.lag(target, lag).over(series(group, cols))
    return df.withColumn("crime_growth", F.coalesce(F.try_divide(F.col(target) - before, before + 1), F.lit(0.0)))


def momentum(df: DataFrame, group: Sequence[str], value: str = "crime_growth", cols: Columns = COLUMNS) -> DataFrame:
    """W5. Mean of the last three growth values, the current one included."""
    return df.withColumn("momentum", F.avg(value).over(series(group, cols).rowsBetween(-2, 0)))


def acceleration(df: DataFrame, group: Sequence[str], value: str = "momentum", cols: Columns = COLUMNS) -> DataFrame:
    """W6. Change of momentum, 0 in the first row."""
    change = F.col(value) - F.lag(value).over(series(group, cols))
    return df.withColumn("acceleration", F.coalesce(change, F.lit(0.0)))


def growth_features(df: DataFrame, group: Sequence[str], target: str, cols: Columns = COLUMNS) -> DataFrame:
    return acceleration(momentum(growth(df, group, target, cols=cols), group, cols=cols), group, cols=cols)


def temporal_features(df: DataFrame, group: Sequence[str], target: str, cols: Columns = COLUMNS) -> DataFrame:
    """W1, W2, W3, F1, W4-W6; all but W3 in one chain over one window specification. W3 runs first, on the narrow panel."""
    name = f"ema_{SETTINGS.ema_span}m"
    df = rolling(lags(ema(df, group, target, cols=cols), group, target, cols=cols), group, target, cols=cols)
    df = df.select(*[c for c in df.columns if c != name], name)
    df = df.withColumns(seasonal_columns(df.columns, cols))
    return growth_features(df, group, target, cols)


# --- yearly series -----------------------------------------------------------


def _years(cols: Columns) -> WindowSpec:
    return Window.partitionBy(*cols.unit_keys).orderBy(cols.year)


def trend3(df: DataFrame, target: str, cols: Columns = COLUMNS) -> DataFrame:
    """W7. Mean of three years, the current one included."""
    return df.withColumn("trend_3y", F.avg(target).over(_years(cols).rowsBetween(-2, 0)))


def yoy_pct(df: DataFrame, target: str, cols: Columns = COLUMNS) -> DataFrame:
    """W8. Year-over-year change; 0 in the first year and for 0 after 0, NULL for growth from 0."""
    before, now = F.lag(target).over(_years(cols)), F.col(target)
    rate = F.when(before.isNull() | ((before == 0) & (now == 0)), F.lit(0.0)).otherwise(
        F.try_divide((now - before).cast("double"), before.cast("double")))
    return df.withColumn("growth_rate", rate)


def historical_growth(df: DataFrame, cols: Columns = COLUMNS) -> DataFrame:
    """W9. Mean of all earlier growth values, 0 when there are none."""
    w = _years(cols).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("historical_growth", F.coalesce(F.avg("growth_rate").over(w), F.lit(0.0)))


def expected_growth(df: DataFrame, cols: Columns = COLUMNS) -> DataFrame:
    """W10. The previous growth value, else the row's own."""
    return df.withColumn("expected_growth", F.coalesce(F.lag("growth_rate").over(_years(cols)), F.col("growth_rate")))


def yearly_features(df: DataFrame, target: str, cols: Columns = COLUMNS) -> DataFrame:
    """W7-W10 over one window specification."""
    return expected_growth(historical_growth(yoy_pct(trend3(df, target, cols), target, cols), cols), cols)
