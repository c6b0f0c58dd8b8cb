"""Panels: one row per group and period, the grain of most other operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import COLUMNS, Columns

# Columns averaged into the unit-month panel when the input has them, in any case.
PANEL_MEANS = ("risk_index", "crime_rate_100k", "is_night", "is_weekend", "is_festival_month", "is_office_hour")
# End of fixed values.


def quarter_of(month: str | Column) -> Column:
    m = F.col(month) if isinstance(month, str) else month
    return ((m - 1) / 3).cast("int") + 1


def unit_month_panel(df: DataFrame, cols: Columns = COLUMNS, extra_means: Sequence[str] = (),
                     digits: int = 2) -> DataFrame:
    """A1. Sum of target and weight, means of place and flags per (unit, state, year, month).

    Sums of money are rounded to ``digits`` so that the panel does not depend
    on the order in which partial sums meet.
    """
    have = set(df.columns)
    wanted = {cols.lat.lower(), cols.lon.lower(), *PANEL_MEANS, *(c.lower() for c in extra_means)}
    means = [c for c in df.columns if c.lower() in wanted]
    sums = [F.round(F.sum(cols.target), digits).alias(cols.target)] if cols.target in have else []
    if cols.weight in have:
        sums.append(F.sum(cols.weight).alias(cols.weight))
    averages = [F.avg(F.col(c).cast("double")).alias(c) for c in means]
    return (
        df.groupBy(cols.unit, cols.state, *cols.time).agg(*sums, *averages)
        .withColumn(cols.quarter, quarter_of(cols.month))
    )


def cell_month_panel(df: DataFrame, cols: Columns = COLUMNS, name: str = "crime_count") -> DataFrame:
    """A2. Sum of target and mean place per (cell, year, month); rows without a cell are left out."""
    return (
        df.filter(F.col(cols.cell).isNotNull()).groupBy(cols.cell, *cols.time)
        .agg(F.round(F.sum(cols.target), 2).alias(name), F.avg(cols.lat).alias("latitude"),
             F.avg(cols.lon).alias("longitude"))
    )


def unit_year_table(df: DataFrame, values: Sequence[str], cols: Columns = COLUMNS) -> DataFrame:
    """A21. The first row (smallest id) per (state, unit, year), as a partial aggregate."""
    picked = F.min_by(F.struct(*values), F.col(cols.id))
    return df.groupBy(*cols.unit_year_keys).agg(picked.alias("_v")).select(*cols.unit_year_keys, "_v.*")
