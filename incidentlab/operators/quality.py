"""Data-quality checks; all checks on one table run in a single aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import COLUMNS, Columns
from ..functions.scalar import col
from ..sources.profile import profile


@dataclass(frozen=True)
class Check:
    """A name, a pass/fail aggregate and a detail-text aggregate."""

    name: str
    passed: Column
    detail: Column


def _count(column: Column) -> Column:
    return F.count_if(F.coalesce(column, F.lit(False)))


def _no_bad(name: str, bad: Column) -> Check:
    n = _count(bad)
    return Check(name, n == 0, F.concat(n.cast("string"), F.lit(" bad rows")))


def unique(column: str) -> Check:
    """V1. No value twice (nulls count as one value)."""
    extra = F.count(F.lit(1)) - F.countDistinct(column) - F.least(F.count_if(F.col(column).isNull()), F.lit(1))
    return Check(f"{column} unique", extra == 0, F.concat(extra.cast("string"), F.lit(" duplicates")))


def within(column: str, low: float, high: float) -> Check:
    """V2, V5. Every row has a value in [low, high]."""
    return _no_bad(f"{column} in range", ~F.coalesce(F.col(column).between(low, high), F.lit(False)))


def not_after(column: str, day: str) -> Check:
    """V3. Every row has a date up to ``day``."""
    return _no_bad(f"{column} not after {day}", ~F.coalesce(F.col(column) <= F.lit(day).cast("date"), F.lit(False)))


def non_negative(column: str) -> Check:
    """V4. No value below zero where present."""
    return _no_bad(f"{column} not negative", F.col(column) < 0)


def positive(column: str) -> Check:
    """V4. Above zero where present."""
    return _no_bad(f"{column} positive", F.col(column) <= 0)


def not_null(column: str) -> Check:
    """V6."""
    return _no_bad(f"{column} present", F.col(column).isNull())


def not_blank(column: str) -> Check:
    """V6. Text of at least one character."""
    return _no_bad(f"{column} not blank", F.length(F.coalesce(F.col(column), F.lit(""))) == 0)


def in_set(column: str, allowed: Sequence[str]) -> Check:
    """V7."""
    return _no_bad(f"{column} in set", ~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def skew(column: Column | str) -> Column:
    """V10. Bias-corrected sample skewness; NULL below three values or without spread."""
    c = col(column)
    n = F.count(c).cast("double")
    spread = F.coalesce(F.var_pop(c), F.lit(0.0)) > 0
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when((n > 2) & spread, F.skewness(c) * factor)


def long_tailed(column: str, above: float = 1.0) -> Check:
    """V10."""
    s = skew(column)
    return Check(f"{column} long-tailed", F.coalesce(s > above, F.lit(False)), F.concat(F.lit("skew="), F.round(s, 4).cast("string")))


def filled(column: str, share: float = 0.9, where: Column | None = None, label: str = "") -> Check:
    """V11. Share of non-null values above ``share``, on a subset if given."""
    inside = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    rate = F.avg(F.when(inside, F.col(column).isNotNull().cast("double")))
    return Check(f"{column} filled{label}", F.coalesce(rate > share, F.lit(False)),
                 F.concat(F.lit("rate="), F.round(rate, 4).cast("string")))


def cluster_domain(column: str, focus: Column, k: int = 8) -> Check:
    """V12. 0..k-1 in the focus rows, -1 elsewhere."""
    good = F.when(focus, F.col(column).between(0, k - 1)).otherwise(F.col(column) == -1)
    return _no_bad(f"{column} domain", ~F.coalesce(good, F.lit(False)))


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(check, passed, detail) per check, from one pass over ``df``."""
    aggregates = [c for i, k in enumerate(checks) for c in (k.passed.alias(f"p{i}"), k.detail.alias(f"d{i}"))]
    rows = [F.struct(F.lit(k.name).alias("check"), F.col(f"p{i}").alias("passed"), F.col(f"d{i}").alias("detail"))
            for i, k in enumerate(checks)]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def weights_reconcile(df: DataFrame, keys: Sequence[str], weight: str, total: str, limit: float = 1.0) -> DataFrame:
    """V8. Weights of a group add up to its total; reports the greatest difference."""
    groups = df.groupBy(*keys).agg(F.abs(F.sum(weight) - F.max(total)).alias("_d"))
    worst = F.round(F.max("_d"), 4)
    return groups.agg(
        F.lit("weights reconcile").alias("check"), (F.count_if(F.col("_d") >= limit) == 0).alias("passed"),
        F.concat(F.format_string("max diff=%.4f", worst), F.lit(" across "), F.count(F.lit(1)).cast("string"),
                 F.lit(" groups")).alias("detail"))


def class_imbalance(df: DataFrame, cols: Columns = COLUMNS, above: float = 0.15) -> DataFrame:
    """V9. The largest category holds more than ``above`` of the rows."""
    counts = df.filter(F.col(cols.category).isNotNull()).groupBy(cols.category).agg(F.count(F.lit(1)).alias("n"))
    share = F.max("n") / F.sum("n")
    return counts.agg(F.lit("class imbalance").alias("check"), F.coalesce(share > above, F.lit(False)).alias("passed"),
                      F.concat(F.lit("share="), F.round(share, 4).cast("string")).alias("detail"))


def some_missing(df: DataFrame) -> DataFrame:
    """V13. At least one value is missing somewhere."""
    n = F.sum("null_count")
    return profile(df).agg(F.lit("missing values present").alias("check"), (n > 0).alias("passed"),
                           F.concat(n.cast("string"), F.lit(" missing")).alias("detail"))


def breakdown(df: DataFrame, label: str) -> DataFrame:
    """V15. Rows per value of a label column."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def focus_listing(unit_year: DataFrame, focus: Column, value: str, count: str, cols: Columns = COLUMNS) -> DataFrame:
    """V15. The focus unit-years by value, greatest first."""
    return unit_year.filter(focus).select(cols.unit, cols.year, F.round(value, 3).alias(value), count).orderBy(
        F.col(value).desc(), cols.unit)
