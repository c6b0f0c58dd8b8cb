"""Splitting totals, projecting them, and drawing capped samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import SETTINGS
from ..functions.scalar import clamp
from .scale import top_k_per_group

# Fixed values.
SHARE_WEIGHTS = {"population": 0.55, "density": 0.20, "commercial": 0.15, "capital": 0.10}
GROWTH_PER_YEAR_LIMITS = (-0.15, 0.35)
# End of fixed values.


def apportion(df: DataFrame, group: Sequence[str], key: str, total: str, share: str,
              name: str = "allocated") -> DataFrame:
    """W19. Whole numbers per member that add up to the group total.

    Each member gets its rounded product; the last in descending share (then
    key) takes what the others leave. Per group only the sum and the last
    member are worked out, as a partial aggregate, so a group may be any size.
    ``key`` is unique in its group.
    """
    own = df.withColumn("_own", F.round(F.col(total) * F.col(share)).cast("long"))
    last = F.max_by(F.struct(F.col(key).alias("key"), F.col("_own").alias("own")), F.struct(-F.col(share), F.col(key)))
    per_group = own.groupBy(*group).agg(F.sum("_own").alias("_sum"), last.alias("_last"))
    rest = F.col(total).cast("long") - (F.col("_sum") - F.col("_last.own"))
    return (
        own.join(per_group, list(group))
        .withColumn(name, F.when(F.col(key) == F.col("_last.key"), rest).otherwise(F.col("_own")))
        .drop("_own", "_sum", "_last")
    )


def share_score(df: DataFrame, parent: Sequence[str], weights: Mapping[str, float] = SHARE_WEIGHTS,
                name: str = "share") -> DataFrame:
    """W20. Weighted sum of each column's share within the parent, normalised to 1.

    ``df`` has one row per member and a column per weight. Parent totals are
    joined back, so a parent may have any number of members. A column whose
    parent total is 0 adds nothing, to the score or to the sum of scores.
    """
    totals = df.groupBy(*parent).agg(*[F.sum(F.col(c).cast("double")).alias(f"_t_{c}") for c in weights])
    part = lambda c: F.coalesce(
        F.try_divide(F.col(c).cast("double"), F.nullif(F.col(f"_t_{c}"), F.lit(0.0))), F.lit(0.0))
    terms = [F.lit(weight) * part(c) for c, weight in weights.items()]
    filled = [F.when(F.coalesce(F.col(f"_t_{c}"), F.lit(0.0)) != 0, F.lit(w)).otherwise(F.lit(0.0)) for c, w in weights.items()]
    score, whole = terms[0], filled[0]
    for term, fill in zip(terms[1:], filled[1:]):
        score, whole = score + term, whole + fill
    # the shares of a column add up to 1 within its parent, so the scores add up to the weights in use
    return (
        df.join(totals, list(parent))
        .withColumn(name, F.try_divide(score, F.nullif(whole, F.lit(0.0))))
        .drop(*[f"_t_{c}" for c in weights])
    )


def project_total(df: DataFrame, keys: Sequence[str], year: str, value: str, years: Sequence[int],
                  limits: tuple[float, float] = GROWTH_PER_YEAR_LIMITS) -> DataFrame:
    """W21. Value of each key in each asked year: known, else compounded from the last known year.

    The yearly rate runs from the first to the last known year and is cut to
    ``limits``; without a positive base the last value is carried. Rows without
    a year are left out; of several values of one year the largest counts.
    """
    known = df.filter(F.col(year).isNotNull()).groupBy(*keys).agg(
        F.collect_list(F.struct(F.col(year).cast("int").alias("y"), F.col(value).cast("double").alias("v"))).alias("_known"),
        F.min(year).alias("_y0"), F.max(year).alias("_y1"),
        F.max_by(F.col(value).cast("double"), F.struct(-F.col(year), value)).alias("_v0"),
        F.max_by(F.col(value).cast("double"), F.struct(year, value)).alias("_v1"),
    )
    asked = known.withColumn(year, F.explode(F.array(*[F.lit(int(y)) for y in years])))
    span = F.col("_y1") - F.col("_y0")
    usable = (F.col("_v0") > 0) & (F.col("_v1") != 0) & (span > 0)
    rate = clamp(F.pow(F.when(usable, F.col("_v1") / F.col("_v0")), F.when(usable, F.lit(1.0) / span)) - 1, *limits)
    grown = F.greatest(F.lit(0.0), F.round(F.col("_v1") * F.pow(1 + rate, F.col(year) - F.col("_y1"))))
    then = F.array_max(F.transform(F.filter("_known", lambda k: k["y"] == F.col(year)), lambda k: k["v"]))
    value_then = F.coalesce(then, F.when(usable, grown), F.col("_v1"), F.lit(0.0))
    return asked.select(*keys, year, value_then.alias(value))


def capped_sample(df: DataFrame, keys: Sequence[str], id_col: str, cap: int = SETTINGS.unit_year_cap, seed: str = "42",
                  total: str | None = None, name: str = "sample_weight") -> DataFrame:
    """W22. At most ``cap`` rows per group in hash order, weighted back to the group total.

    The total is the row count, or ``total`` (equal in all rows of a group).
    """
    all_rows = F.count(F.lit(1)) if total is None else F.max(total)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), all_rows.alias("_total"))
    order = [F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string"))), F.col(id_col)]
    kept = top_k_per_group(df, keys, order, cap, "_rank", id_col)
    weight = F.round(F.col("_total") / F.least(F.lit(cap), F.col("_rows")), 4)
    return kept.join(sizes, list(keys)).withColumn(name, weight).drop("_rank", "_rows", "_total")


def category_mix(df: DataFrame, years: Sequence[int], unit: str = "unit", category: str = "category",
                 first_year: int = SETTINGS.category_first_year) -> DataFrame:
    """W23. Share of each category per unit and year.

    ``df`` has (unit, category, base, growth, intro_year, boost): the base
    grows per year, is 0 before its first year, is boosted, then normalised.
    """
    asked = df.withColumn("year", F.explode(F.array(*[F.lit(int(y)) for y in years])))
    raw = F.when(F.col("year") < F.col("intro_year"), F.lit(0.0)).otherwise(
        F.col("base") * F.pow(1 + F.col("growth"), F.col("year") - F.lit(first_year)))
    weighted = asked.withColumn("_w", raw * F.coalesce(F.col("boost"), F.lit(1.0)))
    total = F.sum("_w").over(Window.partitionBy(unit, "year"))
    return weighted.select(unit, "year", category, F.coalesce(F.try_divide(F.col("_w"), total), F.lit(0.0)).alias("share"))
