"""Feature importance and additive per-row contributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import rounded
from .clean import first_available
from .models import PREDICTION
from .scale import with_stats


def _with_share(df: DataFrame, value: str) -> DataFrame:
    """Percentage of the column total; one row per feature comes in."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn("importance_pct", rounded(F.try_divide(F.col(value) * 100, F.nullif(total, F.lit(0.0))), 2))


def gain_importance(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """M8. Importance of each feature in the boosted model, share of the total, descending."""
    gains = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(gain)) for name, gain in zip(features, gains)]
    df = spark.createDataFrame(rows, "feature string, importance_gain double")
    return _with_share(df, "importance_gain").orderBy(F.col("importance_gain").desc(), "feature")


def global_attribution(attributions: DataFrame) -> DataFrame:
    """M9. Mean absolute contribution per feature, share of the sum, descending."""
    means = attributions.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    return _with_share(means, "mean_abs").orderBy(F.col("mean_abs").desc(), "feature")


def linear_attribution_rows(df: DataFrame, key: str, weights: Mapping[str, float], intercept: float = 0.0) -> DataFrame:
    """M10 (a). Exact contributions of a linear model: phi = w * (x - mean x).

    One row per input row: (key, entries), an array of (feature, value, phi,
    base); base plus a row's phi is its prediction.
    """
    df = with_stats(df, "_means", df.agg(*[F.avg(c).alias(c) for c in weights]))
    means = F.col("_means")
    base = F.lit(float(intercept))
    for c, w in weights.items():
        base = base + F.lit(float(w)) * means[c]
    entries = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                        (F.lit(float(w)) * (F.col(c) - means[c])).alias("phi"), base.alias("base"))
               for c, w in weights.items()]
    return df.select(key, F.array(*entries).alias("entries"))


def linear_attributions(df: DataFrame, key: str, weights: Mapping[str, float], intercept: float = 0.0) -> DataFrame:
    """M10 (a), long form: one row per (key, feature)."""
    return linear_attribution_rows(df, key, weights, intercept).select(key, F.inline("entries"))


def gathered(attributions: DataFrame, key: str) -> DataFrame:
    """Long attributions as one row per key; an array holds one entry per feature."""
    entry = F.struct(*[c for c in attributions.columns if c != key])
    return attributions.groupBy(key).agg(F.collect_list(entry).alias("entries"))


def sampled_attributions(df: DataFrame, background: DataFrame, model: PipelineModel, features: Sequence[str], key: str,
                         permutations: int = 8) -> DataFrame:
    """M10 (b). Permutation-sampled Shapley values (Strumbelj & Kononenko 2014) of any model.

    For each row and permutation a background row turns into the explained row
    one feature at a time; a feature's contribution is the mean change of the
    prediction when it switches. All rows x permutations x (features + 1)
    inputs are one exploded frame scored by the model; contributions are a
    grouped mean. ``background`` is a bounded sample (see background_sample): each
    row meets ``permutations`` of it, evenly spread from a hashed start, so that
    all of it is in use over the rows.
    The orders depend on a hash of row, permutation and feature only.
    """
    d = len(features)
    as_array = lambda: F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    pool = background.agg(F.collect_list(as_array())).scalar()
    order = F.transform(
        F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(d)),
                                 lambda i: F.struct(F.xxhash64(F.col("_key"), F.col("_perm"), i).alias("h"), i.alias("i")))),
        lambda s: s["i"])
    own, other = F.col("_x"), F.col("_z")
    # input after the first k switches: feature i is the row's own if it is among the first k of the order
    mixed = F.transform(
        F.sequence(F.lit(1), F.lit(d)),
        lambda i: F.when(F.array_position(F.col("_order"), i) <= F.col("_k"), F.element_at(own, i.cast("int")))
        .otherwise(F.element_at(other, i.cast("int"))))
    inputs = (
        # the slim rows are dealt by their key before they multiply: the sums below then need no exchange
        df.select(F.col(key).cast("string").alias("_key"), as_array().alias("_x")).repartition("_key")
        .withColumn("_perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
        .withColumn("_z", F.element_at(pool, (F.pmod(
            F.xxhash64("_key") + F.floor(F.col("_perm") * F.size(pool) / permutations).cast("long"), F.size(pool)) + 1).cast("int")))
        .withColumn("_order", order)
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(d))))
        .withColumn("_in", mixed)
        .select("_key", "_order", "_k", *[F.element_at("_in", i + 1).alias(c) for i, c in enumerate(features)])
    )
    scored = model.transform(inputs).select("_key", "_order", "_k", PREDICTION)
    f = F.col(PREDICTION)
    gain = F.struct(F.try_element_at("_order", F.nullif("_k", F.lit(0))).alias("i"), f.alias("d"))
    loss = F.struct(F.try_element_at("_order", F.col("_k") + 1).alias("i"), (-f).alias("d"))
    names = F.array(*map(F.lit, features))
    return (
        scored.select("_key", F.inline(F.array(gain, loss))).filter(F.col("i").isNotNull())
        .groupBy(F.col("_key").alias(key), F.element_at(names, F.col("i").cast("int")).alias("feature"))
        .agg((F.sum("d") / permutations).alias("phi"))
    )


def local_drivers(rows: DataFrame, key: str, n: int = 5) -> DataFrame:
    """M11. The ``n`` strongest positive and negative features of each row, four decimals.

    ``rows`` has (key, entries); the entries are sorted inside their row, so
    nothing is shuffled.
    """
    by_size = F.array_sort(F.transform("entries", lambda e: F.struct(
        (-F.abs(e["phi"])).alias("size"), e["feature"].alias("feature"), e["phi"].alias("phi"), e["value"].alias("value"))))

    def strongest(side: str, positive: bool) -> Column:
        kept = F.slice(F.filter("_sorted", lambda e: e["phi"] > 0 if positive else e["phi"] < 0), 1, n)
        return F.transform(kept, lambda e, i: F.struct(
            F.lit(side).alias("side"), (i + 1).alias("position"), e["feature"].alias("feature"),
            rounded(e["phi"], 4).alias("phi"), rounded(e["value"], 4).alias("value")))

    return rows.select(key, by_size.alias("_sorted")).select(
        key, F.inline(F.concat(strongest("positive", True), strongest("negative", False))))


def unit_drivers(attributions: DataFrame, unit: str, name: str, overall: DataFrame, n: int = 10) -> DataFrame:
    """M12. Features of one unit by absolute value with direction; the overall ranking when it has none."""
    own = attributions.filter(F.lower(F.col(unit)) == name.lower()).select(
        "feature", F.abs("phi").alias("importance"),
        F.when(F.col("phi") > 0, "positive").otherwise("negative").alias("direction"))
    general = overall.select("feature", F.col("mean_abs").alias("importance"), F.lit(None).cast("string").alias("direction"))
    return first_available(own, general).orderBy(F.col("importance").desc(), "feature").limit(n)
