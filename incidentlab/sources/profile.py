"""Column profile of a table, from one aggregate pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_numeric(kind: T.DataType) -> bool:
    """Numbers only; booleans are not numbers here."""
    return isinstance(kind, T.NumericType)


def kind_of(kind: T.DataType) -> str:
    if is_numeric(kind):
        return "numeric"
    if isinstance(kind, T.BooleanType):
        return "bool"
    return "categorical" if isinstance(kind, T.StringType) else "other"


def value_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and non-null values per column, from one aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"n_{i}") for i, c in enumerate(df.columns)]).first()
    return row["_rows"], {c: row[f"n_{i}"] for i, c in enumerate(df.columns)}


def null_shares(df: DataFrame) -> dict[str, float]:
    """Null share per column (0 for an empty table)."""
    rows, counts = value_counts(df)
    return {c: (rows - n) / (rows or 1) for c, n in counts.items()}


def profile(df: DataFrame) -> DataFrame:
    """S2. One row per column: type, kind, null count and null percentage (two decimals)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(types[c].simpleString()).alias("dtype"),
                 F.lit(kind_of(types[c])).alias("kind"), (F.col("_rows") - F.col(f"_{i}")).alias("null_count"),
                 F.col("_rows").alias("_n"))
        for i, c in enumerate(df.columns)])
    pct = F.coalesce(F.round(F.try_divide(F.col("null_count") * 100.0, F.col("_n").cast("double")), 2), F.lit(0.0))
    return counts.select(F.inline(rows)).withColumn("null_pct", pct).drop("_n")


def top_missing(df: DataFrame, n: int = 15) -> DataFrame:
    """S2. The ``n`` columns with most nulls, those without nulls left out."""
    return profile(df).filter(F.col("null_count") > 0).orderBy(F.col("null_count").desc(), "column").limit(n)
