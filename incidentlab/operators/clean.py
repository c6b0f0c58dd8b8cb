"""Cleaning, projection, filters and predicates on incident rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import COLUMNS, SETTINGS, Columns
from ..sources.profile import is_numeric, null_shares, value_counts
from .scale import exact_medians

# Identifiers and labels that are never model features.
NOT_FEATURES = (
    "Incident_ID", "Crime_Count_District", "District", "State", "Incident_Date", "h3_index", "Sample_Weight",
    "Official_Unit_Year_Total", "Data_Source", "Aggregate_Basis", "Coordinate_Type", "Police_Station_ID",
    "Administrative_Code", "Sub_Category", "Complaint_Channel", "Victim_Age_Group", "Victim_Gender", "Time_of_Day",
    "Day_of_Week", "Crime_Category",
)
UNKNOWN = "Unknown"
# End of fixed values.


def with_calendar(df: DataFrame, cols: Columns = COLUMNS) -> DataFrame:
    """C1. Parse the date (unreadable text becomes NULL); add year, month, quarter and ISO week where missing."""
    if cols.date not in df.columns:
        return df
    if isinstance(df.schema[cols.date].dataType, T.StringType):
        df = df.withColumn(cols.date, F.try_to_timestamp(cols.date))
    d = F.col(cols.date)
    parts = {cols.year: F.year(d), cols.month: F.month(d), cols.quarter: F.quarter(d), cols.week: F.weekofyear(d)}
    return df.withColumns({name: c for name, c in parts.items() if name not in df.columns})


def drop_sparse(df: DataFrame, share: float = 0.5) -> DataFrame:
    """C2. Without the columns whose null share is above ``share``; one aggregate decides."""
    return df.drop(*[c for c, s in null_shares(df).items() if s > share])


def _fill_medians(df: DataFrame, gaps: Sequence[str], counts: Mapping[str, int]) -> DataFrame:
    medians = exact_medians(df, gaps, sizes=counts)
    fills = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c]))) for c in gaps if medians[c] is not None}
    return df.withColumns(fills) if fills else df


def _of_kind(df: DataFrame, fits: Callable[[T.DataType], bool]) -> list[str]:
    return [f.name for f in df.schema.fields if fits(f.dataType)]


def _is_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def impute_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """C3. Exact median of the non-null values into numeric columns that have gaps."""
    wanted = list(columns) if columns is not None else _of_kind(df, is_numeric)
    if not wanted:
        return df
    rows, counts = value_counts(df.select(*wanted))
    return _fill_medians(df, [c for c in wanted if counts[c] < rows], counts)


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """C4, statistics: (column, value) with the smallest of the most frequent values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                for c in columns]))
    counts = (
        df.select(pairs.alias("p")).select("p.*").filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))


def _fill_modes(df: DataFrame, gaps: Sequence[str]) -> DataFrame:
    if not gaps:
        return df
    found = {r["column"]: r["value"] for r in modes(df, gaps).collect()}  # one row per column
    return df.fillna({c: found.get(c, UNKNOWN) for c in gaps})


def impute_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """C4. The mode into text columns that have gaps, 'Unknown' where a column has no value at all."""
    wanted = list(columns) if columns is not None else _of_kind(df, _is_text)
    if not wanted:
        return df
    rows, counts = value_counts(df.select(*wanted))
    return _fill_modes(df, [c for c in wanted if counts[c] < rows])


def fill_bool_false(df: DataFrame) -> DataFrame:
    """C5. False into every boolean column."""
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    return df.fillna(False, subset=flags) if flags else df


def handle_missing(df: DataFrame, share: float = 0.5) -> DataFrame:
    """C2-C5 in order. One aggregate finds the gaps for all of them; columns without gaps are not read again."""
    rows, counts = value_counts(df)
    df = df.drop(*[c for c, n in counts.items() if rows and (rows - n) / rows > share])
    gaps = {c for c in df.columns if counts[c] < rows}
    df = _fill_medians(df, [c for c in _of_kind(df, is_numeric) if c in gaps], counts)
    return fill_bool_false(_fill_modes(df, [c for c in _of_kind(df, _is_text) if c in gaps]))


def valid_coordinates(df: DataFrame, cols: Columns = COLUMNS) -> DataFrame:
    """C6. Rows whose coordinates are both present and both non-zero."""
    lat, lon = F.col(cols.lat), F.col(cols.lon)
    return df.filter(lat.isNotNull() & lon.isNotNull() & (lat != 0) & (lon != 0))


def with_split(df: DataFrame, train: Sequence[int] = SETTINGS.train_years, val: Sequence[int] = SETTINGS.val_years,
               test: Sequence[int] = SETTINGS.test_years, cols: Columns = COLUMNS) -> DataFrame:
    """C7. A ``split`` label from the year; rows of no split get NULL."""
    y = F.col(cols.year)
    label = F.when(y.isin(*train), "train").when(y.isin(*val), "val").when(y.isin(*test), "test")
    return df.withColumn("split", label)


def temporal_split(df: DataFrame, cols: Columns = COLUMNS, **years: Sequence[int]) -> dict[str, DataFrame]:
    """C7. The three parts as filters on the year; nothing is shuffled."""
    labelled = with_split(df, cols=cols, **years)
    return {part: labelled.filter(F.col("split") == part).drop("split") for part in ("train", "val", "test")}


def combine_splits(parts: Mapping[str, DataFrame]) -> DataFrame:
    """U1. The parts in order as one frame with a ``split`` label."""
    out: DataFrame | None = None
    for name, part in parts.items():
        labelled = part.withColumn("split", F.lit(name))
        out = labelled if out is None else out.unionByName(labelled)
    if out is None:
        raise ValueError("no parts given")
    return out


def search(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """C10. Case-insensitive substring in any of the columns; NULL counts as empty."""
    wanted = F.lit(text.lower())
    hit: Column = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), wanted)
    return df.filter(hit)


def lookup(df: DataFrame, column: str, value: str, order: Sequence[str]) -> DataFrame:
    """C11. The first row (in ``order``) whose text equals ``value`` in any case."""
    return df.filter(F.lower(F.col(column)) == value.lower()).orderBy(*order).limit(1)


def filter_rankings(df: DataFrame, state: str | None = None, district: str | None = None,
                    min_risk: float | None = None, max_risk: float | None = None, year: int | None = None,
                    cols: Columns = COLUMNS, score: str = "risk_score") -> DataFrame:
    """C12. Ranking rows by any of the given limits."""
    tests = [
        None if state is None else F.col(cols.state) == state,
        None if district is None else F.col(cols.unit) == district,
        None if min_risk is None else F.col(score) >= min_risk,
        None if max_risk is None else F.col(score) <= max_risk,
        None if year is None else F.col(cols.year) == year,
    ]
    for test in tests:
        df = df if test is None else df.filter(test)
    return df


def filter_hotspots(df: DataFrame, min_score: float | None = None,
                    bbox: tuple[float, float, float, float] | None = None, score: str = "risk_score",
                    lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """C12. Cells by score and by [min_lon, min_lat, max_lon, max_lat]."""
    if min_score is not None:
        df = df.filter(F.col(score) >= min_score)
    if bbox is not None:
        df = df.filter(F.col(lon).between(bbox[0], bbox[2]) & F.col(lat).between(bbox[1], bbox[3]))
    return df


def feature_columns(df: DataFrame, exclude: Sequence[str] = (), max_null_share: float = 0.5) -> list[str]:
    """C13. Numeric columns that are no identifiers and less than half null."""
    names = [f.name for f in df.schema.fields
             if is_numeric(f.dataType) and f.name not in NOT_FEATURES and f.name not in exclude]
    if not names:
        return []
    shares = null_shares(df.select(*names))
    return [c for c in names if shares[c] < max_null_share]


def fill_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """C14. NULL to 0 in the feature columns, as doubles."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


def first_available(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """C16, table form: the primary rows, or the fallback's when there are none."""
    return primary.unionByName(fallback.filter(~primary.exists()))


def update_allowed(df: DataFrame, changes: DataFrame, key: str, allowed: Sequence[str],
                   domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """C21. New values for the allowed columns only; a value outside its domain is ignored.

    ``changes`` has at most one row per key.
    """
    picked = [c for c in changes.columns if c in allowed]
    new = changes.select(key, *[
        (F.when(F.col(c).isin(*domains[c]), F.col(c)) if c in domains else F.col(c)).alias(f"_new_{c}") for c in picked])
    joined = df.join(new, key, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in picked}).select(*df.columns)
