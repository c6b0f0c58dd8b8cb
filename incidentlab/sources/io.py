"""Reading and writing incident tables, rankings, reports and GeoJSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..columns import COLUMNS, SETTINGS, Columns
from ..functions.geo import cell_boundary
from .profile import profile

# Names in model artifacts -> names in the serving schema.
PREDICTION_NAMES = {
    "District": "district", "Risk_Score": "risk_score", "Priority_Rank": "risk_rank", "Confidence": "confidence",
    "Predicted_Crime_Count": "predicted_crime_count",
}
HOTSPOT_NAMES = {"Risk_Score": "hotspot_score", "Hotspot_Rank": "rank", "h3_index": "h3_cell"}
GEOJSON_NAMES = {"h3_index": "h3_cell", "risk_score": "hotspot_score"}
CSV_SECTIONS = ("rankings", "top_districts", "categories")
# End of fixed values.


def read_incidents(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   csv_path: str | None = None) -> DataFrame:
    """S1. ``path`` as Parquet when it is there, else ``csv_path`` (same name with .csv) with a header."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    csv = csv_path or f"{path.removesuffix('.parquet')}.csv"
    try:
        return reader.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    try:
        return reader.option("header", True).csv(csv)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"neither {path} nor {csv} exists") from missing


def write_panel(df: DataFrame, path: str, cols: Columns = COLUMNS) -> None:
    """S3. Parquet, one directory per year, so that year filters prune files.

    Rows are spread by adaptive rebalancing on the year: a year with most of
    the rows is split over several files.
    """
    df.hint("rebalance", cols.year).write.mode("overwrite").partitionBy(cols.year).parquet(path)


def csv_ready(df: DataFrame) -> DataFrame:
    """S4. Booleans as 0/1, nested values as JSON text, everything else as it is."""
    def plain(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.BooleanType):
            return F.col(field.name).cast("int").alias(field.name)
        if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(field.name).alias(field.name)
        return F.col(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def write_ranked_csv(df: DataFrame, path: str, order: Sequence[Column | str]) -> None:
    """S4. Header CSV in ``order``: files in name order hold the ranking in order."""
    csv_ready(df).orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def section_lines(sections: Mapping[str, DataFrame]) -> DataFrame:
    """S5. (section, json) with one JSON object per row of each section."""
    out: DataFrame | None = None
    for name, df in sections.items():
        lines = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("json"))
        out = lines if out is None else out.unionByName(lines)
    if out is None:
        raise ValueError("no sections given")
    return out


def write_sections_json(sections: Mapping[str, DataFrame], path: str) -> None:
    """S5. One directory of JSON lines per section."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def to_features(df: DataFrame, cell: str = "cell", score: str = "risk_score", rank: str = "hotspot_rank",
                predicted: str = "predicted_count", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """S6. One GeoJSON Feature (as a struct) per row: the cell's ring, or its point when the id is unreadable."""
    have = set(df.columns)
    number = lambda c, t, d: F.coalesce(F.col(c).cast(t), F.lit(d).cast(t)) if c in have else F.lit(d).cast(t)
    point = F.array(F.array(number(lon, "double", 0.0), number(lat, "double", 0.0)))
    ring = F.coalesce(cell_boundary(cell), point)
    return df.select(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.struct(F.coalesce(cell, F.lit("")).alias("h3_index"), number(score, "double", 0.0).alias("risk_score"),
                 number(rank, "int", 0).alias("rank"),
                 number(predicted, "double", 0.0).alias("predicted_crime_count")).alias("properties"))


def to_geojson(df: DataFrame, **names: str) -> DataFrame:
    """S6. One Feature per row as JSON text (newline-delimited GeoJSON)."""
    features = to_features(df, **names)
    return features.select(F.to_json(F.struct("type", "geometry", "properties")).alias("feature"))


def feature_collection(df: DataFrame, top_n: int = SETTINGS.map_cells, rank: str = "hotspot_rank",
                       resolution: int = SETTINGS.cell_resolution, **names: str) -> DataFrame:
    """S6. One FeatureCollection document with its metadata.

    One document is one value, so it holds the first ``top_n`` cells;
    ``total_hotspots`` counts all of them. ``feature_collections`` and
    ``to_geojson`` write any number.
    """
    total = df.agg(F.count(F.lit(1)).cast("int")).scalar()
    features = to_features(df.orderBy(rank).limit(top_n), rank=rank, **names)
    return features.agg(_in_order().alias("_f")).select(_document(total, resolution))


def feature_collections(df: DataFrame, block: int = SETTINGS.map_cells, rank: str = "hotspot_rank",
                        resolution: int = SETTINGS.cell_resolution, **names: str) -> DataFrame:
    """S6. All cells, in one FeatureCollection document per block of ``block`` ranks.

    ``rank`` numbers the rows from 1 without ties, so a document has at most
    ``block`` features. Rows without a rank would share one document.
    ``total_hotspots`` counts the cells of all documents.
    """
    total = df.agg(F.count(F.lit(1)).cast("int")).scalar()
    features = to_features(df, rank=rank, **names)
    blocks = features.groupBy(F.floor((F.col("properties.rank") - 1) / block).alias("_block")).agg(_in_order().alias("_f"))
    return blocks.select(_document(total, resolution))


def _in_order() -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col("properties.rank").alias("k"), F.struct("type", "geometry", "properties").alias("f"))))


def _document(total: Column, resolution: int) -> Column:
    return F.to_json(F.struct(
        F.lit("FeatureCollection").alias("type"), F.transform("_f", lambda x: x["f"]).alias("features"),
        F.struct(F.lit(resolution).alias("resolution"), total.alias("total_hotspots")).alias("metadata"),
    )).alias("document")


FEATURE_SCHEMA = "type string, geometry string, properties map<string,string>"
GEOJSON_SCHEMA = "type string, features array<struct<type:string, geometry:string, properties:map<string,string>>>"


def read_geojson(spark: SparkSession, path: str, names: Mapping[str, str] | None = None,
                 lines: bool = False, multi_line: bool = True) -> DataFrame:
    """S7. One row per feature of the FeatureCollections at ``path``; property names renamed.

    A document without a feature list gives no rows. With ``lines`` each line
    holds one Feature (as :func:`to_geojson` writes them), which splits over
    tasks at any size. Without ``multi_line`` each line holds one document (as
    :func:`feature_collections` gives them). ``polygons`` is an array of polygons of rings of
    positions for every kind of geometry: a line or a point is one ring,
    and Multi* kinds keep all their parts. :func:`shape_rings` feeds it to the
    spatial operators.
    """
    renames = dict(GEOJSON_NAMES if names is None else names)
    if lines:
        features = spark.read.schema(FEATURE_SCHEMA).json(path).select(F.struct("type", "geometry", "properties").alias("f"))
    else:
        docs = spark.read.schema(GEOJSON_SCHEMA).option("multiLine", multi_line).json(path)
        features = docs.select(F.explode("features").alias("f"))
    return features.select(
        "f.type", F.get_json_object("f.geometry", "$.type").alias("geometry_type"),
        _polygons(F.get_json_object("f.geometry", "$.type"), F.get_json_object("f.geometry", "$.coordinates")).alias("polygons"),
        _renamed(F.coalesce(F.col("f.properties"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), renames)
        .alias("properties"))


def _polygons(kind: Column, coordinates: Column) -> Column:
    """Coordinates of any geometry kind as array<polygon<ring<position<double>>>>; an unknown kind gives NULL."""
    def parsed(depth: int) -> Column:
        return F.from_json(coordinates, "array<" * depth + "double" + ">" * depth)

    return (F.when(kind == "MultiPolygon", parsed(4)).when(kind.isin("Polygon", "MultiLineString"), F.array(parsed(3)))
            .when(kind.isin("LineString", "MultiPoint"), F.array(F.array(parsed(2)))).when(kind == "Point", F.array(F.array(F.array(parsed(1))))))


def shape_rings(features: DataFrame, name: str) -> DataFrame:
    """(name, rings) of features for the spatial operators; ``name`` is a property."""
    position = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    rings = F.transform(F.flatten("polygons"), lambda ring: F.transform(ring, position))
    return features.filter(F.col("polygons").isNotNull()).select(F.col("properties")[name].alias("name"), rings.alias("rings"))


def _renamed(properties: Column, names: Mapping[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform_keys(properties, lambda k, _: F.coalesce(F.try_element_at(pairs, k), k))


def normalize_columns(df: DataFrame, names: Mapping[str, str] = PREDICTION_NAMES) -> DataFrame:
    """S8. Known columns renamed, ``state`` added when missing, unreadable predicted counts to NULL."""
    df = df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})
    if "state" not in df.columns:
        df = df.withColumn("state", F.lit(None).cast("string"))
    if "predicted_crime_count" in df.columns:
        df = df.withColumn("predicted_crime_count", F.col("predicted_crime_count").try_cast("double"))
    return df


def json_map_rows(df: DataFrame, column: str, keys: Sequence[str] = (), value_type: str = "double") -> DataFrame:
    """S9. A JSON object column as rows (key, value), whatever its keys; unreadable text gives no rows."""
    parsed = F.from_json(F.col(column), f"map<string,{value_type}>")
    return df.select(*keys, F.explode(parsed).alias("key", "value"))


def month_rows(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """S9. ``{"1": 4767, ...}`` as (month, value); keys that are no numbers are left out."""
    return json_map_rows(df, column, keys).select(
        *keys, F.col("key").try_cast("int").alias("month"), "value").filter(F.col("month").isNotNull())


def category_rows(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """S9. ``{"name": {"count": n, "pct": p}, ...}`` as (name, count, pct)."""
    return json_map_rows(df, column, keys, "struct<count:bigint,pct:double>").select(
        *keys, F.col("key").alias("name"), F.coalesce("value.count", F.lit(0).cast("long")).alias("count"),
        F.coalesce("value.pct", F.lit(0.0)).alias("pct"))


def trend_rows(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """S9. ``{"unit": {"direction": ..., "change_pct": ...}, ...}`` as (unit, direction, change_pct)."""
    return json_map_rows(df, column, keys, "struct<direction:string,change_pct:double>").select(
        *keys, F.col("key").alias("unit"), "value.direction", "value.change_pct")


def influence_rows(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """S9. ``{"feature": {"correlation": r, "mean": m}, ...}`` as (feature, correlation, mean)."""
    return json_map_rows(df, column, keys, "struct<correlation:double,mean:double>").select(
        *keys, F.col("key").alias("feature"), "value.correlation", "value.mean")


def ranking_rows(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """S9. ``[{"rank": 1, "district": ..., "score": ...}, ...]`` as (rank, district, score)."""
    parsed = F.from_json(F.col(column), "array<struct<rank:int,district:string,score:double>>")
    return df.select(*keys, F.inline(parsed))


def export(payload: Mapping[str, DataFrame], fmt: str, path: str) -> None:
    """S11. A report payload as csv, json or geojson.

    CSV takes the first list-like section, else the first section there is.
    """
    if fmt == "csv":
        name = next((n for n in CSV_SECTIONS if n in payload), next(iter(payload)))
        csv_ready(payload[name]).write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        write_sections_json(payload, path)
    elif fmt == "geojson":
        spark = next(iter(payload.values())).sparkSession
        features = payload.get("geojson")
        if features is None:
            features = spark.range(0).select(F.lit("").alias("feature"))
        features.write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """S13. A column dictionary (Column, Data_Source_Type, Description), composite names ``A/B/C`` split."""
    schema = "Column string, Data_Source_Type string, Description string"
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.select(F.explode(F.split("Column", r"\s*/\s*")).alias("column"), "Data_Source_Type", "Description")


def undocumented(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """S13. Profiled columns the dictionary does not name."""
    return profile(df).join(dictionary.select("column"), "column", "left_anti")


def artifact_freshness(artifacts: Mapping[str, tuple[DataFrame, str]], as_of: Column,
                       limit_seconds: int = SETTINGS.refresh_seconds) -> DataFrame:
    """S14. Per dataset: loaded, rows, age of its newest row, stale when older than the limit.

    ``artifacts`` maps a name to a frame and its load-time column; a dataset
    without rows is not loaded and counts as stale.
    """
    out: DataFrame | None = None
    for name, (df, loaded_at) in artifacts.items():
        age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.max(loaded_at).cast("timestamp"))
        row = df.agg(F.lit(name).alias("artifact"), (F.count(F.lit(1)) > 0).alias("loaded"),
                     F.count(F.lit(1)).alias("rows"), age.alias("age_seconds"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no artifacts given")
    return out.withColumn("stale", F.coalesce(F.col("age_seconds") > limit_seconds, F.lit(True)))
