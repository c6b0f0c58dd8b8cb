"""Streaming operators: the same functions serve batch frames and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import SETTINGS
from ..functions.scalar import client_ip
from ..operators.access import classify_requests
from ..operators.scale import global_row_number
from ..session import new_table_dir

# Fixed values.
UNLIMITED_PATHS = ("/health", "/", "/docs", "/redoc", "/openapi.json")
LIMIT_WINDOW_SECONDS = 60
CHANNELS = ("risk_update", "hotspot_update", "report_complete")
# End of fixed values.


def read_files_in_turn(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a folder of Parquet files as a stream, one file a micro-batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of one table as a stream, schema taken from the table.

    A table may be a folder of part files or a single file; a missing one
    raises. One row tells which: its file lies inside the folder or is the table.
    """
    path = f"{folder.rstrip('/')}/{name}.parquet"
    table = spark.read.parquet(path)
    row = table.select(F.col("_metadata.file_path").alias("file")).first()
    source = spark.readStream.schema(table.schema)
    if row is None or f"/{name}.parquet/" in row.file:
        return source.parquet(path)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def caller(user: str = "user_id", forwarded: str = "forwarded", host: str = "host") -> Column:
    """R1. ``user:<id>`` for a known user, else ``ip:<address>``."""
    return F.when(F.col(user).isNotNull(), F.concat(F.lit("user:"), F.col(user).cast("string"))).otherwise(
        F.concat(F.lit("ip:"), client_ip(forwarded, host)))


def _bounded(df: DataFrame, ts: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late) if df.isStreaming else df


def request_counts(requests: DataFrame, limit: int = SETTINGS.requests_per_minute, seconds: int = LIMIT_WINDOW_SECONDS,
                   ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """R1. Requests per caller and aligned window, with what remains of the limit."""
    counted = (
        _bounded(requests.filter(~F.col("path").isin(*UNLIMITED_PATHS)), ts, late)
        .groupBy(F.window(ts, f"{seconds} seconds"), caller().alias("identifier"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(F.col("window.start").alias("window_start"), "identifier", "n",
                          F.greatest(F.lit(0), F.lit(limit) - F.col("n")).alias("remaining"))


def over_limit(requests: DataFrame, limit: int = SETTINGS.requests_per_minute, seconds: int = LIMIT_WINDOW_SECONDS,
               ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """R1. Callers and windows beyond the limit."""
    return request_counts(requests, limit, seconds, ts, late).filter(F.col("n") > limit)


def live_metrics(events: DataFrame, seconds: int, by: Sequence[str], value: str, ts: str = "ts",
                 late: str = "10 minutes") -> DataFrame:
    """R2. Count and sum per tumbling window and label."""
    return (
        _bounded(events, ts, late).groupBy(F.window(ts, f"{seconds} seconds"), *by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("window_start"), *by, "n", "total")
    )


def audit_rows(requests: DataFrame) -> DataFrame:
    """R3. The audit entry of each request: C19 and C20, row by row."""
    return classify_requests(requests).withColumn("ip_address", client_ip("forwarded", "host")).select(
        "event_id", "ts", "user_id", "action", "method", "path", "status", "ip_address")


def changed_rankings(previous: DataFrame, current: DataFrame, key: str, columns: Sequence[str], channel: str) -> DataFrame:
    """R4. Rows new or changed between two snapshots, tagged with their channel."""
    old = previous.select(key, F.struct(*columns).alias("_old"))
    new = current.select(key, F.struct(*columns).alias("_new"))
    changed = new.join(old, key, "left").filter(~F.col("_new").eqNullSafe(F.col("_old")))
    kind = F.when(F.col("_old").isNull(), "new").otherwise("changed")
    return changed.select(key, F.lit(channel).alias("channel"), kind.alias("change"), "_new.*")


class RankingPushes:
    """R4 as a stream: scores add up by key, and each micro-batch pushes the rows of the ranking that it adds or changes.

    Rankings are versions by batch: a batch reads the version before it,
    writes the next one and then the difference. Both are folders of its own
    that a repeated batch overwrites from the same version, so a restart gives
    the same rows. Only the last version is read again; older ones may be
    deleted.
    """

    def __init__(self, spark: SparkSession, key: str, score: str, channel: str):
        self.key, self.score, self.channel = key, score, channel
        self.versions, self.pushes = new_table_dir(spark, "ranking-versions"), new_table_dir(spark, "ranking-pushes")
        self.progress = new_table_dir(spark, "ranking-progress")

    def version(self, spark: SparkSession, batch_id: int, like: DataFrame | None = None) -> DataFrame:
        """(key, score, rank) after a batch; before the first one an empty table with the types of ``like``."""
        if batch_id < 0:
            return like.select(self.key, self.score, F.lit(0).cast("long").alias("rank")).limit(0)
        return spark.read.parquet(f"{self.versions}/{batch_id}")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        added = batch.groupBy(self.key).agg(F.sum(self.score).alias(self.score))
        before = self.version(spark, batch_id - 1, added)
        totals = before.select(self.key, self.score).unionByName(added).groupBy(self.key).agg(F.sum(self.score).alias(self.score))
        ranked = global_row_number(totals, [F.col(self.score).desc(), F.col(self.key)], "rank")
        ranked.select(self.key, self.score, "rank").write.mode("overwrite").parquet(f"{self.versions}/{batch_id}")
        pushed = changed_rankings(before, self.version(spark, batch_id), self.key, [self.score, "rank"], self.channel)
        pushed.write.mode("overwrite").parquet(f"{self.pushes}/batch={batch_id}")

    def run(self, stream: DataFrame) -> DataFrame:
        """Runs what is available; all pushes with their batch."""
        query = (stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", self.progress)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        return self.pushed(stream.sparkSession)

    def pushed(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.pushes)


def last_pushes(pushes: DataFrame, key: str) -> DataFrame:
    """R4. What a listener holds after all pushes: the last row of each key."""
    values = F.struct(*[c for c in pushes.columns if c not in (key, "batch", "change")])
    return pushes.groupBy(key).agg(F.max_by(values, F.col("batch")).alias("_v"), F.min_by("change", "batch").alias("first_change")
                               ).select(key, "_v.*", "first_change")


def latest_by_key(events: DataFrame, key: str, value: str, ts: str, tie: str) -> DataFrame:
    """R5. Newest value per key (the greater ``tie`` at equal times)."""
    newest = F.max_by(F.struct(F.col(value).alias("value"), F.col(ts).alias("updated_at")), F.struct(ts, tie))
    return events.groupBy(key).agg(newest.alias("_v")).select(key, "_v.*")


def latest_in_windows(events: DataFrame, key: str, value: str, ts: str, tie: str,
                      ttl_seconds: int = SETTINGS.cache_ttl_seconds, late: str = "10 minutes") -> DataFrame:
    """R5 for endless streams: newest value per key and window of the time to live.

    State goes when the watermark passes a window, so it is bounded by the
    keys of the last two windows; merge_latest makes one row per key of the
    written rows.
    """
    newest = F.max_by(F.struct(F.col(value).alias("value"), F.col(ts).alias("updated_at"), F.col(tie).alias("tie")), F.struct(ts, tie))
    return (
        _bounded(events, ts, late).groupBy(F.window(ts, f"{ttl_seconds} seconds"), key).agg(newest.alias("_v"))
        .select(F.col("window.start").alias("window_start"), key, "_v.*")
    )


def merge_latest(windows: DataFrame, key: str) -> DataFrame:
    """R5. One newest row per key from the rows of latest_in_windows."""
    newest = F.max_by(F.struct("value", "updated_at"), F.struct("updated_at", "tie"))
    return windows.groupBy(key).agg(newest.alias("_v")).select(key, "_v.*")


def live_entries(latest: DataFrame, as_of: Column, ttl_seconds: int = SETTINGS.cache_ttl_seconds) -> DataFrame:
    """R5. Entries not older than the time to live."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(F.col("updated_at").cast("timestamp"))
    return latest.filter(age <= ttl_seconds)


# --- running ----------------------------------------------------------------


def append_table(stream: DataFrame, name: str) -> DataFrame:
    """Run what is available into a Parquet table (exactly once) and read it back."""
    spark = stream.sparkSession
    table, progress = new_table_dir(spark, name), new_table_dir(spark, f"{name}-progress")
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", table)
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(table)


def update_table(stream: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Run what is available in update mode; the newest row per key is the result.

    Each micro-batch owns one directory that a repeated batch overwrites, so a
    restart neither loses nor doubles a row.
    """
    spark = stream.sparkSession
    table, progress = new_table_dir(spark, name), new_table_dir(spark, f"{name}-progress")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    written = spark.read.parquet(table)
    values = [c for c in stream.columns if c not in keys]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch")).alias("_v"))
    return newest.select(*keys, "_v.*").select(*stream.columns)
