"""R: streaming operators, as batch twins and as streams over the same files."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import reports
from ..streaming import jobs
from .cleaning import _ACTION
from ..functions.scalar import rounded
from ..session import new_table_dir
from .registry import query, rnd

R = rnd
_STAMP = "yyyy-MM-dd HH:mm:ss"


def _start(seconds: int) -> str:
    return f"strftime(make_timestamp(CAST(floor(epoch(ts) / {seconds}) AS BIGINT) * {seconds}000000), '%Y-%m-%d %H:%M:%S')"


def _stamped(df):
    return df.withColumn("window_start", F.date_format("window_start", _STAMP))


def _stream(spark, d):
    return jobs.read_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_LIMIT = f"""
SELECT window_start, identifier, n, CAST(greatest(0, 2 - n) AS BIGINT) AS remaining FROM (
  SELECT {_start(21600)} AS window_start, CASE WHEN user_id IS NOT NULL THEN 'user:' || CAST(user_id AS VARCHAR) ELSE 'ip:' || ip_address END AS identifier,
         CAST(count(*) AS BIGINT) AS n FROM request_ip GROUP BY 1, 2)"""


@query("r1_request_counts", _LIMIT, "request_ip")
def r1(spark, d):
    return _stamped(jobs.request_counts(fx.requests(fx.ev(spark, d)), 2, 21600))


@query("r1_over_limit", _LIMIT + " WHERE n > 2", "request_ip")
def r1_over(spark, d):
    return _stamped(jobs.over_limit(fx.requests(fx.ev(spark, d)), 2, 21600))


@query("r1_over_limit_stream", _LIMIT + " WHERE n > 2", "request_ip")
def r1_stream(spark, d):
    counts = jobs.over_limit(fx.requests(_stream(spark, d)), 2, 21600)
    return _stamped(jobs.update_table(counts, ["window_start", "identifier"], "over_limit"))


_LIVE = f"""SELECT {_start(86400)} AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, {R('sum(value)', 2)} AS total
FROM ev GROUP BY 1, 2"""


@query("r2_live_metrics", _LIVE, "ev")
def r2(spark, d):
    return _stamped(jobs.live_metrics(fx.ev(spark, d), 86400, ["event_type"], "value")).withColumn("total", rounded("total", 2))


@query("r2_live_metrics_stream", _LIVE, "ev")
def r2_stream(spark, d):
    metrics = jobs.live_metrics(_stream(spark, d), 86400, ["event_type"], "value")
    return _stamped(jobs.update_table(metrics, ["window_start", "event_type"], "live")).withColumn("total", rounded("total", 2))


@query("r3_audit_stream", f"""
SELECT event_id, {_ACTION} AS action, method, path, CAST(status AS INTEGER) AS status, ip_address FROM request_ip""", "request_ip")
def r3(spark, d):
    return jobs.append_table(jobs.audit_rows(fx.requests(_stream(spark, d))), "audit").select(
        "event_id", "action", "method", "path", "status", "ip_address")


@query("r4_changed_rankings", """
WITH a AS (SELECT unit || '/' || CAST(month AS VARCHAR) AS place, n FROM unit_month WHERE year = 1999),
b AS (SELECT unit || '/' || CAST(month AS VARCHAR) AS place, n FROM unit_month WHERE year = 2000)
SELECT b.place, 'risk_update' AS channel, CASE WHEN a.place IS NULL THEN 'new' ELSE 'changed' END AS change, b.n
FROM b LEFT JOIN a ON a.place = b.place WHERE a.n IS DISTINCT FROM b.n""", "unit_month")
def r4(spark, d):
    um = fx.unit_month(spark, d).select("year", F.concat_ws("/", "unit", F.col("month").cast("string")).alias("place"), "n")
    return jobs.changed_rankings(um.filter(F.col("year") == 1999), um.filter(F.col("year") == 2000), "place", ["n"], "risk_update")


@query("r4_ranking_pushes_stream", """
SELECT user_id, 'risk_update' AS channel, CAST(count(*) AS BIGINT) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS rank,
  'new' AS first_change FROM ev GROUP BY user_id""", "ev")
def r4_stream(spark, d):
    """The ranking that a listener holds once the events have come in several files, one micro-batch each."""
    arriving = new_table_dir(spark, "events-in-turn")
    fx.ev(spark, d).select("user_id", F.lit(1).cast("long").alias("n")).repartition(4).write.parquet(arriving)
    pushes = jobs.RankingPushes(spark, "user_id", "n", "risk_update")
    return jobs.last_pushes(pushes.run(jobs.read_files_in_turn(spark, arriving)), "user_id")


_LATEST = """SELECT user_id, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM ev) WHERE r = 1"""


def _texted(df):
    return df.withColumn("updated_at", F.date_format("updated_at", _STAMP))


@query("r5_latest_by_key", _LATEST, "ev")
def r5(spark, d):
    return _texted(jobs.latest_by_key(fx.ev(spark, d), "user_id", "value", "ts", "event_id"))


@query("r5_live_entries", f"""SELECT user_id, value, updated_at FROM ({_LATEST})
WHERE epoch(TIMESTAMP '2024-01-30 00:00:00') - epoch(strptime(updated_at, '%Y-%m-%d %H:%M:%S')) <= 43200""", "ev")
def r5_live(spark, d):
    latest = jobs.latest_by_key(fx.ev(spark, d), "user_id", "value", "ts", "event_id")
    return _texted(jobs.live_entries(latest, F.lit("2024-01-30 00:00:00").cast("timestamp"), 43200))


@query("r5_latest_by_key_stream", _LATEST, "ev")
def r5_stream(spark, d):
    latest = jobs.latest_by_key(_stream(spark, d), "user_id", "value", "ts", "event_id")
    return _texted(jobs.update_table(latest, ["user_id"], "latest"))


@query("r5_live_entries_stream", f"""SELECT user_id, value, updated_at FROM ({_LATEST})
WHERE epoch(TIMESTAMP '2024-01-30 00:00:00') - epoch(strptime(updated_at, '%Y-%m-%d %H:%M:%S')) <= 43200""", "ev")
def r5_live_stream(spark, d):
    windows = jobs.latest_in_windows(_stream(spark, d), "user_id", "value", "ts", "event_id", 43200)
    latest = jobs.merge_latest(jobs.update_table(windows, ["window_start", "user_id"], "entries"), "user_id")
    return _texted(jobs.live_entries(latest, F.lit("2024-01-30 00:00:00").cast("timestamp"), 43200))
