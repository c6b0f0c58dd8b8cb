"""Row visibility, paging, expiry, request classes, upserts and life cycles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
EXPIRING_STATUSES = ("completed", "pending", "processing")
EXPIRED = "expired"
REPORT_DAYS = 7
STAGES = ("pending", "processing", "failed", "completed")
SEE_ALL = {"users": ("admin", "officer"), "reports": ("admin", "officer"), "audit": ("admin",)}
# End of fixed values.


def visible_rows(df: DataFrame, users: DataFrame, uid: int | str, kind: str) -> DataFrame:
    """J11. Rows of a ``users`` / ``reports`` / ``audit`` / ``cache`` table a user may read.

    Own rows always; all rows by role. Only the user table's own rule looks at
    the deletion mark. Roles are tested as uncorrelated EXISTS, so the big
    table is filtered in its scan and joined with nothing.
    """
    if kind == "cache":
        return df
    me = users.filter(F.col("id") == uid)
    privileged = me.filter(F.col("role").isin(*SEE_ALL[kind]))
    if kind == "users":
        return df.filter((F.col("id") == uid) | privileged.filter(~F.col("is_deleted")).exists())
    return df.filter(((F.col("user_id") == uid) & me.exists()) | privileged.exists())


def page(df: DataFrame, skip: int, limit: int, created: str, key: str,
         equals: Mapping[str, str] | None = None) -> DataFrame:
    """C17. Newest first, then by key; soft-deleted rows hidden; optional equality filters."""
    if "is_deleted" in df.columns:
        df = df.filter(~F.col("is_deleted"))
    for name, value in (equals or {}).items():
        df = df.filter(F.col(name) == value)
    return df.orderBy(F.col(created).desc(), F.col(key).asc()).offset(skip).limit(limit)


def drop_expired(cache: DataFrame, as_of: Column) -> DataFrame:
    """C18. Cache rows not past their expiry."""
    return cache.filter(F.col("expires_at") >= as_of)


def _lapsed(as_of: Column) -> Column:
    return (F.col("expires_at") < as_of) & F.col("status").isin(*EXPIRING_STATUSES)


def expire_reports(reports: DataFrame, as_of: Column) -> DataFrame:
    """C18. Reports past expiry in an expiring status become 'expired'."""
    return reports.withColumn("status", F.when(_lapsed(as_of), EXPIRED).otherwise(F.col("status")))


def expiry_counts(cache: DataFrame, reports: DataFrame, as_of: Column) -> DataFrame:
    """C18. Rows each of the two would touch."""
    gone = cache.agg(F.lit("cache").alias("target"), F.count_if(F.col("expires_at") < as_of).alias("rows"))
    return gone.unionByName(reports.agg(F.lit("reports").alias("target"), F.count_if(_lapsed(as_of)).alias("rows")))


def soft_delete(df: DataFrame, which: Column) -> DataFrame:
    """C18. Mark rows deleted instead of removing them."""
    return df.withColumn("is_deleted", F.col("is_deleted") | F.coalesce(which, F.lit(False)))


# Path part, required method, action; the first rule that fits wins.
PATH_ACTIONS = (
    ("/auth/logout", None, "logout"),
    ("/auth/register", None, "register"),
    ("/reports/generate", "POST", "report_generate"),
    ("/reports/download", None, "report_download"),
    ("/ws/", None, "websocket_connect"),
)
LOGIN_PATH = "/auth/login"
METHOD_ACTIONS = {"POST": "create", "DELETE": "delete", "PUT": "update", "PATCH": "update"}
# End of fixed values.


def request_action(path: Column, method: Column, status: Column) -> Column:
    """C19. The audit action of a request."""
    rule = F.when(F.contains(path, F.lit(LOGIN_PATH)), F.when(status == 200, "login").otherwise("login_failed"))
    for part, needed, action in PATH_ACTIONS:
        fits = F.contains(path, F.lit(part))
        rule = rule.when(fits if needed is None else fits & (method == needed), action)
    for verb, action in METHOD_ACTIONS.items():
        rule = rule.when(method == verb, action)
    return rule.otherwise("read")


def classify_requests(df: DataFrame) -> DataFrame:
    """C19. ``action`` for each request, batch or stream."""
    return df.withColumn("action", request_action(F.col("path"), F.col("method"), F.col("status")))


def upsert(target: DataFrame, changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """J12. Target with a batch of changes applied in ``order``.

    A key already there keeps its type, takes the newest payload, expiry and
    refresh time, takes the newest non-null source, and counts one hit per
    change. A new key starts with its first change, at zero hits.

    The batch is reduced to one row per key before the join.
    """
    at = F.struct(*order)
    newest = changes.groupBy(key).agg(
        F.max_by(F.struct("payload", "ttl_seconds", "changed_at"), at).alias("_last"),
        F.max_by("source", F.when(F.col("source").isNotNull(), at)).alias("_source"),
        F.min_by("cache_type", at).alias("_type"), F.count(F.lit(1)).alias("_n"))
    old = target.withColumn("_old", F.lit(True))
    has_old, has_new = F.col("_old").isNotNull(), F.col("_n").isNotNull()
    expires = F.col("_last.changed_at") + F.make_dt_interval(secs=F.col("_last.ttl_seconds"))
    pick = lambda new, column: F.when(has_new, new).otherwise(F.col(column)).alias(column)
    return old.join(newest, key, "full_outer").select(
        key,
        F.when(has_old, F.col("cache_type")).otherwise(F.col("_type")).alias("cache_type"),
        pick(F.col("_last.payload"), "payload"),
        pick(F.length("_last.payload"), "payload_size"),
        F.coalesce("_source", "source").alias("source"),
        pick(F.col("_last.ttl_seconds"), "ttl_seconds"),
        pick(expires, "expires_at"),
        pick(F.col("_last.changed_at"), "last_refreshed_at"),
        F.when(has_old & has_new, F.coalesce("hit_count", F.lit(0)) + F.col("_n"))
        .when(has_new, F.col("_n") - 1).otherwise(F.col("hit_count")).alias("hit_count"),
    )


def report_lifecycle(log: DataFrame) -> DataFrame:
    """F14. Current state of each report from its event log (report_id, seq, at, event).

    Events: created, started, completed, failed, downloaded. Of two events at
    the same place in the log the later stage wins.
    """
    event = F.col("event")
    state = (
        F.when(event == "created", "pending").when(event == "started", "processing")
        .when(event.isin("completed", "failed"), event)
    )
    stage = F.array_position(F.array(*map(F.lit, STAGES)), state)
    created = F.min(F.when(event == "created", F.col("at")))
    return log.groupBy("report_id").agg(
        F.max_by(state, F.when(state.isNotNull(), F.struct(F.col("at"), F.col("seq"), stage))).alias("status"),
        F.count_if(event == "failed").alias("retry_count"),
        F.count_if(event == "downloaded").alias("download_count"),
        created.alias("created_at"),
        (created + F.make_dt_interval(days=F.lit(REPORT_DAYS))).alias("expires_at"))
