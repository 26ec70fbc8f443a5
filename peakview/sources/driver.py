"""Adapter from the driver's generic tables to the telemetry model.

The driver's ``events`` table has users and typed events but no video
sessions or play states, and ``part`` is a product catalogue. This module
maps them onto the raw-event and content schemas so the whole engine runs on
the given tables. The mapping is written once as SQL expressions that both
Spark and DuckDB accept; only the timestamp and JSON accessors differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session as _session

# ---------------------------------------------------------------------------
# Fixed values of the adapter (not part of the telemetry contract; they only
# have to agree between the Spark build and the SQL oracle).
# ---------------------------------------------------------------------------
SESSION_EPOCH_MS = 1_704_067_200_000  # 2024-01-01T00:00:00Z
SESSION_BLOCK_MS = 432_000_000  # a user's events fall into 5-day sessions
PLATFORMS = ("IPHONE", "ANDROID_PHONE", "SONY_ANDROID_TV", "Mweb")
COUNTRIES = ("india", "usa", "uk", "brazil", "germany")
AUDIO_LANGUAGES = ("hin", "HIN", "eng", "tam")
SUBTITLE_LANGUAGES = ("OFF", "eng", "hin")
RESOLUTIONS = ("1920*1080", "1920 * 1080", "Auto-1920*1080", "1280*720", "")


def _pick(expr: str, values: tuple[str, ...]) -> str:
    """CASE expression choosing values[expr % len(values)]."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE ({expr}) % {len(values)} {arms} ELSE '{values[-1]}' END"


# dialect-specific accessors: epoch milliseconds of `ts`, integer `k` of `props`
_ACCESS = {
    "spark": {
        "t_ms": "unix_millis(CAST(ts AS TIMESTAMP))",
        "k": "coalesce(CAST(get_json_object(props, '$.k') AS INT), 0)",
    },
    "duckdb": {
        "t_ms": "epoch_us(ts) // 1000",
        "k": "coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 0)",
    },
}

# raw-event columns as expressions over (event_id, user_id, event_type, t_ms, k)
RAW_EXPRS = (
    ("video_session_id",
     f"CAST(user_id AS STRING) || '-' || CAST(CAST(floor((t_ms - {SESSION_EPOCH_MS}) / {SESSION_BLOCK_MS}) AS BIGINT) AS STRING)"),
    ("user_id", "CAST(user_id AS STRING)"),
    ("event_type",
     "CASE event_type"
     " WHEN 'signup' THEN 'VideoSessionStart'"
     " WHEN 'view' THEN CASE WHEN k % 3 = 0 THEN 'VideoPlay' ELSE 'VideoHeartbeat' END"
     " WHEN 'purchase' THEN CASE WHEN k < 40 THEN 'VideoHeartbeat' WHEN k < 70 THEN 'AppBackgrounded' ELSE 'AppForegrounded' END"
     " WHEN 'error' THEN CASE WHEN k >= 50 THEN 'VideoHeartbeat' WHEN k % 2 = 0 THEN 'VideoError' ELSE 'VideoSessionEnd' END"
     " ELSE 'VideoHeartbeat' END"),
    ("event",
     "CASE WHEN event_type = 'signup' THEN 'Play'"
     " WHEN event_type = 'view' THEN CASE k % 3 WHEN 0 THEN 'Play' WHEN 1 THEN 'Resume' ELSE 'AdResume' END"
     " WHEN event_type = 'purchase' AND k < 40 THEN CASE k % 3 WHEN 0 THEN 'pause' WHEN 1 THEN 'Speed-Pause' ELSE 'AdPause' END"
     " ELSE 'network-activity' END"),
    ("t_ms", "t_ms"),
    ("session_start_ms", "t_ms - CAST(k AS BIGINT) * 60000"),
    ("platform", _pick("k", PLATFORMS)),
    ("app_version", "'4.' || CAST(user_id % 3 AS STRING) || '.0'"),
    ("country", _pick("user_id", COUNTRIES)),
    ("audio_language", _pick("user_id", AUDIO_LANGUAGES)),
    ("subtitle_language", _pick("user_id", SUBTITLE_LANGUAGES)),
    ("player_version", "'2.0.' || CAST(user_id % 2 AS STRING)"),
    ("content_id", "CAST(k + 1 AS BIGINT)"),
    ("video_resolution", _pick("k", RESOLUTIONS)),
)

CONTENT_EXPRS = (
    ("content_id", "CAST(p_partkey AS BIGINT)"),
    ("title", "p_name"),
    ("video_type", "CASE WHEN p_size % 3 = 0 THEN 'live' ELSE 'vod' END"),
    ("category", "lower(p_type)"),
    ("show_name", "p_brand"),
)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver ``events`` as raw telemetry events (canonical raw schema)."""
    _session.ensure(spark)
    acc = _ACCESS["spark"]
    base = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "user_id", "event_type",
        F.expr(acc["t_ms"]).alias("t_ms"), F.expr(acc["k"]).alias("k"))
    return base.select(*[F.expr(e).alias(n) for n, e in RAW_EXPRS])


def event_rows(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the driver's ``events``, by the files' footers."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").count()


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver ``part`` as the content catalogue."""
    _session.ensure(spark)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(*[F.expr(e).alias(n) for n, e in CONTENT_EXPRS])


def raw_events_sql() -> str:
    """The same mapping as a DuckDB subquery over the ``events`` view."""
    acc = _ACCESS["duckdb"]
    cols = ", ".join(f"{e} AS {n}" for n, e in RAW_EXPRS)
    return (f"(SELECT {cols} FROM (SELECT event_id, user_id, event_type, "
            f"{acc['t_ms']} AS t_ms, {acc['k']} AS k FROM events))")


def content_sql() -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in CONTENT_EXPRS)
    return f"(SELECT {cols} FROM part)"
