"""Registered queries (Spark) and their SQL oracles (DuckDB).

Keys start with the operator id of the inventory they exercise. Each Spark
callable takes (spark, sf_dir) and reads the driver tables under sf_dir.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import config as C
from . import oracle as O
from . import pipeline as P
from . import serving as SV

TH = C.DRIVER

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)


def _load_all() -> None:
    # modules that register more queries on import
    from . import registry_io, registry_more, registry_quality, registry_questions, registry_stream, registry_telemetry  # noqa: F401


# --------------------------------------------------------------------------
# SQL helpers for the oracle
# --------------------------------------------------------------------------

DIMENSION_VALUE_CTE = "dimension_value AS (SELECT DISTINCT dimension, value FROM (" + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value FROM minute_occupancy" for d in C.STRING_DIMS) + "))"


def sql_filter(dim: str, value: str) -> str:
    """The filter rule as a lookup: the one value that a spelling stands for, and equality with it.

    A spelling stands for itself where the data holds it, else for the only
    value that differs from it in case, else for nothing.
    """
    v = value.strip(" ").replace("'", "''")
    if v.lower() in C.NO_FILTER_SENTINELS:
        return "TRUE"
    return (f"{dim} = (SELECT CASE WHEN count(*) FILTER (WHERE value = '{v}') = 1 THEN '{v}'"
            f" WHEN count(*) = 1 THEN min(value) END FROM dimension_value WHERE dimension = '{dim}' AND lower(value) = lower('{v}'))")


def sql_filters(filters: dict) -> str:
    parts = [sql_filter(d, v) if d != "content_id" else (f"content_id = {int(v)}" if int(v) else "TRUE")
             for d, v in filters.items()]
    return " AND ".join(parts) if parts else "TRUE"


def with_catalogue(select: str, raw: str | None = None) -> str:
    return O.with_model(select, TH, DIMENSION_VALUE_CTE, raw=raw)


# --------------------------------------------------------------------------
# core tables
# --------------------------------------------------------------------------

@register("A5_minute_occupancy", O.with_model("SELECT * FROM minute_occupancy", TH))
def q_rollup(spark, sf):
    return P.driver_build(spark, sf, TH).rollup


@register("A1_active_intervals", O.with_model("SELECT * FROM active_intervals", TH))
def q_intervals(spark, sf):
    return P.driver_build(spark, sf, TH).intervals


@register("A4_session_minutes", O.with_model("SELECT * FROM session_minutes", TH))
def q_session_minutes(spark, sf):
    return P.driver_build(spark, sf, TH).session_minutes


@register("A6_occupancy_series", O.with_model(
    "SELECT minute, CAST(sum(sessions) AS BIGINT) AS concurrency FROM minute_occupancy GROUP BY minute", TH))
def q_series(spark, sf):
    return SV.occupancy_for(P.driver_build(spark, sf, TH).rollup, {})


_FILTERED = {"platform": "iphone", "country": "INDIA", "audio_language": "hin", "category": " Promo "}


@register("A6_occupancy_filtered", with_catalogue(
    "SELECT minute, CAST(sum(sessions) AS BIGINT) AS concurrency FROM minute_occupancy"
    f" WHERE {sql_filters(_FILTERED)} GROUP BY minute"))
def q_series_filtered(spark, sf):
    return SV.occupancy_for(P.driver_build(spark, sf, TH).materialize("rollup").rollup, _FILTERED)


_DAY = TH.grain_buckets(1440)


@register("A7_concurrency_day", O.with_model(
    f"SELECT minute // {_DAY} * {_DAY} AS bucket_minute, max(c) AS peak_concurrency,"
    " CAST(sum(c) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS average_concurrency,"
    " CAST(count(*) AS BIGINT) AS minutes_in_bucket"
    " FROM (SELECT minute, CAST(sum(sessions) AS BIGINT) AS c FROM minute_occupancy GROUP BY minute)"
    " GROUP BY 1", TH))
def q_concurrency_day(spark, sf):
    return SV.concurrency(SV.occupancy_for(P.driver_build(spark, sf, TH).rollup, {}), _DAY)


def _bench_sql(raw: str | None = None) -> str:
    parts = []
    for label, grain, flt in SV.benchmark_specs(TH):
        parts.append(
            f"SELECT '{label}' AS query_label, CAST({grain} AS BIGINT) AS grain_buckets,"
            " CAST(coalesce(max(c), 0) AS BIGINT) AS peak_concurrency,"
            " coalesce(CAST(sum(c) AS DOUBLE) / CAST(count(c) AS DOUBLE), 0.0) AS average_concurrency,"
            " CAST(count(c) AS BIGINT) AS active_minutes"
            f" FROM (SELECT minute, sum(sessions) AS c FROM minute_occupancy WHERE {sql_filters(flt)} GROUP BY minute)")
    return with_catalogue(" UNION ALL ".join(parts), raw=raw)


@register("A17_benchmark_answers", _bench_sql())
def q_benchmarks(spark, sf):
    return SV.benchmark_answers(P.driver_build(spark, sf, TH).materialize("rollup").rollup, TH)
