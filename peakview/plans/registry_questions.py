"""Registered questions: order and rank, grains, ranges, sentinels, ids, and the written store that serves them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config as C
from .. import session as _session
from ..functions import filters as FL
from . import oracle as O
from . import pipeline as P
from . import serving as SV
from . import store as ST
from .registry import TH, register, sql_filters, with_catalogue
from .registry_more import DIMENSION_VALUES_CTE, TITLES_CTE

B = TH.bucket_ms
PER_DAY = C.DAY_MS // B


def _b(spark, sf):
    return P.driver_build(spark, sf, TH)


def _rollup(spark, sf):
    return _b(spark, sf).materialize("rollup").rollup


def _m(select: str, extra: str = "") -> str:
    return O.with_model(select, TH, extra)


_SERIES = "SELECT minute, CAST(sum(sessions) AS BIGINT) AS concurrency FROM minute_occupancy GROUP BY minute"


# --------------------------------------------------------------------------
# K1, K3 order
# --------------------------------------------------------------------------

@register("K1_ordered_series", _m(f"SELECT *, row_number() OVER (ORDER BY minute) AS place FROM ({_SERIES})"))
def q_ordered_series(spark, sf):
    return SV.ordered_series(SV.occupancy(_b(spark, sf).rollup, FL.Resolved()))


def _buckets_sql(grain: int) -> str:
    return (f"SELECT minute // {grain} * {grain} AS bucket_minute, max(concurrency) AS peak_concurrency,"
            " CAST(sum(concurrency) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS average_concurrency,"
            f" count(*) AS minutes_in_bucket FROM ({_SERIES}) GROUP BY 1")


@register("K1_ordered_days", _m(f"SELECT *, row_number() OVER (ORDER BY bucket_minute) AS place FROM ({_buckets_sql(PER_DAY)})"))
def q_ordered_days(spark, sf):
    return SV.ordered_series(SV.concurrency(SV.occupancy(_b(spark, sf).rollup, FL.Resolved()), PER_DAY), "bucket_minute")


@register("K3_ranked_dimension_values", _m(
    "SELECT *, row_number() OVER (ORDER BY dimension, minutes_present DESC, value) AS rank FROM dimension_values", DIMENSION_VALUES_CTE))
def q_ranked_values(spark, sf):
    return SV.ranked_values(SV.dimension_values(_b(spark, sf).rollup))


@register("K3_ranked_titles", _m(
    "SELECT *, row_number() OVER (ORDER BY minutes_present DESC, content_id) AS rank FROM titles", TITLES_CTE))
def q_ranked_titles(spark, sf):
    b = _b(spark, sf)
    return SV.ranked_titles(SV.titles(b.rollup, b.content))


# --------------------------------------------------------------------------
# A7, P6 other grains
# --------------------------------------------------------------------------

@register("A7_concurrency_hour", _m(_buckets_sql(TH.grain_buckets(60))))
def q_hours(spark, sf):
    return SV.concurrency(SV.occupancy(_b(spark, sf).rollup, FL.Resolved()), TH.grain_buckets(60))


@register("A7_concurrency_six_hours", _m(_buckets_sql(TH.grain_buckets(360))))
def q_six_hours(spark, sf):
    return SV.concurrency(SV.occupancy(_b(spark, sf).rollup, FL.Resolved()), TH.grain_buckets(360))


# --------------------------------------------------------------------------
# P7, P9, P10, P11 filters and ranges
# --------------------------------------------------------------------------

_OPEN = {"platform": " ALL ", "country": "%", "audio_language": "None", "category": "", "video_type": "*", "show_name": "any",
         "app_version": "NULL", "content_id": 0, "subtitle_language": "off"}


@register("P7_sentinels", with_catalogue(
    f"SELECT minute, CAST(sum(sessions) AS BIGINT) AS concurrency FROM minute_occupancy WHERE {sql_filters(_OPEN)} GROUP BY minute"))
def q_sentinels(spark, sf):
    # all of them mean no filter but the last, which folds onto OFF
    return SV.occupancy_for(_rollup(spark, sf), _OPEN)


_ASKED = {"platform": "iphone", "country": "atlantis", "audio_language": "Hin", "subtitle_language": "eng", "video_type": "LIVE"}


@register("P9_filter_report", with_catalogue(" UNION ALL ".join(
    f"""SELECT '{d}' AS dimension, '{v}' AS asked,
       CASE WHEN count(*) FILTER (WHERE value = '{v}') > 0 THEN 'exact' WHEN count(*) = 1 THEN 'folded'
            WHEN count(*) > 1 THEN 'ambiguous' ELSE 'unknown' END AS status,
       CASE WHEN count(*) FILTER (WHERE value = '{v}') > 0 THEN '{v}' WHEN count(*) = 1 THEN min(value) END AS stands_for,
       (SELECT count(*) FROM dimension_value WHERE dimension = '{d}') AS values_known
FROM dimension_value WHERE dimension = '{d}' AND lower(value) = lower('{v}')""" for d, v in _ASKED.items())))
def q_filter_report(spark, sf):
    return FL.report(SV.dimension_value(_b(spark, sf).rollup), _ASKED)


_ID = {"content_id": 6, "platform": "android_phone"}


@register("P10_content_id_filter", with_catalogue(
    f"SELECT minute, CAST(sum(sessions) AS BIGINT) AS concurrency FROM minute_occupancy WHERE {sql_filters(_ID)} GROUP BY minute"))
def q_content_id(spark, sf):
    return SV.occupancy_for(_rollup(spark, sf), _ID)


def _store(spark, sf) -> ST.RollupStore:
    path = _session.scratch_path(spark, f"store-{uuid.uuid4().hex}")
    ST.write_store(_b(spark, sf), path)
    return ST.RollupStore(spark, path, TH)


# a range that starts and ends inside a day
_FROM, _TO = 5 * PER_DAY + 7, 12 * PER_DAY + 3
_RANGE = "minute BETWEEN (SELECT min(minute) FROM minute_occupancy) + {} AND (SELECT min(minute) FROM minute_occupancy) + {}".format(_FROM, _TO)


def _ranged(spark, sf, filters: dict):
    store = _store(spark, sf)
    first = store.projection.agg(F.min("minute")).first()[0] or 0
    return store.series(filters, first + _FROM, first + _TO)


@register("P11_store_minute_range", with_catalogue(f"{_SERIES.replace('GROUP BY', f'WHERE {_RANGE} GROUP BY')}"))
def q_range(spark, sf):
    return _ranged(spark, sf, {})


_RANGE_FILTER = {"audio_language": "eng", "platform": "Mweb"}


@register("P11_store_filtered_range", with_catalogue(
    _SERIES.replace("GROUP BY", f"WHERE {_RANGE} AND {sql_filters(_RANGE_FILTER)} GROUP BY")))
def q_filtered_range(spark, sf):
    # audio_language is not in the projection: the day-partitioned rollup answers
    return _ranged(spark, sf, _RANGE_FILTER)


@register("A39_store_content_id_series", with_catalogue(
    _SERIES.replace("GROUP BY", "WHERE content_id = 7 GROUP BY")))
def q_store_content_id(spark, sf):
    # the second order of the store: one bucket folder is read
    return _store(spark, sf).series({"content_id": 7})


@register("A17_store_benchmarks", with_catalogue(" UNION ALL ".join(
    f"""SELECT '{label}' AS query_label, CAST({grain} AS BIGINT) AS grain_buckets, CAST(coalesce(max(peak), 0) AS BIGINT) AS peak_concurrency,
       coalesce(CAST(sum(total) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 0.0) AS average_concurrency, CAST(coalesce(sum(n), 0) AS BIGINT) AS active_minutes
FROM (SELECT max(concurrency) AS peak, sum(concurrency) AS total, count(*) AS n
      FROM ({_SERIES.replace("GROUP BY", f"WHERE {sql_filters(flt)} GROUP BY")}) GROUP BY minute // {grain})"""
    for label, grain, flt in SV.benchmark_specs(TH))))
def q_store_benchmarks(spark, sf):
    # each question on its own, as it is served
    store = _store(spark, sf)
    rows = [store.benchmark(label).first() for label, _, _ in C.BENCHMARKS]
    return spark.createDataFrame(rows, store.benchmark(C.BENCHMARKS[0][0]).schema)
