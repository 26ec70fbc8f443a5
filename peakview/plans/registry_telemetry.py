"""Registered observability queries: latency report, published metrics, spans, dashboard, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import naive as N
from ..sources import driver
from ..sources import sinks as SK
from . import oracle as O
from . import pipeline as P
from . import serving as SV
from . import telemetry as TL
from .registry import DIMENSION_VALUE_CTE, TH, _bench_sql, register
from .registry_io import _LAST_DAY
from .registry_more import DATA_WINDOW_CTE, NAIVE_CTE

B = TH.bucket_ms


def _b(spark, sf):
    return P.driver_build(spark, sf, TH)


_ACC = driver._ACCESS["duckdb"]
SPANS_SQL = (f"(SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(floor((t_ms - {driver.SESSION_EPOCH_MS}) / "
             f"{driver.SESSION_BLOCK_MS}) AS BIGINT) AS VARCHAR) AS TraceId, event_type AS SpanName, 'player' AS ServiceName,"
             f" t_ms AS TimestampMs, CAST(trunc(value * 1000000) AS BIGINT) AS Duration,"
             f" json_extract_string(props, '$.k') AS k, CAST(trunc(value * 100) AS BIGINT) AS read_rows"
             f" FROM (SELECT *, {_ACC['t_ms']} AS t_ms FROM events))")


@register("A31_latency_report_spans", f"""
WITH m AS (SELECT SpanName, CAST(trunc(Duration / 1000000) AS BIGINT) AS v FROM {SPANS_SQL}),
hist AS (SELECT SpanName, v, count(*) AS n FROM m GROUP BY 1, 2),
cum AS (SELECT *, sum(n) OVER (PARTITION BY SpanName ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
               sum(n) OVER (PARTITION BY SpanName) AS total FROM hist)
SELECT SpanName, min(v) AS min,
       min(v) FILTER (WHERE cum >= CAST(0.5 AS DOUBLE) * CAST(total AS DOUBLE)) AS p50,
       min(v) FILTER (WHERE cum >= CAST(0.95 AS DOUBLE) * CAST(total AS DOUBLE)) AS p95,
       min(v) FILTER (WHERE cum >= CAST(0.99 AS DOUBLE) * CAST(total AS DOUBLE)) AS p99,
       max(v) AS max, CAST(sum(CASE WHEN v <= 50 THEN n ELSE 0 END) AS DOUBLE) / CAST(first(total) AS DOUBLE) AS share_within_target,
       CAST(first(total) AS BIGINT) AS samples
FROM cum GROUP BY SpanName""")
def q_latency(spark, sf):
    spans = TL.spans_from_events(spark, sf)
    metrics = spans.select("SpanName", (F.col("Duration") / 1_000_000).cast("bigint").alias("duration_ms"))
    return TL.latency_report(metrics, "duration_ms", 50, ["SpanName"])


METRICS_CTE = NAIVE_CTE + ",\n" + DATA_WINDOW_CTE + ",\n" + DIMENSION_VALUE_CTE + """,
dense_nvf AS (SELECT avg(foreground_concurrency) AS fg, avg(naive_concurrency) AS nv FROM nvf, data_window
              WHERE minute BETWEEN dense_min_minute AND dense_max_minute),
headline AS (
  SELECT max(foreground_concurrency)::DOUBLE AS foreground_peak, any_value(fg) AS foreground_average,
         max(naive_concurrency)::DOUBLE AS naive_peak,
         100.0 * (max(naive_concurrency)::DOUBLE / max(foreground_concurrency)::DOUBLE - 1) AS peak_overcount_pct,
         100.0 * (any_value(nv) / any_value(fg) - 1) AS average_overcount_pct
  FROM nvf, dense_nvf),
sizes AS (
  SELECT w.occupancy_rows::DOUBLE AS occupancy_rows, w.minutes_with_sessions::DOUBLE AS minutes_with_sessions, w.span_days::DOUBLE AS span_days,
         r.raw_events, r.sessions, c.content_rows, i.active_intervals
  FROM data_window w, (SELECT count(*)::DOUBLE AS raw_events, count(DISTINCT video_session_id)::DOUBLE AS sessions FROM raw) r,
       (SELECT count(*)::DOUBLE AS content_rows FROM content_src) c, (SELECT count(*)::DOUBLE AS active_intervals FROM active_intervals) i),
metrics AS (
  FROM (UNPIVOT headline ON COLUMNS(*) INTO NAME metric VALUE value)
  UNION ALL FROM (UNPIVOT sizes ON COLUMNS(*) INTO NAME metric VALUE value)
  UNION ALL SELECT 'distinct ' || dimension, count(*)::DOUBLE FROM dimension_value GROUP BY dimension
  UNION ALL SELECT 'peak ' || slice, max(c)::DOUBLE FROM (
    SELECT coalesce(nullif(concat('platform=' || platform, 'video_type=' || video_type), ''), 'unfiltered') AS slice, minute, sum(sessions) AS c
    FROM minute_occupancy GROUP BY GROUPING SETS ((minute), (platform, minute), (video_type, minute))) GROUP BY slice)"""


@register("A38_published_metrics", O.with_model("SELECT * FROM metrics", TH, METRICS_CTE))
def q_metrics(spark, sf):
    return TL.measure(_b(spark, sf).materialize())


def _metrics_sql(raw: str | None = None) -> str:
    return "(" + O.with_model("SELECT * FROM metrics", TH, METRICS_CTE, raw=raw) + ")"


@register("A38_drift_vs_held_out_day", f"""
SELECT coalesce(a.metric, b.metric) AS metric, a.value AS current, b.value AS baseline
FROM {_metrics_sql()} a FULL JOIN {_metrics_sql(_LAST_DAY)} b ON a.metric = b.metric
WHERE a.value IS DISTINCT FROM b.value""")
def q_drift(spark, sf):
    b = _b(spark, sf).materialize()
    day = P.build(SK.held_out_day(b.raw), b.content, TH).materialize()
    return TL.drift(TL.measure(b), TL.measure(day))


@register("A40_stage_durations", f"""
SELECT SpanName, count(*) AS spans, CAST(sum(Duration) AS BIGINT) AS total_ns, max(Duration) AS max_ns
FROM {SPANS_SQL} GROUP BY SpanName""")
def q_stages(spark, sf):
    return TL.stage_durations(TL.spans_from_events(spark, sf))


@register("A40_top_by_rows", f"""
SELECT TraceId, SpanName, TimestampMs, read_rows FROM {SPANS_SQL}
ORDER BY read_rows DESC, TraceId, TimestampMs, SpanName LIMIT 10""")
def q_top_rows(spark, sf):
    return TL.top_by_rows(TL.spans_from_events(spark, sf), 10)


@register("A40_timeline", f"""
SELECT TimestampMs // 60000 * 60 AS minute_utc, count(*) AS spans FROM {SPANS_SQL} GROUP BY 1""")
def q_timeline(spark, sf):
    return TL.timeline(TL.spans_from_events(spark, sf))


@register("A40_counters", f"""
SELECT count(DISTINCT TraceId) AS traces, count(*) AS spans, count(*) FILTER (WHERE k IS NOT NULL) AS with_k
FROM {SPANS_SQL}""")
def q_counters(spark, sf):
    return TL.counters(TL.spans_from_events(spark, sf))


@register("A45_concurrency_over_time", O.with_model(
    "SELECT minute_utc, foreground_concurrency FROM nvf WHERE foreground_concurrency > 0", TH, NAIVE_CTE))
def q_curve(spark, sf):
    b = _b(spark, sf)
    return TL.concurrency_over_time(N.naive_vs_foreground(b.rollup, b.raw, B))


@register("A45_overcount_headline", O.with_model("""
SELECT round(100.0 * (CAST(max(naive_concurrency) AS DOUBLE) / CAST(max(foreground_concurrency) AS DOUBLE) - 1), 1) AS peak_overcount_pct,
       round(100.0 * (avg(naive_concurrency) FILTER (WHERE minute BETWEEN (SELECT dense_min_minute FROM data_window) AND (SELECT dense_max_minute FROM data_window))
              / avg(foreground_concurrency) FILTER (WHERE minute BETWEEN (SELECT dense_min_minute FROM data_window) AND (SELECT dense_max_minute FROM data_window)) - 1), 1) AS average_overcount_pct
FROM nvf""", TH, NAIVE_CTE + ",\n" + DATA_WINDOW_CTE))
def q_headline(spark, sf):
    b = _b(spark, sf).materialize()
    return TL.overcount_headline(N.overcount(N.naive_vs_foreground(b.rollup, b.raw, B), SV.data_window(b.rollup, B)))


_METRICS = ["peak_concurrency", "active_minutes"]


@register("J13_compare_full_vs_held_out_day", f"""
SELECT n.query_label, n.peak_concurrency, n.active_minutes, o.peak_concurrency AS old_peak_concurrency,
       o.active_minutes AS old_active_minutes, n.peak_concurrency - o.peak_concurrency AS delta_peak_concurrency,
       n.active_minutes - o.active_minutes AS delta_active_minutes
FROM ({_bench_sql()}) n LEFT JOIN ({_bench_sql(raw=_LAST_DAY)}) o ON o.query_label = n.query_label""")
def q_compare(spark, sf):
    b = _b(spark, sf).materialize()
    new = SV.benchmark_answers(b.rollup, TH)
    old = SV.benchmark_answers(P.build(SK.held_out_day(b.raw), b.content, TH).materialize().rollup, TH)
    return TL.compare_runs(new, old, "query_label", _METRICS)




@register("P15_minute_labels", O.with_model(
    f"SELECT minute, minute_utc, strftime(epoch_ms(minute * {B}), '%Y-%m-%d %H:%M') AS minute_label,"
    " foreground_concurrency FROM nvf WHERE foreground_concurrency > 0", TH, NAIVE_CTE))
def q_labels(spark, sf):
    b = _b(spark, sf)
    nvf = N.naive_vs_foreground(b.rollup, b.raw, B)
    return (nvf.filter(F.col("foreground_concurrency") > 0)
            .select("minute", "minute_utc", X.minute_label("minute", B).alias("minute_label"),
                    "foreground_concurrency"))
