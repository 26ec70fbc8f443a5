"""Observability: latency reports, published-metric drift, span reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from ..functions import running as R
from ..operators import naive as N
from . import pipeline as P
from . import serving as SV


# --------------------------------------------------------------------------
# A31 latency report
# --------------------------------------------------------------------------

def latency_report(metrics: DataFrame, duration: str, target, keys: list[str] | None = None) -> DataFrame:
    """min, p50, p95, p99 (nearest rank), max and share within `target`.

    Nearest rank: the smallest value whose cumulative count reaches f * n.
    """
    k = list(keys or [])
    hist = metrics.groupBy(*k, F.col(duration).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranks = R.nearest_ranks(hist, "v", "n", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, k)
    ends = hist.groupBy(*k).agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.sum("n").alias("samples"),
        F.sum(F.when(F.col("v") <= F.lit(target), F.col("n")).otherwise(0)).alias("within"))
    both = ends.join(ranks, k) if k else ends.withColumn("all", F.lit(0)).join(ranks.withColumn("all", F.lit(0)), "all")
    return both.select(*k, "min", "p50", "p95", "p99", "max",
                       (F.col("within").cast("double") / F.col("samples").cast("double")).alias("share_within_target"),
                       F.col("samples").cast("bigint").alias("samples"))


# --------------------------------------------------------------------------
# A38 published metrics and drift
# --------------------------------------------------------------------------

#: dimensions whose every value has its peak published
PEAK_DIMS = ["platform", "video_type"]


def _tall(one_row: DataFrame) -> DataFrame:
    """A one-row frame as (metric, value) rows."""
    names = one_row.columns
    return one_row.select(*[F.col(n).cast("double") for n in names]).unpivot([], names, "metric", "value")


def measure(build: P.Build, peak_dims: list[str] = PEAK_DIMS) -> DataFrame:
    """The headline numbers of a build as one tall (metric, value) table.

    Every source table gives its numbers in one aggregate, and the parts are
    stacked. A table without rows still gives its counts. Distinct values are
    counted for every dimension, peaks published for every value of `peak_dims`.
    """
    rollup, raw = build.rollup, build.raw
    window = SV.data_window(rollup, build.th.bucket_ms)
    over = N.overcount(N.naive_vs_foreground(rollup, raw, build.th.bucket_ms), window)
    rows = F.count(F.lit(1))
    values = SV.dimension_value(rollup).agg(
        *[F.count_if(F.col("dimension") == d).alias(f"distinct {d}") for d in C.STRING_DIMS])
    peaks = SV.all_slices(rollup, peak_dims, 1).groupBy(SV.slice_name(peak_dims).alias("slice")).agg(F.max("c").alias("c"))
    parts = [
        over.select("foreground_peak", "foreground_average", "naive_peak", "peak_overcount_pct", "average_overcount_pct"),
        window.select("occupancy_rows", "minutes_with_sessions", "span_days"),
        raw.agg(rows.alias("raw_events"), F.count_distinct("video_session_id").alias("sessions")),
        build.content.agg(rows.alias("content_rows")),
        build.intervals.agg(rows.alias("active_intervals")),
        values,
    ]
    named = peaks.select(F.concat(F.lit("peak "), "slice").alias("metric"), F.col("c").cast("double").alias("value"))
    return reduce(DataFrame.unionByName, [*map(_tall, parts), named])


def drift(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Metrics whose value moved, appeared or vanished against a baseline."""
    b = baseline.select("metric", F.col("value").alias("baseline"))
    c = current.select("metric", F.col("value").alias("current"))
    return (c.join(b, "metric", "full")
            .filter(~F.col("current").eqNullSafe(F.col("baseline"))))


# --------------------------------------------------------------------------
# A40 spans: a playback session read as a trace
# --------------------------------------------------------------------------

def spans_from_events(spark, sf_dir: str) -> DataFrame:
    """Driver events as spans: trace = user-session, span = event, attributes from props.

    Columns: TraceId, SpanName, ServiceName, Timestamp, Duration (ns),
    SpanAttributes map<string,string>.
    """
    from ..sources import driver
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    attrs = F.from_json("props", "map<string,string>")
    base = ev.select(
        F.expr(driver._ACCESS["spark"]["t_ms"]).alias("t_ms"), "user_id", "event_type", "value", attrs.alias("a"))
    # the trace id is the adapter's session id, so spans line up with the model
    trace = F.concat(F.col("user_id").cast("string"), F.lit("-"),
                     X.floor_div(F.col("t_ms") - F.lit(driver.SESSION_EPOCH_MS), driver.SESSION_BLOCK_MS).cast("string"))
    return base.select(
        trace.alias("TraceId"), F.col("event_type").alias("SpanName"),
        F.lit("player").alias("ServiceName"),
        F.col("t_ms").alias("TimestampMs"),
        (F.col("value") * 1_000_000).cast("bigint").alias("Duration"),
        F.map_concat("a", F.create_map(F.lit("rows"), (F.col("value") * 100).cast("bigint").cast("string")))
        .alias("SpanAttributes"))


def stage_durations(spans: DataFrame) -> DataFrame:
    """Per span name: spans, total and max duration in ns (A40 stages)."""
    return spans.groupBy("SpanName").agg(F.count(F.lit(1)).alias("spans"), F.sum("Duration").alias("total_ns"),
                                         F.max("Duration").alias("max_ns"))


def top_by_rows(spans: DataFrame, n: int = 10) -> DataFrame:
    """Spans reading the most rows, from the map attribute (A40 queries; the cap is the feature)."""
    rows = F.coalesce(F.expr("try_cast(SpanAttributes['rows'] AS BIGINT)"), F.lit(0))
    return (spans.select("TraceId", "SpanName", "TimestampMs", rows.alias("read_rows"))
            .orderBy(F.desc("read_rows"), F.asc("TraceId"), F.asc("TimestampMs"), F.asc("SpanName")).limit(n))


def timeline(spans: DataFrame) -> DataFrame:
    """Spans per UTC minute (A40 timeline)."""
    minute = F.unix_seconds(F.date_trunc("minute", F.timestamp_millis("TimestampMs")))
    return spans.groupBy(minute.alias("minute_utc")).agg(F.count(F.lit(1)).alias("spans"))


def counters(spans: DataFrame) -> DataFrame:
    """Distinct traces, spans, and spans carrying attribute k (A40 counters)."""
    return spans.agg(F.count_distinct("TraceId").alias("traces"), F.count(F.lit(1)).alias("spans"),
                     F.count_if(F.col("SpanAttributes").getItem("k").isNotNull()).alias("with_k"))


# --------------------------------------------------------------------------
# A45 dashboard series, J13 run comparison
# --------------------------------------------------------------------------

def overcount_headline(over: DataFrame) -> DataFrame:
    """The dashboard headline: peak and average overcount, one decimal."""
    return over.select(F.round("peak_overcount_pct", 1).alias("peak_overcount_pct"),
                       F.round("average_overcount_pct", 1).alias("average_overcount_pct"))


def concurrency_over_time(nvf: DataFrame) -> DataFrame:
    """Foreground curve where it is positive, by UTC timestamp."""
    return nvf.filter(F.col("foreground_concurrency") > 0).select("minute_utc", "foreground_concurrency")


def compare_runs(new: DataFrame, old: DataFrame, label: str, metrics: list[str]) -> DataFrame:
    """Label-matched comparison: every label of the new run, old values beside it."""
    o = old.select(label, *[F.col(m).alias(f"old_{m}") for m in metrics])
    out = new.select(label, *metrics).join(o, label, "left")
    for m in metrics:
        out = out.withColumn(f"delta_{m}", F.col(m) - F.col(f"old_{m}"))
    return out

