"""The naive open-session count the foreground model corrects.

A session counts as open from its first claimed start to its last event,
background and pauses included. Each session has one such interval, which
can span years when a timestamp is stray, so the per-minute count is built
from +1/-1 change points and a running sum, and minutes are generated only
where the count is positive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from ..functions import running as R

S = "video_session_id"


def naive_intervals(raw: DataFrame, from_session_start: bool = True) -> DataFrame:
    """[start, last event + 1) per session.

    The mart starts at min(session_start); the threshold sweep starts at
    min(event time). Both are kept, named apart.
    """
    start = F.min("session_start_ms") if from_session_start else F.min("t_ms")
    return raw.groupBy(S).agg(start.alias("ts_start_ms"), (F.max("t_ms") + 1).alias("ts_end_ms"))


def series_from_intervals(intervals: DataFrame, bucket_ms: int) -> DataFrame:
    """Distinct sessions per minute for one interval per session.

    +1 at the first covered minute, -1 after the last; a two-level running
    sum gives the count at each change minute, which holds until the next.
    A stretch without a change, which a stray time can make centuries long, is
    cut into its days first; the days are dealt to all tasks and only there
    become minutes, at most a day of them per row.
    """
    first = X.floor_div("ts_start_ms", bucket_ms)
    after = X.floor_div(F.col("ts_end_ms") - 1, bucket_ms) + 1
    valid = intervals.filter(F.col("ts_end_ms") > F.col("ts_start_ms"))
    points = (valid.select(first.alias("minute"), F.lit(1).alias("d"))
              .unionByName(valid.select(after.alias("minute"), F.lit(-1).alias("d")))
              .groupBy("minute").agg(F.sum("d").alias("d")))
    per_day = max(1, C.DAY_MS // bucket_ms)
    day = X.floor_div("minute", per_day)
    level = R.running_sum(points, ["minute"], "d", day, "level")
    spans = R.next_row(level, "minute", ["minute"], day).filter(F.col("level") > 0)
    held = spans.select(F.col("minute").alias("since"), "next_minute", F.col("level").cast("bigint").alias("naive_concurrency"))
    return R.expand(held, F.col("since"), F.col("next_minute") - 1, per_day).select("minute", "naive_concurrency")


def foreground_series(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("minute").agg(F.sum("sessions").cast("bigint").alias("foreground_concurrency"))


def naive_vs_foreground(rollup: DataFrame, raw: DataFrame, bucket_ms: int) -> DataFrame:
    """Per minute: foreground, naive, overcount; 0 where a series is absent."""
    naive = series_from_intervals(naive_intervals(raw, True), bucket_ms)
    fg = foreground_series(rollup)
    return (fg.join(naive, "minute", "full")
            .select("minute",
                    X.minute_utc_seconds("minute", bucket_ms).alias("minute_utc"),
                    F.coalesce("foreground_concurrency", F.lit(0)).cast("bigint").alias("foreground_concurrency"),
                    F.coalesce("naive_concurrency", F.lit(0)).cast("bigint").alias("naive_concurrency"))
            .withColumn("overcount", F.col("naive_concurrency") - F.col("foreground_concurrency")))


def overcount(nvf: DataFrame, window: DataFrame) -> DataFrame:
    """One row: peaks, their minutes (earliest on ties), dense-window averages.

    Averages run over the minutes of the dense window present in either
    series, which is how the published figure is defined. Where nobody is in
    the foreground there is no ratio: the percentages are null.
    """
    lo = window.select("dense_min_minute").scalar()
    hi = window.select("dense_max_minute").scalar()
    joined = nvf
    in_dense = (F.col("minute") >= lo) & (F.col("minute") <= hi)
    fg, nv = F.col("foreground_concurrency"), F.col("naive_concurrency")
    fg_avg = F.avg(F.when(in_dense, fg))
    nv_avg = F.avg(F.when(in_dense, nv))
    return joined.agg(
        F.max(fg).alias("foreground_peak"),
        F.max_by("minute_utc", F.struct(fg, -F.col("minute"))).alias("foreground_peak_utc"),
        F.max(nv).alias("naive_peak"),
        F.max_by("minute_utc", F.struct(nv, -F.col("minute"))).alias("naive_peak_utc"),
        (F.lit(100.0) * (F.try_divide(F.max(nv).cast("double"), F.max(fg).cast("double")) - 1)).alias("peak_overcount_pct"),
        fg_avg.alias("foreground_average"),
        nv_avg.alias("naive_average"),
        (F.lit(100.0) * (F.try_divide(nv_avg, fg_avg) - 1)).alias("average_overcount_pct"),
    )
