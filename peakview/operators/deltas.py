"""Second path to the series: signed run boundaries and their running sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from ..functions import running as R

S = "video_session_id"


def runs(session_minutes: DataFrame, chunk_buckets: int = 1440) -> DataFrame:
    """Runs of consecutive minutes in which a session keeps one tuple.

    A run is a maximal chain of touching one-bucket pieces [m, m + 1) of one
    (session, tuple), so it is built by the chunked merge of touching pieces:
    no window spans a whole session or a whole run.
    """
    from .instant import merge_touching
    keys = list(C.ROLLUP_DIMS)
    pieces = session_minutes.select(S, *keys, F.col("minute").alias("clip_start"),
                                    (F.col("minute") + 1).alias("clip_end"))
    merged = merge_touching(pieces, keys, chunk_ms=chunk_buckets)
    return merged.select(S, *keys, F.col("clip_start").alias("first_minute"),
                         (F.col("clip_end") - 1).alias("last_minute"))


def minute_deltas(session_minutes: DataFrame) -> DataFrame:
    """Signed rollup: +1 where a run starts, -1 the minute after it ends.

    Each session-minute contributes +1 at its minute and -1 at the next
    minute under the same tuple; inside a run the two cancel, so after the
    sum only run boundaries remain. Zero rows are dropped on write.
    """
    keys = list(C.ROLLUP_DIMS)
    plus = session_minutes.select(*keys, "minute", F.lit(1).alias("d"))
    minus = session_minutes.select(*keys, (F.col("minute") + 1).alias("minute"), F.lit(-1).alias("d"))
    return (plus.unionByName(minus)
            .groupBy(*keys, "minute").agg(F.sum("d").cast("bigint").alias("delta"))
            .filter(F.col("delta") != 0))


def series_from_deltas(deltas: DataFrame, session_minutes: DataFrame, bucket_ms: int) -> DataFrame:
    """Concurrency per minute as the running sum of deltas on a dense spine.

    The spine runs over the time of `session_minutes` and one more minute; it is
    made in the plan, in stretches of a day. The running sum is two-level (per day, then carried), so no single task
    orders the whole span. Minutes whose running total is zero are omitted.
    """
    per_day = max(1, C.DAY_MS // bucket_ms)
    ends = session_minutes.agg(F.min("minute").alias("lo"), (F.max("minute") + 1).alias("hi")).filter("lo IS NOT NULL")
    spine = R.expand(ends, F.col("lo"), F.col("hi"), per_day).select("minute", F.lit(0).cast("bigint").alias("d"))
    per_minute = (deltas.select("minute", F.col("delta").alias("d")).unionByName(spine)
                  .groupBy("minute").agg(F.sum("d").alias("d")))
    cum = R.running_sum(per_minute, ["minute"], "d", X.floor_div("minute", per_day), "concurrency")
    return cum.filter(F.col("concurrency") != 0).select("minute", F.col("concurrency").cast("bigint"))
