"""Instantaneous overlap: intervals clipped to minutes, merged, swept.

Occupancy counts a session in a minute if it played at any point of it;
the instantaneous peak counts sessions playing at one moment. The sweep is
a running sum of +1/-1 points; only the points of one minute are put in order,
minutes are folded as (net, largest prefix) summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .. import session as _session
from ..functions import exprs as X
from ..functions import running as R

S = "video_session_id"


def clipped(intervals: DataFrame, session_minutes: DataFrame, bucket_ms: int) -> DataFrame:
    """Every interval cut at minute edges, with that minute's dimensions."""
    b = bucket_ms
    pieces = intervals.select(
        S, "ts_start_ms", "ts_end_ms",
        F.explode(F.sequence(X.floor_div("ts_start_ms", b), X.floor_div(F.col("ts_end_ms") - 1, b))).alias("minute"))
    return (pieces.join(session_minutes, [S, "minute"], "inner")
            .withColumn("clip_start", F.greatest("ts_start_ms", F.col("minute") * b))
            .withColumn("clip_end", F.least("ts_end_ms", (F.col("minute") + 1) * b))
            .drop("ts_start_ms", "ts_end_ms"))


_ENDS = (F.min, "clip_start"), (F.max, "clip_end")


def _merged(pieces: DataFrame, part: list[str]) -> DataFrame:
    """Touching pieces of one `part` merged: one shuffle, one sort."""
    w = Window.partitionBy(*part).orderBy("clip_start", "clip_end")
    prior = F.max("clip_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(F.coalesce(prior < F.col("clip_start"), F.lit(True)), F.col("clip_start"))
    return (pieces.withColumn("opened", opened)
            .withColumn("span", F.max("opened").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*part, "span").agg(*[f(c).alias(c) for f, c in _ENDS]).drop("span"))


def merge_touching(pieces: DataFrame, keys: list[str] | None = None, chunk_ms: int = C.DAY_MS) -> DataFrame:
    """Merge pieces of one session that touch or overlap into continuous spans.

    Pieces are cut into time chunks by start and merged inside their chunk,
    once, into a written table. Only spans that reach over their chunk's end,
    and spans that such a reach touches, are merged further: at most two rows
    per chunk, so no window spans all pieces of a session. Pieces with a null
    key go with nothing.
    """
    part = [S, *(keys or [])]
    p = (pieces.select(*part, "clip_start", "clip_end").dropna(subset=part)
         .withColumn("chunk", X.floor_div("clip_start", chunk_ms)))
    crosses = F.col("clip_end") >= (F.col("chunk") + 1) * chunk_ms
    reach = (p.filter(crosses)
             .select(*part, F.explode(F.sequence(F.col("chunk") + 1, X.floor_div("clip_end", chunk_ms))).alias("chunk"), "clip_end")
             .groupBy(*part, "chunk").agg(F.max("clip_end").alias("in_end")))
    spans = _session.written(
        _merged(p, [*part, "chunk"]).join(reach.hint("shuffle_hash"), [*part, "chunk"], "left")
        .withColumn("reached", F.coalesce(F.col("in_end") >= F.col("clip_start"), F.lit(False)))
        .withColumn("crosses", crosses).drop("in_end"), "spans")
    edge = F.col("reached") | F.col("crosses")
    # all that a reach touches in a chunk is one span with it; at most one other span crosses the chunk's end
    edges = spans.filter(edge).groupBy(*part, "chunk", "reached").agg(*[f(c).alias(c) for f, c in _ENDS])
    joined = _merged(edges, part)
    columns = [*part, "clip_start", "clip_end"]
    return spans.filter(~edge).select(*columns).unionByName(joined.select(*columns))


def sweep_peak(spans: DataFrame, start: str, end: str, closed: bool, keys: list[str] | None = None,
               bucket_ms: int = C.MINUTE_MS) -> DataFrame:
    """Max number of spans live at one instant, per `keys`.

    Half-open [start, end): at a tie ends apply before starts. Closed
    [start, end]: starts apply before ends (touching spans overlap).
    Points of one instant are added up map-side; a task orders the instants of
    one `bucket_ms` and, from there, summaries.
    """
    k = list(keys or [])
    # both points of a span from one reading of it
    edges = F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))
    points = (spans.select(*k, F.inline(edges))
              .groupBy(*k, "t", "d").agg(F.sum("d").alias("v")))
    order: list[Column] = [F.col("t"), F.col("d").desc() if closed else F.col("d").asc()]
    peak = R.peak_of_running_sum(points, order, "v", X.floor_div("t", bucket_ms), "peak", partition=k)
    return peak.select(*k, F.col("peak").cast("bigint"))
