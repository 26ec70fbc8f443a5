"""Threshold sensitivity sweep over a (gap, grace) grid.

On-states and neighbouring points do not depend on the thresholds, so the
events are sessionized once. What a cell needs of that is one row per
non-empty piece: its time, the next point's, the piece before it and how the
segment around it began. All cells are evaluated on these rows in one
aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from . import naive, sessionize

S = "video_session_id"


def grid(th: C.Thresholds) -> list[C.Thresholds]:
    """3 x 3 cells scaled from the profile like the telemetry grid around (90 s, 40 s)."""
    gaps = [th.gap_ms * g // 90 for g in C.SWEEP_GAPS_S]
    graces = [th.grace_ms * r // 40 for r in C.SWEEP_GRACES_S]
    return [th.with_(gap_ms=g, grace_ms=r) for g in gaps for r in graces if r <= g]


def pieces(points: DataFrame) -> DataFrame:
    """(t, next_t, before_t, before_next_t, silence, begins) of every on-point that is on for a while.

    `points` are point_states. `before_*` is the piece before it, where it can
    reach into this one's bucket. A segment's first piece either `begins` at a
    switch to on, or follows a `silence` longer than the gap. Of the points of
    one millisecond only the last has a piece, so a switch counts if it was at
    this piece's own time.
    """
    w = Window.partitionBy(S, "chunk").orderBy(F.col("minute"), F.col("ord"), F.col("dims").desc())
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    switched = points.withColumn("was_on", F.coalesce(F.lag("is_on").over(w), F.col("carry_on"))).select(
        "*", F.max(F.when(F.col("is_on") & ~F.col("was_on"), F.col("t"))).over(run).alias("on_since"),
        # the last earlier point of another millisecond; the chunk's first point has it from the carry
        F.max(F.when(F.col("prev_t") < F.col("t"), F.col("prev_t"))).over(run).alias("earlier_t"))
    mine = switched.filter(F.col("is_on") & (F.col("next_t").isNull() | (F.col("next_t") > F.col("t"))))
    first = F.lag("t").over(w).isNull()
    return mine.select(
        "t", "next_t",
        F.when(first, F.when(F.col("carry_on"), F.col("prev_last_t"))).otherwise(F.lag("t").over(w)).alias("before_t"),
        F.when(first, F.when(F.col("carry_on"), F.col("chunk_first_t"))).otherwise(F.lag("next_t").over(w)).alias("before_next_t"),
        (F.col("t") - F.col("earlier_t")).alias("silence"),
        F.coalesce(F.col("on_since") == F.col("t"), F.lit(False)).alias("begins"))


def cells(points: DataFrame, thresholds: list[C.Thresholds], bucket_ms: int) -> DataFrame:
    """Segments and the covered buckets' counts of every (gap_ms, grace_ms)."""
    grid_of = F.array(*[F.struct(F.lit(t.gap_ms).alias("gap_ms"), F.lit(t.grace_ms).alias("grace_ms")) for t in thresholds])
    gap, grace = F.col("cell.gap_ms"), F.col("cell.grace_ms")

    def end(t: str, next_t: str) -> Column:
        return F.when(F.col(next_t).isNull() | (F.col(next_t) - F.col(t) > gap), F.col(t) + grace).otherwise(F.col(next_t))

    covered = X.floor_div(end("before_t", "before_next_t") - 1, bucket_ms)
    lo = X.floor_div("t", bucket_ms)
    lo = F.when(covered == lo, lo + 1).otherwise(lo)
    hi = X.floor_div(end("t", "next_t") - 1, bucket_ms)
    rows = pieces(points).select("*", F.explode(grid_of).alias("cell")).select(
        "cell", (F.col("begins") | (F.col("silence") > gap)).alias("opens"), lo.alias("lo"), hi.alias("hi"))
    # a piece is no longer than the gap, so it covers few buckets
    spread = rows.select("cell", "opens", F.posexplode_outer(F.when(F.col("lo") <= F.col("hi"), F.sequence("lo", "hi"))).alias("at", "minute"))
    per_minute = spread.groupBy("cell", "minute").agg(
        F.count("minute").alias("c"), F.count_if(F.col("opens") & (F.coalesce("at", F.lit(0)) == 0)).alias("opened"))
    return per_minute.groupBy("cell").agg(
        F.sum("opened").alias("segments"), F.max("c").alias("peak"),
        F.max_by("minute", F.struct(F.col("c"), -F.col("minute"))).alias("peak_minute"),
        (F.sum("c").cast("double") / (F.max("minute") - F.min("minute") + 1).cast("double")).alias("average"),
        F.sum("c").cast("bigint").alias("session_minutes")).select("cell.*", "segments", "peak", "peak_minute", "average", "session_minutes")


def sweep(raw: DataFrame, th: C.Thresholds) -> DataFrame:
    """One row per grid cell; naive intervals start at the first event (trap 10)."""
    nv = naive.series_from_intervals(naive.naive_intervals(raw, from_session_start=False), th.bucket_ms)
    naive_peak = nv.agg(F.max("naive_concurrency")).scalar()
    found = cells(sessionize.point_states(sessionize.event_points(raw, th)), grid(th), th.bucket_ms)
    all_cells = raw.sparkSession.createDataFrame([(t.gap_ms, t.grace_ms) for t in grid(th)], "gap_ms bigint, grace_ms bigint")
    return (all_cells.join(found, ["gap_ms", "grace_ms"], "left")
            .withColumn("segments", F.coalesce("segments", F.lit(0)))
            .withColumn("naive_peak", naive_peak)
            .withColumn("peak_minus_naive", F.col("peak") - F.col("naive_peak")))
