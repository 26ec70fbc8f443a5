"""Active playback: classify events, carry play and foreground state, cut segments.

A session is split into time chunks of ``chunk_ms``. Every window runs per
(session, chunk), so a session of any size is spread over many tasks; a
small per-chunk summary (one row per session and chunk) carries the state
across chunk edges. The result equals running the windows over whole
sessions, which is what the SQL oracle does.

Shuffles: the raw events are hash-partitioned once on (session, chunk); the
dedupe and every window reuse that partitioning. The per-chunk summary is
aggregated from the scan with a map-side partial aggregation, so it moves
one row per session-chunk and task, never the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X

S = "video_session_id"

# One ordering for every window over the points. Ordering by bucket first is
# the same order as by `ord` (the bucket is monotone in time), and it lets the
# per-bucket window share the sort of the per-chunk windows: one sort in all.
def _in_bucket_order():
    return (F.col("ord"), F.col("dims").desc())


def _w():
    return Window.partitionBy(S, "chunk").orderBy(F.col("minute"), *_in_bucket_order())


def event_points(raw: DataFrame, th: C.Thresholds) -> DataFrame:
    """Raw events as points (session, chunk, t, kind, ord, minute, dims).

    Not yet partitioned: `states` hash-partitions the points once on
    (session, chunk) for the windows, and aggregates the per-chunk carry
    summary straight from the scan, partially on the map side.
    """
    return (raw.select(
        F.col(S),
        F.col("t_ms").alias("t"),
        X.kind("event_type", "event").alias("kind"),
        X.dims_struct().alias("dims"),
    ).withColumn("chunk", X.floor_div("t", th.chunk_ms))
        .withColumn("ord", X.ord_key("t", "kind"))
        .withColumn("minute", X.floor_div("t", th.bucket_ms))
        # keys are required (the carry join would drop rows without them anyway)
        .filter(F.col(S).isNotNull() & F.col("chunk").isNotNull()))


def _chunk_carry(points: DataFrame) -> DataFrame:
    """Per (session, chunk): the state handed over from the neighbouring chunks.

    Plain long min/max aggregates over the points (the last play and
    foreground signals are encoded as ord * 2 + signal): a hash aggregation,
    partial on the map side, over a scan of the few narrow columns it needs,
    so what it shuffles is one partial row per session-chunk and task, not
    the events, and the window pass over the points runs once. One row per
    session-chunk; the window over it is per session and as long as the
    session's chunk count.
    """
    ps, fs = X.playing_signal("kind"), X.foreground_signal("kind")
    summary = points.groupBy(S, "chunk").agg(
        F.max(F.when(ps.isNotNull(), F.col("ord") * 2 + ps)).alias("lp_code"),
        F.max(F.when(fs.isNotNull(), F.col("ord") * 2 + fs)).alias("lf_code"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
        F.min("minute").alias("first_minute"),
    ).select(S, "chunk", "first_t", "last_t", "first_minute",
             F.pmod("lp_code", F.lit(2)).alias("last_play"), F.pmod("lf_code", F.lit(2)).alias("last_fg"))
    w = Window.partitionBy(S).orderBy("chunk")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(
        S, "chunk",
        F.last("last_play", ignorenulls=True).over(before).alias("in_play"),
        F.last("last_fg", ignorenulls=True).over(before).alias("in_fg"),
        F.lag("chunk").over(w).isNotNull().alias("has_prev"),
        F.lag("last_t").over(w).alias("prev_last_t"),
        F.lead("first_t").over(w).alias("next_first_t"),
        F.lead("first_minute").over(w).alias("next_first_minute"),
        F.col("first_t").alias("chunk_first_t"),
    )


def point_states(points: DataFrame) -> DataFrame:
    """Every distinct point with its on-state and its neighbours in time (P4, W1, W2): no threshold enters here.

    Points repeated at one (session, t, kind) collapse to one, keeping the
    largest tuple. Columns added: is_on, prev_t, next_t, mld (last tuple of
    the point's bucket), next_minute, next_mld, and for the chunk's edges
    carry_on, prev_last_t, chunk_first_t, first_in_chunk, last_in_chunk.
    """
    w = _w()
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_bucket = (Window.partitionBy(S, "chunk", "minute").orderBy(*_in_bucket_order())
                 .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # the one shuffle of the events: hash on (session, chunk), shared by every window below
    distinct = (points.repartition(S, "chunk").withColumn("_prev_ord", F.lag("ord").over(w))
                .filter(F.col("_prev_ord").isNull() | (F.col("_prev_ord") != F.col("ord")))
                .drop("_prev_ord"))
    local = distinct.select(
        "*",
        F.last(X.playing_signal("kind"), ignorenulls=True).over(run).alias("lp"),
        F.last(X.foreground_signal("kind"), ignorenulls=True).over(run).alias("lf"),
        F.last("dims").over(in_bucket).alias("mld"),
    ).select(
        "*",
        F.lag("t").over(w).alias("prev_t_local"),
        F.lead("t").over(w).alias("next_t_local"),
        F.lead("minute").over(w).alias("next_minute_local"),
        F.lead("mld").over(w).alias("next_mld_local"),
    )
    carry = _chunk_carry(points)
    in_on = (F.coalesce("in_play", F.lit(1)) == 1) & (F.coalesce("in_fg", F.lit(1)) == 1)
    last_in_chunk = F.col("next_t_local").isNull()
    # shuffle-hash join: only the small carry side moves, and the points keep
    # their sort order, so the windows below need no new sort
    return local.join(carry.hint("shuffle_hash"), [S, "chunk"], "inner").select(
        S, "chunk", "t", "kind", "ord", "minute", "dims", "mld",
        ((F.coalesce("lp", "in_play", F.lit(1)) == 1)
         & (F.coalesce("lf", "in_fg", F.lit(1)) == 1)).alias("is_on"),
        F.when(F.col("has_prev"), in_on).otherwise(F.lit(False)).alias("carry_on"),
        F.coalesce("prev_t_local", "prev_last_t").alias("prev_t"),
        F.when(last_in_chunk, F.col("next_first_t")).otherwise(F.col("next_t_local")).alias("next_t"),
        F.when(last_in_chunk, F.col("next_first_minute")).otherwise(F.col("next_minute_local")).alias("next_minute"),
        F.col("next_mld_local").alias("next_mld"),
        last_in_chunk.alias("last_in_chunk"),
        F.col("prev_t_local").isNull().alias("first_in_chunk"),
        "prev_last_t", "chunk_first_t",
    )


def states(points: DataFrame, th: C.Thresholds) -> DataFrame:
    """Every distinct point with its on-state, segment opening and piece end.

    On top of `point_states`: opens, pe (end of the piece [t, pe) an on-point
    contributes), last_minute, hi (last bucket the piece emits), is_piece, owed
    and prev_cov (last bucket already emitted before the row).

    A piece of a chunk's last point may end in the next chunk's first bucket;
    that bucket's tuple is only known there, so the next chunk emits it
    (`owed` on its first point) and this chunk stops one bucket short.
    """
    w = _w()
    gap, grace = F.lit(th.gap_ms), F.lit(th.grace_ms)
    joined = point_states(points)
    pe = (F.when(F.col("next_t").isNull() | (F.col("next_t") - F.col("t") > gap), F.col("t") + grace)
          .otherwise(F.col("next_t")))
    # the piece the previous chunk's last point hands into this chunk, if on
    carried_pe = (F.when(F.col("chunk_first_t") - F.col("prev_last_t") > gap, F.col("prev_last_t") + grace)
                  .otherwise(F.col("chunk_first_t")))
    staged = joined.select(
        "*",
        F.coalesce(F.lag("is_on").over(w), F.col("carry_on")).alias("prev_on"),
        pe.alias("pe"),
    ).withColumn(
        "opens",
        F.col("is_on") & (~F.col("prev_on")
                          | (F.col("prev_t").isNotNull() & (F.col("t") - F.col("prev_t") > gap))),
    ).withColumn(
        "last_minute", X.floor_div(F.col("pe") - 1, th.bucket_ms),
    ).withColumn(
        # the carried piece ends in this chunk's first bucket: this chunk emits that bucket
        "owed",
        F.col("first_in_chunk") & F.col("carry_on")
        & (X.floor_div(carried_pe - 1, th.bucket_ms) == F.col("minute")),
    ).withColumn(
        "carry_cov",
        F.when(F.col("carry_on"), F.when(F.col("owed"), F.col("minute") - 1)
               .otherwise(X.floor_div(carried_pe - 1, th.bucket_ms))),
    ).withColumn(
        "is_piece", F.col("is_on") & (F.col("pe") > F.col("t")),
    ).withColumn(
        # a chunk's last piece whose final bucket holds the next chunk's first point stops short
        "hi",
        F.when(F.col("last_in_chunk") & (F.col("last_minute") == F.col("next_minute")), F.col("last_minute") - 1)
        .otherwise(F.col("last_minute")),
    )
    covers = F.when(F.col("is_piece"), F.col("hi")).when(F.col("owed"), F.col("minute"))
    return staged.withColumn(
        "prev_cov",
        F.greatest(F.max(covers).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("carry_cov")),
    ).drop("carry_cov", "prev_last_t", "chunk_first_t", "carry_on", "last_in_chunk", "first_in_chunk")


def session_minutes_events(st: DataFrame) -> DataFrame:
    """(session, minute, event dims): every bucket an active piece covers, once.

    A piece [t, pe) covers buckets m(t)..m(pe-1). Its first bucket is skipped
    when an earlier row already emitted it, so no (session, minute) is
    produced twice and no distinct (and no extra shuffle) is needed. The
    tuple of a covered bucket is the last tuple observed at or before it:
    the point's own bucket uses the last tuple of that bucket; a piece's
    final bucket uses the next point's bucket when that point lies inside it.
    A chunk's first point also emits its bucket when the previous chunk's
    last piece ends there (`owed`).
    """
    rows = st.filter(F.col("is_piece") | F.col("owed"))
    lo = (F.when(F.col("is_piece") & (F.col("prev_cov") >= F.col("minute")), F.col("minute") + 1)
          .otherwise(F.col("minute")))
    hi = F.when(F.col("is_piece"), F.col("hi")).otherwise(F.col("minute"))
    spans = rows.select(
        S, "minute", "last_minute", "mld", "next_minute", "next_mld",
        F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))).alias("m"),
    )
    use_next = ((F.col("m") == F.col("last_minute")) & (F.col("m") > F.col("minute"))
                & (F.col("next_minute") == F.col("last_minute")))
    dims = F.when(use_next, F.col("next_mld")).otherwise(F.col("mld"))
    return spans.select(S, F.col("m").alias("minute"), dims.alias("d")).select(
        S, "minute", *[F.col(f"d.{n}").alias(n) for n in C.EVENT_DIMS])


def active_intervals(st: DataFrame, th: C.Thresholds) -> DataFrame:
    """Half-open active intervals (session, segment_id, ts_start_ms, ts_end_ms).

    A segment can span chunks; its start is the last opening point at or
    before each on-point, carried across chunk edges by a second per-chunk
    summary.
    """
    w = _w()
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens_t = F.when(F.col("opens"), F.col("t"))
    last_open = st.groupBy(S, "chunk").agg(F.max(opens_t).alias("last_open"))
    wc = Window.partitionBy(S).orderBy("chunk")
    carry = last_open.select(
        S, "chunk",
        F.last("last_open", ignorenulls=True).over(wc.rowsBetween(Window.unboundedPreceding, -1)).alias("in_open"))
    seg = (st.join(carry.hint("shuffle_hash"), [S, "chunk"], "inner")
           .select("*", F.coalesce(F.last(opens_t, ignorenulls=True).over(run), F.col("in_open")).alias("seg_start"))
           .filter("is_on"))
    intervals = (seg.groupBy(S, "seg_start")
                 .agg(F.max_by("pe", "ord").alias("ts_end_ms"))
                 .select(S, F.col("seg_start").alias("ts_start_ms"), "ts_end_ms")
                 .filter(F.col("ts_end_ms") > F.col("ts_start_ms")))
    return number_segments(intervals, th)


def number_segments(intervals: DataFrame, th: C.Thresholds) -> DataFrame:
    """segment_id = rank of the interval's start within its session.

    Two-level: intervals per (session, chunk of start) are counted, the counts
    of earlier chunks summed over the small per-chunk table, and added to the
    rank inside the chunk, so no window spans a whole session.
    """
    iv = intervals.withColumn("c0", X.floor_div("ts_start_ms", th.chunk_ms))
    counts = iv.groupBy(S, "c0").agg(F.count(F.lit(1)).alias("n"))
    wc = Window.partitionBy(S).orderBy("c0").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(S, "c0", F.coalesce(F.sum("n").over(wc), F.lit(0)).alias("base"))
    inner = Window.partitionBy(S, "c0").orderBy("ts_start_ms")
    return (iv.join(offsets.hint("shuffle_hash"), [S, "c0"], "inner")
            .select(S, (F.col("base") + F.row_number().over(inner)).cast("bigint").alias("segment_id"),
                    "ts_start_ms", "ts_end_ms"))


def sessionize(raw: DataFrame, th: C.Thresholds) -> DataFrame:
    """Point states for a raw event DataFrame (entry point of the build)."""
    return states(event_points(raw, th), th)
