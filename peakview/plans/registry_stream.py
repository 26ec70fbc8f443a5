"""Registered live-path queries: open-session seed, stream replay, tumbling windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config as C
from .. import session as _session
from ..functions import filters as FL
from ..streaming import open_sessions as LS
from . import oracle as O
from . import pipeline as P
from . import serving as SV
from .registry import TH, register

B = TH.bucket_ms


def _b(spark, sf):
    return P.driver_build(spark, sf, TH)


@register("T3_open_session_seed", O.with_model(f"""
SELECT ai.video_session_id, ai.ts_start_ms AS segment_start_ms, le.last_t AS last_active_ms,
       le.last_t * 8 + le.last_kind AS version
FROM (SELECT video_session_id, arg_max(k, (t_ms, k)) AS last_kind, max(t_ms) AS last_t
      FROM (SELECT *, {O._kind_sql()} AS k FROM raw) GROUP BY 1) le
JOIN (SELECT video_session_id, max(segment_id) AS ms FROM active_intervals GROUP BY 1) ls
  ON ls.video_session_id = le.video_session_id
JOIN active_intervals ai ON ai.video_session_id = ls.video_session_id AND ai.segment_id = ls.ms
WHERE le.last_kind NOT IN (4, 5, 6) AND ai.ts_end_ms = le.last_t + {TH.grace_ms}""", TH))
def q_seed(spark, sf):
    b = _b(spark, sf)
    return LS.open_session_seed(b.raw, b.intervals, TH)


def _folder(spark, name):
    return _session.scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


# sessions of the driver profile last five days at most, so a quiet one is forgotten after six
RETENTION = 6 * C.DAY_MS


@register("T4_stream_replay_equals_batch", O.with_model(
    "SELECT video_session_id, ts_start_ms, ts_end_ms FROM active_intervals", TH))
def q_replay(spark, sf):
    table = LS.replay(spark, _b(spark, sf).raw, TH, _folder(spark, "replay"), files=2, retention_ms=RETENTION)
    return LS.intervals_with_predictions(table, TH)


@register("T1_seeded_resume", O.with_model(
    "SELECT video_session_id, ts_start_ms, ts_end_ms FROM active_intervals", TH))
def q_seeded_resume(spark, sf):
    """Batch up to the middle of the time range, the stream from there on: together the whole batch's intervals."""
    raw = _b(spark, sf).raw
    half = LS.time_slices(raw, 2)
    before = P.build(raw.filter(half == 0), P.driver.content(spark, sf), TH)
    seed = LS.session_state(before.states)
    table = LS.replay(spark, raw.filter(half == 1), TH, _folder(spark, "resume"), slices=2, files=2, seed=seed, retention_ms=RETENTION)
    seeded = spark.read.parquet(f"{table.folder}/base/upto=-1").select(
        "video_session_id", F.col("segment_start_ms").alias("ts_start_ms"))
    done = before.intervals.join(seeded, ["video_session_id", "ts_start_ms"], "left_anti")  # the others go on in the stream
    return done.select("video_session_id", "ts_start_ms", "ts_end_ms").unionByName(LS.intervals_with_predictions(table, TH))


@register("T2_current_state", O.with_model(f"""
SELECT s AS video_session_id, min(t) FILTER (WHERE seg = last_seg AND is_on) AS segment_start_ms,
       max(t) AS last_active_ms, max(ord) AS version
FROM (SELECT *, max(seg) OVER (PARTITION BY s) AS last_seg, max(t) OVER () AS now FROM st3)
GROUP BY s, now HAVING arg_max(is_on, ord) AND max(t) + {TH.gap_ms} >= now""", TH))
def q_current_state(spark, sf):
    """Two micro-batches whose times overlap: rows both of them hold are applied once; then a compaction and one more."""
    raw = _b(spark, sf).raw
    lo, hi = raw.agg(F.min("t_ms"), F.max("t_ms")).first()
    at = (F.col("t_ms") - F.lit(lo)) / F.lit(hi - lo + 1)
    arriving = raw.withColumn("slice", F.explode(F.when(at < 0.4, F.array(F.lit(0))).when(at < 0.6, F.array(F.lit(0), F.lit(1)))
                                                  .when(at < 0.9, F.array(F.lit(1))).otherwise(F.array(F.lit(2)))))
    folder = _folder(spark, "state")
    LS.land_slices(arriving, folder, F.col("slice"), 3, 2)
    live = LS.streaming_session(spark)
    table = LS.StateTable(spark, f"{folder}/out", compact_every=2)
    # the second batch reaches back: the watermark lets a fifth of the range pass
    LS.run_to_completion(LS.live_records(LS.read_stream(live, f"{folder}/in", 2), TH, watermark_ms=(hi - lo) // 4, retention_ms=RETENTION),
                         table, f"{folder}/checkpoint")
    table.spark = spark
    return table.open_now(as_of_ms=hi, gap_ms=TH.gap_ms)


LATE_SLICES, LATE_DELAY = 4, 3 * C.DAY_MS

# one event in seven arrives a slice late, one in 31 arrives twice
_ARRIVALS_SQL = f"""
ev AS (
  SELECT video_session_id AS s, t_ms AS t, t_ms * 8 + ({O._kind_sql()}) AS ord,
         least({LATE_SLICES - 1}, (t_ms - lo) // greatest(1, (hi - lo) // {LATE_SLICES} + 1) + CASE WHEN t_ms % 7 = 0 THEN 1 ELSE 0 END) AS batch,
         unnest(CASE WHEN t_ms % 31 = 0 THEN [1, 2] ELSE [1] END) AS copy
  FROM raw, (SELECT min(t_ms) AS lo, max(t_ms) AS hi FROM raw)),
mark AS (SELECT batch, max(max(t)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {LATE_DELAY} AS late_upto FROM ev GROUP BY batch),
judged AS (SELECT ev.*, coalesce(t <= late_upto, false) AS late FROM ev JOIN mark USING (batch)),
seen AS (SELECT s, batch, max(max(ord)) OVER (PARTITION BY s ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ord
         FROM judged WHERE NOT late GROUP BY s, batch)"""


@register("T5_late_rows", O.with_model(f"""
SELECT CAST(batch AS BIGINT) AS batch, count(*) AS input_rows, count(*) FILTER (WHERE late) AS late_rows,
       count(*) FILTER (WHERE NOT late AND ord <= last_ord) AS out_of_order_rows,
       count(DISTINCT (s, ord)) FILTER (WHERE NOT late AND (last_ord IS NULL OR ord > last_ord)) AS applied_rows,
       count(*) FILTER (WHERE NOT late AND (last_ord IS NULL OR ord > last_ord))
         - count(DISTINCT (s, ord)) FILTER (WHERE NOT late AND (last_ord IS NULL OR ord > last_ord)) AS repeated_rows
FROM judged LEFT JOIN seen USING (s, batch) GROUP BY batch""", TH, _ARRIVALS_SQL))
def q_late_rows(spark, sf):
    """Four scheduled runs of intake and sessions; every row is applied, repeated, out of order or late."""
    raw = _b(spark, sf).raw
    slow = F.when(F.col("t_ms") % 7 == 0, 1).otherwise(0)
    arriving = (raw.withColumn("slice", F.least(F.lit(LATE_SLICES - 1), LS.time_slices(raw, LATE_SLICES) + slow))
                .withColumn("copy", F.explode(F.when(F.col("t_ms") % 31 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))))
    folder = _folder(spark, "late")
    arriving.write.partitionBy("slice").parquet(f"{folder}/arrivals")
    live, runs = LS.streaming_session(spark), []
    for i in range(LATE_SLICES):
        (spark.read.schema(raw.schema.add("slice", "integer")).parquet(f"{folder}/arrivals").filter(F.col("slice") == i).drop("slice")
         .write.parquet(f"{folder}/in/{i:04d}"))
        LS.intake(LS.read_stream(live, f"{folder}/in", None), folder, f"{folder}/checkpoint-intake", LATE_DELAY)
        ended = LS.run_to_completion(LS.live_records(LS.on_time_stream(live, folder, None), TH, LATE_DELAY, retention_ms=RETENTION),
                                     LS.StateTable(live, f"{folder}/out"), f"{folder}/checkpoint-sessions")
        runs.append(ended.lastProgress["batchId"])
    run = F.array_size(F.filter(F.array(*map(F.lit, runs)), lambda last: last < F.col("batch")))
    told = (LS.StateTable(spark, f"{folder}/out").records().filter("record = 'state'").groupBy(run.cast("long").alias("batch"))
            .agg(*[F.sum(c).alias(c) for c in ("applied_rows", "late_rows", "repeated_rows")]))
    return (LS.marks(spark, folder).drop("high_ms")
            .join(told.withColumnRenamed("late_rows", "out_of_order_rows"), "batch", "left")
            .select("batch", "input_rows", "late_rows", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("out_of_order_rows", "applied_rows", "repeated_rows")]))


@register("T7_tumbling_day", O.with_model(f"""
SELECT CAST(minute * {B} // 86400000 * 86400 AS BIGINT) AS window_start_utc, max(c) AS peak_concurrency,
       CAST(sum(c) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS average_concurrency, count(*) AS minutes_in_window
FROM (SELECT minute, CAST(sum(sessions) AS BIGINT) AS c FROM minute_occupancy GROUP BY minute) GROUP BY 1""", TH))
def q_tumbling(spark, sf):
    return SV.tumbling(SV.occupancy(_b(spark, sf).rollup, FL.Resolved()), B, "1 day")


