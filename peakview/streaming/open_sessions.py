"""Live sessions with Structured Streaming.

Three streaming pieces, each restartable from its own checkpoint:

* **Intake** (T5): arriving events are split before any watermark. Rows at or
  below the high-water mark of the earlier batches (largest event time seen,
  less the allowed delay) go to the `late` side of the landed table, all others
  to the `on_time` side. Nothing is dropped: late + on time = input, per batch,
  in `marks`. The side table is what the next batch rebuild picks up.
* **Sessions** (T1, T6): `transformWithStateInPandas` over the on-time events,
  keyed by bucket of sessions, state in RocksDB. An on-point after an off-point, or more than `gap`
  after the previous point, opens a segment; it closes at the next point when
  that point switches off, or at last + grace when the next point is further
  than `gap` away. One event-time timer per bucket closes the segments whose
  sessions went quiet, and removes a session's state `retention` after its
  last event, so state shrinks. The stream starts from the batch build's
  session state (T3, J7), handed over as the operator's initial state.
* **Current state** (T2): every micro-batch writes one versioned state row per
  session it touched (version = ord of its last event). Readers take the
  highest version per session; compaction folds old batches into a base table
  of the open sessions.

Closed intervals plus `last_active + grace` of the open segments equal the
batch intervals (T4), from a cold start and from a seeded one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .. import config as C
from .. import session as _session
from ..functions import exprs as X

S = "video_session_id"

RAW_STREAM_SCHEMA = (
    "video_session_id string, user_id string, event_type string, event string, t_ms bigint, "
    "session_start_ms bigint, platform string, app_version string, country string, "
    "audio_language string, subtitle_language string, player_version string, content_id bigint, "
    "video_resolution string"
)

OUTPUT_SCHEMA = ("record string, video_session_id string, ts_start_ms long, ts_end_ms long, last_active_ms long, "
                 "version long, is_open boolean, applied_rows long, late_rows long, repeated_rows long")

_RECORD = Row(*[c.split()[0] for c in OUTPUT_SCHEMA.split(", ")])

# what a session carries from one micro-batch to the next; the batch build seeds the same columns
SEED_COLUMNS = ("last_t", "last_ord", "on_last", "play", "fg", "seg_start")
# without nulls: -1 is no signal yet, seg_start counts where is_open
STATE_SCHEMA = ("video_session_id string, last_t long, last_ord long, on_last boolean, play int, fg int, is_open boolean, seg_start long")

#: buckets the sessions are dealt into, fixed when a stream first starts; a bucket is one key of the state store
BUCKETS = 1024

_NONE = -1
_PLAY = np.full(7, _NONE)
_PLAY[[C.KIND_START, C.KIND_PLAY, C.KIND_PAUSE, C.KIND_STOP]] = 1, 1, 0, 0
_FG = np.full(7, _NONE)
_FG[[C.KIND_START, C.KIND_FOREGROUND, C.KIND_BACKGROUND]] = 1, 1, 0


def _filled(signal: np.ndarray, before: int | None) -> np.ndarray:
    """Each place's last signal so far; `before` (default on) where there is none yet."""
    at = np.maximum.accumulate(np.where(signal == _NONE, -1, np.arange(len(signal))))
    return np.where(at < 0, 1 if before is None else before, signal[at])


def advance(state: tuple, t: np.ndarray, kind: np.ndarray, gap: int, grace: int):
    """One session's new points on top of its state.

    Returns (state, [(start, end), ...] of the segments closed, applied, late, repeated).
    Points at or before the last one applied are late; a repeated (t, kind) counts once.
    """
    last_t, last_ord, on_last, play, fg, seg_start = state
    ords = t * 8 + kind
    fresh = np.ones(len(ords), bool) if last_ord is None else ords > last_ord
    late = int(len(ords) - fresh.sum())
    ords = np.unique(ords[fresh])
    repeated = len(t) - late - len(ords)
    if not len(ords):
        return state, [], 0, late, repeated
    t, kind = ords >> 3, ords & 7
    play_now, fg_now = _filled(_PLAY[kind], play), _filled(_FG[kind], fg)
    on = (play_now == 1) & (fg_now == 1)
    was_open = np.concatenate([[seg_start is not None], on[:-1]])
    before = np.concatenate([[t[0] if last_t is None else last_t], t[:-1]])
    far = t - before > gap
    starts = t[on & (~was_open | far)].tolist()
    closing = was_open & (far | ~on)
    ends = np.where(far, before + grace, t)[closing].tolist()
    if seg_start is not None:
        starts.insert(0, seg_start)
    closed = [(a, b) for a, b in zip(starts, ends) if b > a]
    signal = lambda s, kinds, old: int(s[-1]) if old is not None or (kinds[kind] != _NONE).any() else None
    new = (int(t[-1]), int(ords[-1]), bool(on[-1]), signal(play_now, _PLAY, play), signal(fg_now, _FG, fg),
           starts[-1] if on[-1] else None)
    return new, closed, len(ords), late, repeated


class Sessions(StatefulProcessor):
    """The sessions of one bucket: their states in one list, one timer for the earliest that needs attention.

    A call to the state store costs the same for one session as for the
    hundreds of a bucket, so a bucket's states are read and written together.
    """

    def __init__(self, gap_ms: int, grace_ms: int, retention_ms: int):
        self.gap, self.grace, self.retention = gap_ms, grace_ms, retention_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getListState("session", STATE_SCHEMA)

    def _due(self, s: tuple) -> int:
        """When the session next needs attention if nothing arrives: to close its segment, or to be forgotten."""
        return s[0] + (self.gap if s[5] is not None else self.retention) + 1

    def _held(self) -> dict[str | None, tuple]:
        return {sid: (t, o, on, None if play == _NONE else play, None if fg == _NONE else fg, seg if is_open else None)
                for sid, t, o, on, play, fg, is_open, seg in self.state.get()}

    def _keep(self, held: dict[str | None, tuple]) -> None:
        if held:
            self.state.put([(sid, t, o, on, _NONE if play is None else play, _NONE if fg is None else fg, seg is not None, seg or 0)
                            for sid, (t, o, on, play, fg, seg) in held.items()])
        else:
            self.state.clear()

    def _arrange(self, held: dict[str | None, tuple]) -> None:
        """One timer, at or before the first session that is due."""
        due, timers = min(map(self._due, held.values())), list(self.handle.listTimers())
        if not timers or due < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)

    def _row(self, sid: str, s: tuple, applied: int = 0, late: int = 0, repeated: int = 0) -> Row:
        return _RECORD("state", sid, s[5], None, s[0], s[1], s[5] is not None, applied, late, repeated)

    def _interval(self, sid: str, start: int, end: int) -> Row:
        return _RECORD("interval", sid, start, end, None, None, None, None, None, None)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        held = self._held()
        for sid, *s in initialState[[S, *SEED_COLUMNS]].astype(object).itertuples(index=False):
            t, o, on, play, fg, seg = (None if pd.isna(x) else x for x in s)
            held[_name(sid)] = (int(t), int(o), bool(on), *(None if x is None else int(x) for x in (play, fg, seg)))
        self._arrange(held)
        self._keep(held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        points = pd.concat(list(rows), ignore_index=True)
        if points["t"].isna().any():
            raise ValueError("an event without a time reached the sessions")
        which, names = pd.factorize(points[S], use_na_sentinel=False)
        order = np.argsort(which, kind="stable")
        t, kind = (points[c].to_numpy(np.int64)[order] for c in ("t", "kind"))
        edges = np.cumsum(np.bincount(which, minlength=len(names)))
        held, out = self._held(), []
        for sid, a, b in zip(map(_name, names), [0, *edges], edges):
            s, closed, *counts = advance(held.get(sid, (None,) * 6), t[a:b], kind[a:b], self.gap, self.grace)
            held[sid] = s
            out += [self._interval(sid, start, end) for start, end in closed]
            out.append(self._row(sid, s, *counts))
        self._arrange(held)
        self._keep(held)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held, out = timerValues.getCurrentWatermarkInMs(), self._held(), []
        for sid, s in list(held.items()):
            if s[5] is not None and s[0] + self.gap < now:  # quiet for longer than gap: it ended at last + grace
                start, s = s[5], (*s[:5], None)
                held[sid] = s
                if s[0] + self.grace > start:
                    out.append(self._interval(sid, start, s[0] + self.grace))
                out.append(self._row(sid, s))
            if s[5] is None and s[0] + self.retention < now:
                del held[sid]
        if held:  # the timer that expired is still listed, and goes after this call
            self.handle.registerTimer(min(map(self._due, held.values())))
        self._keep(held)
        if out:
            yield _frame(out)


def _name(sid) -> str | None:
    return None if pd.isna(sid) else sid


def _frame(records: list[Row]) -> pd.DataFrame:
    return pd.DataFrame(records, columns=_RECORD, dtype=object)


def live_records(events: DataFrame, th: C.Thresholds, watermark_ms: int | None = None, seed: DataFrame | None = None,
                 retention_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Streaming: raw events -> interval / state records.

    `seed` (session and SEED_COLUMNS) is where the sessions start; `retention_ms`
    must cover the longest silence after which a session may still go on
    (default 30 days): after it a session starts anew.
    """
    pts = events.select(
        S, F.col("t_ms").alias("t"), X.kind("event_type", "event").alias("kind"),
        F.timestamp_millis("t_ms").alias("event_time"))
    delay = watermark_ms if watermark_ms is not None else th.gap_ms
    spark = events.sparkSession
    _session.ship_package(spark)
    bucket = F.pmod(F.xxhash64(S), F.lit(buckets)).alias("bucket")
    start = None if seed is None else seed.select(bucket, S, *SEED_COLUMNS).groupBy("bucket")
    return (pts.select(bucket, "*").withWatermark("event_time", f"{delay} milliseconds").groupBy("bucket")
            .transformWithStateInPandas(Sessions(th.gap_ms, th.grace_ms, retention_ms or 30 * C.DAY_MS), OUTPUT_SCHEMA, "Append", "EventTime", start))


def session_state(states: DataFrame) -> DataFrame:
    """What every session of a batch build carries on (SEED_COLUMNS), to start the stream from.

    One partial aggregation over the build's point states; no window.
    """
    ps, fs = X.playing_signal("kind"), X.foreground_signal("kind")
    last = states.groupBy(S).agg(
        F.max("t").alias("last_t"), F.max("ord").alias("last_ord"),
        (F.pmod(F.max(F.col("ord") * 2 + F.col("is_on").cast("int")), F.lit(2)) == 1).alias("on_last"),
        F.pmod(F.max(F.when(ps.isNotNull(), F.col("ord") * 2 + ps)), F.lit(2)).cast("int").alias("play"),
        F.pmod(F.max(F.when(fs.isNotNull(), F.col("ord") * 2 + fs)), F.lit(2)).cast("int").alias("fg"),
        F.max(F.when(F.col("opens"), F.col("t"))).alias("opened"))
    return last.select(S, "last_t", "last_ord", "on_last", "play", "fg", F.when(F.col("on_last"), F.col("opened")).alias("seg_start"))


# --------------------------------------------------------------------------
# intake: nothing vanishes at the watermark
# --------------------------------------------------------------------------

MARKS_SCHEMA = "batch long, input_rows long, late_rows long, high_ms long"


def _mark_before(spark: SparkSession, folder: str, batch_id: int) -> int | None:
    """Largest event time of the batches before this one."""
    if not batch_id:
        return None
    return spark.read.schema(MARKS_SCHEMA).parquet(f"{folder}/marks/id={batch_id - 1}").first().high_ms


def intake(events: DataFrame, folder: str, checkpoint: str, delay_ms: int) -> None:
    """Land the stream's events under `folder`, late rows apart, until no file is left (T5).

    Layout: landed/batch=<id>/side=on_time|late and marks/id=<id>. A batch is
    written once and overwrites itself when it is run again.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        high = _mark_before(spark, folder, batch_id)
        late = F.lit(False) if high is None else F.coalesce(F.col("t_ms") <= F.lit(high - delay_ms), F.lit(False))
        seen = Observation(f"intake-{batch_id}")
        (batch.withColumn("side", F.when(late, "late").otherwise("on_time"))
         .observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == "late").alias("late"), F.max("t_ms").alias("high"))
         .write.mode("overwrite").partitionBy("side").parquet(f"{folder}/landed/batch={batch_id}"))
        got = seen.get
        highest = max((x for x in (high, got["high"]) if x is not None), default=None)
        (spark.createDataFrame([(batch_id, got["n"], got["late"], highest)], MARKS_SCHEMA).coalesce(1)
         .write.mode("overwrite").parquet(f"{folder}/marks/id={batch_id}"))

    _until_done(events, sink, checkpoint)


def marks(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, input_rows, late_rows, high_ms) of every batch taken in."""
    return spark.read.schema(MARKS_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{folder}/marks")


def late_events(spark: SparkSession, folder: str) -> DataFrame:
    """The side table: late events with the batch they came in."""
    return (spark.read.schema(RAW_STREAM_SCHEMA + ", side string, batch long").option("basePath", f"{folder}/landed")
            .parquet(f"{folder}/landed").filter("side = 'late'").drop("side"))


def on_time_stream(spark: SparkSession, folder: str, max_files: int | None = 1) -> DataFrame:
    """The landed on-time events as a stream, in the order they were taken in."""
    return _files(spark, max_files).parquet(f"{folder}/landed/batch=*/side=on_time")


# --------------------------------------------------------------------------
# sinks and the current state
# --------------------------------------------------------------------------

def _files(spark: SparkSession, max_files: int | None):
    """Raw events as they land; `max_files` bounds a micro-batch, None takes all that is there."""
    reader = spark.readStream.schema(RAW_STREAM_SCHEMA)
    return reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)


def read_stream(spark: SparkSession, folder: str, max_files: int | None = 1) -> DataFrame:
    return _files(spark, max_files).option("recursiveFileLookup", "true").parquet(folder)


def _until_done(stream: DataFrame, sink, checkpoint: str):
    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


class StateTable:
    """Latest-wins session state under one folder.

    Layout: records/batch=<id> (what the stream wrote, the upserts among them),
    base/upto=<id> (open sessions after batch <id>) and an empty marker
    compacted/<id>, made last. Reading takes the last marked base and the
    batches after it and keeps the highest version per session; at one version
    a closed row wins over an open one, since only the timer writes a version
    twice. Every write overwrites itself when its batch is run again.
    """

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = 0):
        self.spark, self.folder, self.every = spark, folder, compact_every

    def start_from(self, seed: DataFrame) -> None:
        """The open sessions of a batch build's session state are the base before the first batch."""
        (seed.filter("seg_start IS NOT NULL")
         .select(S, F.col("seg_start").alias("segment_start_ms"), F.col("last_t").alias("last_active_ms"),
                 F.col("last_ord").alias("version"), F.lit(True).alias("is_open"))
         .write.mode("overwrite").parquet(f"{self.folder}/base/upto=-1"))
        self._mark(-1)

    def _mark(self, upto: int) -> None:
        fs, marker = self._path(f"compacted/{upto}")
        fs.create(marker, True).close()

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def compacted(self) -> int | None:
        fs, path = self._path("compacted")
        done = [int(f.getPath().getName()) for f in fs.listStatus(path)] if fs.exists(path) else []
        return max(done, default=None)

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """The sink of the live stream: one write per micro-batch, and a compaction after some of them."""
        self.spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{self.folder}/records/batch={batch_id}")
        if self.every and batch_id % self.every == self.every - 1:
            self.compact(batch_id)

    def compact(self, upto: int) -> None:
        self.latest(upto).filter("is_open").write.mode("overwrite").parquet(f"{self.folder}/base/upto={upto}")
        self._mark(upto)

    def records(self) -> DataFrame:
        fs, path = self._path("records")
        if not fs.exists(path):  # no batch yet
            return self.spark.createDataFrame([], OUTPUT_SCHEMA + ", batch long")
        return (self.spark.read.schema(OUTPUT_SCHEMA + ", batch long").option("basePath", f"{self.folder}/records")
                .parquet(f"{self.folder}/records"))

    def latest(self, upto: int | None = None) -> DataFrame:
        """(session, segment_start_ms, last_active_ms, version, is_open): the highest version of every session."""
        columns = [S, F.col("ts_start_ms").alias("segment_start_ms"), "last_active_ms", "version", "is_open"]
        base = self.compacted()
        rows = self.records().filter(F.col("record") == "state")
        if base is not None:
            rows = rows.filter(F.col("batch") > base)
        if upto is not None:
            rows = rows.filter(F.col("batch") <= upto)
        rows = rows.select(*columns)
        if base is not None:
            rows = rows.unionByName(self.spark.read.parquet(f"{self.folder}/base/upto={base}"))
        newest = F.max_by(F.struct("segment_start_ms", "last_active_ms", "version", "is_open"), F.struct("version", ~F.col("is_open")))
        return rows.groupBy(S).agg(newest.alias("s")).select(S, "s.*")

    def open_now(self, as_of_ms: int | None = None, gap_ms: int = 0) -> DataFrame:
        """Sessions with an open segment; with `as_of_ms` only those active within `gap_ms` before it."""
        rows = self.latest().filter("is_open").drop("is_open")
        return rows if as_of_ms is None else rows.filter(F.col("last_active_ms") + gap_ms >= as_of_ms)


def run_to_completion(records: DataFrame, table: StateTable, checkpoint: str):
    """Process every available file into a state table; return the ended query."""
    return _until_done(records, table.upsert, checkpoint)


def intervals_with_predictions(table: StateTable, th: C.Thresholds) -> DataFrame:
    """Closed intervals plus each still-open segment closed at last_active + grace (T4)."""
    closed = table.records().filter(F.col("record") == "interval").select(S, "ts_start_ms", "ts_end_ms")
    return closed.unionByName(table.open_now().select(
        S, F.col("segment_start_ms").alias("ts_start_ms"), (F.col("last_active_ms") + th.grace_ms).alias("ts_end_ms")))


def open_session_seed(build_raw: DataFrame, intervals: DataFrame, th: C.Thresholds) -> DataFrame:
    """Sessions still open at the end of a batch.

    The last event is not a pause, background or stop, and the session's last
    interval ends exactly at last event + grace.
    """
    k = X.kind("event_type", "event")
    last = build_raw.groupBy(S).agg(F.max_by(k, F.struct("t_ms", k)).alias("last_kind"),
                                    F.max("t_ms").alias("last_t"))
    last_seg = intervals.groupBy(S).agg(F.max_by(F.struct("ts_start_ms", "ts_end_ms"), "segment_id").alias("iv"))
    return (last.join(last_seg, S, "inner")
            .filter(~F.col("last_kind").isin(C.KIND_PAUSE, C.KIND_BACKGROUND, C.KIND_STOP)
                    & (F.col("iv.ts_end_ms") == F.col("last_t") + th.grace_ms))
            .select(S, F.col("iv.ts_start_ms").alias("segment_start_ms"), F.col("last_t").alias("last_active_ms"),
                    (F.col("last_t") * 8 + F.col("last_kind")).alias("version")))


# --------------------------------------------------------------------------
# replay
# --------------------------------------------------------------------------

def land_slices(raw: DataFrame, folder: str, slice_of, slices: int, files: int = 1) -> None:
    """Land events as `slices` groups of `files` files, one after the other, so a replay sees them arrive in that order."""
    columns = [c.split()[0] for c in RAW_STREAM_SCHEMA.split(", ")]
    numbered = raw.withColumn("slice", slice_of).select("slice", *columns)
    numbered.write.mode("overwrite").partitionBy("slice").parquet(f"{folder}/arrivals")
    for i in range(slices):
        part = raw.sparkSession.read.schema(numbered.schema).parquet(f"{folder}/arrivals").filter(F.col("slice") == i).drop("slice")
        part.repartition(files).write.mode("overwrite").parquet(f"{folder}/in/{i:04d}")


def time_slices(raw: DataFrame, slices: int):
    """The slice of an event when the whole time range is cut into equal parts."""
    lo, hi = raw.agg(F.min("t_ms"), F.max("t_ms")).first()
    if lo is None:  # no events
        return F.lit(0)
    width = max(1, (hi - lo) // slices + 1)
    return X.floor_div(F.col("t_ms") - F.lit(lo), width)


def streaming_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session for a live query; its shuffle partitions fix the state store's partition count.

    The count is fixed when the query first starts, so it is set on purpose
    (default: the cluster's parallelism) rather than inherited. State lives in
    RocksDB and checkpoints its changes, not its whole.
    """
    s = spark.newSession()
    n = state_partitions or spark.sparkContext.defaultParallelism
    s.conf.set("spark.sql.shuffle.partitions", str(n))
    s.conf.set("spark.sql.session.timeZone", "UTC")
    s.conf.set("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return s


def replay(spark: SparkSession, raw: DataFrame, th: C.Thresholds, folder: str, slices: int = 4, files: int = 1,
           seed: DataFrame | None = None, state_partitions: int | None = None, compact_every: int = 0, **options) -> StateTable:
    """Stream the events through the live path in time order; return its state table."""
    land_slices(raw, folder, time_slices(raw, slices), slices, files)
    live = streaming_session(spark, state_partitions)
    start = None
    if seed is not None:  # written once, read by the live session
        seed.write.mode("overwrite").parquet(f"{folder}/seed")
        start = live.read.parquet(f"{folder}/seed")
    records = live_records(read_stream(live, f"{folder}/in", files), th, seed=start, **options)
    table = StateTable(spark, f"{folder}/out", compact_every)
    if start is not None:
        table.start_from(start)
    run_to_completion(records, table, f"{folder}/checkpoint")
    table.spark = spark
    return table
