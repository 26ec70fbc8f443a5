import uuid

import numpy as np
from pyspark.sql import functions as F

from peakview import config as C
from peakview import session as _session
from peakview.plans import pipeline as P
from peakview.streaming import open_sessions as LS
from tests.conftest import SF0001
from tests.fixtures import BASE_MS, CASES, EV, case_rows, content_df, raw_df, row

RETENTION = 6 * C.DAY_MS


def _scratch(spark, name):
    return _session.scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _batch(spark, raw, th):
    return P.build(raw, content_df(spark), th).intervals.select("video_session_id", "ts_start_ms", "ts_end_ms")


def test_state_machine_equals_the_hand_worked_cases_however_it_is_cut():
    th = C.TELEMETRY
    kinds = {"START": 1, "PLAY": 2, "resume": 2, "FG": 3, "pause": 4, "BG": 5, "END": 6, "ERROR": 6, "beat": 0}
    assert set(kinds) == set(EV)
    for events, expected in CASES.values():
        points = sorted({(int(sec * 1000) * 8 + kinds[name]) for name, sec in events})
        for cut in range(len(points) + 1):
            state, closed = (None,) * 6, []
            for part in (points[:cut], points[cut:]):
                ords = np.array(part, np.int64)
                state, done, *_ = LS.advance(state, ords >> 3, ords & 7, th.gap_ms, th.grace_ms)
                closed += done
            if state[5] is not None:
                closed.append((state[5], state[0] + th.grace_ms))
            assert closed == [(a * 1000, b * 1000) for a, b in expected], (events, cut)


def test_late_and_repeated_points_are_told_apart():
    t = np.array([1000, 1000, 1000, 2000], np.int64)
    state, closed, applied, late, repeated = LS.advance((None,) * 6, t, np.array([1, 1, 0, 0]), 90_000, 40_000)
    assert (applied, late, repeated) == (3, 0, 1) and state[1] == 16_000 and not closed
    again = LS.advance(state, t, np.array([1, 1, 0, 4]), 90_000, 40_000)
    assert again[2:] == (1, 3, 0) and again[1] == [(1000, 2000)]


def test_live_equals_batch_on_hand_worked_sessions(spark):
    raw = raw_df(spark, case_rows())
    table = LS.replay(spark, raw, C.TELEMETRY, _scratch(spark, "replay-test"), slices=2, state_partitions=2)
    assert _same(LS.intervals_with_predictions(table, C.TELEMETRY), _batch(spark, raw, C.TELEMETRY))


def test_live_equals_batch_on_driver_events_with_compaction(spark):
    b = P.driver_build(spark, SF0001, C.DRIVER)
    table = LS.replay(spark, b.raw, C.DRIVER, _scratch(spark, "replay-test"), slices=4, files=2, compact_every=2, state_partitions=2, retention_ms=RETENTION)
    assert _same(LS.intervals_with_predictions(table, C.DRIVER), b.intervals.select("video_session_id", "ts_start_ms", "ts_end_ms"))
    assert table.compacted() is not None
    base = spark.read.parquet(f"{table.folder}/base/upto={table.compacted()}")
    assert base.filter("NOT is_open").count() == 0 and base.count() < b.raw.select("video_session_id").distinct().count()


def test_seeded_stream_goes_on_where_the_batch_stopped(spark):
    th = C.TELEMETRY
    raw = raw_df(spark, case_rows())
    batch = {(r.video_session_id, r.ts_start_ms, r.ts_end_ms) for r in _batch(spark, raw, th).collect()}
    cut = BASE_MS + 55_000
    before = P.build(raw.filter(F.col("t_ms") < cut), content_df(spark), th)
    seed = LS.session_state(before.states)
    table = LS.replay(spark, raw.filter(F.col("t_ms") >= cut), th, _scratch(spark, "seeded"), slices=2, seed=seed, state_partitions=2)
    going = {(r.video_session_id, r.seg_start) for r in seed.filter("seg_start IS NOT NULL").collect()}
    done = {tuple(r) for r in before.intervals.select("video_session_id", "ts_start_ms", "ts_end_ms").collect()}
    live = {tuple(r) for r in LS.intervals_with_predictions(table, th).collect()}
    assert going and {x for x in done if x[:2] not in going} | live == batch


def test_seed_agrees_with_the_open_sessions_of_the_batch(spark):
    b = P.driver_build(spark, SF0001, C.DRIVER).materialize("intervals")
    opened = LS.open_session_seed(b.raw, b.intervals, C.DRIVER)
    state = LS.session_state(b.states)
    assert state.count() == b.raw.select("video_session_id").distinct().count()
    seeded = state.filter("seg_start IS NOT NULL").select(
        "video_session_id", F.col("seg_start").alias("segment_start_ms"), F.col("last_t").alias("last_active_ms"), F.col("last_ord").alias("version"))
    # a session whose last event leaves it off is in neither
    assert opened.join(seeded, ["video_session_id", "segment_start_ms", "last_active_ms", "version"], "left_anti").count() == 0
    assert seeded.count() == opened.count()


def test_quiet_sessions_are_closed_and_forgotten(spark):
    th, folder = C.TELEMETRY, _scratch(spark, "forget")
    early = raw_df(spark, [row(f"q{i}", "START", i) for i in range(20)])
    later = [raw_df(spark, [row("z", "beat", sec)]) for sec in (400, 3000, 6000)]
    for i, part in enumerate([early, *later]):
        part.coalesce(1).write.parquet(f"{folder}/in/{i:04d}")
    live = LS.streaming_session(spark, 2)
    table = LS.StateTable(live, f"{folder}/out")
    ended = LS.run_to_completion(LS.live_records(LS.read_stream(live, f"{folder}/in"), th, retention_ms=600_000), table, f"{folder}/ckpt")
    rows = [p["stateOperators"][0]["customMetrics"] for p in ended.recentProgress if p["stateOperators"]]
    assert len(rows) >= 4
    table.spark = spark
    closed = {(r.video_session_id, r.ts_end_ms) for r in table.records().filter("record = 'interval'").collect()}
    assert closed >= {(f"q{i}", BASE_MS + i * 1000 + th.grace_ms) for i in range(20)}
    states = live.read.format("statestore").option("stateVarName", "session").load(f"{folder}/ckpt")
    assert states.count() == 1  # twenty sessions were held, one that was heard of lately is left


def test_intake_keeps_late_rows_aside(spark):
    th, folder = C.TELEMETRY, _scratch(spark, "intake")
    parts = [[row("z", "START", 0), row("z", "beat", 100), row("z", "beat", 200)],
             [row("z", "pause", 150), row("y", "START", 10), row("z", "beat", 210), row("z", "beat", 210)],
             [row("x", "START", 5), row("z", "END", 230)]]
    for i, rows in enumerate(parts):
        raw_df(spark, rows).coalesce(1).write.parquet(f"{folder}/in/{i:04d}")
    live = LS.streaming_session(spark, 2)
    LS.intake(LS.read_stream(live, f"{folder}/in"), folder, f"{folder}/ckpt-intake", delay_ms=90_000)
    marks = {r.batch: (r.input_rows, r.late_rows) for r in LS.marks(spark, folder).collect()}
    assert marks == {0: (3, 0), 1: (4, 1), 2: (2, 1)}
    aside = sorted((r.video_session_id, r.batch) for r in LS.late_events(spark, folder).collect())
    assert aside == [("x", 2), ("y", 1)]
    table = LS.StateTable(live, f"{folder}/out")
    LS.run_to_completion(LS.live_records(LS.on_time_stream(live, folder), th, 90_000), table, f"{folder}/ckpt")
    table.spark = spark
    told = table.records().filter("record = 'state'").agg(F.sum("applied_rows"), F.sum("late_rows"), F.sum("repeated_rows")).first()
    # the pause at 150 is within the delay, but after the session's beat at 200 was applied
    assert tuple(told) == (5, 1, 1) and sum(told) + 2 == 9
    # run again over nothing new: nothing changes
    LS.intake(LS.read_stream(live, f"{folder}/in"), folder, f"{folder}/ckpt-intake", delay_ms=90_000)
    assert LS.marks(spark, folder).count() == 3


def test_current_state_takes_the_latest_version(spark):
    th, folder = C.TELEMETRY, _scratch(spark, "latest")
    parts = [[row("a", "START", 0), row("b", "START", 0), row("a", "beat", 30)],
             [row("a", "beat", 30), row("a", "beat", 60), row("b", "pause", 50)]]
    for i, rows in enumerate(parts):
        raw_df(spark, rows).coalesce(1).write.parquet(f"{folder}/in/{i:04d}")
    live = LS.streaming_session(spark, 2)
    table = LS.StateTable(live, f"{folder}/out")
    LS.run_to_completion(LS.live_records(LS.read_stream(live, f"{folder}/in"), th), table, f"{folder}/ckpt")
    table.spark = spark
    now = {r.video_session_id: (r.segment_start_ms - BASE_MS, r.last_active_ms - BASE_MS) for r in table.open_now().collect()}
    assert now == {"a": (0, 60_000)}
    table.compact(1)
    assert {r.video_session_id for r in table.open_now().collect()} == {"a"}
    assert table.open_now(as_of_ms=BASE_MS + 200_000, gap_ms=th.gap_ms).count() == 0


def test_nothing_to_stream(spark):
    table = LS.replay(spark, raw_df(spark, []), C.TELEMETRY, _scratch(spark, "nothing"), slices=1, state_partitions=1)
    assert LS.intervals_with_predictions(table, C.TELEMETRY).count() == 0
    assert LS.StateTable(spark, _scratch(spark, "unwritten")).open_now().count() == 0
