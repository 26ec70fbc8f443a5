import pytest

from peakview import config as C
from peakview.plans import pipeline as P
from tests.fixtures import BASE_MS, CASES, case_rows, content_df, minute, raw_df, row

WIDE = C.TELEMETRY
NARROW = C.Thresholds(gap_ms=90_000, grace_ms=40_000, bucket_ms=60_000, chunk_ms=120_000)


@pytest.mark.parametrize("th", [WIDE, NARROW], ids=["wide-chunk", "2-minute-chunk"])
def test_hand_worked_intervals(spark, th):
    b = P.build(raw_df(spark, case_rows()), content_df(spark), th)
    got = {}
    for r in b.intervals.collect():
        got.setdefault(r["video_session_id"], []).append(
            (r["segment_id"], (r["ts_start_ms"] - BASE_MS) / 1000, (r["ts_end_ms"] - BASE_MS) / 1000))
    for n, (_, expected) in CASES.items():
        segs = sorted(got.get(f"s{n:02d}", []))
        assert [(s, e) for _, s, e in segs] == [(float(a), float(b)) for a, b in expected], f"case {n}"
        assert [i for i, _, _ in segs] == list(range(1, len(expected) + 1))


@pytest.mark.parametrize("th", [WIDE, NARROW], ids=["wide-chunk", "2-minute-chunk"])
def test_minute_coverage(spark, th):
    b = P.build(raw_df(spark, case_rows()), content_df(spark), th)
    mins = {}
    for r in b.session_minutes.collect():
        mins.setdefault(r["video_session_id"], []).append(r["minute"] - minute(0))
    assert sorted(mins["s15"]) == [0]          # two segments in minute 0 count once
    assert sorted(mins["s09"]) == [0, 1, 2]    # [0,20) then [100,130)
    assert sorted(mins["s01"]) == [0, 1]       # [0,90)
    assert "s07" not in mins                   # no interval at all
    # the rollup sums to the session-minute count
    total = b.rollup.groupBy().sum("sessions").collect()[0][0]
    assert total == b.session_minutes.count()


@pytest.mark.parametrize("th", [WIDE, NARROW], ids=["wide-chunk", "2-minute-chunk"])
def test_tuple_in_effect(spark, th):
    rows = [row("x", "START", 0, content_id=1), row("x", "beat", 30, content_id=2),
            row("x", "beat", 70, content_id=3), row("x", "beat", 150, content_id=4)]
    b = P.build(raw_df(spark, rows), content_df(spark), th)
    got = {r["minute"] - minute(0): (r["content_id"], r["video_type"], r["show_name"])
           for r in b.session_minutes.collect()}
    # last tuple of a minute wins; a minute without events keeps the previous tuple
    assert got == {0: (2, "vod", "Show B"), 1: (3, "vod", "Show C"), 2: (4, "live", "Show D"),
                   3: (4, "live", "Show D")}


def test_minute_edge(spark):
    # [0, 60) covers minute 0 only; [0, 61) covers minutes 0 and 1
    rows = [row("a", "START", 0), row("a", "pause", 60),
            row("b", "START", 0), row("b", "pause", 61)]
    b = P.build(raw_df(spark, rows), content_df(spark), WIDE)
    mins = {}
    for r in b.session_minutes.collect():
        mins.setdefault(r["video_session_id"], set()).add(r["minute"] - minute(0))
    assert mins == {"a": {0}, "b": {0, 1}}


def test_order_and_duplicates_do_not_matter(spark):
    rows = case_rows()
    shuffled = list(reversed(rows)) + rows[::3]
    a = P.build(raw_df(spark, rows), content_df(spark), WIDE)
    b = P.build(raw_df(spark, shuffled), content_df(spark), NARROW)
    assert a.rollup.exceptAll(b.rollup).count() == 0
    assert b.rollup.exceptAll(a.rollup).count() == 0


def test_grace_above_gap_rejected():
    with pytest.raises(ValueError):
        C.Thresholds(gap_ms=60_000, grace_ms=90_000)


def test_chunk_width_does_not_change_results(spark):
    from tests.conftest import SF0001
    base = P.driver_build(spark, SF0001, C.DRIVER)
    narrow = P.driver_build(spark, SF0001, C.DRIVER.with_(chunk_ms=12 * C.HOUR_MS))
    wide = P.driver_build(spark, SF0001, C.DRIVER.with_(chunk_ms=400 * C.DAY_MS))
    for other in (narrow, wide):
        for t in ("intervals", "session_minutes", "rollup"):
            x, y = getattr(base, t), getattr(other, t)
            assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0, t
