from peakview import config as C
from peakview.operators import quality as Q
from tests.fixtures import BASE_MS, content_df, raw_df, row

TH = C.TELEMETRY


def _beats(every_s, n=150, sessions=2, content_id=1, platform="IPHONE", ms_scale=True):
    rows = []
    for s in range(sessions):
        rows.append(row(f"p{s}", "START", 0, content_id=content_id, platform=platform))
        rows += [row(f"p{s}", "beat", every_s * (i + 1), content_id=content_id, platform=platform) for i in range(n)]
        rows.append(row(f"p{s}", "pause", every_s * (n + 1), content_id=content_id, platform=platform))
    return rows


def _verdicts(spark, rows):
    return {(r["check"], r["severity"]) for r in Q.preflight_checks(raw_df(spark, rows), content_df(spark), TH).collect()}


def test_forty_second_beats_pass(spark):
    v = _verdicts(spark, _beats(40))
    assert not {x for x in v if x[1] == "problem"}
    assert ("cadence", "warning") not in v


def test_sixty_second_beats_fail(spark):
    assert ("cadence", "problem") in _verdicts(spark, _beats(60))


def test_five_second_beats_warn(spark):
    v = _verdicts(spark, _beats(5))
    assert ("cadence", "warning") in v and ("cadence", "problem") not in v


def test_seconds_timestamps_fail(spark):
    rows = [r[:4] + ((r[4] // 1000),) + r[5:] for r in _beats(40)]
    assert ("timestamps", "problem") in _verdicts(spark, rows)


def test_unknown_content_id_fails(spark):
    assert ("content_ids", "problem") in _verdicts(spark, _beats(40, content_id=999))


def test_no_recognised_event_types_fails(spark):
    rows = [row("h", "beat", 40 * i) for i in range(200)]
    assert ("vocabulary", "problem") in _verdicts(spark, rows)


def test_unknown_platform_only_warns(spark):
    v = _verdicts(spark, _beats(40, platform="FRIDGE"))
    assert ("benchmark_slices", "warning") in v
    assert not {x for x in v if x[1] == "problem"}


def test_base_is_minute_aligned():
    assert BASE_MS % 60_000 == 0
