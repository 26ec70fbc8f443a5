import random
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from peakview import config as C
from peakview import session as _session
from peakview.functions import filters as FL
from peakview.functions import running as R
from peakview.operators import deltas as D
from peakview.operators import instant as I
from peakview.operators import quality as Q
from peakview.plans import pipeline as P
from peakview.plans import serving as SV
from peakview.plans import store as ST
from peakview.plans import telemetry as TL
from tests.conftest import SF0001
from tests.fixtures import content_df, minute, raw_df, row


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame(
        [("audio_language", "hin"), ("audio_language", "HIN"), ("audio_language", "eng"),
         ("video_type", "live"), ("video_type", "vod"), ("platform", "IPHONE")],
        "dimension string, value string")


@pytest.mark.parametrize("asked,expected", [
    ("hin", {"audio_language": "hin"}), ("HIN", {"audio_language": "HIN"}), ("ENG", {"audio_language": "eng"}),
    (" eng ", {"audio_language": "eng"}), ("ALL", {}), ("*", {}), ("%", {}), ("", {}), ("none", {}),
])
def test_filter_resolution(catalogue, asked, expected):
    res = FL.resolve(catalogue, {"audio_language": asked})
    assert not res.impossible and res.equal == expected


def test_ambiguous_fold_matches_nothing(catalogue):
    res = FL.resolve(catalogue, {"audio_language": "Hin"})
    assert res.impossible and res.unknown == {"audio_language": "Hin"}
    with pytest.raises(ValueError, match="audio_language"):
        FL.resolve_strict(catalogue, {"audio_language": "Hin"})


def test_content_id_zero_means_no_filter(catalogue):
    assert FL.resolve(catalogue, {"content_id": 0}).equal == {}
    assert FL.resolve(catalogue, {"content_id": 7}).equal == {"content_id": 7}


def test_impossible_filter_reads_nothing(spark):
    b = P.driver_build(spark, SF0001, C.DRIVER)
    series = SV.occupancy_for(b.rollup, {"platform": "no-such-platform"})
    assert series.count() == 0
    ans = SV.answer(series).first()
    assert (ans["peak_concurrency"], ans["average_concurrency"], ans["active_minutes"]) == (0, 0.0, 0)


def test_store_projection_gives_the_same_answers(spark):
    b = P.driver_build(spark, SF0001, C.DRIVER)
    path = _session.scratch_path(spark, f"store-test-{uuid.uuid4().hex}")
    ST.write_store(b, path)
    store = ST.RollupStore(spark, path, C.DRIVER)
    for label, _, _ in C.BENCHMARKS:
        a = store.benchmark(label).first()
        e = SV.benchmark_one(b.rollup, label, C.DRIVER).first()
        assert a == e, label
    one = {r["query_label"]: r for r in store.benchmarks_one_scan().collect()}
    assert all(one[lbl]["peak_concurrency"] == store.benchmark(lbl).first()["peak_concurrency"]
               for lbl, _, _ in C.BENCHMARKS)
    # only questions on country/platform/video_type may use the projection
    assert store.table_for(FL.Resolved({"platform": "IPHONE"})) is store.projection
    assert store.table_for(FL.Resolved({"audio_language": "hin"})) is store.rollup


def test_overlap_cases(spark):
    th = C.TELEMETRY
    # A [0,60) and B [60,120): half-open peak 1, closed peak 2; one session per minute
    rows = [row("a", "START", 0), row("a", "pause", 60), row("b", "START", 60), row("b", "pause", 120)]
    b = P.build(raw_df(spark, rows), content_df(spark), th)
    half = I.sweep_peak(b.intervals, "ts_start_ms", "ts_end_ms", closed=False).first()["peak"]
    closed = I.sweep_peak(b.intervals, "ts_start_ms", "ts_end_ms", closed=True).first()["peak"]
    assert (half, closed) == (1, 2)
    occ = {r["minute"] - minute(0): r["concurrency"] for r in SV.occupancy(b.rollup, FL.Resolved()).collect()}
    assert occ == {0: 1, 1: 1}
    # A [0,30) and B [30,50): occupancy of minute 0 is 2, half-open peak 1
    rows = [row("a", "START", 0), row("a", "pause", 30), row("b", "START", 30), row("b", "pause", 50)]
    b = P.build(raw_df(spark, rows), content_df(spark), th)
    assert I.sweep_peak(b.intervals, "ts_start_ms", "ts_end_ms", closed=False).first()["peak"] == 1
    assert SV.occupancy(b.rollup, FL.Resolved()).first()["concurrency"] == 2


def test_deltas_rebuild_the_series_and_sum_to_zero(spark):
    b = P.driver_build(spark, SF0001, C.DRIVER)
    d = D.minute_deltas(b.session_minutes)
    assert d.agg(F.sum("delta")).first()[0] == 0
    diff = Q.two_way_difference(SV.occupancy(b.rollup, FL.Resolved()), D.series_from_deltas(d, b.session_minutes, C.HOUR_MS),
                                ["minute", "concurrency"]).first()
    assert (diff["only_left"], diff["only_right"]) == (0, 0)


def test_sum_over_any_dimension_equals_unfiltered(spark):
    b = P.driver_build(spark, SF0001, C.DRIVER)
    total = SV.occupancy(b.rollup, FL.Resolved())
    by_platform = (b.rollup.groupBy("platform", "minute").agg(F.sum("sessions").alias("c"))
                   .groupBy("minute").agg(F.sum("c").cast("bigint").alias("concurrency")))
    assert total.exceptAll(by_platform).count() == 0 and by_platform.exceptAll(total).count() == 0


def test_two_level_running_sum_equals_plain(spark):
    rnd = random.Random(7)
    data = [(rnd.randrange(0, 5000), rnd.choice([-1, 1]), rnd.randrange(1, 4)) for _ in range(3000)]
    df = spark.createDataFrame(data, "t long, d int, v int")
    for order in ([F.col("t"), F.col("d").asc()], [F.col("t"), F.col("d").desc()]):
        two = R.running_sum(df, order, "v", (F.col("t") / 97).cast("bigint"), "cum")
        plain = df.withColumn("cum", F.sum("v").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        # rows tied on the order may be summed in either order; compare the value at each distinct key
        key = ["t", "d"]
        a = two.groupBy(*key).agg(F.max("cum").alias("m"))
        p = plain.groupBy(*key).agg(F.max("cum").alias("m"))
        assert a.exceptAll(p).count() == 0


def test_salted_top_n_equals_plain(spark):
    rnd = random.Random(3)
    data = [("hot" if rnd.random() < 0.6 else f"g{rnd.randrange(5)}", rnd.randrange(10_000), i) for i in range(4000)]
    df = spark.createDataFrame(data, "g string, score int, id int")
    top = R.top_n(df, ["g"], [F.desc("score"), F.asc("id")], 5, salt_buckets=16)
    plain = (df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), F.asc("id"))))
             .filter("rank <= 5"))
    assert top.exceptAll(plain).count() == 0 and plain.exceptAll(top).count() == 0


def test_store_question_surface(spark):
    b = P.driver_build(spark, SF0001, C.DRIVER)
    path = _session.scratch_path(spark, f"store-tools-{uuid.uuid4().hex}")
    ST.write_store(b, path)
    store = ST.RollupStore(spark, path, C.DRIVER)
    peak = store.concurrency_peak({"platform": "iphone"}, grain_minutes=1440)
    expect = SV.answer(SV.occupancy_for(b.rollup, {"platform": "IPHONE"})).first()
    top = peak.first()
    assert top["overall_peak"] == expect["peak_concurrency"] == top["peak_concurrency"]
    series = store.concurrency_series({}).collect()
    assert 0 < len(series) <= C.MAX_SERIES_POINTS
    assert max(r["concurrency"] for r in series) == SV.occupancy(b.rollup, FL.Resolved()).agg(F.max("concurrency")).first()[0]
    slices = {r["value"]: r["peak"] for r in store.top_slices("platform").collect()}
    assert slices == {r["value"]: r["peak"] for r in SV.top_slices(b.rollup, "platform").collect()}
    over = store.overcount().first()
    assert over["foreground_peak"] == SV.occupancy(b.rollup, FL.Resolved()).agg(F.max("concurrency")).first()[0]
    assert over["naive_peak"] >= 0
    assert store.list_dimensions().filter("dimension = 'platform'").count() == 4


def test_store_serves_the_last_build_whole(spark):
    b = P.driver_build(spark, SF0001, C.DRIVER).materialize()
    path = _session.scratch_path(spark, f"store-versions-{uuid.uuid4().hex}")
    ST.write_store(b, path)
    store = ST.RollupStore(spark, path, C.DRIVER)
    label = C.BENCHMARKS[0][0]
    full = store.benchmark(label).first()
    last_day = b.raw.agg(F.max("t_ms")).first()[0] // C.DAY_MS
    small = P.build(b.raw.filter(F.col("t_ms") >= last_day * C.DAY_MS), b.content, C.DRIVER)
    ST.write_store(small, path)
    # the same store object, with no call to refresh, answers from the new build, and no older day is left
    now = store.benchmark(label).first()
    assert now == SV.benchmark_one(small.rollup, label, C.DRIVER).first()
    assert now["active_minutes"] < full["active_minutes"]
    assert store.rollup.count() == small.rollup.count()


def test_facts_of_inputs_where_nobody_is_active(spark):
    b = P.build(raw_df(spark, [row("a", "pause", 0)]), content_df(spark), C.TELEMETRY)
    cad = Q.cadence(b.raw, C.TELEMETRY).first()
    assert (cad["gaps"], cad["verdict"]) == (0, "warn")
    stats = Q.run_stats(b.raw, b.intervals, b.session_minutes, C.TELEMETRY.bucket_ms).first()
    assert (stats["sessions"], stats["sessions_with_no_active_time"], stats["segments"]) == (1, 1, 0)
    assert (stats["session_minutes"], stats["peak_concurrency"]) == (0, 0)
    metrics = {r["metric"]: r["value"] for r in TL.measure(b).collect()}
    assert metrics["raw_events"] == 1 and metrics["occupancy_rows"] == 0 and metrics["active_intervals"] == 0
