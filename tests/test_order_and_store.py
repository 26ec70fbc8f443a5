"""Order-dependent helpers against plain windows, and what a store reads for a question."""

import random
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from peakview import config as C
from peakview import session as _session
from peakview.functions import filters as FL
from peakview.functions import running as R
from peakview.operators import naive as N
from peakview.operators import sessionize, sweep
from peakview.plans import pipeline as P
from peakview.plans import serving as SV
from peakview.plans import store as ST
from tests.conftest import SF0001
from tests.fixtures import case_rows, raw_df


def test_peak_of_running_sum_equals_plain(spark):
    rnd = random.Random(11)
    data = [(rnd.choice("ab"), rnd.randrange(-3000, 3000), rnd.choice([-3, -1, 1, 2])) for _ in range(4000)]
    points = spark.createDataFrame(data, "k string, t long, v int").groupBy("k", "t").agg(F.sum("v").alias("v"))
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.k: r.m for r in points.withColumn("s", F.sum("v").over(w)).groupBy("k").agg(F.max("s").alias("m")).collect()}
    for widths in ((4, 3), (1440, 366), ()):
        got = R.peak_of_running_sum(points, ["t"], "v", F.floor(F.col("t") / 7).cast("bigint"), "peak", ["k"], widths)
        assert {r.k: r.peak for r in got.collect()} == want


def test_global_rank_is_the_place_in_the_whole_order(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("xyz"), rnd.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a string, n int, i int").repartition(6)
    order = [F.asc("a"), F.desc("n"), F.asc("i")]
    got = {r.i: r.rank for r in R.global_rank(df, order).collect()}
    want = {r[2]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (r[0], -r[1], r[2])))}
    assert got == want
    assert R.global_rank(df.limit(0), order).count() == 0


@pytest.mark.parametrize("ways", [100, 1024])
def test_nearest_ranks_are_exact(spark, ways):
    rnd = random.Random(ways)
    values = {"wide": [rnd.randrange(-10**12, 10**12) for _ in range(500)], "steep": [int(1.05 ** rnd.randrange(400)) for _ in range(700)],
              "one": [7], "same": [3] * 50}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v long")
    hist = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    fractions = {"p0": 0.001, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for r in R.nearest_ranks(hist, "v", "n", fractions, ["k"], ways).collect():
        vs = sorted(values[r.k])
        assert r.total == len(vs)
        for name, f in fractions.items():
            assert r[name] == next(v for i, v in enumerate(vs) if i + 1 >= f * len(vs)), (r.k, name)
    alone = R.nearest_ranks(hist.filter("k = 'wide'").drop("k"), "v", "n", {"p50": 0.5}, ways=ways).first()
    assert alone.p50 == sorted(values["wide"])[249]
    assert R.nearest_ranks(hist.limit(0).drop("k"), "v", "n", {"p50": 0.5}).count() == 0


def test_expand_gives_every_number_once(spark):
    spans = [(1, 0, 0), (2, -5, 9), (3, 4, 3), (4, 95, 212), (5, 10, 19)]
    got = R.expand(spark.createDataFrame(spans, "i int, a long, b long"), F.col("a"), F.col("b"), 10, "m").collect()
    assert sorted((r.i, r.m) for r in got) == [(i, m) for i, a, b in spans for m in range(a, b + 1)]


def test_a_stray_time_makes_no_huge_array(spark):
    day = C.DAY_MS
    intervals = spark.createDataFrame([("a", 0, 3 * day), ("stray", 0, 40 * 365 * day)], "video_session_id string, ts_start_ms long, ts_end_ms long")
    series = N.series_from_intervals(intervals, C.MINUTE_MS)
    r = series.agg(F.count(F.lit(1)).alias("n"), F.sum("naive_concurrency").alias("s")).first()
    assert (r.n, r.s) == (40 * 365 * 1440, 40 * 365 * 1440 + 3 * 1440)


def test_grid_cells_equal_a_sessionization_each(spark):
    for raw, th in ((raw_df(spark, case_rows()), C.TELEMETRY), (P.driver_build(spark, SF0001, C.DRIVER).raw, C.DRIVER),
                    (P.driver_build(spark, SF0001, C.DRIVER).raw, C.DRIVER.with_(chunk_ms=30 * C.DAY_MS))):
        got = {(r.gap_ms, r.grace_ms): r for r in sweep.sweep(raw, th).collect()}
        for cell in sweep.grid(th)[1::5]:
            st = sessionize.sessionize(raw, cell)
            minutes = sessionize.session_minutes_events(st).groupBy("minute").agg(F.count(F.lit(1)).alias("c"))
            want = minutes.agg(F.max("c").alias("peak"), F.sum("c").alias("total")).first()
            r = got[cell.gap_ms, cell.grace_ms]
            assert (r.peak, r.session_minutes, r.segments) == (want.peak, want.total, sessionize.active_intervals(st, cell).count())
    empty = sweep.sweep(raw_df(spark, []), C.TELEMETRY).collect()
    assert len(empty) == 9 and all(r.segments == 0 and r.peak is None for r in empty)


def test_slices_come_from_the_data(spark):
    rollup = P.driver_build(spark, SF0001, C.DRIVER).materialize("rollup").rollup
    got = {r.slice: (r.peak, r.peak_minute) for r in SV.crossover(rollup, ["platform", "video_type"], 2).collect()}
    assert len(got) == 1 + 4 + 2 + 8
    named = {"unfiltered": {}, "platform=Mweb": {"platform": "Mweb"}, "platform=IPHONE, video_type=live": {"platform": "IPHONE", "video_type": "live"}}
    for r in SV.slice_peaks(rollup, named).collect():
        assert got[r.slice] == (r.peak, r.peak_minute)
    assert SV.slice_peaks(rollup, {"none": {"platform": "no such"}}).count() == 0


def _stored(spark, keep=2, times=1):
    path = _session.scratch_path(spark, f"store-layout-{uuid.uuid4().hex}")
    b = P.driver_build(spark, SF0001, C.DRIVER)
    for _ in range(times):
        ST.write_store(b, path, keep)
    return b, path, ST.RollupStore(spark, path, C.DRIVER)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_id_question_reads_one_bucket(spark):
    b, _, store = _stored(spark)
    rollup = b.rollup.cache()
    ids = [r.content_id for r in rollup.select("content_id").distinct().orderBy("content_id").limit(3).collect()]
    for i in ids:
        for filters in ({"content_id": i}, {"content_id": i, "platform": "mweb"}):
            series = store.series(filters)
            assert sorted(map(tuple, series.collect())) == sorted(map(tuple, SV.occupancy_for(rollup, filters).collect()))
        plan = _plan(store.series({"content_id": i}))
        assert "PartitionFilters: [isnotnull(id_bucket" in plan and f"EqualTo(content_id,{i})" in plan
    assert store.kind_for(FL.Resolved({"content_id": 1})) == "by_content"
    files = store.tables["by_content"].filter(F.col("id_bucket") == ST.content_bucket(F.lit(ids[0]).cast("bigint"))).select(F.input_file_name()).distinct().count()
    assert files == 1 < store.tables["by_content"].select(F.input_file_name()).distinct().count()


def test_a_small_ask_needs_no_shuffle(spark):
    _, _, store = _stored(spark)
    plan = _plan(store.benchmark("day_peak_iphone_india"))
    assert "Exchange" not in plan and "PushedFilters: [IsNotNull(country)" in plan and "ReadSchema: struct<minute:bigint,country:string,platform:string,sessions:bigint>" in plan
    impossible = store.answer({"platform": "no such"}, 24).first()
    assert tuple(impossible) == (0, 0.0, 0)
    odd = store.answer({"platform": "it's a \\ \" mess"}, 24).first()
    assert tuple(odd) == (0, 0.0, 0)


def test_old_versions_are_deleted_in_order(spark):
    _, path, store = _stored(spark, keep=1, times=2)
    names = ST._names(spark, f"{path}/versions")
    assert [int(n.split("-")[0]) for n in names] == [1]
    assert ST._names(spark, f"{path}/data") == names
    assert store.version.endswith(names[-1])


def test_filter_report_and_strict(spark):
    catalogue = spark.createDataFrame([("platform", "IPHONE"), ("platform", "Mweb"), ("audio_language", "hin"), ("audio_language", "HIN")],
                                      "dimension string, value string")
    told = {r.dimension: (r.status, r.stands_for, r.values_known)
            for r in FL.report(catalogue, {"platform": "iphone", "audio_language": "Hin", "country": "x", "category": " all "}).collect()}
    assert told == {"platform": ("folded", "IPHONE", 2), "audio_language": ("ambiguous", None, 2), "country": ("unknown", None, 0)}
    with pytest.raises(ValueError, match="the 2 known values"):
        FL.resolve_strict(catalogue, {"platform": "nokia"})
