"""What must not grow with the input: rows behind a shuffle partition, tasks of small splits, calls to the state store, plans of merged spans."""

import random
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from peakview import config as C
from peakview import session as _session
from peakview.operators import instant as I
from peakview.plans import pipeline as P
from peakview.sources import quoted_lines as QL
from peakview.streaming import open_sessions as LS
from tests.fixtures import content_df, raw_df, row


def _folder(spark, name):
    import os
    path = _session.scratch_path(spark, f"{name}-{uuid.uuid4().hex}").removeprefix("file:")
    os.makedirs(path)
    return path


def test_partitions_follow_the_events(spark, monkeypatch):
    sf = _folder(spark, "many-events")
    hour = 3_600_000_000
    n = 3000
    pq.write_table(pa.table({
        "event_id": pa.array(range(n)), "ts": pa.array([1_704_067_200_000_000 + (i % 700) * hour for i in range(n)], pa.timestamp("us")),
        "user_id": pa.array([i % 97 for i in range(n)]), "event_type": ["view"] * n, "value": [1.0] * n,
        "props": [f'{{"k": {i % 100}}}' for i in range(n)]}), f"{sf}/events.parquet")
    pq.write_table(pa.table({"p_partkey": pa.array(range(100)), "p_name": ["x"] * 100, "p_type": ["T"] * 100, "p_brand": ["B"] * 100,
                             "p_size": pa.array([1] * 100)}), f"{sf}/part.parquet")
    monkeypatch.setattr(_session, "ROWS_PER_PARTITION", 50)
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "4")
    own.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1b")
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1b")
    build = P.driver_build(own, sf, C.DRIVER)
    assert build.states.select(F.spark_partition_id().alias("p")).distinct().count() > 30
    # few rows keep the session's number, and a smaller size of the session holds
    monkeypatch.setattr(_session, "ROWS_PER_PARTITION", 50_000)
    P.driver_build(own, sf, C.DRIVER)
    assert own.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "4"
    assert own.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "1b"
    assert own.conf.get("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes") == "32m"


def test_sizes_as_spark_writes_them():
    assert [_session._bytes(x) for x in ("64MB", "67108864b", "8m", "16k", "1g", "512")] == [64 << 20, 64 << 20, 8 << 20, 16 << 10, 1 << 30, 512]


def test_many_splits_in_one_task(spark):
    folder = _folder(spark, "packed")
    rows = [(f'v "{i}"\n{i}', f"{i},x") for i in range(200)]
    with open(f"{folder}/f.csv", "w", encoding="utf-8", newline="") as f:
        f.write("a,b\n")
        for a, b in rows:
            f.write('"' + a.replace('"', '""') + f'","{b}"\n')
    splits = spark.newSession()
    for key, value in (("spark.sql.files.maxPartitionBytes", "64"), ("spark.sql.files.maxPartitionNum", "3")):
        splits.conf.set(key, value)
    lines = QL.raw_lines(splits, folder)
    assert lines.select("start").distinct().count() > 40 and lines.rdd.getNumPartitions() <= 3
    records, _ = QL.read_records(splits, folder, lambda header: ",")
    assert sorted(tuple(r.fields) for r in records.collect()) == sorted(rows)


def test_the_quoted_query_packs_its_splits(spark, monkeypatch):
    from peakview.plans import registry
    seen = []
    real = QL.raw_lines
    monkeypatch.setattr(QL, "raw_lines", lambda s, path: seen.append(s.conf.get("spark.sql.files.maxPartitionNum", None)) or real(s, path))
    registry.queries()["S1_quoted_line_ends_in_splits"](spark, "/root/testdata/sf0.001")
    assert seen == [str(4 * spark.sparkContext.defaultParallelism)]


def test_sessions_of_one_bucket_are_held_together(spark):
    th, folder = C.TELEMETRY, _session.scratch_path(spark, f"bucket-{uuid.uuid4().hex}")
    parts = [[row(f"s{i}", "START", i) for i in range(30)],
             [row(f"s{i}", "beat", 60 + i) for i in range(0, 30, 2)] + [row("z", "START", 70)],
             [row(f"s{i}", "beat", 400 + i) for i in range(0, 30, 3)], [row("z", "beat", 2000)], [row("z", "beat", 2060)]]
    for i, rows in enumerate(parts):
        raw_df(spark, rows).coalesce(1).write.parquet(f"{folder}/in/{i:04d}")
    live = LS.streaming_session(spark, 1)
    table = LS.StateTable(live, f"{folder}/out")
    records = LS.live_records(LS.read_stream(live, f"{folder}/in"), th, retention_ms=86_400_000, buckets=1)
    LS.run_to_completion(records, table, f"{folder}/ckpt")
    table.spark = spark
    got = LS.intervals_with_predictions(table, th)
    want = P.build(raw_df(spark, [r for p in parts for r in p]), content_df(spark), th).intervals.select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    states = live.read.format("statestore").option("stateVarName", "session").load(f"{folder}/ckpt")
    assert states.select("key").distinct().count() == 1 and states.count() == 31


def test_spans_over_chunk_edges(spark):
    rng = random.Random(7)
    pieces = [(f"s{rng.randrange(6)}", f"k{rng.randrange(2)}", a := rng.randrange(-300, 300), a + rng.choice((1, 3, 10, 10, 45, 120))) for _ in range(250)]
    want = set()
    for key in {p[:2] for p in pieces}:
        spans = []
        for _, _, a, b in sorted(p for p in pieces if p[:2] == key):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        want |= {(*key, a, b) for a, b in spans}
    df = spark.createDataFrame(pieces, "video_session_id string, k string, clip_start bigint, clip_end bigint")
    for chunk in (7, 10, 50, 10_000):
        got = I.merge_touching(df, ["k"], chunk_ms=chunk)
        # the pieces are merged once, into a table: what is left to run reads it and sorts the edges
        assert sorted(map(tuple, got.collect())) == sorted(want), chunk
    assert all("spans-" in f for f in got.inputFiles()) and got.inputFiles()
