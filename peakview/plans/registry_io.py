"""Registered source and sink queries, run on data derived from the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config as C
from .. import session as _session
from ..operators import quality as Q
from ..sources import csv_events as CE
from ..sources import driver
from ..sources import sinks as SK
from . import oracle as O
from . import pipeline as P
from . import serving as SV
from .registry import TH, _bench_sql, register

B = TH.bucket_ms
BASE = driver.raw_events_sql()


def _b(spark, sf):
    return P.driver_build(spark, sf, TH)


def _scratch(spark, name):
    return _session.scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@register("S1_csv_round_trip_rollup", O.with_model("SELECT * FROM minute_occupancy", TH))
def q_csv_round_trip(spark, sf):
    b = _b(spark, sf)
    path = _scratch(spark, "csv-events")
    CE.write_events_csv(b.raw, path, sep=";", compression="gzip", upper=True)
    events, _, _ = CE.events_from_csv(spark, path)
    return P.build(events, b.content, TH).rollup


_ODD_NAMES = "'v ' || chr(34) || 'x' || chr(34) || chr(10) || app_version || ', y'"


@register("S1_quoted_line_ends_in_splits", O.with_model(f"""
SELECT {_ODD_NAMES} AS app_version, video_session_id, count(*) AS rows, CAST(sum(t_ms) AS DECIMAL(38, 0)) AS times
FROM raw GROUP BY 1, 2""", TH))
def q_quoted_splits(spark, sf):
    # every row holds a quoted line end, quotes and delimiters; files are read in splits of 64 KB, many splits to a task
    path = _scratch(spark, "csv-quoted")
    odd = _b(spark, sf).raw.withColumn("app_version", F.concat(F.lit('v "x"\n'), F.col("app_version"), F.lit(", y")))
    CE.write_events_csv(odd, path)
    splits = spark.newSession()
    tasks = 4 * spark.sparkContext.defaultParallelism
    for key, value in (("spark.sql.files.maxPartitionBytes", "64k"), ("spark.sql.files.maxPartitionNum", str(tasks)), ("spark.sql.session.timeZone", "UTC")):
        splits.conf.set(key, value)
    events, _, _ = CE.events_from_csv(splits, path)
    return events.groupBy("app_version", "video_session_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("t_ms").cast("decimal(38,0)").alias("times"))


@register("S3_mixed_headers_rollup", O.with_model("SELECT * FROM minute_occupancy", TH))
def q_mixed_headers(spark, sf):
    # one folder, three kinds of files: other order, names, case and delimiter in each
    b = _b(spark, sf)
    path = _scratch(spark, "csv-mixed")
    third = F.pmod(F.xxhash64("video_session_id"), F.lit(3))
    CE.write_events_csv(b.raw.filter(third == 0), f"{path}/a")
    CE.write_events_csv(b.raw.filter(third == 1).select(*reversed(b.raw.columns)), f"{path}/b", sep="|", upper=True)
    CE.write_events_csv(b.raw.filter(third == 2).withColumn("extra", F.lit("?")), f"{path}/c", sep=";", header_names={"country": "geo"})
    events, _, _ = CE.events_from_csv(spark, f"{path}/*", renames={"geo": "country"})
    return P.build(events, b.content, TH).rollup


@register("S4_absent_optional_column", O.with_model(
    "SELECT platform, '' AS video_resolution, count(*) AS rows FROM raw GROUP BY platform", TH))
def q_absent_column(spark, sf):
    path = _scratch(spark, "csv-narrow")
    CE.write_events_csv(_b(spark, sf).raw.drop("video_resolution"), path)
    events, _, _ = CE.events_from_csv(spark, path)
    return events.groupBy("platform", "video_resolution").agg(F.count(F.lit(1)).alias("rows"))


@register("S2_content_csv", O.with_model("""
SELECT content_id, title, video_type, category, show_name FROM content_src WHERE content_id % 4 <> 0 OR content_id = 0""", TH))
def q_content_csv(spark, sf):
    # every fourth id is written negative, which the reader sorts out; titles are quoted
    content = _b(spark, sf).content
    path = _scratch(spark, "csv-content")
    (content.withColumn("content_id", F.when(F.col("content_id") % 4 == 0, -F.col("content_id")).otherwise(F.col("content_id")))
     .select("title", "content_id", F.col("show_name").alias("Show_Name"), "category", "video_type")
     .write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path))
    good, _, _ = CE.content_from_csv(spark, path)
    return good


@register("S7_ragged_rows", O.with_model("""
SELECT CASE WHEN content_id % 10 = 1 THEN 'ragged' WHEN content_id % 10 = 2 THEN 'ragged' WHEN content_id % 10 = 3 THEN 'unparsable'
            WHEN content_id % 10 = 4 THEN 'out_of_range' ELSE 'good' END AS status, count(*) AS rows FROM raw GROUP BY 1""", TH))
def q_ragged(spark, sf):
    # rows that end early, rows with a field too many, words for times, seconds for milliseconds
    raw = _b(spark, sf).raw
    kind = F.col("content_id") % 10
    time = (F.when(kind == 3, F.lit("noon")).when(kind == 4, (F.col("t_ms") / 1000).cast("bigint").cast("string"))
            .otherwise(F.col("t_ms").cast("string")))
    names = [c for c in raw.columns if c != "video_resolution"]
    fields = [time if c == "t_ms" else F.col(c).cast("string") for c in names]
    header = ",".join({"t_ms": "event_timestamp", "session_start_ms": "session_start_epoch"}.get(c, c) for c in names)
    line = (F.when(kind == 1, F.concat_ws(",", *fields[:5])).when(kind == 2, F.concat_ws(",", *fields, F.lit("more")))
            .otherwise(F.concat_ws(",", *fields)))
    path = _scratch(spark, "csv-ragged")
    # whole lines as one column, whose name is the header line
    raw.select(line.alias(header)).write.option("header", True).option("sep", "\u0001").csv(path)
    _, counts, _ = CE.events_from_csv(spark, path)
    return counts


@register("S7_csv_row_status", O.with_model("""
SELECT status, count(*) AS rows FROM (
  SELECT CASE WHEN content_id BETWEEN 4 AND 6 THEN 'unparsable' WHEN content_id <= 3 THEN 'out_of_range' ELSE 'good' END AS status
  FROM raw) GROUP BY status""", TH))
def q_row_status(spark, sf):
    # damage a derived copy: ids 1-3 carry seconds instead of milliseconds, ids 4-6 a non-numeric id
    b = _b(spark, sf)
    damaged = (b.raw.withColumn("t_ms", F.when(F.col("content_id") <= 3, (F.col("t_ms") / 1000).cast("bigint"))
                                .otherwise(F.col("t_ms")).cast("string"))
               .withColumn("content_id", F.when(F.col("content_id").between(4, 6), F.lit("n/a"))
                           .otherwise(F.col("content_id").cast("string"))))
    path = _scratch(spark, "csv-damaged")
    CE.write_events_csv(damaged, path, sep="|")
    _, counts, _ = CE.events_from_csv(spark, path)
    return counts


@register("S8_day_partitioned_rollup", O.with_model("SELECT * FROM minute_occupancy", TH))
def q_day_partitioned(spark, sf):
    path = _scratch(spark, "rollup-by-day")
    P.write_rollup(_b(spark, sf).rollup, path, TH)
    return spark.read.parquet(path).drop("day")


@register("S9_answers_file", _bench_sql())
def q_answers_file(spark, sf):
    path = _scratch(spark, "answers")
    SK.write_answers(SV.benchmark_answers(_b(spark, sf).rollup, TH), path, ["query_label"])
    return (spark.read.option("header", True)
            .schema("query_label string, grain_buckets bigint, peak_concurrency bigint, "
                    "average_concurrency double, active_minutes bigint").csv(path))


_CODED_SQL = " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, minute FROM minute_occupancy" for c in SK.CODED)


@register("S10_snapshot_dictionary", O.with_model(f"""
SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY minutes_present DESC, value) - 1 AS code,
       value, minutes_present
FROM (SELECT "column", value, count(*) AS minutes_present FROM ({_CODED_SQL}) GROUP BY 1, 2)""", TH))
def q_snapshot_dictionary(spark, sf):
    return SK.snapshot_dictionary(_b(spark, sf).rollup)


@register("S11_snapshot_audit", O.with_model("""
SELECT count(*) AS rows, count(*) AS rollup_rows, count(DISTINCT minute) AS minutes,
       (SELECT max(c) FROM (SELECT minute, sum(sessions) AS c FROM minute_occupancy GROUP BY minute)) AS snapshot_peak,
       (SELECT max(c) FROM (SELECT minute, sum(sessions) AS c FROM minute_occupancy GROUP BY minute)) AS rollup_peak,
       CAST(0 AS BIGINT) AS minutes_present_mismatches, CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right
FROM minute_occupancy""", TH))
def q_snapshot_audit(spark, sf):
    rollup = _b(spark, sf).materialize().rollup
    path = _scratch(spark, "snapshot")
    packed, dictionary, minute_index = SK.snapshot(rollup, B)
    packed.write.parquet(f"{path}/rollup")
    dictionary.write.parquet(f"{path}/dictionary")
    minute_index.write.parquet(f"{path}/minutes")
    rd = spark.read.parquet
    out = SK.audit_snapshot(rollup, rd(f"{path}/rollup"), rd(f"{path}/dictionary"), rd(f"{path}/minutes"))
    return out.withColumn("snapshot_peak", F.col("snapshot_peak").cast("bigint")) \
              .withColumn("rollup_peak", F.col("rollup_peak").cast("bigint"))


_LAST_DAY = f"(SELECT * FROM {BASE} WHERE t_ms // {C.DAY_MS} = (SELECT max(t_ms // {C.DAY_MS}) FROM {BASE}))"


@register("S12_held_out_day_answers", _bench_sql(raw=_LAST_DAY))
def q_held_out(spark, sf):
    b = _b(spark, sf)
    day = P.build(SK.held_out_day(b.raw), b.content, TH)
    return SV.benchmark_answers(day.rollup, TH)


@register("S13_entity_sample", O.with_model("""
SELECT video_session_id, count(*) AS rows, count(DISTINCT user_id) AS users FROM raw
WHERE video_session_id IN (SELECT video_session_id FROM raw WHERE ('0x' || md5(user_id)[1:8])::BIGINT % 4 = 0)
GROUP BY video_session_id""", TH))
def q_sample(spark, sf):
    b = _b(spark, sf)
    events, content = SK.entity_sample(b.raw, b.content, bucket=0, buckets=4)
    return events.groupBy("video_session_id").agg(F.count(F.lit(1)).alias("rows"),
                                                  F.count_distinct("user_id").alias("users"))


@register("S14_verified_copy", O.with_model(
    "SELECT 'minute_occupancy' AS \"table\", count(*) AS rows, true AS identical FROM minute_occupancy", TH))
def q_verified_copy(spark, sf):
    return SK.verified_copy(_b(spark, sf).rollup, _scratch(spark, "copy"), "minute_occupancy")


@register("S16_reference_intervals_round_trip", "SELECT CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right")
def q_reference_intervals(spark, sf):
    iv = _b(spark, sf).intervals
    path = _scratch(spark, "ref-intervals")
    iv.write.option("header", True).csv(path)
    return Q.two_way_difference(iv, SK.read_reference_intervals(spark, path))


_OTHER = "CASE WHEN platform = 'Mweb' THEN sessions + 1 ELSE sessions END"


@register("S16_reference_rollup_difference", O.with_model(f"""
SELECT (SELECT count(*) FROM (SELECT * FROM minute_occupancy EXCEPT ALL SELECT * FROM reference)) AS only_left,
       (SELECT count(*) FROM (SELECT * FROM reference EXCEPT ALL SELECT * FROM minute_occupancy)) AS only_right""", TH,
    f"reference AS (SELECT * REPLACE ({_OTHER} AS sessions) FROM minute_occupancy WHERE minute % 7 <> 0)"))
def q_reference_rollup(spark, sf):
    # a reference file that misses some minutes and counts one session more on one platform
    rollup = _b(spark, sf).materialize("rollup").rollup
    path = _scratch(spark, "ref-rollup")
    other = rollup.filter("minute % 7 <> 0").withColumn("sessions", F.when(F.col("platform") == "Mweb", F.col("sessions") + 1)
                                                        .otherwise(F.col("sessions")))
    other.select(*C.ROLLUP_DIMS, "minute", "sessions").write.option("header", True).option("emptyValue", '""').csv(path)
    reference = SK.read_reference_rollup(spark, path).fillna("", [d for d in C.ROLLUP_DIMS if d != "content_id"])
    return Q.two_way_difference(rollup, reference)


_REP = 3
_SPAN = f"(((SELECT max(t_ms) - min(t_ms) FROM {BASE}) // {C.DAY_MS} + 1) * {C.DAY_MS})"
_REPLICATED = (f"(SELECT video_session_id || '-rep' || CAST(r AS VARCHAR) AS video_session_id,"
               f" user_id || '-rep' || CAST(r AS VARCHAR) AS user_id, event_type, event,"
               f" t_ms + (r - 1) * {_SPAN} AS t_ms, session_start_ms + (r - 1) * {_SPAN} AS session_start_ms,"
               f" platform, app_version, country, audio_language, subtitle_language, player_version, content_id,"
               f" video_resolution FROM (SELECT *, unnest(range(1, {_REP + 1})) AS r FROM {BASE}))")


@register("S17_replicated_build", O.with_model(
    f"SELECT CAST({_REP} AS BIGINT) AS copies, (SELECT count(*) FROM raw) AS raw_rows,"
    " (SELECT count(*) FROM minute_occupancy) AS rollup_rows,"
    " (SELECT max(c) FROM (SELECT minute, sum(sessions) AS c FROM minute_occupancy GROUP BY minute)) AS peak",
    TH, raw=_REPLICATED))
def q_replicated(spark, sf):
    b = _b(spark, sf)
    lo, hi = b.raw.agg(F.min("t_ms"), F.max("t_ms")).first()
    span = ((hi - lo) // C.DAY_MS + 1) * C.DAY_MS
    _session.sized(spark, _REP * driver.event_rows(spark, sf))
    rep = SK.replicate(b.raw, _REP, span)
    built = P.build(rep, b.content, TH)
    peak = SV.occupancy(built.rollup, SV.FL.Resolved()).agg(F.max("concurrency")).scalar()
    return built.rollup.agg(F.lit(_REP).cast("bigint").alias("copies"),
                            F.count(F.lit(1)).alias("rollup_rows")).select(
        "copies", rep.agg(F.count(F.lit(1))).scalar().alias("raw_rows"), "rollup_rows", peak.cast("bigint").alias("peak"))


def _describe_sql(raw: str | None, name: str) -> str:
    return O.with_model(
        f"SELECT '{name}' AS dataset, min(minute) AS min_minute, max(minute) AS max_minute, count(*) AS occupancy_rows,"
        " count(DISTINCT minute) AS minutes_with_sessions,"
        " (SELECT max(c) FROM (SELECT minute, sum(sessions) AS c FROM minute_occupancy GROUP BY minute)) AS peak"
        " FROM minute_occupancy", TH, raw=raw)


@register("A43_dataset_list", f"""
SELECT min(dataset) AS dataset, min_minute, max_minute, occupancy_rows, minutes_with_sessions, CAST(peak AS BIGINT) AS peak
FROM (SELECT * FROM ({_describe_sql(None, 'full')}) UNION ALL SELECT * FROM ({_describe_sql(None, 'full_copy')})
      UNION ALL SELECT * FROM ({_describe_sql(_LAST_DAY, 'last_day')}))
GROUP BY min_minute, max_minute, occupancy_rows, minutes_with_sessions, peak""")
def q_datasets(spark, sf):
    b = _b(spark, sf).materialize()
    day = P.build(SK.held_out_day(b.raw), b.content, TH).materialize()
    return SV.dataset_list([SV.describe_dataset(b.rollup, "full"), SV.describe_dataset(b.rollup, "full_copy"),
                            SV.describe_dataset(day.rollup, "last_day")])
