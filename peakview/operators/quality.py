"""Checks and profiles of the input and of the built tables.

Every figure is computed over all rows; nothing is sampled or capped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from ..functions import running as R

S = "video_session_id"


# --------------------------------------------------------------------------
# fingerprints and differences
# --------------------------------------------------------------------------

def _row_hash(df: DataFrame, portable: bool) -> Column:
    columns = sorted(df.columns)
    if not portable:
        return F.xxhash64(*columns)
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def fingerprint(df: DataFrame, name: str = "table", portable: bool = False) -> DataFrame:
    """Row count plus order-independent XOR and SUM of row hashes.

    XOR alone cancels pairs of equal rows, so the sum rides along. A `portable`
    fingerprint takes 60 bits of the md5 of the row's columns as text, in name
    order, which any other engine can compute as well; the other is cheaper.
    """
    h = _row_hash(df, portable)
    return df.select(h.alias("h")).agg(
        F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor_hash"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("sum_hash"))


def compare_fingerprints(a: DataFrame, b: DataFrame, portable: bool = False) -> DataFrame:
    """Side by side fingerprints of two tables and whether they agree."""
    fa = fingerprint(a, "a", portable).drop("table")
    fb = fingerprint(b, "b", portable).drop("table")
    cols = fa.columns
    both = fa.select(*[F.col(c).alias(f"a_{c}") for c in cols],
                     *[fb.select(c).scalar().alias(f"b_{c}") for c in cols])
    same = reduce(lambda x, y: x & y, [F.col(f"a_{c}") == F.col(f"b_{c}") for c in cols])
    return both.select("*", same.alias("identical"))


def two_way_difference(a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows only in a and rows only in b, as multisets."""
    cols = columns or sorted(a.columns)
    x, y = a.select(*cols), b.select(*cols)
    only_a = x.exceptAll(y).agg(F.count(F.lit(1)).alias("only_left"))
    only_b = y.exceptAll(x).agg(F.count(F.lit(1)).alias("only_right"))
    return only_a.select("only_left", only_b.scalar().alias("only_right"))


# --------------------------------------------------------------------------
# reconciliation, ratio guard, vocabulary, preflight
# --------------------------------------------------------------------------

def orphan_content_ids(raw: DataFrame, content: DataFrame) -> DataFrame:
    """Distinct content ids in events with no catalogue row."""
    ids = raw.select("content_id").distinct()
    return ids.join(content.select("content_id").distinct(), "content_id", "left_anti")


def reconcile(raw: DataFrame, content: DataFrame) -> DataFrame:
    """One row of landing counts: rows, sessions, users, ids, catalogue rows, orphans.

    Rows are first counted per (session, user, id), on the map side; the three
    distinct counts then expand that small table and not the events.
    """
    seen = raw.groupBy(S, "user_id", "content_id").agg(F.count(F.lit(1)).alias("rows"))
    counts = seen.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("raw_rows"),
                      F.count_distinct(S).alias("sessions"),
                      F.count_distinct("user_id").alias("users"),
                      F.count_distinct("content_id").alias("raw_content_ids"))
    return counts.select("*",
                         content.agg(F.count(F.lit(1))).scalar().alias("content_rows"),
                         orphan_content_ids(raw, content).agg(F.count(F.lit(1))).scalar().alias("join_orphans"))


def active_ratio(raw: DataFrame, intervals: DataFrame, floor: float = 0.5) -> DataFrame:
    """Share of sessions with any active interval, and whether it clears `floor`."""
    total = raw.agg(F.count_distinct(S)).scalar()
    active = intervals.agg(F.count_distinct(S).alias("active_sessions"))
    return active.select(total.alias("sessions"), "active_sessions",
                         (F.col("active_sessions").cast("double") / total.cast("double")).alias("ratio")
                         ).withColumn("passes", (F.col("ratio") >= floor).cast("int"))


def vocabulary_report(raw: DataFrame, top: int = 25) -> DataFrame:
    """Top tokens per vocabulary column with a recognised flag."""
    expected = {"event_type": C.EXPECTED_EVENT_TYPES, "event": C.EXPECTED_EVENTS}
    parts = []
    for column, tokens in expected.items():
        counts = raw.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
        rec = F.lower("value").isin(*[t.lower() for t in tokens]).cast("int")
        parts.append(counts.select(F.lit(column).alias("column"), "value", "rows", rec.alias("recognised")))
    allv = reduce(DataFrame.unionByName, parts)
    return R.top_n(allv, ["column"], [F.desc("rows"), F.asc("value")], top).withColumn("rank", F.col("rank").cast("bigint"))


def vocabulary_absent(raw: DataFrame) -> DataFrame:
    """Expected tokens that never occur (case-insensitively), per column."""
    spark = raw.sparkSession
    expected = spark.createDataFrame(
        [("event_type", t) for t in C.EXPECTED_EVENT_TYPES] + [("event", t) for t in C.EXPECTED_EVENTS],
        "column string, token string")
    seen = (raw.select(F.explode(F.array(
        F.struct(F.lit("event_type").alias("column"), F.lower("event_type").alias("token")),
        F.struct(F.lit("event").alias("column"), F.lower("event").alias("token")))).alias("p"))
        .select("p.column", "p.token").distinct())
    return (expected.withColumn("lt", F.lower("token"))
            .join(seen.withColumnRenamed("token", "lt"), ["column", "lt"], "left_anti").drop("lt"))


def preflight_profile(raw: DataFrame, content: DataFrame) -> DataFrame:
    """Everything knowable about the events before a build, in one row.

    Open sessions never reach a stop event; mixed sessions carry more than one
    content id; duplicates are rows repeating a (session, timestamp).
    """
    stop = F.col("event_type").isin(*C.EVENT_TYPES_STOP).cast("int")
    per_session = raw.groupBy(S).agg(F.max(stop).alias("stopped"),
                                     F.count_distinct("content_id").alias("ids"))
    sess = per_session.agg(F.count(F.lit(1)).alias("sessions"),
                           F.count_if(F.col("stopped") == 0).alias("open_sessions"),
                           F.count_if(F.col("ids") > 1).alias("mixed_content_sessions"))
    distinct_stamps = raw.select(S, "t_ms").distinct().agg(F.count(F.lit(1))).scalar()
    ids = content.select("content_id").distinct()
    orphan_rows = raw.join(ids, "content_id", "left_anti").agg(F.count(F.lit(1))).scalar()
    rows = raw.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("t_ms").alias("low_ms"),
        F.max("t_ms").alias("high_ms"),
        F.count_if((F.col("t_ms") < C.MIN_EPOCH_MS) | (F.col("t_ms") > C.MAX_EPOCH_MS)).alias("out_of_range_rows"),
    )
    return (rows.select("*",
                        sess.select("sessions").scalar().alias("sessions"),
                        sess.select("open_sessions").scalar().alias("open_sessions"),
                        sess.select("mixed_content_sessions").scalar().alias("mixed_content_sessions"),
                        orphan_rows.alias("orphan_rows"),
                        (F.col("rows") - distinct_stamps).alias("duplicate_rows")))


def column_values(raw: DataFrame, columns=C.EVENT_DIMS, top: int = 8) -> DataFrame:
    """Most frequent values per column, with counts (A29 per-column counters)."""
    stacked = raw.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p"))
    counts = stacked.groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("rows"))
    return R.top_n(counts, ["column"], [F.desc("rows"), F.asc("value")], top).withColumn("rank", F.col("rank").cast("bigint"))


# --------------------------------------------------------------------------
# heartbeat cadence
# --------------------------------------------------------------------------

def stamp_gaps(raw: DataFrame, chunk_ms: int, heartbeats_only: bool) -> DataFrame:
    """Gaps between consecutive distinct timestamps of each session.

    Sessions are cut into time chunks; the first stamp of a chunk takes the
    last stamp of the session's previous chunk from a per-chunk table, so no
    window spans a whole session.
    """
    src = raw.filter(F.col("event_type") == C.EVENT_TYPE_HEARTBEAT) if heartbeats_only else raw
    stamps = (src.select(S, F.col("t_ms").alias("t")).distinct()
              .withColumn("chunk", X.floor_div("t", chunk_ms)))
    last = stamps.groupBy(S, "chunk").agg(F.max("t").alias("last_t"))
    carry = last.select(S, "chunk", F.lag("last_t").over(Window.partitionBy(S).orderBy("chunk")).alias("in_t"))
    w = Window.partitionBy(S, "chunk").orderBy("t")
    return (stamps.join(carry.hint("shuffle_hash"), [S, "chunk"], "inner")
            .select((F.col("t") - F.coalesce(F.lag("t").over(w), F.col("in_t"))).alias("gap_ms"))
            .filter(F.col("gap_ms").isNotNull()))


def cadence_by_basis(raw: DataFrame, th: C.Thresholds) -> DataFrame:
    """Cadence p50/p90/p99 (nearest rank), mode and a verdict, for heartbeat gaps and for gaps of all events.

    Verdict: fail when p90 exceeds grace by over a second or gap <= p90;
    warn when grace is far above p90 or fewer than 100 gaps were seen.
    """
    bases = reduce(DataFrame.unionByName, [
        stamp_gaps(raw, th.chunk_ms, only).select(F.lit(basis).alias("basis"), "gap_ms")
        for basis, only in ((C.EVENT_TYPE_HEARTBEAT, True), ("all", False))])
    hist = bases.groupBy("basis", "gap_ms").agg(F.count(F.lit(1)).alias("n"))
    ranks = R.nearest_ranks(hist, "gap_ms", "n", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, ["basis"])
    mode = hist.groupBy("basis").agg(F.max_by(F.struct("gap_ms", "n"), F.struct(F.col("n"), -F.col("gap_ms"))).alias("m"))
    told = (raw.sparkSession.createDataFrame([(C.EVENT_TYPE_HEARTBEAT,), ("all",)], "basis string")
            .join(ranks, "basis", "left").join(mode, "basis", "left")
            .select("basis", *[(F.col(p) / 1000.0).alias(f"{p}_s") for p in ("p50", "p90", "p99")],
                    F.coalesce("total", F.lit(0)).cast("bigint").alias("gaps"),
                    F.col("m.gap_ms").alias("mode_ms"), F.col("m.n").alias("mode_count")))
    grace_s, gap_s = th.grace_ms / 1000.0, th.gap_ms / 1000.0
    fail = (F.col("p90_s") > grace_s + 1) | (F.lit(gap_s) <= F.col("p90_s"))
    warn = (F.col("gaps") < 100) | (F.lit(grace_s) > F.col("p90_s") * 1.5 + 1)
    return told.withColumn("verdict", F.when(F.col("gaps") < 100, "warn")
                           .when(fail, "fail").when(warn, "warn").otherwise("pass"))


def cadence(raw: DataFrame, th: C.Thresholds) -> DataFrame:
    """The cadence that counts: of heartbeats where there are gaps of them, else of all events."""
    both = cadence_by_basis(raw, th)
    preferred = F.struct((F.col("basis") == C.EVENT_TYPE_HEARTBEAT) & (F.col("gaps") > 0), F.col("basis") == "all")
    one = both.groupBy().agg(F.max_by(F.struct(*both.columns), preferred).alias("c"))
    return one.select("c.*")


# --------------------------------------------------------------------------
# run statistics and variety
# --------------------------------------------------------------------------

def run_stats(raw: DataFrame, intervals: DataFrame, session_minutes: DataFrame, bucket_ms: int) -> DataFrame:
    """Counts of a build over two denominators.

    Every table is asked once: what the raw events and the intervals tell comes
    as one struct each and stands beside the one counted row, also when nobody
    was active.
    """
    minute = X.floor_div("t_ms", bucket_ms)
    ev_minutes = raw.select(S, minute.alias("minute")).distinct()
    without = session_minutes.select(S, "minute").join(ev_minutes, [S, "minute"], "left_anti")
    totals = session_minutes.groupBy("minute").agg(F.count(F.lit(1)).alias("c"))
    # one row per session first, so that the distinct count is a plain one
    events = raw.groupBy(S).agg(F.min(minute).alias("lo"), F.max(minute).alias("hi"))
    facts = events.agg(F.struct(F.count(S).alias("sessions"), (F.max("hi") - F.min("lo") + 1).alias("span"))).scalar()
    active = intervals.groupBy(S).agg(F.count(F.lit(1)).alias("n")).agg(
        F.struct(F.count(S).alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("segments"))).scalar()
    counted = totals.agg(
        F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("session_minutes"),
        F.count(F.lit(1)).alias("minutes_with_activity"),
        F.coalesce(F.max("c"), F.lit(0)).alias("peak_concurrency"),
        F.max_by("minute", F.struct(F.col("c"), -F.col("minute"))).alias("peak_minute"),
        F.coalesce(F.try_divide(F.sum("c").cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0))
        .alias("average_over_active_minutes"),
    ).withColumns({"_raw": facts, "_active": active})
    return counted.select(
        "session_minutes", "minutes_with_activity", "peak_concurrency", "peak_minute", "average_over_active_minutes",
        F.col("_raw.sessions").alias("sessions"), (F.col("_raw.sessions") - F.col("_active.sessions")).alias("sessions_with_no_active_time"),
        F.col("_active.segments").alias("segments"),
        without.agg(F.count(F.lit(1))).scalar().alias("covered_minutes_without_events"),
        F.col("_raw.span").alias("minutes_in_span"),
        (F.col("session_minutes").cast("double") / F.col("_raw.span").cast("double")).alias("average_over_span"),
    )


def variety(raw: DataFrame, intervals: DataFrame, session_minutes: DataFrame) -> DataFrame:
    """How many sessions show each behaviour; users with several sessions or devices."""
    k = X.kind("event_type", "event")
    shows = {"paused": k == C.KIND_PAUSE, "resumed": k == C.KIND_PLAY, "backgrounded": k == C.KIND_BACKGROUND,
             "foregrounded": k == C.KIND_FOREGROUND, "errored": F.col("event_type") == "VideoError",
             "ended": F.col("event_type") == "VideoSessionEnd"}
    per_session = raw.groupBy(S).agg(*[F.max(c.cast("int")).alias(n) for n, c in shows.items()])
    counts = per_session.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(f"sessions_{n}") for n in shows])
    users = raw.groupBy("user_id").agg(F.count_distinct(S).alias("s"), F.count_distinct("platform").alias("d"))
    many = lambda df: df.groupBy(S).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1)).scalar()
    return counts.select(
        "*", many(intervals).alias("sessions_multi_interval"), many(session_minutes).alias("sessions_multi_minute"),
        users.agg(F.count_if(F.col("s") > 1)).scalar().alias("users_multi_session"),
        users.agg(F.count_if(F.col("d") > 1)).scalar().alias("users_multi_device"))


# --------------------------------------------------------------------------
# scale proofs and the presence proxy
# --------------------------------------------------------------------------

def shard_proof(session_minutes: DataFrame, shards: int = 8) -> DataFrame:
    """Per-shard partial counts merged by sum equal the global series."""
    sharded = (session_minutes.withColumn("shard", F.pmod(F.xxhash64(S), F.lit(shards)))
               .groupBy("shard", "minute").agg(F.count(F.lit(1)).alias("c"))
               .groupBy("minute").agg(F.sum("c").cast("bigint").alias("concurrency")))
    glob = session_minutes.groupBy("minute").agg(F.count(F.lit(1)).alias("concurrency"))
    diff = two_way_difference(glob, sharded, ["minute", "concurrency"])
    return diff.select(F.lit(shards).cast("bigint").alias("shards"),
                       glob.agg(F.count(F.lit(1))).scalar().alias("minutes"), "only_left", "only_right")


def presence_series(raw: DataFrame, bucket_ms: int) -> DataFrame:
    """Distinct sessions with any event in the minute."""
    return (raw.select(S, X.floor_div("t_ms", bucket_ms).alias("minute")).distinct()
            .groupBy("minute").agg(F.count(F.lit(1)).alias("presence_sessions")))


PROXY_DIMS = ("country", "platform", "app_version", "audio_language", "subtitle_language",
              "player_version", "content_id")


def presence_rollup(raw: DataFrame, bucket_ms: int) -> DataFrame:
    """Proxy rollup: distinct (session, minute, tuple) cells with an event, counted."""
    return (raw.select(S, *PROXY_DIMS, X.floor_div("t_ms", bucket_ms).alias("minute")).distinct()
            .groupBy(*PROXY_DIMS, "minute").agg(F.count(F.lit(1)).alias("sessions")))


def presence_vs_active(raw: DataFrame, session_minutes: DataFrame, bucket_ms: int) -> DataFrame:
    """Cell by cell: (session, minute) cells with an event against active cells."""
    pres = raw.select(S, X.floor_div("t_ms", bucket_ms).alias("minute")).distinct().withColumn("p", F.lit(1))
    act = session_minutes.select(S, "minute").withColumn("a", F.lit(1))
    cells = pres.join(act, [S, "minute"], "full")
    per_minute_p = presence_series(raw, bucket_ms).agg(F.max("presence_sessions")).scalar()
    per_minute_a = session_minutes.groupBy("minute").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).scalar()
    return cells.agg(
        F.count_if(F.col("p").isNotNull() & F.col("a").isNotNull()).alias("both"),
        F.count_if(F.col("a").isNull()).alias("presence_only"),
        F.count_if(F.col("p").isNull()).alias("active_only"),
    ).select("*", per_minute_p.alias("presence_peak"), per_minute_a.alias("active_peak"))


# --------------------------------------------------------------------------
# preflight verdicts
# --------------------------------------------------------------------------

def preflight_checks(raw: DataFrame, content: DataFrame, th: C.Thresholds) -> DataFrame:
    """What is knowable before a build, as one row per check: (check, severity, n, detail).

    timestamps and content_ids: a problem where n rows are off. vocabulary: a
    problem if no recognised event type occurs, a warning where n tokens are
    absent. cadence: severity from the cadence's own verdict, n its gaps.
    benchmark_slices: a warning where n filter values never occur.
    """
    level = lambda bad, severity: F.when(bad, severity).otherwise("ok")
    none = F.lit("")
    profile = preflight_profile(raw, content).select(
        F.explode(F.array(
            F.struct(F.lit("timestamps").alias("check"), level(F.col("out_of_range_rows") > 0, "problem").alias("severity"),
                     F.col("out_of_range_rows").alias("n"), none.alias("detail")),
            F.struct(F.lit("content_ids").alias("check"), level(F.col("orphan_rows") > 0, "problem").alias("severity"),
                     F.col("orphan_rows").alias("n"), none.alias("detail")))).alias("c")).select("c.*")
    absent = vocabulary_absent(raw).withColumn("name", F.concat_ws("=", "column", "token"))
    types_absent = F.count_if(F.col("column") == "event_type")
    vocabulary = absent.agg(
        F.lit("vocabulary").alias("check"),
        F.when(types_absent == len(C.EXPECTED_EVENT_TYPES), "problem").when(F.count(F.lit(1)) > 0, "warning").otherwise("ok").alias("severity"),
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("detail"))
    paced = cadence(raw, th).select(
        F.lit("cadence").alias("check"),
        F.element_at(F.create_map(F.lit("fail"), F.lit("problem"), F.lit("warn"), F.lit("warning"), F.lit("pass"), F.lit("ok")),
                     F.col("verdict")).alias("severity"), F.col("gaps").alias("n"), F.col("basis").alias("detail"))
    asked = raw.sparkSession.createDataFrame(
        sorted({(d, v) for _, _, flt in C.BENCHMARKS for d, v in flt.items() if d in C.EVENT_DIMS}), "dimension string, value string")
    held = reduce(DataFrame.unionByName, [raw.select(F.lit(d).alias("dimension"), F.col(d).alias("value")).distinct()
                                          for d in sorted({d for _, _, flt in C.BENCHMARKS for d in flt if d in C.EVENT_DIMS})])
    missing = asked.join(held, ["dimension", "value"], "left_anti").withColumn("name", F.concat_ws("=", "dimension", "value"))
    slices = missing.agg(
        F.lit("benchmark_slices").alias("check"), level(F.count(F.lit(1)) > 0, "warning").alias("severity"),
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("detail"))
    return reduce(DataFrame.unionByName, [profile, vocabulary, paced, slices])
