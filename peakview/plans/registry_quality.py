"""Registered checks and profiles: fingerprints, reconciliation, cadence, sweep, users."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import deltas as D
from ..operators import quality as Q
from ..operators import sweep as SW
from ..operators import userlevel as U
from . import oracle as O
from . import pipeline as P
from . import serving as SV
from .registry import TH, register
from .registry_more import RUNS_CTE

B = TH.bucket_ms
S = "video_session_id"


def _b(spark, sf):
    return P.driver_build(spark, sf, TH)


def _m(select: str, extra: str = "") -> str:
    return O.with_model(select, TH, extra)


_ROLLUP_TEXT = " || chr(31) || ".join(f"CAST({c} AS VARCHAR)" for c in sorted([*C.ROLLUP_DIMS, "minute", "sessions"]))
PRINT_CTE = f"""print AS (SELECT count(*) AS rows, bit_xor(h) AS xor_hash, sum(h) AS sum_hash
  FROM (SELECT ('0x' || md5({_ROLLUP_TEXT})[1:15])::BIGINT AS h FROM minute_occupancy))"""


@register("A25_fingerprint_rollup", _m(
    "SELECT 'minute_occupancy' AS \"table\", rows, xor_hash, CAST(sum_hash AS DECIMAL(38, 0)) AS sum_hash FROM print", PRINT_CTE))
def q_fingerprint(spark, sf):
    return Q.fingerprint(_b(spark, sf).rollup, "minute_occupancy", portable=True)


@register("A25_rebuild_identical", _m("SELECT " + ", ".join(
    f"rows AS {x}_rows, xor_hash AS {x}_xor_hash, CAST(sum_hash AS DECIMAL(38, 0)) AS {x}_sum_hash" for x in "ab")
    + ", true AS identical FROM print", PRINT_CTE))
def q_rebuild(spark, sf):
    # Gate B: two independent builds of the same input give identical fingerprints
    return Q.compare_fingerprints(_b(spark, sf).rollup, _b(spark, sf).rollup, portable=True)


@register("U2_occupancy_vs_deltas", _m("""
SELECT (SELECT count(*) FROM (SELECT * FROM occ EXCEPT ALL SELECT * FROM dser)) AS only_left,
       (SELECT count(*) FROM (SELECT * FROM dser EXCEPT ALL SELECT * FROM occ)) AS only_right""",
    RUNS_CTE + """,
occ AS (SELECT minute, CAST(sum(sessions) AS BIGINT) AS concurrency FROM minute_occupancy GROUP BY minute),
dser AS (SELECT minute, CAST(cum AS BIGINT) AS concurrency FROM (
  SELECT minute, sum(d) OVER (ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM (
    SELECT minute, sum(d) AS d FROM (
      SELECT unnest(range((SELECT min(minute) FROM minute_occupancy), (SELECT max(minute) FROM minute_occupancy) + 2)) AS minute, 0 AS d
      UNION ALL SELECT minute, delta AS d FROM minute_deltas) GROUP BY minute)) WHERE cum != 0)"""))
def q_occ_vs_deltas(spark, sf):
    b = _b(spark, sf).materialize("session_minutes", "rollup")
    occ = SV.occupancy(b.rollup, SV.FL.Resolved())
    dser = D.series_from_deltas(D.minute_deltas(b.session_minutes), b.session_minutes, B)
    return Q.two_way_difference(occ, dser, ["minute", "concurrency"])


@register("A26_reconcile", _m("""
SELECT count(*) AS raw_rows, count(DISTINCT video_session_id) AS sessions, count(DISTINCT user_id) AS users,
       count(DISTINCT content_id) AS raw_content_ids, (SELECT count(*) FROM content_src) AS content_rows,
       (SELECT count(*) FROM (SELECT DISTINCT content_id FROM raw WHERE content_id NOT IN (SELECT content_id FROM content_src))) AS join_orphans
FROM raw"""))
def q_reconcile(spark, sf):
    b = _b(spark, sf)
    return Q.reconcile(b.raw, b.content)


@register("J5_orphan_content_ids", _m(
    "SELECT DISTINCT content_id FROM raw WHERE content_id NOT IN (SELECT content_id FROM content_src)"))
def q_orphans(spark, sf):
    b = _b(spark, sf)
    return Q.orphan_content_ids(b.raw, b.content)


_PARTIAL = "(SELECT * FROM content_src WHERE content_id % 5 <> 0)"


@register("J5_orphans_of_partial_catalogue", _m(
    f"SELECT DISTINCT content_id FROM raw WHERE content_id NOT IN (SELECT content_id FROM {_PARTIAL})"))
def q_partial_orphans(spark, sf):
    # one id in five is missing from a derived catalogue, so there are orphans to find
    b = _b(spark, sf)
    return Q.orphan_content_ids(b.raw, b.content.filter("content_id % 5 <> 0"))


@register("A26_reconcile_partial_catalogue", _m(f"""
SELECT count(*) AS raw_rows, count(DISTINCT video_session_id) AS sessions, count(DISTINCT user_id) AS users,
       count(DISTINCT content_id) AS raw_content_ids, (SELECT count(*) FROM {_PARTIAL}) AS content_rows,
       (SELECT count(*) FROM (SELECT DISTINCT content_id FROM raw WHERE content_id NOT IN (SELECT content_id FROM {_PARTIAL}))) AS join_orphans
FROM raw"""))
def q_reconcile_partial(spark, sf):
    b = _b(spark, sf)
    return Q.reconcile(b.raw, b.content.filter("content_id % 5 <> 0"))


@register("A27_active_ratio", _m("""
SELECT (SELECT count(DISTINCT video_session_id) FROM raw) AS sessions,
       count(DISTINCT video_session_id) AS active_sessions,
       CAST(count(DISTINCT video_session_id) AS DOUBLE) / CAST((SELECT count(DISTINCT video_session_id) FROM raw) AS DOUBLE) AS ratio,
       CAST(CAST(count(DISTINCT video_session_id) AS DOUBLE) / CAST((SELECT count(DISTINCT video_session_id) FROM raw) AS DOUBLE) >= 0.5 AS INTEGER) AS passes
FROM active_intervals"""))
def q_ratio(spark, sf):
    b = _b(spark, sf)
    return Q.active_ratio(b.raw, b.intervals)


def _tokens(ts) -> str:
    return ", ".join(f"'{t.lower()}'" for t in ts)


@register("A28_vocabulary_report", _m(f"""
SELECT "column", value, rows, recognised, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY rows DESC, value) AS rank FROM (
    SELECT 'event_type' AS "column", event_type AS value, count(*) AS rows,
           CAST(lower(event_type) IN ({_tokens(C.EXPECTED_EVENT_TYPES)}) AS INTEGER) AS recognised FROM raw GROUP BY event_type
    UNION ALL
    SELECT 'event' AS "column", event AS value, count(*) AS rows,
           CAST(lower(event) IN ({_tokens(C.EXPECTED_EVENTS)}) AS INTEGER) AS recognised FROM raw GROUP BY event))
WHERE rank <= 25"""))
def q_vocab(spark, sf):
    return Q.vocabulary_report(_b(spark, sf).raw)


def _absent_rows() -> str:
    rows = ", ".join([f"('event_type', '{t}')" for t in C.EXPECTED_EVENT_TYPES]
                     + [f"('event', '{t}')" for t in C.EXPECTED_EVENTS])
    return f"""SELECT e.c, e.token FROM (VALUES {rows}) e(c, token)
WHERE NOT EXISTS (SELECT 1 FROM raw WHERE (e.c = 'event_type' AND lower(raw.event_type) = lower(e.token))
                                       OR (e.c = 'event' AND lower(raw.event) = lower(e.token)))"""


@register("A28_vocabulary_absent", _m(f"SELECT c AS \"column\", token FROM ({_absent_rows()})"))
def q_absent(spark, sf):
    return Q.vocabulary_absent(_b(spark, sf).raw)


@register("A29_preflight_profile", _m(f"""
SELECT count(*) AS rows, min(t_ms) AS low_ms, max(t_ms) AS high_ms,
       count(*) FILTER (WHERE t_ms < {C.MIN_EPOCH_MS} OR t_ms > {C.MAX_EPOCH_MS}) AS out_of_range_rows,
       (SELECT count(*) FROM ps) AS sessions,
       (SELECT count(*) FROM ps WHERE stopped = 0) AS open_sessions,
       (SELECT count(*) FROM ps WHERE ids > 1) AS mixed_content_sessions,
       (SELECT count(*) FROM raw WHERE content_id NOT IN (SELECT content_id FROM content_src)) AS orphan_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT video_session_id, t_ms FROM raw)) AS duplicate_rows
FROM raw""", """ps AS (SELECT video_session_id, max(CASE WHEN event_type IN ('VideoError', 'VideoSessionEnd') THEN 1 ELSE 0 END) AS stopped,
                count(DISTINCT content_id) AS ids FROM raw GROUP BY video_session_id)"""))
def q_preflight(spark, sf):
    b = _b(spark, sf)
    return Q.preflight_profile(b.raw, b.content)


@register("A29_column_values", _m("""
SELECT "column", value, rows, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY rows DESC, value) AS rank FROM (
    SELECT "column", value, count(*) AS rows FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM raw" for c in C.EVENT_DIMS) + """)
    GROUP BY "column", value)) WHERE rank <= 8"""))
def q_column_values(spark, sf):
    return Q.column_values(_b(spark, sf).raw)


def _cadence_sql() -> str:
    gap_s, grace_s = TH.gap_ms / 1000.0, TH.grace_ms / 1000.0
    rank = lambda f: f"CAST(quantile_disc(gap_ms, {f}) AS DOUBLE) / CAST(1000 AS DOUBLE)"
    between = "t_ms - lag(t_ms) OVER (PARTITION BY video_session_id ORDER BY t_ms) AS gap_ms"
    return f"""bases(basis) AS (VALUES ('{C.EVENT_TYPE_HEARTBEAT}'), ('all')),
gaps AS (
  SELECT '{C.EVENT_TYPE_HEARTBEAT}' AS basis, {between} FROM (SELECT DISTINCT video_session_id, t_ms FROM raw WHERE event_type = '{C.EVENT_TYPE_HEARTBEAT}')
  UNION ALL SELECT 'all', {between} FROM (SELECT DISTINCT video_session_id, t_ms FROM raw)),
common AS (SELECT basis, gap_ms, count(*) AS n FROM gaps WHERE gap_ms IS NOT NULL GROUP BY basis, gap_ms
           QUALIFY row_number() OVER (PARTITION BY basis ORDER BY n DESC, gap_ms) = 1),
paced AS (SELECT basis, count(gap_ms) AS gaps, {rank(0.5)} AS p50_s, {rank(0.9)} AS p90_s, {rank(0.99)} AS p99_s
          FROM bases LEFT JOIN gaps USING (basis) GROUP BY basis),
cadence AS (SELECT basis, p50_s, p90_s, p99_s, gaps, common.gap_ms AS mode_ms, common.n AS mode_count,
       CASE WHEN gaps < 100 THEN 'warn' WHEN p90_s > {grace_s + 1} OR {gap_s} <= p90_s THEN 'fail'
            WHEN {grace_s} > p90_s * 1.5 + 1 THEN 'warn' ELSE 'pass' END AS verdict
  FROM paced LEFT JOIN common USING (basis)),
chosen AS (SELECT * FROM cadence ORDER BY basis = '{C.EVENT_TYPE_HEARTBEAT}' AND gaps > 0 DESC, basis = 'all' DESC LIMIT 1)"""


@register("A30_cadence", _m("SELECT * FROM chosen", _cadence_sql()))
def q_cadence(spark, sf):
    return Q.cadence(_b(spark, sf).raw, TH)


@register("A30_cadence_by_basis", _m("SELECT * FROM cadence", _cadence_sql()))
def q_cadence_by_basis(spark, sf):
    return Q.cadence_by_basis(_b(spark, sf).raw, TH)


@register("A37_run_stats", _m(f"""
SELECT (SELECT count(DISTINCT video_session_id) FROM raw) AS sessions,
       (SELECT count(*) FROM active_intervals) AS segments,
       (SELECT count(DISTINCT video_session_id) FROM raw) - (SELECT count(DISTINCT video_session_id) FROM active_intervals) AS sessions_with_no_active_time,
       CAST(sum(c) AS BIGINT) AS session_minutes,
       (SELECT count(*) FROM session_minutes sm WHERE NOT EXISTS (
          SELECT 1 FROM raw r WHERE r.video_session_id = sm.video_session_id AND r.t_ms // {B} = sm.minute)) AS covered_minutes_without_events,
       (SELECT max(t_ms) // {B} - min(t_ms) // {B} + 1 FROM raw) AS minutes_in_span,
       count(*) AS minutes_with_activity, max(c) AS peak_concurrency, arg_max(minute, (c, -minute)) AS peak_minute,
       CAST(sum(c) AS DOUBLE) / CAST((SELECT max(t_ms) // {B} - min(t_ms) // {B} + 1 FROM raw) AS DOUBLE) AS average_over_span,
       CAST(sum(c) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS average_over_active_minutes
FROM (SELECT minute, count(*) AS c FROM session_minutes GROUP BY minute)"""))
def q_run_stats(spark, sf):
    b = _b(spark, sf).materialize()
    return Q.run_stats(b.raw, b.intervals, b.session_minutes, B)


_SHOWS = {"paused": "k = 4", "resumed": "k = 2", "backgrounded": "k = 5", "foregrounded": "k = 3",
          "errored": "event_type = 'VideoError'", "ended": "event_type = 'VideoSessionEnd'"}


def _more_than_one(table: str, key: str = "video_session_id", what: str = "*") -> str:
    return f"(SELECT count(*) FROM (SELECT {key} FROM {table} GROUP BY 1 HAVING count({what}) > 1))"


@register("A41_variety", _m("SELECT " + ", ".join(
    f"count(DISTINCT video_session_id) FILTER (WHERE {c}) AS sessions_{n}" for n, c in _SHOWS.items()) + f""",
       {_more_than_one("active_intervals")} AS sessions_multi_interval, {_more_than_one("session_minutes")} AS sessions_multi_minute,
       {_more_than_one("raw", "user_id", "DISTINCT video_session_id")} AS users_multi_session,
       {_more_than_one("raw", "user_id", "DISTINCT platform")} AS users_multi_device
FROM (SELECT *, {O._kind_sql()} AS k FROM raw)"""))
def q_variety(spark, sf):
    b = _b(spark, sf).materialize()
    return Q.variety(b.raw, b.intervals, b.session_minutes)


@register("A34_shard_proof", _m("""
SELECT CAST(8 AS BIGINT) AS shards, (SELECT count(*) FROM g) AS minutes,
       (SELECT count(*) FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM sh)) AS only_left,
       (SELECT count(*) FROM (SELECT * FROM sh EXCEPT ALL SELECT * FROM g)) AS only_right""", """
g AS (SELECT minute, count(*) AS concurrency FROM session_minutes GROUP BY minute),
sh AS (SELECT minute, CAST(sum(c) AS BIGINT) AS concurrency FROM (
  SELECT hash(video_session_id) % 8 AS shard, minute, count(*) AS c FROM session_minutes GROUP BY 1, 2) GROUP BY minute)"""))
def q_shard(spark, sf):
    return Q.shard_proof(_b(spark, sf).session_minutes, 8)


@register("A35_presence_series", _m(
    f"SELECT minute, count(*) AS presence_sessions FROM (SELECT DISTINCT video_session_id, t_ms // {B} AS minute FROM raw) GROUP BY minute"))
def q_presence(spark, sf):
    return Q.presence_series(_b(spark, sf).raw, B)


_PD = ", ".join(Q.PROXY_DIMS)


@register("A35_presence_rollup", _m(
    f"SELECT {_PD}, minute, count(*) AS sessions FROM (SELECT DISTINCT video_session_id, {_PD}, t_ms // {B} AS minute FROM raw)"
    f" GROUP BY {_PD}, minute"))
def q_presence_rollup(spark, sf):
    return Q.presence_rollup(_b(spark, sf).raw, B)


@register("A36_presence_vs_active", _m(f"""
SELECT count(*) FILTER (WHERE p.video_session_id IS NOT NULL AND a.video_session_id IS NOT NULL) AS both,
       count(*) FILTER (WHERE a.video_session_id IS NULL) AS presence_only,
       count(*) FILTER (WHERE p.video_session_id IS NULL) AS active_only,
       (SELECT max(c) FROM (SELECT minute, count(*) AS c FROM pres GROUP BY minute)) AS presence_peak,
       (SELECT max(c) FROM (SELECT minute, count(*) AS c FROM session_minutes GROUP BY minute)) AS active_peak
FROM pres p FULL OUTER JOIN (SELECT video_session_id, minute FROM session_minutes) a
  ON p.video_session_id = a.video_session_id AND p.minute = a.minute""",
    f"pres AS (SELECT DISTINCT video_session_id, t_ms // {B} AS minute FROM raw)"))
def q_presence_vs_active(spark, sf):
    b = _b(spark, sf)
    return Q.presence_vs_active(b.raw, b.session_minutes, B)


SESSION_USER_CTE = """su AS (SELECT video_session_id, arg_max(user_id, (t_ms, user_id)) AS user_id FROM raw GROUP BY video_session_id)"""


@register("A22_user_level_peak", _m("""
SELECT sm.minute, count(*) AS sessions, count(DISTINCT su.user_id) AS users_exact
FROM session_minutes sm JOIN su ON su.video_session_id = sm.video_session_id
GROUP BY sm.minute ORDER BY sessions DESC, sm.minute LIMIT 1""", SESSION_USER_CTE))
def q_user_peak(spark, sf):
    b = _b(spark, sf).materialize()
    return U.peak_minute_users(b.session_minutes, b.raw)


@register("A22_user_level_sketch", _m("""
SELECT sm.minute, count(*) AS sessions, count(DISTINCT su.user_id) AS users_exact, true AS within_three_errors
FROM session_minutes sm JOIN su ON su.video_session_id = sm.video_session_id
GROUP BY sm.minute ORDER BY sessions DESC, sm.minute LIMIT 1""", SESSION_USER_CTE))
def q_user_sketch(spark, sf):
    # a sketch of 2^12 registers has a standard error of 1.04 / 2^6 = 1.625 per cent
    b = _b(spark, sf).materialize()
    told = U.peak_minute_users_approx(b.session_minutes, b.raw)
    return told.select("minute", "sessions", "users_exact", (F.col("error_pct") <= 3 * 1.625).alias("within_three_errors"))


@register("A23_multi_user_and_session", _m("""
SELECT (SELECT count(*) FROM (SELECT video_session_id FROM raw GROUP BY 1 HAVING count(DISTINCT user_id) > 1)) AS multi_user_sessions,
       (SELECT count(*) FROM (SELECT user_id FROM raw GROUP BY 1 HAVING count(DISTINCT video_session_id) > 1)) AS multi_session_users"""))
def q_multi(spark, sf):
    return U.multi_counts(_b(spark, sf).raw)


def _sweep_sql() -> str:
    cells = SW.grid(TH)
    extra = [f"""nv_int AS (SELECT video_session_id, min(t_ms) AS ts_start_ms, max(t_ms) + 1 AS ts_end_ms FROM raw GROUP BY 1),
nv_peak AS (SELECT max(c) AS p FROM (SELECT minute, count(DISTINCT video_session_id) AS c FROM (
  SELECT video_session_id, unnest(range(ts_start_ms // {B}, (ts_end_ms - 1) // {B} + 1)) AS minute FROM nv_int) GROUP BY minute))"""]
    rows = []
    for i, th in enumerate(cells):
        sfx = f"_{i}"
        extra.append(O.interval_ctes(th, sfx).strip())
        extra.append(f"""cov{sfx} AS (SELECT DISTINCT video_session_id, minute FROM (
  SELECT video_session_id, unnest(range(ts_start_ms // {B}, (ts_end_ms - 1) // {B} + 1)) AS minute FROM active_intervals{sfx})),
per{sfx} AS (SELECT minute, count(*) AS c FROM cov{sfx} GROUP BY minute)""")
        rows.append(f"""SELECT CAST({th.gap_ms} AS BIGINT) AS gap_ms, CAST({th.grace_ms} AS BIGINT) AS grace_ms,
  (SELECT count(*) FROM active_intervals{sfx}) AS segments, max(c) AS peak, arg_max(minute, (c, -minute)) AS peak_minute,
  CAST(sum(c) AS DOUBLE) / CAST(max(minute) - min(minute) + 1 AS DOUBLE) AS average, CAST(sum(c) AS BIGINT) AS session_minutes,
  (SELECT p FROM nv_peak) AS naive_peak, max(c) - (SELECT p FROM nv_peak) AS peak_minus_naive FROM per{sfx}""")
    return _m(" UNION ALL ".join(rows), ",\n".join(extra))


@register("A24_threshold_sweep", _sweep_sql())
def q_sweep(spark, sf):
    return SW.sweep(_b(spark, sf).raw, TH)


_ASKED = sorted({(d, v) for _, _, flt in C.BENCHMARKS for d, v in flt.items() if d in C.EVENT_DIMS})


@register("A29_preflight_checks", _m("""
SELECT 'timestamps' AS "check", CASE WHEN n > 0 THEN 'problem' ELSE 'ok' END AS severity, n, '' AS detail FROM odd_times
UNION ALL SELECT 'content_ids', CASE WHEN n > 0 THEN 'problem' ELSE 'ok' END, n, '' FROM orphan_rows
UNION ALL SELECT 'vocabulary', CASE WHEN types = """ + str(len(C.EXPECTED_EVENT_TYPES)) + """ THEN 'problem' WHEN n > 0 THEN 'warning' ELSE 'ok' END, n, detail
  FROM (SELECT count(*) AS n, count(*) FILTER (WHERE c = 'event_type') AS types,
               coalesce(string_agg(c || '=' || token, ', ' ORDER BY c || '=' || token), '') AS detail FROM unseen)
UNION ALL SELECT 'cadence', CASE verdict WHEN 'fail' THEN 'problem' WHEN 'warn' THEN 'warning' ELSE 'ok' END, gaps, basis FROM chosen
UNION ALL SELECT 'benchmark_slices', CASE WHEN n > 0 THEN 'warning' ELSE 'ok' END, n, detail
  FROM (SELECT count(*) AS n, coalesce(string_agg(name, ', ' ORDER BY name), '') AS detail FROM never)""", f"""
odd_times AS (SELECT count(*) AS n FROM raw WHERE t_ms NOT BETWEEN {C.MIN_EPOCH_MS} AND {C.MAX_EPOCH_MS}),
orphan_rows AS (SELECT count(*) AS n FROM raw WHERE content_id NOT IN (SELECT content_id FROM content_src)),
unseen AS ({_absent_rows()}),
never AS ({" UNION ALL ".join(f"SELECT '{d}={v}' AS name WHERE NOT EXISTS (SELECT 1 FROM raw WHERE {d} = '{v}')" for d, v in _ASKED)}),
{_cadence_sql()}"""))
def q_preflight_checks(spark, sf):
    b = _b(spark, sf)
    return Q.preflight_checks(b.raw, b.content, TH)
