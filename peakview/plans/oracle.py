"""Independent SQL statement of the model, for DuckDB over the driver tables.

This is the straightforward single-node form: whole-session windows, a union
of covered and observed minutes and a carry-forward window. The Spark build
computes the same tables with a chunked, shuffle-lean plan; the two agree
row for row, which is the correctness gate.
"""

from __future__ import annotations

from .. import config as C
from ..sources import driver


def _kind_sql(et: str = "event_type", ev: str = "event") -> str:
    play = ", ".join(f"'{t}'" for t in C.EVENT_TOKENS_PLAY)
    pause = ", ".join(f"'{t}'" for t in C.EVENT_TOKENS_PAUSE)
    stop = ", ".join(f"'{t}'" for t in C.EVENT_TYPES_STOP)
    return (f"CASE WHEN {et} = '{C.EVENT_TYPE_START}' THEN 1"
            f" WHEN {et} = '{C.EVENT_TYPE_PLAY}' OR lower({ev}) IN ({play}) THEN 2"
            f" WHEN lower({ev}) IN ({pause}) THEN 4"
            f" WHEN {et} = '{C.EVENT_TYPE_BACKGROUND}' THEN 5"
            f" WHEN {et} = '{C.EVENT_TYPE_FOREGROUND}' THEN 3"
            f" WHEN {et} IN ({stop}) THEN 6 ELSE 0 END")


def _dims_sql() -> str:
    return "struct_pack(" + ", ".join(f"{d} := {d}" for d in C.EVENT_DIMS) + ")"


def interval_ctes(th: C.Thresholds, sfx: str = "", raw: str = "raw") -> str:
    """CTEs ending in active_intervals{sfx}: whole-session windows over distinct points."""
    gap, grace = th.gap_ms, th.grace_ms
    return f"""
pts{sfx} AS (
  SELECT s, t, kind, max(dims) AS dims, t * 8 + kind AS ord,
         CASE WHEN kind IN (1, 2) THEN 1 WHEN kind IN (4, 6) THEN 0 END AS ps,
         CASE WHEN kind IN (1, 3) THEN 1 WHEN kind = 5 THEN 0 END AS fs
  FROM (SELECT video_session_id AS s, t_ms AS t, {_kind_sql()} AS kind, {_dims_sql()} AS dims FROM {raw})
  GROUP BY s, t, kind),
st1{sfx} AS (
  SELECT s, t, ord,
         coalesce(last_value(ps IGNORE NULLS) OVER run, 1) = 1
           AND coalesce(last_value(fs IGNORE NULLS) OVER run, 1) = 1 AS is_on,
         lag(t) OVER w AS prev_t, lead(t) OVER w AS next_t
  FROM pts{sfx}
  WINDOW w AS (PARTITION BY s ORDER BY ord),
         run AS (PARTITION BY s ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
st2{sfx} AS (
  SELECT s, t, ord, is_on,
         is_on AND (NOT coalesce(lag(is_on) OVER (PARTITION BY s ORDER BY ord), false)
                    OR (prev_t IS NOT NULL AND t - prev_t > {gap})) AS opens,
         CASE WHEN next_t IS NULL OR next_t - t > {gap} THEN t + {grace} ELSE next_t END AS pe
  FROM st1{sfx}),
st3{sfx} AS (
  SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END)
              OVER (PARTITION BY s ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg
  FROM st2{sfx}),
iv0{sfx} AS (
  SELECT s, min(t) AS ts_start_ms, arg_max(pe, ord) AS ts_end_ms FROM st3{sfx} WHERE is_on GROUP BY s, seg),
active_intervals{sfx} AS (
  SELECT s AS video_session_id,
         CAST(row_number() OVER (PARTITION BY s ORDER BY ts_start_ms) AS BIGINT) AS segment_id,
         ts_start_ms, ts_end_ms
  FROM iv0{sfx} WHERE ts_end_ms > ts_start_ms)"""


def ctes(th: C.Thresholds = C.DRIVER, raw: str | None = None) -> str:
    """WITH-clause body defining raw, content, intervals, session_minutes, minute_occupancy.

    `raw` replaces the events subquery (e.g. one day of it, or copies of it).
    """
    b = th.bucket_ms
    dims_out = ", ".join(f"d.{d} AS {d}" for d in C.EVENT_DIMS)
    cdims = ", ".join(f"coalesce(c.{d}, '') AS {d}" for d in C.CONTENT_DIMS)
    keys = ", ".join(C.ROLLUP_DIMS)
    return f"""
raw AS {raw or driver.raw_events_sql()},
content_src AS {driver.content_sql()},
content AS (
  SELECT content_id, r.title AS title, r.video_type AS video_type, r.category AS category, r.show_name AS show_name
  FROM (SELECT content_id, max(struct_pack(title := coalesce(title, ''), video_type := coalesce(video_type, ''),
                                          category := coalesce(category, ''), show_name := coalesce(show_name, ''))) AS r
        FROM content_src WHERE content_id >= 0 GROUP BY content_id)),{interval_ctes(th)},
covered AS (
  SELECT DISTINCT video_session_id, minute FROM (
    SELECT video_session_id, unnest(range(ts_start_ms // {b}, (ts_end_ms - 1) // {b} + 1)) AS minute
    FROM active_intervals)),
observed AS (
  SELECT video_session_id, minute, arg_max(dims, struct_pack(o := ord, d := dims)) AS dims FROM (
    SELECT video_session_id, t_ms // {b} AS minute, t_ms * 8 + ({_kind_sql()}) AS ord, {_dims_sql()} AS dims
    FROM raw)
  GROUP BY video_session_id, minute),
marked AS (
  SELECT video_session_id, minute, 1 AS cov, NULL AS dims FROM covered
  UNION ALL
  SELECT video_session_id, minute, 0 AS cov, dims FROM observed),
carried AS (
  SELECT video_session_id, minute, cov,
         last_value(dims IGNORE NULLS) OVER (PARTITION BY video_session_id ORDER BY minute, cov
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d
  FROM marked),
session_minutes AS (
  SELECT x.video_session_id, x.minute, {", ".join(f"x.{d}" for d in C.EVENT_DIMS)}, {cdims}
  FROM (SELECT video_session_id, minute, {dims_out} FROM carried WHERE cov = 1) x
  LEFT JOIN content c ON c.content_id = x.content_id),
minute_occupancy AS (
  SELECT {keys}, minute, CAST(count(*) AS BIGINT) AS sessions
  FROM session_minutes GROUP BY {keys}, minute)"""


def with_model(select: str, th: C.Thresholds = C.DRIVER, extra: str = "", raw: str | None = None) -> str:
    """A full statement: the model CTEs, optional extra CTEs, then `select`."""
    more = f",\n{extra}" if extra else ""
    return f"WITH {ctes(th, raw)}{more}\n{select}"
