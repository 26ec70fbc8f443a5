"""Column expressions shared by the batch build, serving and streaming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_div(c: str | Column, n: int) -> Column:
    """Exact integer floor division of a bigint by a positive constant."""
    c = col(c)
    return ((c - F.pmod(c, F.lit(n))) / F.lit(n)).cast("bigint")


def kind(event_type: str | Column = "event_type", event: str | Column = "event") -> Column:
    """Event kind 0..6; the first matching rule wins."""
    et, ev = col(event_type), F.lower(col(event))
    return (
        F.when(et == C.EVENT_TYPE_START, C.KIND_START)
        .when((et == C.EVENT_TYPE_PLAY) | ev.isin(*C.EVENT_TOKENS_PLAY), C.KIND_PLAY)
        .when(ev.isin(*C.EVENT_TOKENS_PAUSE), C.KIND_PAUSE)
        .when(et == C.EVENT_TYPE_BACKGROUND, C.KIND_BACKGROUND)
        .when(et == C.EVENT_TYPE_FOREGROUND, C.KIND_FOREGROUND)
        .when(et.isin(*C.EVENT_TYPES_STOP), C.KIND_STOP)
        .otherwise(C.KIND_OTHER)
    )


def ord_key(t_ms: str | Column = "t", k: str | Column = "kind") -> Column:
    """Total order inside a session: at one millisecond, switching-off applies last."""
    return col(t_ms) * 8 + col(k)


def playing_signal(k: str | Column = "kind") -> Column:
    """1 = playing, 0 = not playing, null = no signal."""
    k = col(k)
    return (F.when(k.isin(C.KIND_START, C.KIND_PLAY), F.lit(1))
            .when(k.isin(C.KIND_PAUSE, C.KIND_STOP), F.lit(0)))


def foreground_signal(k: str | Column = "kind") -> Column:
    k = col(k)
    return (F.when(k.isin(C.KIND_START, C.KIND_FOREGROUND), F.lit(1))
            .when(k == C.KIND_BACKGROUND, F.lit(0)))


def dims_struct(names=C.EVENT_DIMS) -> Column:
    return F.struct(*[F.col(n) for n in names])


def grain_bucket(minute: str | Column, grain: int) -> Column:
    """Start of the reporting bucket that holds `minute`."""
    return floor_div(minute, grain) * F.lit(grain)


def bucket_to_ms(minute: str | Column, bucket_ms: int) -> Column:
    return col(minute) * F.lit(bucket_ms)


def minute_utc_seconds(minute: str | Column, bucket_ms: int) -> Column:
    """Epoch seconds of a bucket start (P15); kept integral for stable hashes."""
    return (col(minute) * F.lit(bucket_ms) / F.lit(1000)).cast("bigint")


def minute_label(minute: str | Column, bucket_ms: int) -> Column:
    """UTC label of a bucket start, e.g. 2024-01-05 13:00."""
    return F.date_format(F.timestamp_millis(col(minute) * F.lit(bucket_ms)), "yyyy-MM-dd HH:mm")
