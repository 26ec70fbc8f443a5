"""Session-minutes with content dimensions, and the per-minute rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C

S = "video_session_id"

def dedupe_content(content: DataFrame) -> DataFrame:
    """One catalogue row per content_id; on duplicates the largest row wins."""
    fields = ("title", "video_type", "category", "show_name")
    return (content.filter(F.col("content_id") >= 0)
            .groupBy("content_id")
            .agg(F.max(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in fields])).alias("r"))
            .select("content_id", *[F.col(f"r.{c}").alias(c) for c in fields]))


def enrich(session_minutes: DataFrame, content: DataFrame) -> DataFrame:
    """Add video_type, category, show_name by content_id, '' when unknown.

    The adaptive plan sends a catalogue that its shuffle has shown to be small
    to every task, and splits a content id that many session-minutes share.
    """
    cat = dedupe_content(content).select("content_id", *C.CONTENT_DIMS)
    return (session_minutes.join(cat, "content_id", "left")
            .select(S, "minute", *C.EVENT_DIMS,
                    *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in C.CONTENT_DIMS]))


def rollup(session_minutes: DataFrame) -> DataFrame:
    """Sessions per (11 dims, minute) (A5). Partial aggregation runs map-side."""
    return (session_minutes.groupBy(*C.ROLLUP_DIMS, "minute")
            .agg(F.count(F.lit(1)).alias("sessions"))
            .select(*C.ROLLUP_DIMS, "minute", "sessions"))
