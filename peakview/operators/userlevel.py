"""User-level concurrency (A22, A23, J4): distinct viewers rather than sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session as _session

S = "video_session_id"


def session_user(raw: DataFrame) -> DataFrame:
    """The user of each session: the one on its latest event (ties: largest id)."""
    return raw.groupBy(S).agg(F.max_by("user_id", F.struct("t_ms", "user_id")).alias("user_id"))


def per_minute_users(session_minutes: DataFrame, raw: DataFrame) -> DataFrame:
    """Sessions and exact distinct users per minute."""
    joined = session_minutes.select(S, "minute").join(session_user(raw), S, "inner")
    return joined.groupBy("minute").agg(F.count(F.lit(1)).alias("sessions"),
                                        F.count_distinct("user_id").alias("users_exact"))


def peak_minute_users(session_minutes: DataFrame, raw: DataFrame) -> DataFrame:
    """At the busiest minute (earliest on ties): sessions and exact users.

    The minute is found from counts alone; users are joined and told apart in
    that minute only.
    """
    per = session_minutes.groupBy("minute").agg(F.count(F.lit(1)).alias("c"))
    busiest = per.agg(F.max_by("minute", F.struct(F.col("c"), -F.col("minute")))).scalar()
    return per_minute_users(session_minutes.filter(F.col("minute") == busiest), raw)


def user_sketch_rollup(session_minutes: DataFrame, raw: DataFrame, dims=("platform",), lg_k: int = 12) -> DataFrame:
    """Mergeable per-(dims, minute) HLL sketches of users (A22, mergeable form).

    Sketches union across any dimensions left unfiltered, the way session
    counts sum, so user-level answers can be served from a rollup too.
    """
    joined = session_minutes.select(S, "minute", *dims).join(session_user(raw), S, "inner")
    return joined.groupBy(*dims, "minute").agg(F.hll_sketch_agg("user_id", lg_k).alias("users_sketch"))


def users_from_sketches(sketches: DataFrame) -> DataFrame:
    """Estimated distinct users per minute after merging the sketches of all slices."""
    return (sketches.groupBy("minute").agg(F.hll_union_agg("users_sketch").alias("u"))
            .select("minute", F.hll_sketch_estimate("u").alias("users_approx")))


def peak_minute_users_approx(session_minutes: DataFrame, raw: DataFrame) -> DataFrame:
    """Exact and sketch-estimated users at the peak minute, with the relative error."""
    exact = _session.written(peak_minute_users(session_minutes, raw), "peak-users")
    at_peak = session_minutes.filter(F.col("minute") == exact.select("minute").scalar())
    approx = users_from_sketches(user_sketch_rollup(at_peak, raw))
    return (exact.join(approx, "minute", "inner")
            .withColumn("error_pct", F.abs(F.col("users_approx") - F.col("users_exact")) * 100.0
                        / F.col("users_exact")))


def multi_counts(raw: DataFrame) -> DataFrame:
    """Sessions carrying more than one user, users with more than one session."""
    by_session = raw.groupBy(S).agg(F.count_distinct("user_id").alias("u"))
    by_user = raw.groupBy("user_id").agg(F.count_distinct(S).alias("s"))
    return by_session.agg(F.count_if(F.col("u") > 1).alias("multi_user_sessions")).select(
        "multi_user_sessions", by_user.agg(F.count_if(F.col("s") > 1)).scalar().alias("multi_session_users"))
