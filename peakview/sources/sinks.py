"""Sinks and dataset utilities."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from ..functions import running as R
from ..operators.quality import fingerprint, two_way_difference

S = "video_session_id"


def write_by_day(df: DataFrame, path: str, minute_col: str, bucket_ms: int, sort: list[str]) -> None:
    """Day-partitioned table write with dynamic overwrite of the days present."""
    per_day = max(1, C.DAY_MS // bucket_ms)
    (df.withColumn("day", X.floor_div(minute_col, per_day))
     .repartitionByRange("day", *sort).sortWithinPartitions(*sort)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def write_answers(df: DataFrame, path: str, order: list[str], fmt: str = "csv") -> None:
    """One ordered file of answers with stable bytes: no ids, no timestamps."""
    w = df.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.json(path)


# --------------------------------------------------------------------------
# S10, S11 dictionary-coded snapshot
# --------------------------------------------------------------------------

CODED = (*C.STRING_DIMS, "content_id")


def snapshot_dictionary(rollup: DataFrame) -> DataFrame:
    """(column, code, value, minutes_present): codes by descending minutes present, then value."""
    stacked = rollup.select("minute", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in CODED])).alias("p")
    ).select("p.column", "p.value", "minute").distinct()
    present = stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("minutes_present"))
    w = Window.partitionBy("column").orderBy(F.desc("minutes_present"), F.asc("value"))
    return present.select("column", (F.row_number().over(w) - 1).cast("bigint").alias("code"),
                          "value", "minutes_present")


def snapshot(rollup: DataFrame, bucket_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packed rollup of integer codes, dictionary, minute index)."""
    dictionary = snapshot_dictionary(rollup)
    minutes = rollup.select("minute").distinct()
    minute_index = R.row_index(minutes, ["minute"], X.floor_div("minute", max(1, C.DAY_MS // bucket_ms)),
                               "minute_index").withColumn("minute_index", F.col("minute_index") - 1)
    packed = rollup.join(minute_index, "minute", "inner")
    for c in CODED:
        d = dictionary.filter(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"{c}_code"))
        packed = packed.join(d, F.col(c).cast("string") == F.col(f"_v_{c}"), "inner").drop(f"_v_{c}")
    packed = packed.select("minute_index", *[f"{c}_code" for c in CODED], "sessions")
    return packed, dictionary, minute_index


def decode(packed: DataFrame, dictionary: DataFrame, minute_index: DataFrame) -> DataFrame:
    """Inverse of `snapshot`: codes back to values and minute indexes back to minutes."""
    out = packed.join(minute_index, "minute_index", "inner")
    for c in CODED:
        d = dictionary.filter(F.col("column") == c).select(F.col("code").alias(f"{c}_code"), F.col("value").alias(f"_v_{c}"))
        out = out.join(d, f"{c}_code", "inner")
        cast = "bigint" if c == "content_id" else "string"
        out = out.withColumn(c, F.col(f"_v_{c}").cast(cast)).drop(f"_v_{c}", f"{c}_code")
    return out.select(*C.ROLLUP_DIMS, "minute", "sessions")


def audit_snapshot(rollup: DataFrame, packed: DataFrame, dictionary: DataFrame, minute_index: DataFrame) -> DataFrame:
    """Recompute peak, minutes, rows and per-value minutes from the snapshot; compare."""
    back = decode(packed, dictionary, minute_index)
    diff = two_way_difference(rollup.select(*C.ROLLUP_DIMS, "minute", "sessions"), back)
    peak_of = lambda df: df.groupBy("minute").agg(F.sum("sessions").alias("c")).agg(F.max("c")).scalar()
    again = snapshot_dictionary(back).select("column", "value", F.col("minutes_present").alias("m2"))
    mism = (dictionary.select("column", "value", "minutes_present").join(again, ["column", "value"], "full")
            .filter(~F.col("minutes_present").eqNullSafe(F.col("m2"))).agg(F.count(F.lit(1))).scalar())
    return diff.select(
        packed.agg(F.count(F.lit(1))).scalar().alias("rows"),
        rollup.agg(F.count(F.lit(1))).scalar().alias("rollup_rows"),
        minute_index.agg(F.count(F.lit(1))).scalar().alias("minutes"),
        peak_of(back).alias("snapshot_peak"),
        peak_of(rollup).alias("rollup_peak"),
        mism.alias("minutes_present_mismatches"),
        "only_left", "only_right")


# --------------------------------------------------------------------------
# S12-S14, S16, S17 dataset utilities
# --------------------------------------------------------------------------

def held_out_day(raw: DataFrame) -> DataFrame:
    """Events of the latest UTC day in the data (S12; the last day, not the busiest)."""
    day = X.floor_div("t_ms", C.DAY_MS)
    last = raw.agg(F.max(day)).scalar()
    return raw.filter(day == last)


def split_day(raw: DataFrame, day_index: int) -> DataFrame:
    return raw.filter(X.floor_div("t_ms", C.DAY_MS) == F.lit(day_index))


def user_bucket(buckets: int):
    """A user's bucket, from the first 32 bits of the md5 of the id: the same in any engine."""
    return F.pmod(F.conv(F.substring(F.md5("user_id"), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def entity_sample(raw: DataFrame, content: DataFrame, bucket: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Keep whole sessions any of whose users hash into `bucket` of `buckets`.

    A sampling operator by design: sessions are kept or dropped whole, and
    the catalogue keeps the ids the kept events use.
    """
    chosen = raw.filter(user_bucket(buckets) == bucket).select(S).distinct()
    events = raw.join(chosen, S, "left_semi")
    ids = events.select("content_id").distinct()
    return events, content.join(ids, "content_id", "left_semi")


def verified_copy(df: DataFrame, path: str, name: str) -> DataFrame:
    """Copy a table to `path` and compare row count and content fingerprint.

    The source is fingerprinted while it is written, in the same pass, and the
    copy is read once.
    """
    seen = Observation(f"copy-{uuid.uuid4().hex}")
    h = F.xxhash64(*sorted(df.columns))
    (df.observe(seen, F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor_hash"), F.sum(h.cast("decimal(38,0)")).alias("sum_hash"))
     .write.mode("overwrite").parquet(path))
    source = seen.get
    copy = fingerprint(df.sparkSession.read.schema(df.schema).parquet(path), name)
    same = [F.col(k) == F.lit(source[k] if source[k] is not None else 0).cast(copy.schema[k].dataType) for k in ("rows", "xor_hash", "sum_hash")]
    return copy.select("table", "rows", (same[0] & same[1] & same[2]).alias("identical"))


def read_reference_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Interval table from CSV with an explicit schema, for diffing."""
    return (spark.read.option("header", True)
            .schema("video_session_id string, segment_id bigint, ts_start_ms bigint, ts_end_ms bigint").csv(path))


def read_reference_rollup(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{d} {'bigint' if d == 'content_id' else 'string'}" for d in C.ROLLUP_DIMS)
    return spark.read.option("header", True).schema(f"{schema}, minute bigint, sessions bigint").csv(path)


def replicate(raw: DataFrame, copies: int, span_ms: int | None = None) -> DataFrame:
    """`copies` copies of the events with suffixed session ids and shifted time.

    Each row fans out to a fixed, small number of copies (generate, not a join).
    """
    if span_ms is None:
        lo, hi = raw.agg(F.min("t_ms"), F.max("t_ms")).first()
        span_ms = hi - lo + 1
    rep = raw.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    shift = (F.col("_r") - 1).cast("bigint") * F.lit(span_ms)
    return (rep.withColumn(S, F.concat(F.col(S), F.lit("-rep"), F.col("_r").cast("string")))
            .withColumn("user_id", F.concat(F.col("user_id"), F.lit("-rep"), F.col("_r").cast("string")))
            .withColumn("t_ms", F.col("t_ms") + shift)
            .withColumn("session_start_ms", F.col("session_start_ms") + shift)
            .drop("_r"))

