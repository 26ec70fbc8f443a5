"""Order-dependent computations without a single-partition window.

A window with ORDER BY but no PARTITION BY moves every row into one task.
These helpers split the order into buckets (any monotone key, e.g. the day
of a timestamp), run the window inside each bucket, and carry in what the
earlier buckets contribute from a table with one row per bucket. The result
is exact; only the per-bucket table is ever ordered as a whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session as _session

_B = "_bucket"


def running_sum(df: DataFrame, order: list[str | Column], value: str, bucket: Column, out: str,
                partition: list[str] | None = None) -> DataFrame:
    """`out` = sum of `value` over all rows up to and including this one.

    `bucket` must be non-decreasing along `order`, and rows tied on `order`
    must share a bucket. `partition` optionally restarts the sum per key.
    """
    part = list(partition or [])
    b = df.withColumn(_B, bucket)
    per = b.groupBy(*part, _B).agg(F.sum(value).alias("_bsum"))
    wc = Window.partitionBy(*part).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*part, _B, F.coalesce(F.sum("_bsum").over(wc), F.lit(0)).alias("_carry"))
    w = Window.partitionBy(*part, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (b.join(carry, [*part, _B], "inner")
            .withColumn(out, F.col("_carry") + F.sum(value).over(w))
            .drop("_carry", _B))


def peak_of_running_sum(df: DataFrame, order: list[str | Column], value: str, bucket: Column, out: str,
                        partition: list[str] | None = None, widths: tuple[int, ...] = (1440, 366)) -> DataFrame:
    """`out` = the largest running sum of `value` along `order`, per `partition`.

    A bucket is summarised as (net, best): its sum and its largest prefix sum.
    Summaries merge, (n1, b1) + (n2, b2) = (n1 + n2, max(b1, n1 + b2)), so they
    are folded level by level, `widths` neighbouring buckets into one, and what
    is left of a partition in a last step. Rows are ordered inside one bucket
    only; every later step orders summaries, at most `widths` of them at once.
    `bucket` must be a whole number, non-decreasing along `order`, and rows tied
    on `order` must share a bucket.
    """
    part = list(partition or [])
    w = Window.partitionBy(*part, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    folded = (df.withColumn(_B, bucket).withColumn("_so_far", F.sum(value).over(w))
              .groupBy(*part, _B).agg(F.sum(value).alias("_net"), F.max("_so_far").alias("_best")))
    for width in (*widths, None):
        wide = F.lit(0).cast("bigint") if width is None else F.floor(F.col(_B) / F.lit(width)).cast("bigint")
        w = Window.partitionBy(*part, "_wide").orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
        folded = (folded.withColumn("_wide", wide)
                  .withColumn("_best", F.col("_best") + F.coalesce(F.sum("_net").over(w), F.lit(0)))
                  .groupBy(*part, "_wide").agg(F.sum("_net").alias("_net"), F.max("_best").alias("_best"))
                  .withColumnRenamed("_wide", _B))
    return folded.select(*part, F.col("_best").alias(out))


def neighbour_row(df: DataFrame, order: str, cols: list[str], bucket: Column,
                  prefix: str = "prev_", following: bool = False) -> DataFrame:
    """Attach the previous (or next) row's `cols` by `order` (unique) as prefix+col.

    Inside a bucket this is lag() / lead(); the edge row of a bucket takes the
    edge row of the nearest bucket before (after) it, carried through a
    per-bucket table.
    """
    b = df.withColumn(_B, bucket)
    pick = F.min_by if following else F.max_by
    edge = b.groupBy(_B).agg(pick(F.struct(*cols), F.col(order)).alias("_edge"))
    wc = Window.orderBy(_B)
    carry = edge.select(_B, (F.lead if following else F.lag)("_edge").over(wc).alias("_in"))
    w = Window.partitionBy(_B).orderBy(order)
    step = F.lead if following else F.lag
    out = b.join(carry, _B, "inner")
    for c in cols:
        out = out.withColumn(prefix + c, F.coalesce(step(c).over(w), F.col(f"_in.{c}")))
    return out.drop("_in", _B)


def previous_row(df: DataFrame, order: str, cols: list[str], bucket: Column, prefix: str = "prev_") -> DataFrame:
    return neighbour_row(df, order, cols, bucket, prefix, following=False)


def next_row(df: DataFrame, order: str, cols: list[str], bucket: Column, prefix: str = "next_") -> DataFrame:
    return neighbour_row(df, order, cols, bucket, prefix, following=True)


def row_index(df: DataFrame, order: list[str | Column], bucket: Column, out: str = "rn") -> DataFrame:
    """1-based position of each row in a total order, two-level."""
    return running_sum(df.withColumn("_one", F.lit(1)), order, "_one", bucket, out).drop("_one") \
        .withColumn(out, F.col(out).cast("bigint"))


def expand(spans: DataFrame, lo: Column, hi: Column, per: int, out: str = "minute") -> DataFrame:
    """`spans` with a row for every whole number from `lo` to `hi` in `out`, however long a span is.

    A span is cut into stretches of `per` numbers first. The stretches are dealt
    to all tasks and only there become numbers, `per` at most per row, so one
    span of centuries is neither one array nor one task's work.
    """
    part = lambda c: F.floor(c / F.lit(per)).cast("bigint")
    cut = spans.withColumn("_lo", lo).withColumn("_hi", hi).filter("_lo <= _hi")
    cut = cut.withColumn("_part", F.explode(F.sequence(part(F.col("_lo")), part(F.col("_hi")))))
    dealt = cut.repartition(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_part")
    numbers = F.sequence(F.greatest("_lo", F.col("_part") * per), F.least("_hi", F.col("_part") * per + (per - 1)))
    return dealt.withColumn(out, F.explode(numbers)).drop("_lo", "_hi", "_part")


def nearest_ranks(hist: DataFrame, value: str, count: str, fractions: dict[str, float], partition: list[str] | None = None,
                  ways: int = 1024) -> DataFrame:
    """Exact nearest-rank quantiles per `partition`, with `total`: the smallest value whose running count reaches f * total.

    `hist` holds whole-number values and their counts. Each quantile has a range
    that is sure to hold it, at first all values of its partition. A round cuts
    every range into `ways` equal parts, adds up the parts' counts and goes on
    with the part that holds the rank, until the range is one value. A round is
    one aggregation to at most `ways` rows per quantile, however the values are
    spread; the number of rounds is the logarithm of the range.
    """
    part = list(partition or [])
    if not part:
        return nearest_ranks(hist.withColumn("_all", F.lit(0)), value, count, fractions, ["_all"], ways).drop("_all")
    hist = _session.written(hist.select(*part, F.col(value).cast("bigint").alias("_v"), F.col(count).alias("_n")), "ranks")
    ends = hist.groupBy(*part).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("total"))
    asked = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(f)).alias("f")) for n, f in fractions.items()])
    ranges = _session.written(ends.select(*part, "total", F.explode(asked).alias("_q"), "_lo", "_hi", F.lit(0).cast("bigint").alias("_below")), "ranks")
    wide = ranges.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0]
    while wide:  # at most log(range) / log(ways) rounds
        step = F.floor((F.col("_hi") - F.col("_lo")) / F.lit(ways)).cast("bigint") + 1
        inside = hist.join(ranges, part).filter("_v BETWEEN _lo AND _hi")
        counted = (inside.withColumn("_part", F.floor((F.col("_v") - F.col("_lo")) / step).cast("bigint"))
                   .groupBy(*part, "total", "_q", "_lo", "_hi", "_below", "_part").agg(F.sum("_n").alias("_n")))
        w = Window.partitionBy(*part, "_q").orderBy("_part")
        upto = F.col("_below") + F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))
        reached = counted.withColumn("_upto", upto).filter(F.col("_upto") >= F.col("_q.f") * F.col("total"))
        first = reached.withColumn("_at", F.row_number().over(w)).filter("_at = 1")
        ranges = _session.written(first.select(
            *part, "total", "_q", (F.col("_lo") + F.col("_part") * step).alias("_lo"),
            F.least("_hi", F.col("_lo") + (F.col("_part") + 1) * step - 1).alias("_hi"), (F.col("_upto") - F.col("_n")).alias("_below")), "ranks")
        wide = ranges.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0]
    return ranges.groupBy(*part, "total").agg(*[F.max(F.when(F.col("_q.name") == n, F.col("_lo"))).alias(n) for n in fractions])


def global_rank(df: DataFrame, order: list[str | Column], out: str = "rank") -> DataFrame:
    """1-based position of each row in a total order of any columns, by range partitions.

    Rows are dealt into ranges of the order and sorted inside them; a row's rank
    is its place in its range plus the sizes of the ranges before. The sorted
    ranges are written once, so that places and sizes are of the same ranges
    also when a lost task is run again, and only one row per range is ever
    ordered as a whole. `order` should have no ties.
    """
    spark = df.sparkSession
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    path = _session.scratch_path(spark, f"rank-{uuid.uuid4().hex}")
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
     .withColumn("_range", F.spark_partition_id())
     .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
     .write.parquet(path))
    ranges = spark.read.schema(df.schema.add("_range", "integer").add("_place", "long")).parquet(path)
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    # one row per shuffle partition
    return (ranges.join(F.broadcast(before), "_range")
            .withColumn(out, (F.col("_before") + F.col("_place") + 1).cast("bigint")).drop("_range", "_place", "_before"))


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, salt_buckets: int = 64,
          salt_of: list[str] | None = None) -> DataFrame:
    """The first `n` rows per group by `order`, with ties broken by `order` only.

    Rows are first cut to the top `n` inside (group, salt) sub-groups, so a
    hot group is ranked by many tasks; the final ranking sees at most
    n * salt_buckets rows per group.
    """
    salt_cols = salt_of or [c for c in df.columns if c not in group]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_cols), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    pre = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= n).drop("_r", "_salt")
    w2 = Window.partitionBy(*group).orderBy(*order)
    return pre.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= n)
