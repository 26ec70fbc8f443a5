"""The batch build: raw events + content -> intervals, session-minutes, rollup."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from .. import session as _session
from ..operators import occupancy, sessionize
from ..sources import driver


@dataclass
class Build:
    """Lazily planned tables of one build; nothing runs until an action."""

    raw: DataFrame
    content: DataFrame
    th: C.Thresholds

    @cached_property
    def states(self) -> DataFrame:
        return sessionize.sessionize(self.raw, self.th)

    @cached_property
    def intervals(self) -> DataFrame:
        return sessionize.active_intervals(self.states, self.th)

    @cached_property
    def session_minutes(self) -> DataFrame:
        return occupancy.enrich(sessionize.session_minutes_events(self.states), self.content)

    @cached_property
    def rollup(self) -> DataFrame:
        return occupancy.rollup(self.session_minutes)

    def materialize(self, *tables: str) -> "Build":
        """The same build with `tables` (default: intervals, session_minutes and rollup) written.

        They go to the shared folder named by spark.checkpoint.dir, so questions
        that read the built tables many times (scalar subqueries, several joins)
        scan the columns they need instead of re-running the sessionizer, and a
        lost executor does not send the recovery back to the raw events.
        """
        m = Build(self.raw, self.content, self.th)
        wanted = set(tables or ("intervals", "session_minutes", "rollup"))
        # two tables come from the point states: the events are sessionized once for both
        m.__dict__["states"] = _session.written(self.states, "states") if {"intervals", "session_minutes"} <= wanted else self.states
        for name in ("intervals", "session_minutes", "rollup"):
            if name in wanted:
                m.__dict__[name] = _session.written(getattr(m, name), name.replace("_", "-"))
        return m


def build(raw: DataFrame, content: DataFrame, th: C.Thresholds) -> Build:
    return Build(raw, content, th)


def driver_build(spark: SparkSession, sf_dir: str, th: C.Thresholds = C.DRIVER) -> Build:
    """The build over the driver's tables (events -> telemetry, part -> content)."""
    _session.sized(_session.ensure(spark), driver.event_rows(spark, sf_dir))
    return Build(driver.raw_events(spark, sf_dir), driver.content(spark, sf_dir), th)


def write_rollup(rollup: DataFrame, path: str, th: C.Thresholds, replace_days: bool = False) -> None:
    """Persist the rollup partitioned by UTC day, sorted by minute inside files.

    Day partitions prune a minute range; min/max statistics on `minute` prune
    row groups inside a day. The table becomes what `rollup` holds; with
    `replace_days` only the days that `rollup` holds are replaced.
    Range partitioning on (day, minute) spreads one day over as many tasks as
    its size needs while keeping the files of a day few and minute-ordered.
    """
    per_day = C.DAY_MS // th.bucket_ms
    (rollup.withColumn("day", (F.col("minute") - F.pmod("minute", F.lit(per_day))) / F.lit(per_day))
     .withColumn("day", F.col("day").cast("bigint"))
     .repartitionByRange("day", "minute")
     .sortWithinPartitions("minute")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if replace_days else "static")
     .partitionBy("day").parquet(path))


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
