"""A built rollup on storage, opened for serving questions.

Layout under one folder:
  versions/<name>               an empty marker: this build is complete; the last name is served
  data/<name>/minute_occupancy  the 11-dimension rollup, partitioned by UTC day
  data/<name>/occupancy_cpv     projection on (minute, country, platform, video_type), ordered by minute
  data/<name>/occupancy_by_content  the rollup in a second order: by bucket of content_id, content_id, minute
  data/<name>/dimension_value   (dimension, value) catalogue for filter resolution
  data/<name>/naive_vs_foreground  per-minute foreground and naive counts (overcount questions)

A build goes into a new folder and its marker is made last, so a reader sees
the previous build or the new one, whole, and no day of an older build stays.
Names count up from the last marker, so a writer's clock decides nothing. The
last `keep` builds stay for readers that are still on them; older ones, and
folders that a writer never finished, are deleted by the next writer.

The projection is a plain sum of the rollup over the other dimensions, so a
question whose filters touch only its dimensions gets the same answer from
far fewer rows; the store picks the smallest table that holds every filtered
dimension. A question about one content id reads the one bucket folder that
the id falls into, and there only the row groups that its sorted ids touch.

An ask is one SQL statement over a table that is registered when a version is
opened: it looks up the version to serve, is planned anew and reads the files.
The value catalogue, if it is small, and what a filter's values resolve to are
remembered for as long as the version is served; answers never are. A table below `ONE_TASK_BYTES` is read by one task: its sum
per minute and the answer over the minutes then need no shuffle at all. Larger
tables are read in parallel and shuffled by minute. Serving runs in its own
session (isolated SQL conf), without adaptive re-planning: a question's
intermediate result has one row per minute.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import filters as FL
from ..operators import naive as N
from . import pipeline as P
from . import serving as SV

PROJECTION_DIMS = ("country", "platform", "video_type")
RESOLVED_MOST = 4096  # resolved filter sets remembered per version
CONTENT_BUCKETS = 64  # folders of the second order; recorded in its name
ONE_TASK_BYTES = 32 * 1024 * 1024
VALUES_BYTES = 1024 * 1024  # a value catalogue up to this size is held by the store; a larger one is asked


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _folder(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def served_version(spark: SparkSession, path: str) -> str:
    """Folder of the last complete build under `path`."""
    names = _names(spark, f"{path}/versions")
    if not names:
        raise FileNotFoundError(f"no complete build under {path}")
    return f"{path}/data/{names[-1]}"


def content_bucket(content_id) -> Column:
    return F.pmod(F.xxhash64(content_id), F.lit(CONTENT_BUCKETS)).cast("int")


def write_store(build: P.Build, path: str, keep: int = 2) -> str:
    """Write all tables of one build as a new version, delete old versions; return its folder."""
    th = build.th
    spark = build.raw.sparkSession
    done = _names(spark, f"{path}/versions")
    name = f"{int(done[-1].split('-')[0]) + 1 if done else 0:020d}-{uuid.uuid4().hex}"
    to = f"{path}/data/{name}"
    P.write_rollup(build.rollup, f"{to}/minute_occupancy", th)
    rollup = spark.read.parquet(f"{to}/minute_occupancy")
    (rollup.groupBy("minute", *PROJECTION_DIMS)
     .agg(F.sum("sessions").cast("bigint").alias("sessions"))
     .repartitionByRange("minute").sortWithinPartitions("minute")
     .write.parquet(f"{to}/occupancy_cpv"))
    (rollup.drop("day").withColumn("id_bucket", content_bucket(F.col("content_id")))
     .repartitionByRange("id_bucket", "content_id", "minute").sortWithinPartitions("id_bucket", "content_id", "minute")
     .write.partitionBy("id_bucket").option("parquet.block.size", 16 * 1024 * 1024).parquet(f"{to}/occupancy_by_content_{CONTENT_BUCKETS}"))
    SV.dimension_value(rollup).coalesce(1).write.parquet(f"{to}/dimension_value")
    N.naive_vs_foreground(rollup, build.raw, th.bucket_ms).write.parquet(f"{to}/naive_vs_foreground")
    fs, marker = _folder(spark, f"{path}/versions/{name}")
    fs.create(marker).close()
    drop_old_versions(spark, path, keep)
    return to


def drop_old_versions(spark: SparkSession, path: str, keep: int) -> None:
    """Delete all but the last `keep` complete builds, and what was never finished before them."""
    kept = _names(spark, f"{path}/versions")[-keep:]
    if len(kept) < keep:
        return
    for name in _names(spark, f"{path}/data"):
        if name < kept[0]:
            for folder in (f"{path}/versions/{name}", f"{path}/data/{name}"):  # the marker first: nobody opens it any more
                fs, target = _folder(spark, folder)
                fs.delete(target, True)


def _sql_value(value) -> str:
    return str(value) if isinstance(value, int) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


class RollupStore:
    """Questions over a written store, answered in a serving session."""

    def __init__(self, spark: SparkSession, path: str, th: C.Thresholds, shuffle_partitions: int = 4) -> None:
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.adaptive.enabled", "false")
        self.spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.th = th
        self.path = path
        self.version = None
        self.refresh()

    def refresh(self) -> None:
        """Open the last complete build if it is not the one already open."""
        last = served_version(self.spark, self.path)
        if last == self.version:
            return
        self.tables, self._views = {}, {}
        for kind, folder in (("rollup", "minute_occupancy"), ("projection", "occupancy_cpv"),
                             ("by_content", f"occupancy_by_content_{CONTENT_BUCKETS}")):
            table = self.spark.read.parquet(f"{last}/{folder}")
            fs, at = _folder(self.spark, f"{last}/{folder}")
            view = f"{kind}_{last.rsplit('/', 1)[1].replace('-', '_')}"
            table.createOrReplaceTempView(view)
            self.tables[kind], self._views[kind] = table, (view, fs.getContentSummary(at).getLength() <= ONE_TASK_BYTES)
        self.catalogue = self.spark.read.parquet(f"{last}/dimension_value")
        fs, at = _folder(self.spark, f"{last}/dimension_value")
        self._values = None
        if fs.getContentSummary(at).getLength() <= VALUES_BYTES:
            self._values = {}
            for dimension, value in self.catalogue.select("dimension", "value").collect():
                self._values.setdefault((dimension, value.lower()), set()).add(value)
        self._resolved: dict = {}
        self.version = last

    @property
    def rollup(self) -> DataFrame:
        return self.tables["rollup"]

    @property
    def projection(self) -> DataFrame:
        return self.tables["projection"]

    def resolve(self, filters: dict) -> FL.Resolved:
        self.refresh()
        key = tuple(sorted((k, str(v)) for k, v in filters.items()))
        if key not in self._resolved:
            if len(self._resolved) >= RESOLVED_MOST:
                self._resolved.clear()
            self._resolved[key] = FL.resolve_among(self._values, filters) if self._values is not None else FL.resolve(self.catalogue, filters)
        return self._resolved[key]

    def kind_for(self, resolved: FL.Resolved) -> str:
        """The table that holds every filtered dimension in the fewest rows."""
        if set(resolved.equal) <= set(PROJECTION_DIMS):
            return "projection"
        return "by_content" if "content_id" in resolved.equal else "rollup"

    def table_for(self, resolved: FL.Resolved) -> DataFrame:
        return self.tables[self.kind_for(resolved)]

    def _where(self, kind: str, resolved: FL.Resolved, minute_from, minute_to) -> str:
        per_day = max(1, C.DAY_MS // self.th.bucket_ms)
        parts = [f"{d} = {_sql_value(v)}" for d, v in resolved.equal.items()] + (["false"] if resolved.impossible else [])
        for bound, op in ((minute_from, ">="), (minute_to, "<=")):
            if bound is not None:
                parts.append(f"minute {op} {int(bound)}")
                if kind == "rollup":  # a minute range also bounds the day partitions, so whole days are pruned (P11)
                    parts.append(f"day {op} {int(bound) // per_day}")
        if kind == "by_content":
            # a constant in the plan, so that one folder is listed and read
            parts.append(f"id_bucket = pmod(xxhash64({int(resolved.equal['content_id'])}L), {CONTENT_BUCKETS})")
        return " AND ".join(parts) or "true"

    def series_sql(self, filters: dict, minute_from=None, minute_to=None) -> str:
        """The statement of a question's series: (minute, concurrency)."""
        resolved = self.resolve(filters)
        kind = self.kind_for(resolved)
        view, small = self._views[kind]
        hint = "/*+ COALESCE(1) */ " if small else ""
        return (f"SELECT minute, CAST(sum(sessions) AS BIGINT) AS concurrency FROM (SELECT {hint}minute, sessions FROM {view}"
                f" WHERE {self._where(kind, resolved, minute_from, minute_to)}) GROUP BY minute")

    def series(self, filters: dict, minute_from=None, minute_to=None) -> DataFrame:
        return self.spark.sql(self.series_sql(filters, minute_from, minute_to))

    def concurrency(self, filters: dict, grain: int, minute_from=None, minute_to=None) -> DataFrame:
        return SV.concurrency(self.series(filters, minute_from, minute_to), grain)

    def answer_sql(self, filters: dict, grain: int, minute_from=None, minute_to=None) -> str:
        """Peak of the buckets of `grain`, minute-weighted average of their averages, active minutes."""
        buckets = (f"SELECT max(concurrency) AS peak, sum(concurrency) AS total, count(*) AS minutes"
                   f" FROM ({self.series_sql(filters, minute_from, minute_to)}) GROUP BY floor(minute / {int(grain)})")
        return ("SELECT coalesce(max(peak), 0L) AS peak_concurrency,"
                " coalesce(try_divide(CAST(sum(total) AS DOUBLE), CAST(sum(minutes) AS DOUBLE)), 0.0D) AS average_concurrency,"
                f" CAST(coalesce(sum(minutes), 0) AS BIGINT) AS active_minutes FROM ({buckets})")

    def answer(self, filters: dict, grain: int, minute_from=None, minute_to=None) -> DataFrame:
        return self.spark.sql(self.answer_sql(filters, grain, minute_from, minute_to))

    def benchmark(self, label: str) -> DataFrame:
        grain, flt = {lbl: (g, f) for lbl, g, f in SV.benchmark_specs(self.th)}[label]
        return self.spark.sql(f"SELECT {_sql_value(label)} AS query_label, {int(grain)}L AS grain_buckets, * FROM ({self.answer_sql(flt, grain)})")

    def benchmarks_one_scan(self) -> DataFrame:
        self.refresh()
        specs = SV.benchmark_specs(self.th)
        dims = {d for _, _, flt in specs for d in flt}
        table = self.projection if dims <= set(PROJECTION_DIMS) else self.rollup
        return SV.benchmark_answers(table, self.th, catalogue=self.catalogue, resolver=self.resolve)

    # the five questions of the question surface, as DataFrames

    def concurrency_peak(self, filters: dict, grain_minutes: int = 1, minute_from=None, minute_to=None,
                         limit: int = C.MAX_SERIES_POINTS) -> DataFrame:
        """Buckets busiest first, with the overall peak, average and number of buckets beside them."""
        return SV.busiest_buckets(self.series(filters, minute_from, minute_to), self.th.grain_buckets(grain_minutes), limit)

    def concurrency_series(self, filters: dict, minute_from=None, minute_to=None,
                           points: int = C.MAX_SERIES_POINTS) -> DataFrame:
        """The series downsampled to at most `points`, keeping each stride's peak."""
        return SV.downsample(self.series(filters, minute_from, minute_to), self.th.bucket_ms, points)

    def top_slices(self, dimension: str, filters: dict | None = None, minute_from=None, minute_to=None,
                   limit: int | None = None) -> DataFrame:
        """Peak per value of one dimension under the other filters."""
        res = self.resolve(filters or {})
        table = self.projection if set(res.equal) | {dimension} <= set(PROJECTION_DIMS) else self.rollup
        return SV.top_slices(table, dimension, res, minute_from, minute_to, limit)

    def overcount(self) -> DataFrame:
        """Foreground against naive peaks and dense-window averages."""
        self.refresh()
        nvf = self.spark.read.parquet(f"{self.version}/naive_vs_foreground")
        return N.overcount(nvf, SV.data_window(self.rollup, self.th.bucket_ms))

    def list_dimensions(self) -> DataFrame:
        """Every filterable value with minutes present and first/last minute (A10)."""
        self.refresh()
        return SV.dimension_values(self.rollup)
