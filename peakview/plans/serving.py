"""Serving over the rollup: series, buckets, answers, catalogues.

Every answer follows one rule: filter, sum over the dimensions left
unfiltered, then take the max over minutes; never max first.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .. import session as _session
from ..functions import exprs as X
from ..functions import filters as FL
from ..functions.running import global_rank


def dimension_value(rollup: DataFrame) -> DataFrame:
    """(dimension, value) for every string dimension, in one pass."""
    stacked = rollup.select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
        for d in C.STRING_DIMS])).alias("p")).select("p.dimension", "p.value")
    return stacked.distinct()


def _minute_range(df: DataFrame, minute_from, minute_to) -> DataFrame:
    if minute_from is not None:
        df = df.filter(F.col("minute") >= F.lit(minute_from))
    if minute_to is not None:
        df = df.filter(F.col("minute") <= F.lit(minute_to))
    return df


def occupancy(rollup: DataFrame, resolved: FL.Resolved, minute_from=None, minute_to=None) -> DataFrame:
    """(minute, concurrency) under resolved filters."""
    df = _minute_range(resolved.apply(rollup), minute_from, minute_to)
    return df.groupBy("minute").agg(F.sum("sessions").cast("bigint").alias("concurrency"))


def occupancy_for(rollup: DataFrame, filters: dict, minute_from=None, minute_to=None,
                  catalogue: DataFrame | None = None) -> DataFrame:
    cat = catalogue if catalogue is not None else dimension_value(rollup)
    return occupancy(rollup, FL.resolve(cat, filters), minute_from, minute_to)


def concurrency(series: DataFrame, grain: int) -> DataFrame:
    """Peak, average and minutes per bucket of `grain` buckets."""
    return (series.groupBy(X.grain_bucket("minute", grain).alias("bucket_minute"))
            .agg(F.max("concurrency").alias("peak_concurrency"),
                 (F.sum("concurrency").cast("double") / F.count(F.lit(1)).cast("double")).alias("average_concurrency"),
                 F.count(F.lit(1)).alias("minutes_in_bucket")))


def answer(series: DataFrame) -> DataFrame:
    """One row: peak, minute-weighted average, active minutes; empty -> 0.

    Over buckets of any grain the peak is the peak of the minutes and the
    minute-weighted mean of bucket means is the mean of the minutes, so the
    answer is taken from the series directly, in exact integer sums.
    """
    return series.agg(
        F.coalesce(F.max("concurrency"), F.lit(0)).cast("bigint").alias("peak_concurrency"),
        F.coalesce(F.sum("concurrency").cast("double") / F.count(F.lit(1)).cast("double"),
                   F.lit(0.0)).alias("average_concurrency"),
        F.count(F.lit(1)).cast("bigint").alias("active_minutes"),
    )


def benchmark_specs(th: C.Thresholds):
    return [(label, th.grain_buckets(g), flt) for label, g, flt in C.BENCHMARKS]


def benchmark_one(rollup: DataFrame, label: str, th: C.Thresholds, catalogue=None) -> DataFrame:
    """One benchmark question as its own plan (what the bench times)."""
    spec = {lbl: (g, flt) for lbl, g, flt in benchmark_specs(th)}[label]
    series = occupancy_for(rollup, spec[1], catalogue=catalogue)
    return answer(series).select(F.lit(label).alias("query_label"),
                                 F.lit(spec[0]).cast("bigint").alias("grain_buckets"), "*")


def conditional_series(rollup: DataFrame, resolved: list[FL.Resolved]) -> DataFrame:
    """(minute, c0, c1, ...): the series of several questions side by side, from one scan and one row per minute.

    A question's column is null in a minute that none of its rows falls in.
    """
    sums = []
    for i, res in enumerate(resolved):
        pred = res.predicate()
        sums.append(F.sum(F.col("sessions") if pred is None else F.when(pred, F.col("sessions"))).cast("bigint").alias(f"c{i}"))
    return rollup.groupBy("minute").agg(*sums)


def benchmark_answers(rollup: DataFrame, th: C.Thresholds, catalogue: DataFrame | None = None,
                      resolver=None) -> DataFrame:
    """All eight benchmark answers from a single scan of the rollup (A17, A19 pattern).

    Questions with no matching row still return a row of zeros.
    """
    cat = catalogue if catalogue is not None else dimension_value(rollup)
    specs = benchmark_specs(th)
    resolved = ([resolver(flt) for _, _, flt in specs] if resolver is not None
                else FL.resolve_many(cat, [flt for _, _, flt in specs]))
    # peak over buckets is the peak over minutes, and the minute-weighted mean
    # of bucket means is the mean over minutes, so the grain drops out here
    answers = [F.struct(
        F.lit(label).alias("query_label"), F.lit(grain).cast("bigint").alias("grain_buckets"),
        F.coalesce(F.max(f"c{i}"), F.lit(0)).cast("bigint").alias("peak_concurrency"),
        F.coalesce(F.try_divide(F.sum(f"c{i}").cast("double"), F.count(f"c{i}").cast("double")), F.lit(0.0)).alias("average_concurrency"),
        F.count(f"c{i}").alias("active_minutes")) for i, (label, grain, _) in enumerate(specs)]
    one = conditional_series(rollup, resolved).agg(F.array(*answers).alias("answers"))
    return one.select(F.explode("answers").alias("a")).select("a.*")


# --------------------------------------------------------------------------
# catalogues and the data window
# --------------------------------------------------------------------------

def _day(minute: str, bucket_ms: int):
    return X.floor_div(minute, max(1, C.DAY_MS // bucket_ms))


def _days_of(buckets, bucket_ms: int):
    return (buckets * F.lit(bucket_ms)).cast("double") / F.lit(float(C.DAY_MS))


def data_window(rollup: DataFrame, bucket_ms: int) -> DataFrame:
    """Extent and dense window of the data.

    The dense window spans the days carrying at least min(1% of all
    session-minutes, the busiest day's); strays outside it are counted, not
    dropped. The per-day table is small and feeds scalar subqueries.
    """
    days = (rollup.groupBy(_day("minute", bucket_ms).alias("day"))
            .agg(F.sum("sessions").cast("double").alias("sm"),
                 F.min("minute").alias("day_min"), F.max("minute").alias("day_max")))
    floor = F.coalesce(days.agg(F.least(F.lit(0.01) * F.sum("sm"), F.max("sm"))).scalar(), F.lit(0.0))
    dense = days.filter(F.col("sm") >= floor)
    lo = F.coalesce(dense.agg(F.min("day_min")).scalar(), F.lit(0)).cast("bigint")
    hi = F.coalesce(dense.agg(F.max("day_max")).scalar(), F.lit(0)).cast("bigint")
    n_dense = F.coalesce(dense.agg(F.count(F.lit(1))).scalar(), F.lit(0)).cast("bigint")
    # one row per minute first: distinct minutes are then plain counts
    minutes = rollup.groupBy("minute").agg(F.count(F.lit(1)).alias("rows"))
    outside = (F.col("minute") < lo) | (F.col("minute") > hi)
    return minutes.agg(
        F.min("minute").alias("min_minute"),
        F.max("minute").alias("max_minute"),
        X.minute_utc_seconds(F.min("minute"), bucket_ms).alias("min_utc"),
        X.minute_utc_seconds(F.max("minute"), bucket_ms).alias("max_utc"),
        _days_of(F.max("minute") - F.min("minute"), bucket_ms).alias("span_days"),
        F.count(F.lit(1)).alias("minutes_with_sessions"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("occupancy_rows"),
        F.count_if(outside).alias("outlier_minutes"),
        F.coalesce(F.sum(F.when(outside, F.col("rows"))), F.lit(0)).alias("outlier_rows"),
    ).select(
        "*", lo.alias("dense_min_minute"), hi.alias("dense_max_minute"),
        X.minute_utc_seconds(lo, bucket_ms).alias("dense_min_utc"),
        X.minute_utc_seconds(hi, bucket_ms).alias("dense_max_utc"),
        _days_of(hi - lo, bucket_ms).alias("dense_span_days"),
        n_dense.alias("dense_days"),
    )


def dimension_values(rollup: DataFrame) -> DataFrame:
    """Every non-empty value of every string dimension with minutes present (A10).

    One unpivot pass; distinct (dimension, value, minute) first so the count
    of minutes is a plain count after a partial aggregation.
    """
    stacked = rollup.select("minute", F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
        for d in C.STRING_DIMS])).alias("p")).select("p.dimension", "p.value", "minute")
    return (stacked.filter(F.col("value") != "").distinct()
            .groupBy("dimension", "value")
            .agg(F.count(F.lit(1)).alias("minutes_present"),
                 F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute")))


def titles(rollup: DataFrame, content: DataFrame) -> DataFrame:
    """Every content_id with sessions, its catalogue title and minutes present."""
    from ..operators.occupancy import dedupe_content
    seen = (rollup.select("content_id", "minute").distinct()
            .groupBy("content_id")
            .agg(F.count(F.lit(1)).alias("minutes_present"),
                 F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute")))
    cat = dedupe_content(content).select("content_id", "title", "video_type", "category")
    return (seen.join(cat, "content_id", "left")
            .select("content_id",
                    *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "video_type", "category")],
                    "minutes_present", "first_minute", "last_minute"))


def title_search(titles_df: DataFrame, text: str, limit: int = C.TITLE_MATCHES) -> DataFrame:
    """Case-insensitive substring match on titles: exact first, then busiest.

    The cap is the feature (a short pick list), applied after a total order.
    """
    needle = text.strip(" ").lower()
    hit = titles_df.filter(F.instr(F.lower("title"), F.lit(needle)) > 0)
    exact = (F.lower("title") == F.lit(needle)).cast("int")
    return (hit.select("*", exact.alias("exact"))
            .orderBy(F.desc("exact"), F.desc("minutes_present"), F.asc("content_id"))
            .limit(limit))


# --------------------------------------------------------------------------
# slices, crossover, tools
# --------------------------------------------------------------------------

def top_slices(rollup: DataFrame, dimension: str, resolved: FL.Resolved | None = None,
               minute_from=None, minute_to=None, limit: int | None = None) -> DataFrame:
    """Peak per value of one dimension, its minute (earliest on ties), minutes present."""
    df = rollup if resolved is None else resolved.apply(rollup)
    df = _minute_range(df, minute_from, minute_to)
    per = df.groupBy(F.col(dimension).cast("string").alias("value"), "minute").agg(F.sum("sessions").alias("c"))
    out = per.groupBy("value").agg(
        F.max("c").cast("bigint").alias("peak"),
        F.max_by("minute", F.struct(F.col("c"), -F.col("minute"))).alias("peak_minute"),
        F.count(F.lit(1)).alias("minutes_present"))
    out = out.select(F.lit(dimension).alias("dimension"), "*")
    if limit is not None:
        out = out.orderBy(F.desc("peak"), F.asc("value")).limit(limit)
    return out


def slice_peaks(rollup: DataFrame, slices: dict[str, dict], catalogue: DataFrame | None = None) -> DataFrame:
    """Peak and peak minute of several named slices from one scan (A19, P12); a slice without rows is left out."""
    cat = catalogue if catalogue is not None else dimension_value(rollup)
    series = conditional_series(rollup, FL.resolve_many(cat, list(slices.values())))
    peaks = [F.struct(F.lit(label).alias("slice"), F.max(f"c{i}").alias("peak"),
                      F.max_by(F.when(F.col(f"c{i}").isNotNull(), F.col("minute")), F.struct(F.col(f"c{i}"), -F.col("minute"))).alias("peak_minute"))
             for i, label in enumerate(slices)]
    return (series.agg(F.array(*peaks).alias("peaks")).select(F.explode("peaks").alias("p")).select("p.*")
            .filter("peak IS NOT NULL"))


def all_slices(rollup: DataFrame, dimensions: list[str], max_dims: int) -> DataFrame:
    """(the dimensions, minute, c) of every slice the data holds over up to `max_dims` of `dimensions` at once.

    Grouping sets over one scan; a dimension a slice leaves open is null. The
    rollup is first summed over all other dimensions, on the map side.
    """
    narrow = rollup.groupBy(*dimensions, "minute").agg(F.sum("sessions").alias("sessions"))
    sets = [[*chosen, "minute"] for n in range(max_dims + 1) for chosen in combinations(dimensions, n)]
    return (narrow.groupingSets([[F.col(c) for c in s] for s in sets], *dimensions, "minute")
            .agg(F.sum("sessions").cast("bigint").alias("c")))


def slice_name(dimensions: list[str]):
    """`platform=Mweb, video_type=vod`; 'unfiltered' where every dimension is open."""
    parts = [F.when(F.col(d).isNotNull(), F.concat(F.lit(f"{d}="), F.col(d).cast("string"))) for d in dimensions]
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("unfiltered"))


def crossover(rollup: DataFrame, dimensions: list[str], max_dims: int = 2) -> DataFrame:
    """Peak and peak minute of every slice over up to `max_dims` dimensions, and how many distinct minutes the peaks land on.

    The peaks are grouped to one row per slice before they are written, so the
    count of distinct minutes reads them and not the rollup again.
    """
    peaks = all_slices(rollup, dimensions, max_dims).groupBy(slice_name(dimensions).alias("slice")).agg(
        F.max("c").alias("peak"), F.max_by("minute", F.struct(F.col("c"), -F.col("minute"))).alias("peak_minute"))
    peaks = _session.written(peaks, "slices")
    return peaks.select("*", peaks.agg(F.count_distinct("peak_minute")).scalar().alias("distinct_peak_minutes"))


def concurrency_tool(rollup: DataFrame, filters: dict, grain: int, minute_from=None, minute_to=None,
                     limit: int = C.MAX_SERIES_POINTS) -> DataFrame:
    """Buckets busiest first with the overall peak, weighted average and number of buckets beside them."""
    return busiest_buckets(_session.written(occupancy_for(rollup, filters, minute_from, minute_to), "series"), grain, limit)


def busiest_buckets(series: DataFrame, grain: int, limit: int) -> DataFrame:
    """The first `limit` buckets of a series, busiest first; how many there are stands beside them."""
    buckets = concurrency(series, grain)
    overall = answer(series)
    return (buckets.select("*",
                           overall.select("peak_concurrency").scalar().alias("overall_peak"),
                           overall.select("average_concurrency").scalar().alias("overall_average"),
                           buckets.agg(F.count(F.lit(1))).scalar().alias("buckets_total"))
            .orderBy(F.desc("peak_concurrency"), F.asc("bucket_minute")).limit(limit))


def busiest_day(rollup: DataFrame, bucket_ms: int) -> DataFrame:
    """The UTC day with the highest per-minute peak; minutes present beside it."""
    series = occupancy(rollup, FL.Resolved())
    per_day = series.groupBy(_day("minute", bucket_ms).alias("day")).agg(
        F.count(F.lit(1)).alias("minutes_present"), F.max("concurrency").alias("peak"))
    return per_day.orderBy(F.desc("peak"), F.asc("day")).limit(1)


def default_window(rollup: DataFrame, bucket_ms: int) -> DataFrame:
    """Reporting window: the busiest day when the data spans over two days, else all."""
    ext = rollup.agg(F.min("minute").alias("lo"), F.max("minute").alias("hi"))
    per_day = max(1, C.DAY_MS // bucket_ms)
    bd = busiest_day(rollup, bucket_ms)
    day_lo = (bd.select("day").scalar() * F.lit(per_day))
    long = (F.col("hi") - F.col("lo")) > F.lit(2 * per_day)
    return ext.select(
        F.when(long, day_lo).otherwise(F.col("lo")).cast("bigint").alias("minute_from"),
        F.when(long, day_lo + per_day - 1).otherwise(F.col("hi")).cast("bigint").alias("minute_to"))


def crossover_dimensions(values: DataFrame, max_dims: int = 2) -> DataFrame:
    """Dimensions fit for a crossover: 2..12 values, platform and video_type first."""
    counts = values.groupBy("dimension").agg(F.count(F.lit(1)).alias("n_values"))
    pref = (F.when(F.col("dimension") == "platform", 0).when(F.col("dimension") == "video_type", 1).otherwise(2))
    fit = counts.filter((F.col("n_values") >= 2) & (F.col("n_values") <= 12))
    return fit.orderBy(pref, F.asc("n_values"), F.asc("dimension")).limit(max_dims)


def dimensions_available(values: DataFrame, first: int = 5) -> DataFrame:
    """Distinct value count and the first values in order per dimension."""
    from ..functions.running import top_n
    counts = values.groupBy("dimension").agg(F.count(F.lit(1)).alias("n_values"))
    firsts = (top_n(values.select("dimension", "value"), ["dimension"], [F.col("value")], first)
              .groupBy("dimension")
              .agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("first_values")))
    return counts.join(firsts, "dimension", "inner")


def top_values(values: DataFrame, n: int) -> DataFrame:
    """The n values with most minutes per dimension, totals beside each."""
    from ..functions.running import top_n
    totals = values.groupBy("dimension").agg(F.count(F.lit(1)).alias("values_in_dimension"))
    grand = values.agg(F.count(F.lit(1))).scalar()
    top = top_n(values, ["dimension"], [F.desc("minutes_present"), F.asc("value")], n)
    return (top.join(totals, "dimension", "inner")  # one row per dimension
            .select("dimension", "value", "minutes_present", "rank", "values_in_dimension",
                    grand.alias("values_total")))


def total_and_platforms(rollup: DataFrame) -> DataFrame:
    """Series for all platforms and per platform in one pass (A33, grouping sets)."""
    return all_slices(rollup, ["platform"], 1).select(
        "minute", F.coalesce("platform", F.lit("all platforms")).alias("series"), F.col("c").alias("concurrency"))


def decline_alerts(series: DataFrame, bucket_ms: int, min_prior: int = 50, drop: float = 0.5) -> DataFrame:
    """Minute-over-minute drops and their size: prior >= min_prior and a fall of at least `drop`.

    The prior row is the previous present minute, found two-level.
    """
    from ..functions.running import previous_row
    with_prev = previous_row(series, "minute", ["minute", "concurrency"], _day("minute", bucket_ms))
    return (with_prev.filter((F.col("prev_concurrency") >= min_prior)
                             & (F.col("concurrency") <= F.col("prev_concurrency") * (1 - drop)))
            .select("minute", F.col("prev_minute").alias("prior_minute"),
                    F.col("prev_concurrency").alias("prior_concurrency"), "concurrency",
                    (F.lit(100.0) * (F.col("prev_concurrency") - F.col("concurrency")).cast("double")
                     / F.col("prev_concurrency").cast("double")).alias("drop_pct")))


def ranked_declines(alerts: DataFrame) -> DataFrame:
    """Alerts with their place, largest drop first, earliest minute on ties."""
    return global_rank(alerts, [F.desc("drop_pct"), F.asc("minute")])


# --------------------------------------------------------------------------
# order: series by time, catalogues by presence
# --------------------------------------------------------------------------

def ordered_series(series: DataFrame, by: str = "minute") -> DataFrame:
    """A series in time order, with each row's place in it (K1)."""
    return global_rank(series, [F.asc(by)], "place")


def ranked_values(values: DataFrame) -> DataFrame:
    """The value catalogue by dimension, most minutes first (K3)."""
    return global_rank(values, [F.asc("dimension"), F.desc("minutes_present"), F.asc("value")])


def ranked_titles(titles_df: DataFrame) -> DataFrame:
    """The title catalogue, most minutes first (K3)."""
    return global_rank(titles_df, [F.desc("minutes_present"), F.asc("content_id")])


def downsample(series: DataFrame, bucket_ms: int, cap: int = C.MAX_SERIES_POINTS) -> DataFrame:
    """At most `cap` points, each the peak of its stride, earliest on ties."""
    from ..functions.running import row_index
    n = series.agg(F.count(F.lit(1))).scalar()
    stride = F.greatest(F.lit(1), F.ceil(n / F.lit(cap))).cast("bigint")
    idx = row_index(series, ["minute"], _day("minute", bucket_ms))
    return (idx.withColumn("stride", ((F.col("rn") - 1) / stride).cast("bigint"))
            .groupBy("stride").agg(F.max_by(F.struct("minute", "concurrency"),
                                             F.struct(F.col("concurrency"), -F.col("minute"))).alias("p"))
            .select("p.minute", "p.concurrency"))


def busiest_content_id(rollup: DataFrame) -> DataFrame:
    """content_id with the most rollup rows."""
    return (rollup.groupBy("content_id").agg(F.count(F.lit(1)).alias("rows"))
            .orderBy(F.desc("rows"), F.asc("content_id")).limit(1))


def naive_by_grain(nvf: DataFrame, grain: int) -> DataFrame:
    """Naive series bucketed to a grain, only minutes with foreground > 0."""
    return (nvf.filter(F.col("foreground_concurrency") > 0)
            .groupBy(X.grain_bucket("minute", grain).alias("bucket_minute"))
            .agg(F.max("naive_concurrency").alias("naive_peak"),
                 F.max("foreground_concurrency").alias("foreground_peak")))


def tumbling(series: DataFrame, bucket_ms: int, duration: str = "1 day") -> DataFrame:
    """Peak and mean per tumbling event-time window, as a stream would group."""
    ts = F.timestamp_millis(F.col("minute") * F.lit(bucket_ms))
    return (series.groupBy(F.window(ts, duration).alias("w"))
            .agg(F.max("concurrency").alias("peak_concurrency"),
                 (F.sum("concurrency").cast("double") / F.count(F.lit(1)).cast("double")).alias("average_concurrency"),
                 F.count(F.lit(1)).alias("minutes_in_window"))
            .select(F.unix_seconds(F.col("w.start")).alias("window_start_utc"), "peak_concurrency",
                    "average_concurrency", "minutes_in_window"))


def describe_dataset(rollup: DataFrame, name: str) -> DataFrame:
    """Extent of one built dataset: first/last minute, rows, minutes, peak."""
    peak = rollup.groupBy("minute").agg(F.sum("sessions").alias("c")).agg(F.max("c")).scalar()
    return rollup.agg(F.lit(name).alias("dataset"), F.min("minute").alias("min_minute"),
                      F.max("minute").alias("max_minute"), F.count(F.lit(1)).alias("occupancy_rows"),
                      F.count_distinct("minute").alias("minutes_with_sessions"),
                      F.first(peak).cast("bigint").alias("peak"))


def dataset_list(described: list[DataFrame]) -> DataFrame:
    """All datasets, one row per distinct extent; a duplicate keeps the smallest name."""
    allx = reduce(DataFrame.unionByName, described)
    extent = ["min_minute", "max_minute", "occupancy_rows", "minutes_with_sessions", "peak"]
    return allx.groupBy(*extent).agg(F.min("dataset").alias("dataset")).select("dataset", *extent)
