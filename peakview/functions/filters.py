"""Filter resolution (P7-P10): sentinels, exact match first, unique case fold.

Resolution runs once per question against the small value catalogue, and
only the catalogue rows that fold to the asked values come to the driver.
The resolved filters are plain equality literals, so Catalyst pushes them
into the parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C


def is_sentinel(value: str | None) -> bool:
    """'' all any none null * % (trimmed, any case) mean no filter."""
    return value is None or value.strip(" ").lower() in C.NO_FILTER_SENTINELS


@dataclass(frozen=True)
class Resolved:
    """Exact values per dimension; `impossible` when some value matched nothing."""

    equal: dict[str, object] = field(default_factory=dict)
    impossible: bool = False
    unknown: dict[str, str] = field(default_factory=dict)

    def predicate(self) -> Column | None:
        if self.impossible:
            return F.lit(False)
        if not self.equal:
            return None
        return reduce(lambda a, b: a & b, [F.col(d) == F.lit(v) for d, v in self.equal.items()])

    def apply(self, df: DataFrame) -> DataFrame:
        p = self.predicate()
        return df if p is None else df.filter(p)


def _asked(filters: dict[str, object]) -> tuple[dict[str, object], dict[str, str]]:
    """Split user filters into ready equalities (content_id) and string values to look up."""
    equal: dict[str, object] = {}
    asked: dict[str, str] = {}
    for dim, raw in filters.items():
        if dim == "content_id":
            if raw not in (None, 0, "0", ""):
                equal["content_id"] = int(raw)
            continue
        if dim not in C.STRING_DIMS:
            raise ValueError(f"unknown dimension {dim!r}")
        if is_sentinel(raw):
            continue
        asked[dim] = str(raw).strip(" ")
    return equal, asked


def _decide(equal: dict, asked: dict, found: dict[str, set[str]]) -> Resolved:
    unknown: dict[str, str] = {}
    for dim, v in asked.items():
        cands = {x for x in found.get(dim, set()) if x.lower() == v.lower()}
        if v in cands:
            equal[dim] = v
        elif len(cands) == 1:
            equal[dim] = next(iter(cands))
        else:
            unknown[dim] = v
    return Resolved(equal, impossible=bool(unknown), unknown=unknown)


def resolve_many(catalogue: DataFrame, many: list[dict[str, object]]) -> list[Resolved]:
    """Resolve several questions' filters with one catalogue lookup.

    Exact value wins; otherwise a case-insensitive match counts only when it
    lands on exactly one real value; otherwise the filter matches nothing.
    content_id 0 means no filter. Only catalogue spellings that fold onto an
    asked value reach the driver, so the lookup stays bounded.
    """
    split = [_asked(f) for f in many]
    pairs = {(d, v.lower()) for _, asked in split for d, v in asked.items()}
    found: dict[str, set[str]] = {}
    if pairs:
        cond = reduce(lambda a, b: a | b, [
            (F.col("dimension") == d) & (F.lower(F.col("value")) == F.lit(v)) for d, v in sorted(pairs)])
        for r in catalogue.filter(cond).select("dimension", "value").distinct().collect():
            found.setdefault(r["dimension"], set()).add(r["value"])
    return [_decide(dict(eq), asked, found) for eq, asked in split]


def resolve_among(values: dict[tuple[str, str], set[str]], filters: dict[str, object]) -> Resolved:
    """Resolve against values at hand, (dimension, lower-cased value) -> its spellings, without a lookup."""
    equal, asked = _asked(filters)
    return _decide(dict(equal), asked, {d: values.get((d, v.lower()), set()) for d, v in asked.items()})


def resolve(catalogue: DataFrame, filters: dict[str, object]) -> Resolved:
    """Resolve one question's filters against the (dimension, value) catalogue."""
    return resolve_many(catalogue, [filters])[0]


def report(catalogue: DataFrame, filters: dict[str, object]) -> DataFrame:
    """What each asked value stands for (P8, P9): (dimension, asked, status, stands_for, values_known).

    status: exact, folded (one value in another case), ambiguous (several) or
    unknown. Values that mean no filter are not asked.
    """
    _, asked = _asked(filters)
    rows = catalogue.sparkSession.createDataFrame(sorted(asked.items()), "dimension string, asked string")
    known = catalogue.groupBy("dimension").agg(F.count(F.lit(1)).alias("values_known"))
    folds = (rows.join(catalogue, "dimension").filter(F.lower("value") == F.lower("asked"))
             .groupBy("dimension", "asked").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("only"),
                                                F.max((F.col("value") == F.col("asked")).cast("int")).alias("same")))
    told = rows.join(folds, ["dimension", "asked"], "left").join(known, "dimension", "left")
    status = (F.when(F.col("same") == 1, "exact").when(F.col("n") == 1, "folded").when(F.col("n") > 1, "ambiguous").otherwise("unknown"))
    return told.select("dimension", "asked", status.alias("status"),
                       F.when(F.col("same") == 1, F.col("asked")).when(F.col("n") == 1, F.col("only")).alias("stands_for"),
                       F.coalesce("values_known", F.lit(0)).alias("values_known"))


def resolve_strict(catalogue: DataFrame, filters: dict[str, object], named: int = 25) -> Resolved:
    """As `resolve`, but an unknown or ambiguous value raises, naming the first `named` real ones and how many there are."""
    res = resolve(catalogue, filters)
    if res.unknown:
        dim, v = next(iter(res.unknown.items()))
        real = catalogue.filter(F.col("dimension") == dim)
        known = [r["value"] for r in real.orderBy("value").select("value").limit(named).collect()]
        raise ValueError(f"{dim} has no value {v!r}; the {real.count()} known values include {known}")
    return res
