"""Mixing sources to target weights by Pfair scheduling of blocks.

Each source is cut into blocks of documents. Block i of a source with weight w, as its exact
part of all weights, is released at floor((i-1)/w) and due at ceil(i/w); among the released, the earliest
deadline goes first. No weight is rounded, so after any number of slots each
source is less than one block from its share. A source that has run out leaves its slots to the
others' released blocks; when none is released, those left are scheduled anew from there by
their weights among themselves; every document gets a place.

Every source has a weight and a stream of its own. The schedule is one pass over the blocks
on the driver, in whole numbers, a heap entry per source and a table row
per block (a block is `block` rows); the rows join it by source and block number.

Numbering within a source is two-level: documents are spread over buckets by a hash
and numbered inside them, and bucket sizes are chained, so a source with most
rows is spread. Null sources are one stream `__other__`, and with given weights so are the sources not named in them. Repeated rows get places of their own; an empty table gives
an empty schedule. Weights that are zero, negative or all missing raise.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OTHER = "__other__"


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole slots per period and source, at least one each, by largest remainder."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("every weight must be positive")
    period = max(period, len(weights))
    total = sum(map(Fraction, weights.values()))
    exact = {s: Fraction(w) / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    while (left := period - sum(out.values())) != 0:
        step = 1 if left > 0 else -1
        movable = [s for s in out if step > 0 or out[s] > 1]
        s = max(movable, key=lambda s: ((exact[s] - out[s]) * step, s))
        out[s] += step
    return out


def edf_period(share: dict[str, int]) -> list[tuple[str, int, int, int]]:
    """(source, release, deadline, block number in the period) for each slot, earliest deadline first among the released."""
    c = sum(share.values())
    coming = [(0, -(-c // n), s, 1) for s, n in share.items()]  # release, deadline, source, block
    heapq.heapify(coming)
    ready: list[tuple[int, str, int, int]] = []
    slots = []
    for t in range(c):
        while coming and coming[0][0] <= t:
            release, due, s, i = heapq.heappop(coming)
            heapq.heappush(ready, (due, s, i, release))
        due, s, i, release = heapq.heappop(ready)  # shares add up to the period, so a block is always released
        slots.append((s, release, due, i))
        if i < share[s]:
            heapq.heappush(coming, (i * c // share[s], -(-(i + 1) * c // share[s]), s, i + 1))
    return slots


def block_slots(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block number from 0, release, deadline, slot) of every block, in slot order."""
    if any(weights[s] <= 0 for s in blocks):
        raise ValueError("every weight must be positive")
    used = dict.fromkeys(blocks, 0)
    slot = 0
    while live := sorted(s for s in blocks if used[s] < blocks[s]):
        exact = [Fraction(weights[s]) for s in live]
        whole = math.lcm(*(w.denominator for w in exact))
        w = {s: x.numerator * (whole // x.denominator) for s, x in zip(live, exact)}
        total, at, before = sum(w.values()), slot, {s: used[s] for s in live}
        coming = [(0, -(-total // w[s]), s) for s in live]  # release, deadline, source, as counted from `at`
        heapq.heapify(coming)
        ready: list[tuple[int, str, int]] = []
        while True:
            while coming and coming[0][0] <= slot - at:
                release, due, s = heapq.heappop(coming)
                heapq.heappush(ready, (due, s, release))
            if not ready:  # only as sources have run out, else the weights add up to a block a slot
                break
            due, s, release = heapq.heappop(ready)
            yield s, used[s], at + release, at + due, slot
            used[s] += 1
            slot += 1
            if used[s] < blocks[s]:
                i = used[s] - before[s] + 1
                heapq.heappush(coming, ((i - 1) * total // w[s], -(-i * total // w[s]), s))


def tempered(counts: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Weights from sizes: size to the power, which lifts small sources."""
    return {s: float(n) ** power for s, n in counts.items() if n}


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 64, period: int = 1000,
             id_col: str = "doc_id", source_col: str = "source", named: int = 256) -> DataFrame:
    """Per row: doc_id, source, stream, block_no, release_slot, deadline_slot, slot, position.

    Without weights, every source gets a weight tempered from its size. `position` numbers all rows 0.. in the order
    of the mix. `period` and `named` have no effect: weights are exact, and every source is a stream.
    """
    spark = docs.sparkSession
    src = F.coalesce(F.col(source_col).cast("string"), F.lit(OTHER))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), src.alias("stream"))
    if weights is not None:
        if not weights or min(weights.values()) <= 0:
            raise ValueError("every weight must be positive")
        known = spark.createDataFrame([(s,) for s in sorted(weights)], "k string")
        rows = (rows.join(F.broadcast(known), F.col("stream") == F.col("k"), "left")  # the names of the weights
                .withColumn("stream", F.coalesce("k", F.lit(OTHER))).drop("k"))
    sizes = rows.groupBy("stream").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = dict(zip(sizes.column("stream").to_pylist(), sizes.column("n").to_pylist()))
    total = sum(counts.values())
    weights = tempered(counts) if weights is None else weights
    if missing := set(counts) - set(weights):
        weights = weights | {s: min(weights.values()) for s in missing}

    # number rows within their stream: hash buckets first, then inside
    buckets = 1 << max(0, min(16, (total // 2000).bit_length()))
    h = F.xxhash64("doc_id", F.lit(11))
    rows = rows.withColumns({"h": h, "bucket": F.pmod(h, F.lit(buckets))})
    inside = Window.partitionBy("stream", "bucket").orderBy("h", "doc_id", "source")
    rows = rows.withColumn("i", F.row_number().over(inside) - 1)
    per = rows.groupBy("stream", "bucket").agg(F.count(F.lit(1)).alias("n"))
    chain = Window.partitionBy("stream").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("stream").alias("s2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("n").over(chain), F.lit(0)).alias("before"))
    rows = rows.join(per, F.expr("stream = s2 and bucket = b2")).withColumn("no", F.col("before") + F.col("i"))
    rows = rows.withColumns({"block_no": F.floor(F.col("no") / block).cast("long"), "in_block": (F.col("no") % block).cast("long")})

    # the plan: one row per block, with the number of rows before it
    names = list(counts)
    number = {s: i for i, s in enumerate(names)}
    plan = {c: array(kind) for c, kind in (("p", "i"), ("b", "q"), ("release_slot", "q"), ("deadline_slot", "q"), ("slot", "q"), ("first", "q"))}
    done = 0
    for s, i, release, due, slot in block_slots({s: -(-n // block) for s, n in counts.items()}, weights):
        for c, v in zip(plan.values(), (number[s], i, release, due, slot, done)):
            c.append(v)
        done += min(block, counts[s] - i * block)
    table = pa.table({c: np.frombuffer(v, v.typecode) for c, v in plan.items()})
    stream = pa.DictionaryArray.from_arrays(table.column("p").combine_chunks(), pa.array(names, pa.string())).cast(pa.string())
    plan_df = spark.createDataFrame(table.drop_columns(["p"]).append_column("ps", stream))
    rows = rows.join(plan_df, F.expr("ps = stream and b = block_no"))
    return rows.select("doc_id", "source", "stream", "block_no", "release_slot", "deadline_slot", "slot",
                       (F.col("first") + F.col("in_block")).cast("long").alias("position"))
