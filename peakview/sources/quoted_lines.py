"""Delimited text with quoted line ends, read in splits.

A CSV reader that allows line ends inside quotes has to read a file from its
start, so each file is one task. Here files are read as plain lines, which
split, and the quoting is worked out per split:

1. Every split is scanned once from both possible states, outside and inside
   a quoted field: what a split makes of the state is a function of two values.
2. These functions are composed along each file, one small row per split, and
   tell the state every split really starts in.
3. The lines are read again with that state, put together to records and cut
   into fields. A record that crosses splits leaves a fragment in each of
   them; only where a split starts inside a quoted field are there any, and
   they are put together by a small grouping.

A quote counts only at the start of a field, as CSV has it; a stray quote
inside an unquoted field is text. A task reads many splits where the session
says so (`spark.sql.files.maxPartitionNum`); the state is still told per split. Headers are taken per file, and files of
one folder may have different ones: each distinct header has a number, and
records carry their file's. Compressed files are one split each.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import session as _session

#: a folder's distinct headers are bound one by one on the driver
MOST_HEADERS = 1000
#: rows of a per-split table that may be sent to every task; with more, lines are dealt by split and put in order
MOST_SENT = 100_000

HEAD, MIDDLE, TAIL, WHOLE = 0, 1, 2, 3
_FIELDS = pa.list_(pa.string())


def still_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted field is open after `line`, given whether one was before it."""
    at = 0
    while True:
        if not inside and line[at:at + 1] == '"':
            inside, at = True, at + 1
        while inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1:at + 2] == '"':
                at += 2
            else:
                inside, at = False, at + 1
        at = line.find(sep, at) + 1
        if not at:
            return False


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start, at): lines with their file, split and order."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                    F.monotonically_increasing_id().alias("at")))


def headers(lines: DataFrame) -> DataFrame:
    """(file, header): the first line of every file that has one."""
    first = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    clean = F.regexp_replace(F.regexp_replace("header", "^﻿", ""), "\r$", "")
    return first.select("file", clean.alias("header")).filter(F.trim("header") != "")


def _numbered(lines: DataFrame, known: dict[str, int], files: DataFrame) -> DataFrame:
    """Lines with the number of their file's header."""
    if len(known) == 1:
        return lines.withColumn("shape", F.lit(0))
    number = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    of_file = files.select("file", number[F.col("header")].alias("shape"))
    return _tagged(lines, of_file, ["file"], "inner")


def _tagged(lines: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """`lines` with the columns of a per-file or per-split table, lines of a split still in order.

    A table of proven size is sent to every task, which leaves the lines where
    they are; with a larger one the lines are dealt by split and sorted.
    """
    if small.limit(MOST_SENT + 1).count() <= MOST_SENT:
        return lines.join(F.broadcast(small), on, how)
    return lines.join(small, on, how).repartition("file", "start").sortWithinPartitions("file", "start", "at")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """(split, from, to) of the stretches of a batch that belong to one split."""
    key = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
    edges = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) + 1
    edges = [0, *edges.tolist(), len(key[0])]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield (int(key[0][a]), int(key[1][a])), a, b


def _with_quote(values: pa.Array) -> list[int]:
    return np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False)).tolist()


def split_effects(lines: DataFrame, seps: list[str]) -> DataFrame:
    """(file, start, from_outside, from_inside): the state a split ends in, for both states it may start in."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, ends, shape = None, [False, True], 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([split[0]], pa.int64()), pa.array([split[1]], pa.int64()),
                                               pa.array([ends[0]]), pa.array([ends[1]])], ["file", "start", "from_outside", "from_inside"])
        for batch in batches:
            for key, a, b in _runs(batch):
                if key != split:
                    if split is not None:
                        yield told()
                    split, ends, shape = key, [False, True], batch.column(3)[a].as_py()
                part = batch.column(0).slice(a, b - a)
                for i in _with_quote(part):  # a line without a quote changes nothing
                    line = part[i].as_py()
                    ends = [still_inside(line, s, seps[shape]) for s in ends]
        if split is not None:
            yield told()

    keyed = lines.select("value", "file", "start", "shape")
    _session.ship_package(lines.sparkSession)
    return keyed.mapInArrow(work, "file long, start long, from_outside boolean, from_inside boolean")


def split_states(effects: DataFrame) -> DataFrame:
    """(file, start, inside, after): whether each split starts, and ends, inside a quoted field.

    A split that ends alike from both states forgets what came before; others
    pass the state on or turn it round. So a split's state is that of the last
    split before it that forgets, turned round as often as the ones since do.
    """
    w = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    forgets = F.col("from_outside") == F.col("from_inside")
    turns = F.when(~forgets & F.col("from_outside"), 1).otherwise(0)
    counted = effects.withColumn("turned", F.coalesce(F.sum(turns).over(w), F.lit(0)))
    last = counted.withColumn("last", F.last(F.when(forgets, F.struct("from_outside", "turned")), ignorenulls=True).over(w))
    since = F.col("turned") - F.coalesce("last.turned", F.lit(0))
    inside = (F.coalesce(F.col("last.from_outside").cast("int"), F.lit(0)) + since) % 2 == 1
    return last.select("file", "start", inside.alias("inside"),
                       F.when(inside, F.col("from_inside")).otherwise(F.col("from_outside")).alias("after"))


def _assembled(lines: DataFrame, seps: list[str], edges: bool = False) -> DataFrame:
    """(shape, file, start, kind, text, fields) of every whole record; with `edges`, of every fragment at the edge of a split."""
    names = ["shape", "file", "start", "kind", "text", "fields"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, shape, inside, begun, open_kind = None, 0, False, [], TAIL

        def left() -> Iterator[pa.RecordBatch]:
            if begun and edges:
                yield rows([(open_kind, "\n".join(begun), None)], split, shape)

        def rows(which: list[tuple[int, str | None, list[str] | None]], key, shape) -> pa.RecordBatch:
            n = len(which)
            return pa.RecordBatch.from_arrays([
                pa.array([shape] * n, pa.int32()), pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int64()),
                pa.array([k for k, _, _ in which], pa.int32()), pa.array([t for _, t, _ in which], pa.string()),
                pa.array([f for _, _, f in which], _FIELDS)], names)

        def rows_of(plain: pa.Array, key, shape) -> pa.RecordBatch:
            """Lines without any quote are cut in one call."""
            n = len(plain)
            same = lambda x, kind: pa.repeat(pa.scalar(x, kind), n)
            return pa.RecordBatch.from_arrays([
                same(shape, pa.int32()), same(key[0], pa.int64()), same(key[1], pa.int64()), same(WHOLE, pa.int32()),
                pa.nulls(n, pa.string()), pc.split_pattern(plain, seps[shape]).cast(_FIELDS)], names)

        for batch in batches:
            for key, a, b in _runs(batch):
                values = batch.column(0).slice(a, b - a)
                first = 0
                if key != split:
                    yield from left()
                    split, shape, begun = key, batch.column(3)[a].as_py(), []
                    inside = bool(batch.column(4)[a].as_py())
                    open_kind = MIDDLE if inside else TAIL
                    first = 1 if key[1] == 0 else 0  # the header
                quoted = set(_with_quote(values))
                if not quoted and not inside and not begun:
                    if edges:
                        continue
                    plain = pc.replace_substring_regex(values.slice(first), "\r$", "")
                    plain = plain.filter(pc.not_equal(plain, ""))
                    if len(plain):
                        yield rows_of(plain, split, shape)
                    continue
                texts, done = values.to_pylist(), []
                for i in range(first, len(texts)):
                    text = texts[i]
                    after = still_inside(text, inside, seps[shape]) if i in quoted else inside
                    if after:
                        begun.append(text)
                    elif begun or inside:
                        begun.append(text)
                        if (open_kind == MIDDLE) == edges:
                            whole = "\n".join(begun)
                            done.append((HEAD, whole, None) if edges else (WHOLE, None, fields_of(whole, seps[shape])))
                        begun, open_kind = [], TAIL
                    elif not edges and text and text != "\r":
                        done.append((WHOLE, None, fields_of(text, seps[shape]) if i in quoted else text.removesuffix("\r").split(seps[shape])))
                    inside = after
                if done:
                    yield rows(done, split, shape)
        yield from left()

    keyed = lines.select("value", "file", "start", "shape", F.coalesce("inside", F.lit(False)).alias("inside"))
    _session.ship_package(lines.sparkSession)
    return keyed.mapInArrow(work, "shape int, file long, start long, kind int, text string, fields array<string>")


def fields_of(record: str, sep: str) -> list[str]:
    return next(csv.reader([record.removesuffix("\r")], delimiter=sep), [])


def _glued(fragments: DataFrame, seps: list[str]) -> DataFrame:
    """(shape, fields) of the records that cross splits: a tail, middles and a head of one file, in order."""
    w = Window.partitionBy("file").orderBy("start", "kind")
    chained = fragments.withColumn("chain", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = chained.groupBy("shape", "file", "chain").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "text"))).alias("parts"))

    @F.pandas_udf("array<string>")
    def cut(shapes, texts):
        return texts.combine(shapes, lambda t, s: fields_of(t, seps[s]))

    _session.ship_package(fragments.sparkSession)
    return whole.select("shape", cut("shape", F.array_join("parts.text", "\n")).alias("fields"))


def read_records(spark: SparkSession, path: str, bind: Callable[[str], str]) -> tuple[DataFrame, list[str]]:
    """((shape, fields) of every record, the distinct headers in the order of their numbers).

    `bind` gives a header's delimiter and raises if the header will not do.
    """
    lines = raw_lines(spark, path)
    files = _session.written(headers(lines), "csv-headers")
    seen = files.groupBy("header").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "header").limit(MOST_HEADERS + 1).collect()
    if not seen:
        raise ValueError(f"{path} has no header row")
    if len(seen) > MOST_HEADERS:
        raise ValueError(f"{path} holds more than {MOST_HEADERS} different headers")
    known = {r.header: i for i, r in enumerate(seen)}
    seps = [bind(h) for h in known]
    lines = _numbered(lines, known, files).withColumn("file", F.xxhash64("file"))
    states = _session.written(split_states(split_effects(lines, seps)), "csv-splits")
    inside = states.filter("inside").select("file", "start", "inside")
    across = not inside.isEmpty()
    marked = _tagged(lines, inside, ["file", "start"], "left") if across else lines.withColumn("inside", F.lit(False))
    records = _assembled(marked, seps).select("shape", "fields")
    if not across and states.groupBy("file").agg(F.max_by("after", "start").alias("open")).filter("open").isEmpty():
        return records, list(known)
    edges = _assembled(marked, seps, edges=True).select("shape", "file", "start", "kind", "text")
    return records.unionByName(_glued(edges, seps)), list(known)
