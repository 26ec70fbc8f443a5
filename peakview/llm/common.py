"""Shared pieces: written intermediates, word hashing, connected components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end_with_the_write(spark: SparkSession):
    """Spark deletes a write's shuffle files when the write ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, name: str, by: str | None = None, **metrics) -> DataFrame:
    """Write `df` to the shared folder named by spark.checkpoint.dir and read it back.

    Later steps start from the files, so a lost executor costs only its own
    tasks. With `metrics` (name -> aggregate column) their values over the
    written rows are returned beside the frame. `by` names a column whose
    values get a subfolder each.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    seen = Observation(f"{name}-{uuid.uuid4().hex}") if metrics else None
    rows = df.observe(seen, *[c.alias(k) for k, c in metrics.items()]) if metrics else df
    with _shuffles_end_with_the_write(spark):
        rows.write.parquet(path, partitionBy=by)
    if not metrics:
        return spark.read.schema(df.schema).parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


def release(*tables: DataFrame) -> None:
    """Delete tables written by cut() once everything made from them is written too."""
    for df in tables:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = hadoop.Path(folder)
            if path.getName().startswith("llm-"):
                path.getFileSystem(conf).delete(path, True)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, work, schema) -> DataFrame:
    """mapInArrow, with this package on the workers.

    Texts are long rows: unless the session names another size, a batch holds
    at most 1,000 of them, which bounds what a worker has in memory.
    """
    ship_package(df.sparkSession)
    if df.sparkSession.conf.get(_BATCH) == "10000":
        df.sparkSession.conf.set(_BATCH, "1000")

    def bounded(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()  # else the worker keeps the largest task's buffers

    return df.mapInArrow(bounded, schema)


def ascii_lower(col):
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --------------------------------------------------------------------------
# word shingles inside a task
# --------------------------------------------------------------------------

class WordHashes(dict):
    """bytes -> 64-bit hash, remembered for the words met so far (bounded)."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of `text`.

    Words are the runs without space and \\x09-\\x0D after lower-casing A-Z.
    Fewer than k words make one shingle of the whole sequence; no word, none.
    """
    words = text.lower().split() if text else ()
    if not words:
        return np.empty(0, U64)
    h = np.fromiter(map(hashes.__getitem__, words), U64, len(words))
    width = min(k, len(h))
    n = len(h) - width + 1
    s = np.full(n, width, U64)
    for j in range(width):
        s = (s ^ h[j:j + n]) * U64(0x9E3779B97F4A7C15)
        s ^= s >> U64(29)
    s *= U64(0xBF58476D1CE4E5B9)
    s ^= s >> U64(32)
    return np.unique(s)


# --------------------------------------------------------------------------
# connected components
# --------------------------------------------------------------------------

def _with_smallest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the smallest v of u.

    The minimum is grouped map-side first. `u ^ 0` keeps the join from reusing
    the aggregate's partitioning: both inputs get an exchange of their own, so
    that the adaptive plan may split the edges of a hub over many tasks.
    """
    m = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.expr("u ^ 0").alias("mu"), "m")
    return edges.join(m, F.col("u") == F.col("mu"), "inner")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = _with_smallest(both).withColumn("m", F.least("m", "u"))
    return e.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    e = _with_smallest(edges)
    moved = e.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    kept = e.select("u", F.col("m").alias("v"))
    return moved.union(kept).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) of every node of `edges` (a, b: long); label is the smallest node reachable.

    Alternating large and small stars: each round is two joins over the edge
    list, written to the shared folder, until a round changes nothing. No
    adjacency list of a node is ever gathered in one place.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    prints = {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("u", "v"))}
    e, last = cut(e, "cc", **prints)
    for _ in range(max_rounds):
        if not last["n"]:
            break
        before = e
        e, now = cut(_small_star(_large_star(before)), "cc", **prints)
        release(before)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
