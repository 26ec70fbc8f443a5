"""N-gram Jaccard self-join by vertical partitioning, with linked groups.

Every document is the set of its distinct k-word shingles, each a 64-bit hash.
The global shingle order (the hash order) is cut into fragments. A fragment
holds, of every document, the segment of its shingles that falls there; the
fragment's task counts in how many different sets each of its shingles
occurs and keeps those in two or more. What the fragments report is summed per
document: a set that shares fewer than t% of its shingles with any other set
cannot link and is done. The survivors' shingles are ordered by (frequency,
hash); two linked sets share one within their prefixes, and length and
positional filters drop most other pairs that do. What remains is counted
fragment by fragment and the partial overlaps summed per pair.

Set sizes are counted on 64-bit hashes, overlaps on their upper 48 bits: two
different shingles of one pair fall together in about one of 10^8 pairs of
thousand-word texts, which moves that pair's overlap by one.

Equal sets are one class from the start, so copies cost nothing but their
scan. Because the result is the linked groups, pairs inside a group that is
already connected are never formed: first every shingle of a prefix pairs its
sets with one leader, linked pairs are joined to groups, and only
pairs across groups that still share a prefix shingle follow. All
of those are tested, so no link between different groups is lost.

Nulls and edge cases: null or blank text has no shingle and links with nothing
(its component is its own id); fewer than k words make one shingle; repeated
rows give repeated result rows; a row whose id is null takes its class's
component; an empty table gives an empty result. Class ids are 64-bit digests
of whole sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, WordHashes, components, cut, map_arrow, release, shingle_set

FLUSH = 1_000_000  # shingles gathered in a task before its segments are sent on
FRAGMENT = 4_000_000  # shingles that one fragment's task counts
BANDS = 4  # fragments are counted for a pair in so many groups of fragments, one after the other


def class_of(shingles: np.ndarray) -> int | None:
    if not len(shingles):
        return None
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def document_classes(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, cls) per row; cls names the set, null where it is empty. `key_col`, a long, is carried along as key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(t.as_py(), k, hashes) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([class_of(s) for s in sets], pa.int64()), *b.columns[2:]], ["doc_id", "n_shingles", "cls", *more])

    more = ["key"] if key_col else []
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
                       *[F.col(key_col).alias("key") for _ in more])
    return map_arrow(slim, work, "doc_id long, n_shingles long, cls long" + ", key long" * len(more))


def _narrow(toks: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, six bytes each: what the fragments are sent."""
    return (toks >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _widen(packed: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, :6] = packed.reshape(-1, 6)
    return wide.view(U64).ravel()


def _segments(docs: DataFrame, k: int, fragments: int, text_col: str) -> DataFrame:
    """(frag, cls, lens, toks): per task and fragment, the segments of its documents, packed."""

    def pack(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        ids = np.fromiter(sets, np.int64, len(sets))
        toks = np.concatenate(list(sets.values()))
        owner = np.repeat(np.arange(len(ids)), [len(s) for s in sets.values()])
        frag = ((toks >> U64(32)) * U64(fragments)) >> U64(32)
        order = np.argsort(frag, kind="stable")
        frag, owner, toks = frag[order], owner[order], toks[order]
        starts = np.flatnonzero(np.r_[True, (frag[1:] != frag[:-1]) | (owner[1:] != owner[:-1])])
        lens = np.diff(np.r_[starts, len(toks)]).astype(np.uint32)
        seg_frag, seg_cls = frag[starts], ids[owner[starts]]
        heads = np.flatnonzero(np.r_[True, seg_frag[1:] != seg_frag[:-1]])
        ends = np.r_[heads[1:], len(starts)]
        tok_at = np.r_[starts, len(toks)]
        return pa.RecordBatch.from_arrays([
            pa.array(seg_frag[heads].astype(np.int32)),
            pa.array([seg_cls[i:j].tobytes() for i, j in zip(heads, ends)], pa.binary()),
            pa.array([lens[i:j].tobytes() for i, j in zip(heads, ends)], pa.binary()),
            pa.array([_narrow(toks[tok_at[i]:tok_at[j]]) for i, j in zip(heads, ends)], pa.binary()),
        ], ["frag", "cls", "lens", "toks"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sets, held = WordHashes(), {}, 0
        for b in batches:
            for t in b.column(0):
                s = shingle_set(t.as_py(), k, hashes)
                c = class_of(s)
                if c is None or c in sets:
                    continue
                sets[c] = s
                held += len(s)
                if held >= FLUSH:
                    yield pack(sets)
                    sets, held = {}, 0
        if sets:
            yield pack(sets)

    slim = docs.select(F.col(text_col).cast("binary").alias("text"))
    return map_arrow(slim, work, "frag int, cls binary, lens binary, toks binary")


def _packed(table: pa.Table, name: str, kind) -> np.ndarray:
    """The numbers in a binary column's values, one after the other, without copies of the single values."""
    parts = []
    for chunk in table.column(name).chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
        parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0]:ends[-1]])
    return np.frombuffer(np.concatenate(parts), kind)


def _count_fragment(table: pa.Table) -> pa.Table:
    """Shingles of one fragment that two or more different sets hold, by set: cls, frag, toks, df."""
    cls, lens, toks = _packed(table, "cls", np.int64), _packed(table, "lens", np.uint32), _widen(_packed(table, "toks", np.uint8))
    first = np.zeros(len(cls), bool)
    first[np.unique(cls, return_index=True)[1]] = True  # the segment of an equal set counts once
    owner = np.repeat(np.arange(len(cls), dtype=np.uint32), lens)
    keep = first[owner]
    owner, toks = owner[keep], toks[keep]
    s = np.sort(toks)
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    runs = np.diff(np.r_[starts, len(s)]).astype(np.int32)
    values, runs = s[starts[runs >= 2]], runs[runs >= 2]
    del s, starts, keep
    at = np.searchsorted(values, toks).astype(np.uint32)
    at[at == len(values)] = 0
    shared = values[at] == toks if len(values) else np.zeros(len(toks), bool)
    owner, toks, df = owner[shared], toks[shared], runs[at[shared]] if len(values) else runs
    held, counts = np.unique(owner, return_counts=True)
    offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
    frag = table.column("frag")[0].as_py()
    return pa.table({
        "cls": pa.array(cls[held]), "frag": pa.array(np.full(len(held), frag, np.int32)),
        "toks": pa.ListArray.from_arrays(offsets, pa.array(toks.view(np.int64))),
        "df": pa.ListArray.from_arrays(offsets, pa.array(df))})


def _overlaps(pairs: DataFrame, seg: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose Jaccard reaches `percent`.

    Band after band adds its partial overlap o. A pair goes once the shingles
    its sets still hold in later bands (ra, rb) can't lift it to `percent`, so
    most false pairs end with the first band; links meet every band.
    """
    reach = F.col("o") + F.least("ra", "rb")
    live = pairs.withColumns({"o": F.lit(0).cast("long"), "ra": F.col("na"), "rb": F.col("nb")})
    for band in range(BANDS):
        one = seg.filter(F.col("band") == band)
        ours = one.select(F.col("cls").alias("a"), F.col("toks").alias("ta"), F.col("later").alias("la"))
        theirs = one.select(F.col("cls").alias("b"), F.col("toks").alias("tb"), F.col("later").alias("lb"))
        more = live.join(ours, "a", "left").join(theirs, "b", "left").select(
            "a", "b", "na", "nb", (F.col("o") + F.coalesce(F.size(F.array_intersect("ta", "tb")), F.lit(0))).alias("o"),
            F.coalesce("la", "ra").alias("ra"), F.coalesce("lb", "rb").alias("rb"))
        if band == BANDS - 1:  # nothing comes after: ra and rb no longer count
            more = more.withColumns({"ra": F.lit(0).cast("long"), "rb": F.lit(0).cast("long")})
        kept = cut(more.filter(100 * reach >= percent * (F.col("na") + F.col("nb") - reach)), "live")
        if band:
            release(live)
        live = kept
    return live.select("a", "b")


def _can_reach(na, nb, left_a, left_b, percent: int):
    """Length and positional filters: sets of these sizes that first meet with so many shingles left may link.

    The row of a pair's first common shingle has the largest bound, so a pair that may link keeps that row.
    """
    return ((na * 100 >= nb * percent) & (nb * 100 >= na * percent)
            & (F.least(left_a, left_b) * (100 + percent) >= (na + nb) * percent))


def _leader_pairs(posts: DataFrame, percent: int, leader, shift: float) -> DataFrame:
    """Each prefix shingle pairs its sets with one leader of about their size and of another group."""
    posts = posts.withColumn("size", F.floor(F.log("n") / math.log(100 / percent) * 2 + shift))
    tops = (posts.groupBy("tok", "size").agg(F.min_by(F.struct("cls", "n", "grp", "left"), leader).alias("top"), F.min("grp").alias("g0"),
                                     F.max("grp").alias("g1"))
            .filter("g0 <> g1").select(F.expr("tok ^ 0").alias("ltok"), F.expr("size ^ 0").alias("lsize"), "top.*")
            .withColumnsRenamed({"cls": "lcls", "n": "ln", "grp": "lgrp", "left": "lleft"}))
    may = _can_reach(F.col("n"), F.col("ln"), F.col("left"), F.col("lleft"), percent)
    p = posts.join(tops, F.expr("tok = ltok and size = lsize")).filter(F.expr("grp <> lgrp") & may)
    p = p.select(F.least("cls", "lcls").alias("a"), F.greatest("cls", "lcls").alias("b"),
                 F.when(F.col("cls") < F.col("lcls"), F.col("n")).otherwise(F.col("ln")).alias("na"),
                 F.when(F.col("cls") < F.col("lcls"), F.col("ln")).otherwise(F.col("n")).alias("nb"))
    return p.distinct()


def _cross_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """All pairs of different groups that share a prefix shingle and pass the length filter."""
    mixed = posts.groupBy("tok").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).filter("g0 <> g1")
    p = cut(posts.join(mixed.select(F.expr("tok ^ 0").alias("mtok")), F.col("tok") == F.col("mtok"), "left_semi"), "cross")
    x = p.select("tok", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("grp").alias("ga"), F.col("left").alias("la"))
    y = p.select("tok", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("grp").alias("gb"), F.col("left").alias("lb"))
    may = _can_reach(F.col("na"), F.col("nb"), F.col("la"), F.col("lb"), percent)
    return x.join(y, "tok").filter((F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & may).select("a", "b", "na", "nb").distinct()


def linked_classes(docs: DataFrame, classes: DataFrame, total: int, k: int, percent: int, text_col: str = "text") -> DataFrame:
    """(node, label) over class ids: the groups of sets that links connect. total: shingles of all rows."""
    spark = docs.sparkSession
    fragments = max(16, -(-total // FRAGMENT))
    schema = "cls long, frag int, toks array<long>, df array<int>"
    shared = cut(_segments(docs, k, fragments, text_col).groupBy("frag").applyInArrow(_count_fragment, schema), "shared")

    need = F.floor((F.col("n") * percent + 99) / 100)
    sizes = classes.filter("cls is not null").groupBy("cls").agg(F.max("n_shingles").alias("n"))
    held = shared.groupBy("cls").agg(F.sum(F.size("toks")).cast("long").alias("s"))
    alive = cut(held.join(sizes, "cls").filter(F.col("s") >= need), "alive")
    mine = cut(shared.join(alive.select("cls"), "cls", "left_semi").join(alive, "cls"), "mine")

    release(shared)

    band = F.floor(F.col("frag") * BANDS / fragments).cast("int")
    seg = mine.repartition("cls").groupBy("cls", band.alias("band")).agg(F.flatten(F.collect_list("toks")).alias("toks"))
    after = Window.partitionBy("cls").orderBy("band").rowsBetween(1, Window.unboundedFollowing)
    later = F.coalesce(F.sum(F.size("toks").cast("long")).over(after), F.lit(0))
    seg = cut(seg.withColumn("later", later), "seg", by="band")
    ordered = mine.groupBy("cls", "n", "s").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("df", "toks")))).alias("ts"))
    # shingles of one set only come first in the order; what is left of the prefix is among the shared ones
    prefix = ordered.select("cls", "n", "s", F.posexplode(F.slice("ts", F.lit(1), (F.col("s") - need + 1).cast("int"))).alias("pos", "t"))
    prefix = cut(prefix.select("cls", "n", (F.col("n") - F.col("s")).alias("own"), F.col("t.toks").alias("tok"),
                               (F.col("s") - F.col("pos")).alias("left")), "prefix")

    release(mine)

    links, groups = None, None
    # a set with few shingles of its own is the likeliest to link with many: it leads first
    leaders = [(F.struct("own", "cls"), 0.0), (F.struct(F.floor(F.col("own") / 8), F.xxhash64("cls", "tok")), 0.5),
               (F.xxhash64("tok", "cls"), 0.0), (F.xxhash64("cls", "tok", F.lit(1)), 0.5)]
    for leader in [*leaders, None]:
        if groups is None:
            posts = prefix.withColumn("grp", F.col("cls"))
        else:
            names = groups.select(F.col("node").alias("cls"), F.col("label").alias("grp"))
            posts = prefix.join(names, "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
        pairs = _cross_pairs(posts, percent) if leader is None else _leader_pairs(posts, percent, *leader)
        pairs, told = cut(pairs, "pairs", n=F.count(F.lit(1)))
        if not told["n"]:  # leaders may pair with nobody where other sets still do; only the last round is about all
            release(pairs)
            continue
        found, told = cut(_overlaps(pairs, seg, percent), "links", n=F.count(F.lit(1)))
        if told["n"] or groups is None:
            links = found if links is None else links.union(found)
            groups = cut(components(links), "groups")
        release(pairs)
    if groups is None:
        return spark.createDataFrame([], "node long, label long")
    return groups


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, cls, component_id (smallest id reachable by links).

    With `key_col`, a long, also key and root: the class that names the component, null for an empty set. Two
    components have the same id where one id comes with two texts, but never the same root.
    """
    classes, told = cut(document_classes(docs, k, id_col, text_col, key_col), "classes", n=F.sum("n_shingles"))
    groups = linked_classes(docs, classes, told["n"] or 0, k, percent, text_col)
    own = classes.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least_id"))
    known = own.join(groups, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("label", "cls"))
    known = cut(known.select("cls", "least_id", "root"), "known")
    heads = known.groupBy("root").agg(F.min("least_id").alias("component_id")).select(F.expr("root ^ 0").alias("r"), "component_id")
    of_class = cut(known.join(heads, F.col("root") == F.col("r")).select(F.col("cls").alias("c"), "component_id", "root"), "component")
    more = ["key", "root"] if key_col else []
    linked = classes.filter("cls is not null").join(of_class, F.col("cls") == F.col("c")).select("doc_id", "n_shingles", "cls", "component_id", *more)
    empty = classes.filter("cls is null").withColumn("root", F.col("cls")).select("doc_id", "n_shingles", "cls", F.col("doc_id").alias("component_id"), *more)
    return linked.unionByName(empty)
