"""Embedding near-duplicates on a robust-pruned flat graph.

Vectors are scaled to unit length in double precision and equal arrays become one
node. Centres are fitted on a sample of at most `sample_rows` vectors; every
node joins the shards of its nearest `overlap` centres, the nearest being its
home. In each shard a flat graph is built: candidates are a node's nearest
members, robust pruning keeps those not already covered by a kept, closer
one. Adjacency lists of a node are united over its shards. The search runs at
a node's home shard (and, if that is a large one, at its other shards too) over its members and the neighbours that the union brings
in: greedy from the shard's medoid to the query's region, then
expanding through every node within the range until none is new. Each hit is
checked by its cosine in double precision.

Recall is audited for the rows whose id is divisible by `audit_every`,
against all rows in blocks; below `least_recall` the graph is built again
with more overlap, and if that doesn't reach it, all rows meet in blocks. The number
of centres grows with the row count, from `max_centres` on with its square
root. A shard over `max_shard` members gets no graph: it is dealt into parts by a hash,
and every two parts meet in a task, so all of its pairs are compared.

Hits between two nodes of one home are counted where they are found; only
hits across homes leave the task as pairs, so a group of copies at one
home makes as many rows as it has members.

Vectors that are null, zero or hold null or non-finite components link with
nothing: n_links 0, component their own id, kept. Vectors of different length
are never compared. Repeated rows are vectors of their own that link with each other.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import components, cut, map_arrow

DEGREE = 24  # kept neighbours of a node in one shard
CANDIDATES = 64  # nearest members looked at in pruning
ALPHA = 1.2  # a kept neighbour covers what is this much closer to it than to the node
BEAM = 16  # nodes held in the greedy search
BLOCK = 1024  # rows of a similarity block


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so nothing overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    """List column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def nodes_of(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, node) and (nodes: node, dim, vec, times, vec_id smallest); node is null for vectors that can't link."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("node", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("v")))
    nodes = rows.filter("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("vec_id"), F.first("v").alias("v"))
    return rows, nodes


def _scaled(nodes: DataFrame) -> DataFrame:

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(3):
                out.append(unit(np.asarray(v.values.to_numpy(zero_copy_only=False))[None])[0])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(x) for x in out], pa.int32()), pa.array(out, pa.list_(pa.float64()))],
                                             ["node", "times", "vec_id", "dim", "vec"])

    return map_arrow(nodes.select("node", "times", "vec_id", "v"), work, "node long, times long, vec_id long, dim int, vec array<double>")


def fit_centres(nodes: DataFrame, total: int, per_shard: int, sample_rows: int, max_centres: int, seed: int = 17) -> dict[int, np.ndarray]:
    """dim -> centres, by spherical k-means over about `sample_rows` nodes picked by their hash.

    Beyond `max_centres`**2 nodes there are as many centres as the root of `total`, on a sample of 16 nodes each at least.
    """
    max_centres = max(max_centres, math.isqrt(total))
    sample_rows = max(sample_rows, 16 * math.isqrt(total))
    share = min(1.0, sample_rows / max(1, total))
    some = nodes.filter(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)).select("dim", "vec").toArrow()
    dims = np.asarray(some.column("dim"))
    out = {}
    for dim in np.unique(dims):
        x = _matrix(some.filter(pa.array(dims == dim)).column("vec"))
        k = int(min(max_centres, max(1, total * len(x) // max(1, len(dims)) // per_shard), len(x)))
        rng = np.random.default_rng(seed)
        c = x[np.sort(rng.choice(len(x), k, replace=False))]
        step = max(64, min(4096, 4_000_000 // k))
        for _ in range(8):
            near = np.concatenate([(x[i:i + step] @ c.T).argmax(axis=1) for i in range(0, len(x), step)])
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
        out[int(dim)] = c
    return out


def assign(nodes: DataFrame, centres: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """Nodes with `shards`: (number, cosine to the centre), nearest first; the numbers of different lengths don't meet."""
    first = dict(zip(centres, np.cumsum([0, *map(len, centres.values())]).tolist()))
    shared = nodes.sparkSession.sparkContext.broadcast(centres)  # as many of each length as fit_centres() allows
    kind = pa.list_(pa.struct([("shard", pa.int64()), ("sim", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column(3))
            out: list = [None] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                c = shared.value.get(int(dim))
                if c is None:  # a length that the sample has missed: one shard of its own
                    for i in at:
                        out[i] = [{"shard": -int(dim), "sim": 0.0}]
                    continue
                sims = _matrix(b.column(4).take(pa.array(at))) @ c.T
                k = min(overlap, sims.shape[1])
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                for i, t, s in zip(at, top, sims):
                    out[i] = [{"shard": first[int(dim)] + int(j), "sim": float(s[j])} for j in t]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], [*b.schema.names, "shards"])

    return map_arrow(nodes, work, "node long, times long, vec_id long, dim int, vec array<double>, shards array<struct<shard:long,sim:double>>")


def _members(placed: DataFrame, max_shard: int, whole: bool = False) -> DataFrame:
    """(shard, node, times, vec, hs, parts, asked): who is in which shard.

    hs is a node's home shard, parts is set in large shards only, and asked holds where the node is searched for:
    at home, and everywhere if its home is large. whole: every shard counts as large.
    """
    each = placed.select("node", "times", "vec", F.expr("shards[0].shard").alias("hs"), F.explode("shards.shard").alias("shard"))
    sizes = each.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > (0 if whole else max_shard))
    large = cut(sizes.select(F.expr("shard ^ 0").alias("ls"), F.ceil(2 * F.col("n") / max_shard).cast("int").alias("parts")), "vec-large")
    # at most as many rows as there are centres
    each = each.join(F.broadcast(large), F.col("shard") == F.col("ls"), "left").drop("ls")
    homes = large.select(F.col("ls").alias("lh"))
    each = each.join(F.broadcast(homes), F.col("hs") == F.col("lh"), "left")
    return each.withColumn("asked", F.expr("hs = shard or lh is not null")).drop("lh")


def robust_prune(sims: np.ndarray, near: np.ndarray, x: np.ndarray) -> list[int]:
    """Of the candidates `near` (nearest first, with cosines `sims`) those kept: none is covered by a kept one before it."""
    d_node = 1.0 - sims
    d_each = 1.0 - x[near] @ x[near].T
    alive = np.ones(len(near), bool)
    kept: list[int] = []
    for i in range(len(near)):
        if alive[i]:
            kept.append(i)
            if len(kept) == DEGREE:
                break
            alive &= ALPHA * d_each[i] > d_node
    return kept


def _build(table: pa.Table) -> pa.Table:
    """One shard's graph: node, nbrs, and `sims` to them."""
    ids = np.asarray(table.column("node"))
    x = _matrix(table.column("vec"))
    nbrs, values = [], []
    k = min(CANDIDATES, len(ids) - 1)
    for at in range(0, len(ids), BLOCK):
        sims = x[at:at + BLOCK] @ x.T
        sims[np.arange(len(sims)), at + np.arange(len(sims))] = -2.0
        for i, row in enumerate(sims):
            near = np.argpartition(-row, k - 1)[:k] if k else np.empty(0, np.int64)
            near = near[np.lexsort((ids[near], -row[near]))]
            kept = near[robust_prune(row[near], near, x)] if k else near
            nbrs.append(ids[kept])
            values.append(row[kept])
    return pa.table({"node": pa.array(ids), "nbrs": pa.array(nbrs, pa.list_(pa.int64())), "sims": pa.array(values, pa.list_(pa.float64()))})


def _search(threshold: float):

    def work(table: pa.Table) -> pa.Table:
        """One shard: hits of the nodes asked there. Rows: node, n (weighted hits at home), root (least node linked at home), away (hits of other homes)."""
        ids = np.asarray(table.column("node"))
        member = np.asarray(table.column("member"))
        hs = np.asarray(table.column("hs"))
        home = member & (hs == np.asarray(table.column("shard")))
        asked = np.asarray(table.column("asked"))
        order = np.lexsort((~home, ~member, ids))  # a node may come as a member and as a neighbour
        first = order[np.unique(ids[order], return_index=True)[1]]
        table = table.take(pa.array(first))
        ids, home, hs, asked = ids[first], home[first], hs[first], asked[first]
        member = member[first]
        times = np.asarray(table.column("times"))
        x = _matrix(table.column("vec"))
        lists = table.column("nbrs").combine_chunks()
        offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        at = np.searchsorted(ids, flat)
        at[at == len(ids)] = 0
        here = ids[at] == flat if len(flat) else np.empty(0, bool)
        adj = [at[a:b][here[a:b]] for a, b in zip(offsets[:-1], offsets[1:])]
        back: list[list[int]] = [[] for _ in ids]  # the graph is walked both ways
        for i, js in enumerate(adj):
            for j in js.tolist():
                back[j].append(i)
        adj = [np.union1d(a, np.array(b, np.int64)).astype(np.int64) for a, b in zip(adj, back)]
        centre = x[member].mean(axis=0)
        medoid = int(np.flatnonzero(member)[(x[member] @ centre).argmax()])

        hits: dict[int, np.ndarray] = {}
        for q in np.flatnonzero(asked).tolist():
            v = x[q]
            seen = {medoid: float(x[medoid] @ v)}
            beam, done = [medoid], set()
            while True:  # greedy: the best node not yet opened, among the best BEAM
                todo = [n for n in beam if n not in done]
                if not todo:
                    break
                n = todo[0]
                done.add(n)
                new = [j for j in adj[n].tolist() if j not in seen]
                if new:
                    seen.update(zip(new, (x[new] @ v).tolist()))
                    beam = sorted({*beam, *new}, key=lambda j: (-seen[j], j))[:BEAM]
                if q in seen:  # the query's own node is reached
                    break
            # expansion: through all nodes in range, from the query's own node and what the walk has met
            front = [q] + [j for j, s in seen.items() if s >= threshold and j != q]
            inside = set(front)
            while front:
                new = np.unique(np.concatenate([adj[j] for j in front]))
                new = new[[j not in inside for j in new.tolist()]] if len(new) else new
                front = new[x[new] @ v >= threshold].tolist() if len(new) else []
                inside.update(front)
            inside.discard(q)
            hits[q] = np.array(sorted(inside), np.int64)

        at_home = [q for q in hits if home[q]]
        for q in at_home:  # both of a pair at home know of it
            for j in hits[q][home[hits[q]]].tolist():
                if q not in hits[j]:
                    hits[j] = np.append(hits[j], q)
        root = {q: q for q in hits}

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for q in at_home:
            for j in hits[q][home[hits[q]]].tolist():
                a, b = find(q), find(j)
                root[max(a, b)] = min(a, b)
        qs = list(hits)
        return pa.table({
            "node": pa.array(ids[qs], pa.int64()),
            "n": pa.array([int(times[hits[q][home[hits[q]]]].sum()) if home[q] else 0 for q in qs], pa.int64()),
            "root": pa.array([int(ids[find(q)]) for q in qs], pa.int64()),
            "away": pa.array([ids[hits[q][hs[hits[q]] != hs[q]]] for q in qs], pa.list_(pa.int64()))})

    return work


def _meet(threshold: float):

    def work(table: pa.Table) -> pa.Table:
        """Two parts of a large shard, or one with itself: all pairs compared. Rows as from _search."""
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        ids, part, times, hs = (np.asarray(table.column(c)) for c in ("node", "part", "times", "hs"))
        x = _matrix(table.column("vec"))
        home = hs == table.column("shard")[0].as_py()
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        linked = np.zeros((len(left), len(right)), bool)  # pairs at home
        n = np.zeros(len(ids), np.int64)
        away: dict[int, list[np.ndarray]] = {}
        for at in range(0, len(left), BLOCK):
            of = left[at:at + BLOCK]
            hit = x[of] @ x[right].T >= threshold
            if i == j:
                hit[np.arange(len(of)), at + np.arange(len(of))] = False
            other = hit & (hs[of][:, None] != hs[right][None, :])
            for r in np.flatnonzero(other.any(axis=1)).tolist():
                away[int(of[r])] = ids[right[other[r]]]
            hit &= home[of][:, None] & home[right][None, :]
            linked[at:at + len(of)] = hit
            n[of] += (hit * times[right][None, :]).sum(axis=1)
            if i != j:
                n[right] += (hit * times[of][:, None]).sum(axis=0)
        # groups at home: breadth first, each row and column of `linked` is looked at once
        root = np.arange(len(ids))
        place = np.full(len(ids), -1)
        place[left] = np.arange(len(left))
        new_l, new_r = linked.any(axis=1), linked.any(axis=0)
        for first in np.flatnonzero(linked.any(axis=1)).tolist():
            if not new_l[first]:
                continue
            ls, group = np.array([first]), [left[[first]]]
            new_l[first] = False
            while len(ls):
                rs = np.flatnonzero(linked[ls].any(axis=0) & new_r)
                new_r[rs] = False
                ls = np.flatnonzero(linked[:, rs].any(axis=1) & new_l)
                new_l[ls] = False
                group += [right[rs], left[ls]]
            group = np.concatenate(group)
            root[group] = group[ids[group].argmin()]
        # a node at home reports from its own part in any case, so each has a count
        out = np.flatnonzero(home) if i == j else np.flatnonzero((n > 0) | (root != np.arange(len(ids))))
        out = np.union1d(out, np.array(list(away), np.int64)).astype(np.int64)
        none = np.empty(0, np.int64)
        return pa.table({"node": pa.array(ids[out], pa.int64()), "n": pa.array(n[out], pa.int64()), "root": pa.array(ids[root[out]], pa.int64()),
                         "away": pa.array([away.get(q, none) for q in out.tolist()], pa.list_(pa.int64()))})

    return work


def _block_links(members: DataFrame, threshold: float) -> DataFrame:
    """Hits in large shards, as from _search: a row goes to one task for each part that its own part meets."""
    m = members.withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    m = m.select("shard", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "times", "vec", "hs")
    return m.groupBy("shard", "i", "j").applyInArrow(_meet(threshold), "node long, n long, root long, away array<long>")


def _graph_links(placed: DataFrame, threshold: float, max_shard: int, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(node, n: weighted links to other nodes) and edges (a, b) that connect what links connect."""
    every = cut(_members(placed, max_shard, whole), "vec-members")
    members = every.filter("parts is null").drop("parts")
    built = cut(members.groupBy("shard").applyInArrow(lambda t: _build(t), "node long, nbrs array<long>, sims array<double>"), "vec-graph")
    pairs = built.select("node", F.explode(F.arrays_zip("nbrs", "sims")).alias("e")).select("node", F.col("e.nbrs").alias("nbr"), F.col("e.sims").alias("sim"))
    union = cut(pairs.groupBy("node").agg(F.array_sort(F.collect_set("nbr")).alias("nbrs"),
                                          F.array_sort(F.collect_set(F.when(F.col("sim") >= threshold - 0.1, F.col("nbr")))).alias("close")), "vec-union")
    # neighbours near enough to lie in a range come along to the homes that know them
    homes = members.filter("asked").select("shard", "node")
    wanted = homes.join(union, "node").select("shard", F.explode("close").alias("nbr")).distinct()
    vectors = placed.select(F.col("node").alias("v_node"), "times", "vec", F.expr("shards[0].shard").alias("hs"))
    guests = wanted.join(vectors, F.col("nbr") == F.col("v_node")).select(
        "shard", F.col("nbr").alias("node"), "times", "vec", "hs", F.lit(False).alias("asked"), F.lit(False).alias("member"))
    there = members.withColumn("member", F.lit(True)).unionByName(guests)
    there = there.join(union.select(F.col("node").alias("u"), "nbrs"), F.col("node") == F.col("u"), "left").drop("u")
    there = there.withColumn("nbrs", F.coalesce("nbrs", F.array().cast("array<long>")))
    found = there.groupBy("shard").applyInArrow(_search(threshold), "node long, n long, root long, away array<long>")
    found = cut(found.unionByName(_block_links(every.filter("parts is not null"), threshold)), "vec-found")
    across = found.select("node", F.explode("away").alias("o"))
    across = across.unionByName(across.select(F.col("o").alias("node"), F.col("node").alias("o"))).distinct()
    weight = across.join(placed.select(F.col("node").alias("w"), "times"), F.col("o") == F.col("w")).groupBy("node").agg(F.sum("times").alias("m"))
    here = found.groupBy("node").agg(F.sum("n").alias("n"))
    counts = here.join(weight.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select(
        "node", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
    edges = found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(
        across.filter("node < o").select(F.col("node").alias("a"), F.col("o").alias("b")))
    return cut(counts, "vec-counts"), cut(edges, "vec-edges")


def true_links(placed: DataFrame, threshold: float, every: int) -> DataFrame:
    """(node, truth) for the stated queries, rows whose id is divisible by `every`: links by brute force, in blocks.

    Rows are packed into blocks of about BLOCK; each block of queries meets each block of rows once.
    """
    total = placed.agg(F.count(F.lit(1)).alias("n")).first().n
    n_rows, n_queries = 1 + total // BLOCK, 1 + total // every // BLOCK
    slim = placed.select("node", "times", "dim", "vec", (F.pmod(F.col("vec_id"), F.lit(every)) == 0).alias("asked"))
    block = lambda n: F.pmod(F.xxhash64("node", F.lit(9)), F.lit(n)).cast("int")
    rows = slim.withColumns({"rb": block(n_rows), "qb": F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))), "query": F.lit(False)})
    asked = slim.filter("asked").withColumns({"qb": block(n_queries), "rb": F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))), "query": F.lit(True)})

    def meet(t: pa.Table) -> pa.Table:
        query = np.asarray(t.column("query"))
        dims, ids, times = (np.asarray(t.column(c)) for c in ("dim", "node", "times"))
        out_ids, out_n = [], []
        for dim in np.unique(dims[query]):
            q, r = np.flatnonzero(query & (dims == dim)), np.flatnonzero(~query & (dims == dim))
            if len(r):
                hit = _matrix(t.column("vec").take(pa.array(q))) @ _matrix(t.column("vec").take(pa.array(r))).T >= threshold
                hit &= ids[q][:, None] != ids[r][None, :]
                out_ids += ids[q].tolist()
                out_n += (hit * times[r][None, :]).sum(axis=1).tolist()
        return pa.table({"node": pa.array(out_ids, pa.int64()), "n": pa.array(out_n, pa.int64())})

    met = rows.unionByName(asked).drop("asked").groupBy("rb", "qb").applyInArrow(meet, "node long, n long")
    return met.groupBy("node").agg(F.sum("n").alias("truth"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", per_shard: int = 512,
                    max_shard: int = 4096, overlap: int = 2, sample_rows: int = 20_000, max_centres: int = 1024,
                    audit_every: int = 100, least_recall: float = 0.95) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept, audit_recall (links found over links there are, for the audited rows)."""
    ship_package(vectors.sparkSession)
    rows, nodes = nodes_of(vectors, id_col, vec_col)
    nodes, told = cut(_scaled(nodes), "vec-nodes", n=F.count(F.lit(1)))
    rows = cut(rows.select("vec_id", "node"), "vec-rows")
    centres = fit_centres(nodes, told["n"] or 0, per_shard, sample_rows, max_centres)
    truth = cut(true_links(nodes, threshold, audit_every), "vec-truth")
    for more in (0, 1, 3, None):
        if more is None:  # no overlap has reached it: one shard of each length, all of whose parts meet
            one = F.struct((-F.col("dim").cast("long")).alias("shard"), F.lit(0.0).alias("sim"))
            placed = cut(nodes.withColumn("shards", F.array(one)), "vec-placed")
        else:
            placed = cut(assign(nodes, centres, overlap + more), "vec-placed")
        counts, edges = _graph_links(placed, threshold, max_shard, whole=more is None)
        audit = truth.join(counts, "node").agg(F.sum("truth").alias("t"), F.sum(F.least("truth", "n")).alias("f")).first()
        recall = (audit.f / audit.t) if audit.t else 1.0
        if recall >= least_recall:
            break
    groups = components(edges)
    labels = nodes.select("node", "times", "vec_id").join(groups.withColumnRenamed("node", "g"), F.col("node") == F.col("g"), "left")
    labels = labels.withColumn("label", F.coalesce("label", "node")).join(counts.withColumnRenamed("node", "c"), F.col("node") == F.col("c"))
    labels = cut(labels.select("node", "label", "vec_id", (F.col("n") + F.col("times") - 1).alias("n_links")), "vec-labels")
    heads = labels.groupBy("label").agg(F.min("vec_id").alias("component_id")).select(F.expr("label ^ 0").alias("h"), "component_id")
    known = cut(labels.join(heads, F.col("label") == F.col("h")).select(F.col("node").alias("k"), "n_links", "component_id"), "vec-known")
    out = rows.join(known, F.col("node") == F.col("k"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
                      F.lit(float(recall)).alias("audit_recall")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).select(
        "vec_id", "n_links", "component_id", "kept", "audit_recall")
