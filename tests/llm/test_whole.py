"""Cases in which an operator once did less than its whole job."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa

import corpus_pipeline as C
from peakview.llm import langid, mixing, pii, vector_graph

from .test_operators import roots


def brute_links(rows, threshold):
    """n_links and the component of each id by all pairs."""
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in rows}
    links = [(a, b) for a in unit for b in unit if a < b and sum(x * y for x, y in zip(unit[a], unit[b])) >= threshold]
    n = dict.fromkeys(unit, 0)
    for pair in links:
        for i in pair:
            n[i] += 1
    return n, roots(links, list(unit))


def test_vector_graph_large_shards(spark):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.15) for x in centres[i % 6]]) for i in range(600)] + [(700, [1.0] * 8), (701, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n, component = brute_links(rows, 0.9)
    for per_shard, overlap in ((602, 1), (100, 3)):  # shards far over max_shard; nothing is left to a second try
        got = vector_graph.near_duplicates(df, max_shard=40, per_shard=per_shard, overlap=overlap, least_recall=0.0).collect()
        found = {r.vec_id: r.n_links for r in got}
        if per_shard == 602:
            assert found == n and {r.vec_id: r.component_id for r in got} == component
        assert all(found[i] <= n[i] for i in n) and sum(found.values()) >= 0.98 * sum(n.values())


def test_vector_graph_audit_finishes_exactly(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_graph.near_duplicates(df, per_shard=3, max_centres=100, overlap=1, max_shard=64, audit_every=1, least_recall=1.0).collect()
    n, component = brute_links(rows, 0.9)
    assert {r.vec_id: r.n_links for r in got} == n and {r.vec_id: r.component_id for r in got} == component
    assert {r.audit_recall for r in got} == {1.0}


def test_vector_graph_centres_grow(spark):
    nodes = spark.createDataFrame([(i, 1, i, 2, [1.0, float(i)]) for i in range(400)], "node long, times long, vec_id long, dim int, vec array<double>")
    assert len(vector_graph.fit_centres(nodes, 400, per_shard=4, sample_rows=400, max_centres=5)[2]) == 20


def test_groups_keep_one_row_each(spark):
    words = [f"w{i}" for i in range(200)]
    text = lambda n, last="end": " ".join(f"{n}{w}" for w in words) + f" {last}"
    rows = [
        (1, text("a")), (None, text("a", "other")),  # linked: the one with an id stays
        (None, text("b")),  # unique, without an id
        (2, text("c")), (5, text("c", "other")), (5, text("d")), (9, text("d", "other")),  # id 5 comes with two texts
        (None, text("e")), (None, text("e", "other")), (None, text("e")),  # a group without any id
        (7, text("f")), (7, text("f").upper()), (7, text("f", "other")),  # near copies of one id
        (8, None), (8, ""), (None, None), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = C.one_of_each_group(spark, docs, "").collect()
    groups = sorted(((r.text or "-").strip() or "-")[0].lower() + str(r.doc_id) for r in got)
    assert groups == sorted(["a1", "bNone", "c2", "d5", "eNone", "f7", "-8", "-None", "-None"])


def test_pii_beside_other_numbers_and_seeds(spark):
    rows = [(i, f"please call me at +1 (523) 555-{1000 + i} today or tomorrow") for i in range(30)]
    alone = "please call me at {} today or tomorrow".format
    table = " ".join(f"523-555-{2000 + i}" for i in range(40))
    rows += [(100, alone("523-555-1099 523-555-1100")), (101, alone("523-555-1099 2024")), (102, alone("523-555-1099 24")),
             (103, alone("jane@x.com 523-555-1099")), (104, alone("(523) 555-1099")), (105, alone("523 555 1099 523 555 1100")), (106, alone(table)),
             (107, alone("4111 1111 1111 1112")), (108, alone("24 523-555-1099"))]
    got = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == alone("<PHONE> <PHONE>") and got[101] == alone("<PHONE> 2024") and got[102] == alone("<PHONE> 24")
    assert got[103] == alone("<EMAIL> <PHONE>") and got[104] == alone("<PHONE>") and got[105] == alone("<PHONE> <PHONE>")
    assert got[106] == alone(" ".join(["<PHONE>"] * 40)) and got[107] == rows[-2][1] and got[108] == alone("24 <PHONE>")


def test_mixing_exact_weights_and_every_source(spark):
    # no rounding: the share holds over a long run, for weights that no period of 1000 slots can state
    weights = {"a": 0.9, "b": 0.0997, "c": 0.0003}
    seen, total = Counter(), sum(map(Fraction, weights.values()))
    for t, (s, i, release, due, slot) in enumerate(mixing.block_slots({"a": 18000, "b": 1994, "c": 6}, weights)):
        assert slot == t and i == seen[s] and release <= slot < due
        seen[s] += 1
        if t % 97 == 0:
            assert all(abs(seen[x] - (t + 1) * Fraction(weights[x]) / total) < 1 for x in weights)
    assert seen == {"a": 18000, "b": 1994, "c": 6}
    # 600 sources, one of them null: each is a stream with its own weight
    rows = [(1000 * s + i, f"s{s}" if s else None) for s in range(600) for i in range(4 + s % 5)]
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), block=2).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    assert {r.stream for r in got} == {mixing.OTHER, *(f"s{s}" for s in range(1, 600))}
    assert all(r.release_slot <= r.slot < r.deadline_slot for r in got)
    order = sorted(got, key=lambda r: r.position)
    assert [r.slot for r in order] == sorted(r.slot for r in order)


def test_language_id_whole_runs():
    run = "a" * 300 + "b" * 300
    batch = pa.RecordBatch.from_arrays([pa.array([run]), pa.array(["xx"])], ["text", "lang"])
    counts = {(r["kind"], r["item"]): r["n"] for b in langid._count([batch]) for r in b.to_pylist()}
    assert counts[1, "a"] == 300 and counts[1, "b"] == 300 and counts[4, "bbb$"] == 1
    rows = np.array([[-1.0, -9.0], [-9.0, -1.0]])
    model = langid.Model(["aa", "bb"], [{}, {"a": 0, "b": 1}, {}, {}, {}], rows)
    assert model.word_score("a" * 256 + "b" * 900).argmax() == 1
