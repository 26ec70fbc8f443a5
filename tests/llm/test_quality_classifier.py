"""The quality classifier: features and updates against plain loops, accuracy on rows it has not seen."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from peakview.llm import quality_classifier as Q

from ..conftest import SF001
from .test_operators import odd


def test_features_do_not_depend_on_the_texts_beside():
    texts = ["One two two one two.\nOne two", "", None, "a", "A a A a", "##  ## 12 34\n\n", "x " * 5000, "One two two one two.\nOne two"]
    owner, place, value = Q.Features().of(texts)
    for i, t in enumerate(texts):
        _, p, v = Q.Features().of([t])
        assert (place[owner == i] == p).all() and (value[owner == i] == v).all()
        assert len(set(p.tolist())) == len(p)
        assert abs((v.astype(float) ** 2).sum() - (1 if t else 0)) < 1e-4
    assert (place[owner == 0] == place[owner == 7]).all()


def test_features_count_ngrams():
    f = Q.Features(bits=30)
    words = "a b a b c".split()
    owner, place, value = f.of([" ".join(words)])
    flags = [0, 0, 0, 1, 0]  # the second "a b" repeats
    grams = [tuple(words[i:i + n]) for n in (1, 2) for i in range(6 - n)]
    shapes = [tuple(("s", flags[j]) for j in range(i, i + n)) for n in (1, 2, 3) for i in range(6 - n)]
    total = len(grams) + len(shapes)
    counts = sorted([grams.count(g) for g in set(grams)] + [shapes.count(g) for g in set(shapes)])
    assert sorted(np.rint(value.astype(float) ** 2 * total).astype(int).tolist()) == counts


def test_updates_are_ftrl():
    rng = random.Random(2)
    learner = Q.Learner(6, 0.5, 1.0, 0.1, 0.01)
    z, n = [0.0] * 7, [0.0] * 7

    def weight(i):
        l1 = 0.0 if i == 6 else 0.1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.5 + 0.01)
    for _ in range(200):
        at = sorted(rng.sample(range(6), rng.randint(0, 4)))
        x = [np.float32(rng.random()) for _ in at]
        y = rng.randint(0, 1)
        learner.learn(np.array(at, np.int32), np.array(x, np.float32), y)
        rows = [(i, float(v)) for i, v in zip(at, x)] + [(6, 1.0)]
        w = {i: weight(i) for i, _ in rows}
        g = 1 / (1 + math.exp(-sum(w[i] * v for i, v in rows))) - y
        for i, v in rows:
            step = (math.sqrt(n[i] + (g * v) ** 2) - math.sqrt(n[i])) / 0.5
            z[i] += g * v - step * w[i]
            n[i] += (g * v) ** 2
    assert np.allclose(learner.z, z) and np.allclose(learner.n, n) and np.allclose(learner.weights(slice(None)), [weight(i) for i in range(7)])


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.held_out_scores(docs, labels).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: r.held_out for r in got} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    test = [(r.score, r.predicted, quality[r.doc_id]) for r in got if r.held_out and r.doc_id in quality]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    good, bad = ([s for s, _, y in test if y == k] for k in (1, 0))
    assert sum(a > b for a in good for b in bad) >= 0.97 * len(good) * len(bad)
    assert sum(p == y for _, p, y in test) >= 0.95 * len(test)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet").filter("doc_id < 300") for t in ("documents", "labels"))
    swapped = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    mixed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).repartition(5)
    a, b, c = ({(r.doc_id, r.score) for r in Q.held_out_scores(*x, shards=3).collect()}
               for x in ((docs, labels), (docs, swapped), (mixed, labels.repartition(4))))
    assert a == b == c


def test_odd_rows(spark):
    labels = spark.createDataFrame([(3, 0), (5, 1), (6, 1), (7, 0), (7, 0), (7, None), (None, 1), (99, 1), (5, 7)], "doc_id long, quality int")
    rows = Q.held_out_scores(odd(spark), labels).collect()
    assert len(rows) == odd(spark).count()
    blank = {r.score for r in rows if r.doc_id in (1, 2)}  # a line end is a word, so text 3 has some
    assert len(blank) == 1 and all(not r.held_out for r in rows if r.doc_id is None)
    assert {r.score for r in Q.held_out_scores(odd(spark), labels.limit(0)).collect()} == {0.5}
    assert Q.held_out_scores(odd(spark).limit(0), labels).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5.0, "k", 1, "s")], "doc_id long, text string, score double, predicted string, places int, key string")
    out = Q.score(docs, np.zeros(2 ** 10 + 1), keep=("score", "key", "text"))
    assert out.columns == ["doc_id", "key", "text", "score", "predicted"] and out.first().score == 0.5 and out.first().key == "s"


def test_sample_is_bounded_for_any_number_of_labels(spark):
    n = 40_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    taken = Q.labelled_sample(docs, labels, 500, 4, "doc_id", "text", "quality")
    assert 400 < taken.count() < 600
    assert taken.select("shard").distinct().count() == 4
