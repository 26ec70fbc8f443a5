"""Quality classifier: logistic regression over hashed word n-grams, learnt by follow-the-regularised-leader.

A text is a row of words: runs of letters, of digits and of other signs, and
line ends. Two streams of n-grams are hashed into `2**bits` places: the words
themselves (lower-cased), and their shapes (small, Capital, CAPITALS, digits,
the sign itself, line end), where a shape also says whether this word followed
the one before it earlier in the text. An n-gram's value is the root of its
share of the text, so every text has length one.

Training is FTRL-Proximal: per place the sums z and n decide the weight, with
L1 keeping rare places at exactly zero. The labelled sample is dealt into
`shards` by a hash; a round runs FTRL over each shard from the same state, in
the order of a hash, and the next state is the mean z and n over the shards
that met a place. Shards are a parameter and not the cluster's size, so the
same rows give the same model anywhere. The model is bounded by `2**bits`
places, the sample by `sample_rows` labels.

A score is the logistic of the sparse dot product of a text with the weights;
the cut at which a text counts as good is `threshold`.

Null and empty texts have no n-gram: the bias alone scores them. Labels that
are null or not 0 or 1, null ids and ids without a document train nothing.
Rows of one id train each; repeated rows give repeated rows. Without any label
every score is 0.5. Whole texts are read. Columns of the documents other than
id and text are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, cut, map_arrow, release

WORD = regex.compile(r"\p{L}+|\p{N}+|\n|[^\s\p{L}\p{N}]+")
_MIX, _MORE = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9)


def shape(word: str) -> str:
    if word[0].isalpha():
        return "small" if word.islower() else "CAPITALS" if len(word) > 1 and word.isupper() else "Capital" if word[1:].islower() or len(word) == 1 else "miXed"
    return "digits" if word[0].isnumeric() else word[:8]


class Features:
    """Hashed n-grams of texts; remembers the words met so far (bounded)."""

    LIMIT = 250_000

    def __init__(self, bits: int = 18, word_order: int = 2, shape_order: int = 3):
        self.places, self.word_order, self.shape_order = 1 << bits, word_order, shape_order
        self.known: dict[str, int] = {}
        self.table = np.empty((2, 1024), U64)

    def _hashes(self, words: list[str]) -> np.ndarray:
        """Two rows: hashes of the words and of their shapes."""
        known = self.known
        if len(known) > self.LIMIT:
            known.clear()
        for w in set(words).difference(known):
            at = known[w] = len(known)
            if at >= self.table.shape[1]:
                self.table = np.concatenate([self.table, np.empty_like(self.table)], axis=1)
            self.table[:, at] = xxhash.xxh64_intdigest(w.lower()), xxhash.xxh64_intdigest(shape(w), 1)
        return self.table[:, np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    @staticmethod
    def _grams(h: np.ndarray, owner: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hashes, texts) of all n-grams of 1 to `order` items inside one text."""
        for n in range(1, min(order, len(h)) + 1):
            inside = owner[:len(h) - n + 1] == owner[n - 1:]
            s = np.full(len(inside), n, U64)
            for j in range(n):
                s = (s ^ h[j:j + len(s)]) * _MIX
                s ^= s >> U64(29)
            s *= _MORE
            yield (s ^ s >> U64(32))[inside], owner[:len(inside)][inside]

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, place, value) of the n-grams of some texts, by owner and place; places of a text are distinct."""
        split = [WORD.findall(t) if t else [] for t in texts]
        words = [w for ws in split for w in ws]
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
        if not words:
            return owner, np.empty(0, np.int32), np.empty(0, np.float32)
        h, shapes = self._hashes(words)
        before = np.zeros(len(words), bool)
        if len(words) > 1:
            near = np.flatnonzero(owner[1:] == owner[:-1]) + 1
            pairs = (h[near - 1] * _MIX ^ h[near]) * _MORE ^ owner[near].astype(U64)
            _, first, at = np.unique(pairs, return_index=True, return_inverse=True)
            before[near] = first[at] < np.arange(len(at))  # it followed the word before it earlier in the text
            shapes[near[h[near] == h[near - 1]]] ^= _MIX  # the same word twice
        shapes[before] ^= _MORE
        keys = [U64(self.places) * of.astype(U64) + g % U64(self.places)
                for stream, order in ((h, self.word_order), (shapes, self.shape_order)) for g, of in self._grams(stream, owner, order)]
        keys, n = np.unique(np.concatenate(keys), return_counts=True)
        owner = (keys // U64(self.places)).astype(np.int64)
        share = n / np.bincount(owner, n)[owner]
        return owner, (keys % U64(self.places)).astype(np.int32), np.sqrt(share).astype(np.float32)


class Learner:
    """FTRL-Proximal: z and n per place; the last place is the bias, which is not regularised."""

    def __init__(self, places: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(places + 1), np.zeros(places + 1)
        self.bias = np.array([places])

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(np.arange(len(self.z))[at] == self.bias, 0.0, self.l1)
        free = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, free / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.concatenate([places, self.bias]), np.append(values.astype(np.float64), 1.0)
        w = self.weights(at)
        g = (logistic(w @ x) - label) * x
        more = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = more


def logistic(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


# --------------------------------------------------------------------------
# training
# --------------------------------------------------------------------------

TEXTS_AT_ONCE = 64


def _features(rows: DataFrame, bits: int) -> DataFrame:
    """(shard, ord, label, places, values) of rows (shard, ord, label, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                owner, place, value = features.of(part.column(3).to_pylist())
                ends = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(ends, pa.array(place)),
                                                  pa.ListArray.from_arrays(ends, pa.array(value))], ["shard", "ord", "label", "places", "values"])

    return map_arrow(rows, work, "shard int, ord long, label int, places array<int>, values array<float>")


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int, shards: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(shard, ord, label, text) of about `sample_rows` labelled ids, picked by a hash of the id."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    share = sample_rows / max(1, known.count())
    known = known.filter(F.shiftrightunsigned(F.xxhash64("id", F.lit(7)), 11) * F.lit(2.0 ** -53) < share)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    met = rows.join(F.broadcast(known), "id")  # at most about sample_rows ids with a label or two
    return met.select(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("id", F.lit(13)).alias("ord"), "label", "text")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample_rows: int = 12_000, bits: int = 18, shards: int = 8, rounds: int = 4, alpha: float = 2.0, beta: float = 1.0,
          l1: float = 0.02, l2: float = 0.001) -> np.ndarray:
    """Weights per place, the bias last, fitted on a sample of the labelled ids."""
    places = 1 << bits
    rows = cut(_features(labelled_sample(docs, labels, sample_rows, shards, id_col, text_col, label_col), bits), "quality")
    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "ord", "label", F.xxhash64("places", "values"))
    context = docs.sparkSession.sparkContext
    state = Learner(places, alpha, beta, l1, l2)
    for _ in range(rounds):
        shared = context.broadcast((state.z, state.n))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, shard, mine = shared.value, None, None

            def met() -> pa.RecordBatch:
                at = np.flatnonzero(mine.n != start[1])
                return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(mine.z[at]), pa.array(mine.n[at])], ["place", "z", "n"])

            for batch in batches:
                for row_shard, label, at, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                    if row_shard != shard:
                        if mine:
                            yield met()
                        shard, mine = row_shard, Learner(places, alpha, beta, l1, l2)
                        mine.z, mine.n = start[0].copy(), start[1].copy()
                    mine.learn(at.values.to_numpy(), x.values.to_numpy(), label)
            if mine:
                yield met()

        # rounding makes the means the same whatever order the shards come in
        means = (map_arrow(dealt, work, "place int, z double, n double").groupBy("place")
                 .agg(F.round(F.avg("z"), 9).alias("z"), F.round(F.avg("n"), 9).alias("n")))
        means = cut(means, "quality-round")
        moved = means.toArrow()  # at most a row per place
        at = moved.column("place").to_numpy()
        state.z[at], state.n[at] = moved.column("z").to_numpy(), moved.column("n").to_numpy()
        release(means)
        shared.destroy()
    release(rows)
    return state.weights(slice(None))


# --------------------------------------------------------------------------
# scoring
# --------------------------------------------------------------------------

def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
          threshold: float = 0.3) -> DataFrame:
    """(doc_id, `keep`, score, predicted) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    bits = (len(weights) - 1).bit_length() - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(bits), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                owner, place, value = features.of(part.column(part.num_columns - 1).to_pylist())
                p = logistic(np.bincount(owner, w[place] * value, part.num_rows) + w[-1])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                                                 [*part.schema.names[:-1], "score", "predicted"])

    kept = [c for c in keep if c not in ("doc_id", "score", "predicted")]
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), *kept, F.col(text_col).cast("string").alias("_quality_text"))
    return map_arrow(slim, work, slim.drop("_quality_text").schema.add("score", "double").add("predicted", "integer"))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is a multiple of 5; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def held_out_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted: trained on the labels of the documents that are not held out."""
    weights = train(docs, labels.filter(~held_out()), **options)
    return score(docs, weights).withColumn("held_out", held_out())
