"""Language identification, word first: known words by log frequency, unseen ones by shorter and shorter n-grams.

Training counts words per language over labelled documents and keeps, for each
language, its most frequent `max_words` words and `max_grams` n-grams of each
length; both are documented sizes of the classifier, and so is the number of
labelled documents it is fitted on. A document's score is the sum over its
words: a known word counts with its log frequency in each language; an unseen
word backs off to its 4-grams, those not known to their 3-grams, and so on to
single characters.

`und` is predicted for null text and text without a letter, with score 0.
Labels are used in training only. Null labels and null ids aren't trained on.
With nothing to train on every prediction is `und`. Ties go to the language
first in name order. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

UNKNOWN = "und"
WORD = regex.compile(r"\p{L}+")
MAX_ORDER = 4


def grams(word: str, order: int) -> list[str]:
    padded = f"^{word}$" if order > 1 else word
    return [padded[i:i + order] for i in range(len(padded) - order + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: (kind, item, lang, n); kind 0 counts words, kind o the n-grams of length o of the words met."""
    names = ["kind", "item", "lang", "n"]

    def out(words: Counter) -> pa.RecordBatch:
        counts: Counter = Counter()
        for (lang, w), n in words.items():
            counts[0, w, lang] += n
            for o in range(1, MAX_ORDER + 1):
                for g in grams(w, o):
                    counts[o, g, lang] += n
        keys = list(counts)
        return pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()),
            pa.array([k[2] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], names)

    words: Counter = Counter()
    for b in batches:
        for text, lang in zip(b.column(0), b.column(1)):
            words.update((lang.as_py(), w) for w in WORD.findall(text.as_py().lower()))
        if len(words) > 100_000:
            yield out(words)
            words = Counter()
    if words:
        yield out(words)


class Model:
    """Bounded tables: word -> row, n-gram -> row by length; `rows` has a score per language."""

    def __init__(self, langs: list[str], tables: list[dict[str, int]], rows: np.ndarray):
        self.langs, self.tables, self.rows = langs, tables, rows
        self.floor = np.full(len(langs), -14.0)

    def word_score(self, word: str) -> np.ndarray:
        known = self.tables[0].get(word)
        return self.rows[known] if known is not None else self._back_off(word, MAX_ORDER)

    def _back_off(self, text: str, order: int) -> np.ndarray:
        """Mean over the n-grams of `text`; one that isn't known is scored by its own shorter n-grams."""
        if order == 0:
            return self.floor
        parts = grams(text, order) if order == MAX_ORDER else [text[i:i + order] for i in range(max(1, len(text) - order + 1))]
        if not parts:
            return self._back_off(f"^{text}$", order - 1)
        table = self.tables[order]
        found = [self.rows[s] if (s := table.get(p)) is not None else self._back_off(p, order - 1) - 0.5 for p in parts]
        return np.mean(found, axis=0)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          sample_rows: int = 20_000, max_words: int = 20_000, max_grams: int = 8_000) -> Model:
    """Fit on a sample of about `sample_rows` labelled documents, picked by a hash of their id."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    total = labelled.select(id_col).count()
    share = min(1.0, sample_rows / max(1, total))
    some = labelled.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    counts = (map_arrow(some.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")), _count, "kind int, item string, lang string, n long")
              .groupBy("kind", "item", "lang").agg(F.sum("n").alias("n")))
    counts, _ = cut(counts, "langid", n=F.count(F.lit(1)))
    totals = {(r.kind, r.lang): r.n for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for _, lang in totals})
    picked = [counts.filter((F.col("lang") == lang) & (F.col("kind") == kind)).orderBy(F.desc("n"), "item").limit(max_grams if kind else max_words)
              for lang in langs for kind in range(MAX_ORDER + 1)]
    tables: list[dict[str, int]] = [{} for _ in range(MAX_ORDER + 1)]
    raw: list[dict[str, dict[str, int]]] = [defaultdict(dict) for _ in tables]
    for kind, item, lang, n in reduce(DataFrame.unionAll, picked).collect() if picked else []:
        raw[kind][item][lang] = n
    at = {lang: i for i, lang in enumerate(langs)}
    scores = np.empty((sum(map(len, raw)), len(langs)))
    n_rows = 0
    for kind, items in enumerate(raw):
        floors = np.array([np.log(0.2 / (1 + totals.get((kind, lang), 0))) for lang in langs])
        for item, by_lang in items.items():
            scores[n_rows] = floors
            for lang, n in by_lang.items():
                scores[n_rows, at[lang]] = np.log(n / totals[kind, lang])
            tables[kind][item] = n_rows
            n_rows += 1
    return Model(langs, tables, scores)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None,
            lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """`keep` columns of docs with the predicted language and its posterior (0 to 1)."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.tables, model.rows))
    schema = docs.select(*keep).schema.add(lang_out, "string").add(score_out, "double")
    limit = 100_000
    extra = [] if text_col in keep else [F.col(text_col).cast("string").alias("_text")]
    at_text = len(keep) if extra else keep.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        index: dict[str, int] = {}
        rows = np.empty((1024, len(m.langs)))
        for b in batches:
            found, scores = [], []
            for t in b.column(at_text):
                words = WORD.findall(t.as_py().lower()) if t.is_valid else ()
                if not words or not m.langs:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                if len(index) > limit:
                    index.clear()
                for w in set(words).difference(index):
                    if len(index) >= len(rows):
                        rows = np.concatenate([rows, np.empty_like(rows)])
                    rows[len(index)] = m.word_score(w)
                    index[w] = len(index)
                at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                total = np.bincount(at, minlength=len(index)) @ rows[:len(index)] if len(at) > 4 * len(index) else rows[at].sum(axis=0)
                mean = total / len(at) * min(len(at), 20)
                p = np.exp(mean - mean.max())
                best = int(mean.argmax())
                found.append(m.langs[best])
                scores.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                                             [*keep, lang_out, score_out])

    return map_arrow(docs.select(*keep, *extra), work, schema)


def remainder(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 4."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the documents whose remainder is not 2, a null id on neither side."""
    model = train(docs.filter(remainder() != 2))
    told = predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return told.withColumn("held_out", F.coalesce(remainder() == 2, F.lit(False)))
