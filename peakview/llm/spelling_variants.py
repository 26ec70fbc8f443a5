"""Spelling variant grouping: Gram matrices of letter counts propose pairs, exact edits confirm them.

Two words one edit apart have letter-count vectors at squared distance 1 (a
letter more or less) or 2 (one replaced). So the words of a block are one
count matrix X, and `|x|^2 + |y|^2 - 2 X X'` gives all its squared distances
in one NumPy product; pairs at most two apart, of one length or of adjacent
lengths, are compared letter by letter.

Blocks stay small as the vocabulary grows, and lose nothing: the alphabet is
dealt into `groups` letter groups, and an edit touches one of them (insertion,
deletion) or at most two (replacement). For every two groups left out there
is a block of the words that share the lower length and the counts of all
other groups, so every near pair meets in some block; it is reported by the
first such block only. A block of more than `tile` words is dealt into tiles
and every pair of tiles meets in a task of its own, so no task holds a block
that grows with the data.

A word's form is its near word of largest count (ties: smallest in code-point
order), where that count is at least `ratio` times its own. Roots follow the
forms by doubling: each round every word takes its root's root. Counts at
least double along a chain, so the number of rounds grows with the logarithm
of the logarithm of the largest count.

Null and empty texts have no word; a null id reads as an empty one; texts and
runs of any length are taken whole; repeated rows count each; an empty table
gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, map_arrow, release

# The letters of a run after A-Z is lower-cased, all of them Latin-1
LETTERS = bytes([*range(0x61, 0x7B), *range(0xC0, 0x100)]).decode("latin-1")

#: letters of padded words that a product holds at once
CELLS = 4_000_000

_SLOT = np.zeros(256, np.int64)
_SLOT[list(LETTERS.encode("latin-1"))] = np.arange(len(LETTERS))


def thinned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, one_in: int = 97) -> DataFrame:
    """(word) of every run of `min_chars` letters or more; one letter is deleted where `one_in` divides the run's hash."""
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text, F.lit(f"[a-z\\u00C0-\\u00FF]{{{min_chars},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    return runs.withColumn("h", h).select(
        F.when(F.col("h") % one_in != 0, F.col("run"))
        .otherwise(F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).alias("word")
    ).filter(F.length("word") >= min_chars)


def vocabulary(docs: DataFrame, min_chars: int = 5, min_count: int = 3, one_in: int = 97, **columns: str) -> DataFrame:
    """(word, n) of the words that occur often enough."""
    words = thinned(docs, min_chars=min_chars, one_in=one_in, **columns)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


# --------------------------------------------------------------------------
# blocks
# --------------------------------------------------------------------------

def letter_groups(words: DataFrame, groups: int) -> list[str]:
    """The alphabet dealt into groups of about equal weight: most frequent letter first, in turn and back again."""
    rows = (words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''")
            .groupBy("letter").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "letter").collect())  # at most 90 rows
    out = [""] * groups
    for i, r in enumerate(rows):
        out[i % groups if i // groups % 2 == 0 else groups - 1 - i % groups] += r.letter
    return out


def left_out(groups: int) -> tuple[list[tuple[int, int]], list[int]]:
    """All pairs of groups that a block leaves out, and those that together cover each single group."""
    pairs = list(combinations(range(groups), 2))
    cover = [pairs.index((g, g + 1)) for g in range(0, groups - 1, 2)]
    if groups % 2:
        cover.append(pairs.index((0, groups - 1)))
    return pairs, cover


def first_block(groups: int) -> tuple[np.ndarray, np.ndarray]:
    """By the bit mask of the groups in which two words differ: the first block that holds both, same and adjacent length."""
    pairs, cover = left_out(groups)
    same, adjacent = (np.full(1 << groups, -1) for _ in range(2))
    for mask in range(1 << groups):
        fits = [i for i, (a, b) in enumerate(pairs) if not mask & ~(1 << a | 1 << b)]
        if fits:
            same[mask] = fits[0]
        if fits := [i for i in fits if i in cover]:
            adjacent[mask] = fits[0]
    return same, adjacent


def blocks(words: DataFrame, alphabet: list[str]) -> DataFrame:
    """(word, n, block, left, low, longer): a row per word and block.

    `low` is the lower length of a block; a `longer` word has one letter more
    and meets the others only.
    """
    pairs, cover = left_out(len(alphabet))
    length = F.length("word")
    letters = F.array_join(F.array_sort(F.split("word", "")), "")
    rests = [F.translate(letters, alphabet[a] + alphabet[b], "") for a, b in pairs]
    own = [F.struct(F.lit(i).alias("left"), length.alias("low"), F.lit(False).alias("longer"), r.alias("rest")) for i, r in enumerate(rests)]
    up = [F.struct(F.lit(i).alias("left"), (length - 1).alias("low"), F.lit(True).alias("longer"), rests[i].alias("rest")) for i in cover]
    return (words.select("word", "n", F.explode(F.array(*own, *up)).alias("b"))
            .select("word", "n", F.xxhash64("b.left", "b.low", "b.rest").alias("block"), "b.left", "b.low", "b.longer"))


def tiles(rows: DataFrame, tile: int) -> DataFrame:
    """`rows` with (a, b, side): the pair of tiles a row is sent to, and whether it is of the second one.

    Long words make smaller tiles. Only blocks over one tile are looked up.
    """
    most = F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(F.lit(2048 * tile) / F.col("large_low"))))
    many = (rows.groupBy(F.col("block").alias("large"), F.col("low").alias("large_low")).agg(F.count(F.lit(1)).alias("m"))
            .select("large", "large_low", F.ceil(F.col("m") / most).cast("int").alias("t")).filter("t > 1"))
    i = F.pmod(F.xxhash64("word", "block"), F.col("t")).cast("int")
    dealt = (rows.join(many, (F.col("block") == F.col("large")) & (F.col("low") == F.col("large_low")), "left").drop("large", "large_low")
             .withColumn("i", F.coalesce(i, F.lit(0)))
             .withColumn("j", F.explode(F.sequence(F.lit(0), F.coalesce("t", F.lit(1)) - 1))))
    return dealt.select("block", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), (F.col("i") > F.col("j")).alias("side"),
                        "left", "longer", "word", "n")


class Gram:
    """Near pairs of the words of whole blocks, by one product of their count matrix."""

    def __init__(self, alphabet: list[str], rows: int):
        self.rows = rows
        self.same, self.adjacent = first_block(len(alphabet))
        self.weights = np.zeros((len(LETTERS), len(alphabet)), np.float32)
        for g, letters in enumerate(alphabet):
            self.weights[_SLOT[list(letters.encode("latin-1"))], g] = 1
        self.bits = 1 << np.arange(len(alphabet))

    def pairs(self, words: list[str], group: np.ndarray, split: np.ndarray, side: np.ndarray, left: np.ndarray, longer: np.ndarray):
        """Indices (i, j) of the near pairs, each reported by one block only.

        `group` numbers the blocks; where `split`, only words of different sides meet.
        """
        none = np.empty(0, np.int64)
        if len(words) < 2:
            return none, none
        raw = [w.encode("latin-1") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        width = int(size.max())
        code = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(len(raw), width)
        row, col = np.nonzero(code)
        # squared distances are whole numbers: float32 holds them exactly up to 2^24
        x = np.bincount(row * len(LETTERS) + _SLOT[code[row, col]], minlength=len(raw) * len(LETTERS))
        x = x.reshape(len(raw), -1).astype(np.float32 if width < 2000 else np.float64)
        norm = np.einsum("ij,ij->i", x, x)
        i, j = np.nonzero(np.triu(norm[:, None] + norm[None, :] - 2 * (x @ x.T) <= 2, 1))
        fits = (group[i] == group[j]) & ~(longer[i] & longer[j]) & (~split[i] | (side[i] != side[j]))
        fits &= size[i] + longer[j] == size[j] + longer[i]
        i, j = i[fits], j[fits]
        kept_i, kept_j = [none], [none]
        step = max(1, CELLS // max(width, len(LETTERS)))
        for at in range(0, len(i), step):
            a, b = i[at:at + step], j[at:at + step]
            a, b = np.where(longer[a], b, a), np.where(longer[a], a, b)  # b is the longer one, if any
            mask = (((x[a] != x[b]) @ self.weights) > 0) @ self.bits
            here = np.where(longer[b], self.adjacent[mask], self.same[mask]) == left[a]
            a, b = a[here], b[here]
            near = self.one_edit(code[a], code[b], longer[b])
            kept_i.append(a[near])
            kept_j.append(b[near])
        return np.concatenate(kept_i), np.concatenate(kept_j)

    @staticmethod
    def one_edit(a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> np.ndarray:
        """Whether rows of `b` come from those of `a` by one replaced letter or, where `longer`, one inserted."""
        differs = a != b
        replaced = differs.sum(1) == 1
        first = differs.argmax(1)  # a longer word differs at the latest after the end of the shorter
        shifted = a[:, :-1] != b[:, 1:]
        last = np.where(shifted.any(1), shifted.shape[1] - 1 - shifted[:, ::-1].argmax(1), -1) if shifted.shape[1] else np.full(len(a), -1)
        return np.where(longer, last < first, replaced)


def near_pairs(words: DataFrame, groups: int = 5, tile: int = 512) -> DataFrame:
    """(word, near, near_n) of every near pair of `words` (word, n), in both directions, once each."""
    alphabet = letter_groups(words, groups)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = Gram(alphabet, 2 * tile)

        def multiplied(t: pa.Table) -> Iterator[pa.RecordBatch]:
            col = lambda name: t.column(name).to_numpy()
            group = np.cumsum(starts(t))
            text = t.column("word").to_pylist()
            if len(text) * max(map(len, text)) > CELLS and group[-1] > 1:  # long words among others: block by block
                edges = np.append(np.flatnonzero(starts(t)), len(text)).tolist()
                for a, b in zip(edges, edges[1:]):
                    yield from multiplied(t.slice(a, b - a))
                return
            i, j = gram.pairs(text, group, col("a") != col("b"), col("side"), col("left"), col("longer"))
            n = col("n")
            yield pa.RecordBatch.from_arrays([pa.array([text[k] for k in np.concatenate([i, j])], pa.string()),
                                               pa.array([text[k] for k in np.concatenate([j, i])], pa.string()),
                                               pa.array(np.concatenate([n[j], n[i]]), pa.int64())], ["word", "near", "near_n"])

        def starts(t: pa.Table) -> np.ndarray:
            """True at the first row of a block's pair of tiles."""
            key = [t.column(c).to_numpy() for c in ("block", "a", "b")]
            new = np.ones(t.num_rows, bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
            return new

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            edges = np.flatnonzero(starts(held))
            at = 0
            while edges[-1] - at >= gram.rows:  # whole blocks only; the last one may go on
                stop = int(edges[np.searchsorted(edges, at + gram.rows, "right") - 1])
                if stop <= at:
                    stop = int(edges[np.searchsorted(edges, at, "right")])
                yield from multiplied(held.slice(at, stop - at))
                at = stop
            held = held.slice(at)
        while held is not None and held.num_rows:
            edges = np.append(np.flatnonzero(starts(held)), held.num_rows)
            stop = int(edges[max(1, np.searchsorted(edges, gram.rows, "right") - 1)])
            yield from multiplied(held.slice(0, stop))
            held = held.slice(stop)

    dealt = tiles(blocks(words, alphabet), tile).repartition("block", "a", "b").sortWithinPartitions("block", "a", "b")
    return map_arrow(dealt, work, "word string, near string, near_n long")


# --------------------------------------------------------------------------
# forms and roots
# --------------------------------------------------------------------------

def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(word, root) of every word of `forms` (word, form): the last word its forms lead to."""
    at, moved = cut(forms.select("word", F.col("form").alias("root")), "root"), 1
    for _ in range(max_rounds):
        before, to = at, at.select(F.col("word").alias("mid"), F.col("root").alias("further"))
        step = before.join(to, F.col("root") == F.col("mid"), "left").select("word", F.coalesce("further", "root").alias("root"), "further")
        at, seen = cut(step, "root", moved=F.count("further"))
        release(before)
        at, moved = at.drop("further"), seen["moved"]
        if not moved:
            return at
    raise RuntimeError("forms lead in a circle")


def variants(docs: DataFrame, min_chars: int = 5, min_count: int = 3, one_in: int = 97, ratio: int = 2, groups: int = 5,
             tile: int = 512, **columns: str) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents' vocabulary."""
    words = cut(vocabulary(docs, min_chars, min_count, one_in, **columns), "words")
    near = (near_pairs(words, groups, tile).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")))
    told = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                                  F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.near")).alias("form"),
                                                  F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")).alias("form_n"))
    told = cut(told, "forms")
    last = roots(told.filter("form IS NOT NULL").select("word", "form"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
