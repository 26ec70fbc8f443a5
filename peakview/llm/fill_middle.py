"""Fill-in-middle transformation: one repeated-capture match per text tells its units and both cuts.

A text is units of a word with the white space before it, and of trailing
white space. One `fullmatch` of `(unit)*` by the regex library keeps every
repetition of the group, so `match.ends(1)` is the list of all unit ends: its
length is n, and the ends number min and max of the two drawn cut points are
the offsets at which prefix, middle and suffix part. Nothing iterates over
units. Units never backtrack (possessive quantifiers), so the match is linear
in the text.

Draws come from sha256 of `<seed>:<doc_id>` and depend on nothing else, so a
text is cut alike on every run and every partitioning.

Null text is the empty text; the empty text and one that contains a mark stay
plain, so every output can be restored exactly. A null id draws like an empty
one. Texts of any length are matched whole. Repeated rows give repeated rows.
Columns of the input whose names this operator returns are replaced by its
own; others are carried along with `keep`. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# White space of a unit, and the marks of prefix, suffix and middle
SPACE = r"\x20\x09-\x0D"
MARKS = ("<P>", "<S>", "<M>")

UNITS = regex.compile(rf"((?:[{SPACE}]*+[^{SPACE}]++|[{SPACE}]++))*+")
PLAIN, PSM, SPM = "plain", "psm", "spm"


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the hex digest, as unsigned integers."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def cut_points(text: str, h1: int, h2: int) -> tuple[int, int, int]:
    """(n, end of the prefix, end of the middle) in code points."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    ends.append(0)  # cut point 0 reads the last place, -1
    return n, ends[low - 1], ends[high - 1]


def rearranged(text: str, doc_id: int | None, seed: int, fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    h1, h2, h3, h4 = draws(seed, doc_id)
    n, a, b = cut_points(text, h1, h2)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= fim_percent:
        return n, PLAIN, None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    if h4 % 100 < spm_percent:
        return n, SPM, a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, PSM, a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), seed: int = 42,
              fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """(doc_id, `keep`, n, form, prefix_chars, middle_chars, output) of every text."""
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for at in range(0, len(texts), 100):  # so many texts are held at once
                part = batch.slice(at, 100)
                rows = [rearranged(t or "", i, seed, fim_percent, spm_percent)
                        for i, t in zip(part.column(0).to_pylist(), part.column(part.num_columns - 1).to_pylist())]
                out = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *out], [*part.schema.names[:-1], *names])

    kept = [c for c in keep if c not in {"doc_id", *names}]
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), *kept, F.col(text_col).cast("string").alias("_fim_text"))
    schema = slim.drop("_fim_text").schema
    for name, kind in zip(names, ["long", "string", "long", "long", "string"]):
        schema = schema.add(name, kind)
    return map_arrow(slim, work, schema)


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The exact text, rebuilt from an output and its form alone.

    A rearranged text holds no mark of its own, so the first place of each mark
    is the one that was put there.
    """
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = MARKS
    head, body = F.substring_index(out, m, 1), F.substring_index(out, m, -1)
    psm = F.concat(F.replace(F.substring_index(head, s, 1), F.lit(p), F.lit("")), body, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), body, F.replace(F.substring_index(head, p, 1), F.lit(s), F.lit("")))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(out)


def digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every text."""
    made = transform(docs, **options)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(restored().cast("binary"), 256).alias("restored_sha256"))
