"""License scan: exact set-similarity join of text blocks with license templates.

Blocks are windows of `block` words over the whole text, half overlapping, the
last one shorter. A block carries a template when it holds at least
`percent`% of the template's distinct words. The words of all templates
are ordered by how many blocks of the corpus hold them, rarest first; a block
that meets the threshold must hold one of a template's first
|T| - ceil(percent |T|) + 1 words, which an inverted index finds; length and
positional filters come before the exact count. Phrases are searched as
consecutive words over the whole text and give the base labels.

Null text is empty text, without words, places or labels. Repeated rows
give repeated rows; other columns of the input aren't read. The templates are
a parameter, so the broadcast order is bounded by their words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# Base phrases and their labels
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Sentences of well-known license notices, by label
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
            " documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
            " public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
            " the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
]

# words are runs of 0-9, a-z and of every character beyond ASCII; A-Z is lower-cased first
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def blocks_of(words: list, block: int) -> Iterator[tuple[int, list]]:
    """Windows of `block` words, each starting half a block after the one before, to the end of the text."""
    step = max(1, block // 2)
    for at in range(0, max(1, len(words) - block + step), step):
        yield at, words[at:at + block]


def _sets(templates) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(words_of(t.encode()))) for label, t in templates]


def word_order(docs: DataFrame, templates=TEMPLATES, block: int = 64, text_col: str = "text") -> dict[bytes, int]:
    """Template word -> place in the global order, by the number of blocks that hold it over all documents."""
    every = frozenset().union(*(s for _, s in _sets(templates)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                words = words_of(t.as_py())
                hits = every.intersection(words)
                if len(words) <= block:
                    seen.update(hits)
                elif hits:
                    step = max(1, block // 2)
                    n = len(range(0, max(1, len(words) - block + step), step))
                    held: dict[bytes, set] = {w: set() for w in hits}
                    for i, w in enumerate(words):
                        if w in hits:  # position i lies in the windows that start at (i - block, i]
                            held[w].update(range(max(0, (i - block) // step + 1), min(n - 1, i // step) + 1))
                    seen.update({w: len(s) for w, s in held.items()})
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counted = map_arrow(docs.select(F.col(text_col).cast("binary").alias("text")), work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = {bytes(r.word): r.n for r in counted.collect()}  # one row per template word
    return {w: i for i, w in enumerate(sorted(every, key=lambda w: (n.get(w, 0), w)))}


class Index:
    """Inverted index over the templates' prefixes in the global order."""

    def __init__(self, templates, order: dict[bytes, int], percent: int):
        self.order, self.templates = order, []
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for i, (label, words) in enumerate(_sets(templates)):
            ranked = sorted(words, key=order.__getitem__)
            need = -(-percent * len(ranked) // 100)
            self.templates.append((label, words, need))
            for pos, w in enumerate(ranked[:len(ranked) - need + 1]):
                self.prefix.setdefault(w, []).append((i, pos))

    def match(self, block: list[bytes]) -> dict[int, float]:
        """template -> containment, for those that reach their threshold in this block."""
        have = frozenset(block)
        first: dict[int, int] = {}
        for w in have.intersection(self.prefix):
            for i, pos in self.prefix[w]:
                first[i] = min(pos, first.get(i, pos))
        out = {}
        for i, pos in first.items():
            _, words, need = self.templates[i]
            if len(have) >= need and len(words) - pos >= need and (o := len(words & have)) >= need:
                out[i] = o / len(words)
        return out


def find_phrases(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> tuple[list[int], set[str]]:
    """Starts of all places where a phrase's words stand consecutively, and the labels."""
    starts, labels = [], set()
    for parts, label in phrases:
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at:at + len(parts)] == parts:
                starts.append(at)
                labels.add(label)
    return starts, labels


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, percent: int = 90, block: int = 64,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    score is the largest containment of a template in a block (1.0 where a base phrase stands, 0.0 where nothing is found);
    matches lists (block start, template number, containment).
    """
    order = word_order(docs, templates, block, text_col)
    split = [(words_of(p.encode()), label) for p, label in phrases.items()]
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
              " score double, matches array<struct<start:long,template:int,containment:double>>")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, order, percent)
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(t.as_py())
                starts, base = find_phrases(words, split)
                matches = []
                if not index.prefix.keys().isdisjoint(words):
                    for at, part in blocks_of(words, block):
                        matches += [{"start": at, "template": k, "containment": c} for k, c in sorted(index.match(part).items())]
                labels = base | {index.templates[m["template"]][0] for m in matches}
                score = 1.0 if starts else max((m["containment"] for m in matches), default=0.0)
                out.append({"doc_id": i, "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None),
                            "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)),
                            "labels": ",".join(sorted(labels)), "score": score, "matches": matches})
            yield pa.RecordBatch.from_pylist(out, ARROW)

    ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                       ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                       ("matches", pa.list_(pa.struct([("start", pa.int64()), ("template", pa.int32()), ("containment", pa.float64())])))])
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_arrow(slim, work, schema)
