"""BPE encoding and decoding: speculate by greedy longest match, verify pairs, merge only what fails.

Each distinct word is proposed as greedy longest-match tokens. A proposal is
the merge result exactly when every token merges to itself and every two
neighbours, merged as one string, stay those two; so all adjacent pairs of a
batch of new words are looked up in a table of judged pairs, and
only pairs never met are judged by merging. A word with a failing token or
pair is merged exactly, by rank. Words are remembered with their ids, so a task does
this once per distinct word.

Texts are split as the vocabulary file says: its added tokens are cut out
first, the rest goes through its normalizer and its pre-tokenizer. For texts
in Latin script the same splitting is one regular expression; all others are
normalized and split by the tokenizers library's own two steps.

Null text encodes as the empty text; empty text has no token and decodes to
the empty text; no text is cut short; repeated rows give repeated rows; other
columns of the input are left alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# How the public vocabulary file splits words
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

#: tab, line ends, printable ASCII and Latin letters and signs that normalization leaves alone but for case
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7E\xA1-\xAC\xAE-įı-ɏ]*")


def _byte_symbols() -> list[str]:
    """The visible character for each byte of byte-level BPE: itself if printable, else the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            table[b] = chr(b)
        else:
            table[b] = chr(spare)
            spare += 1
    return table


class Codec:
    """Encoder and decoder of one vocabulary file, with its memory of words and pairs."""

    WORDS = 100_000  # words in a generation of the memory; the one before it is kept too

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.text = [""] * (1 + max([*self.ids.values(), *self.added.values()]))
        for s, i in [*self.ids.items(), *self.added.items()]:
            self.text[i] = s
        self.none = len(self.rank)
        self.longest: dict[str, int] = {}  # first two characters -> length of the longest token that starts so
        for s in self.ids:
            body = s.removesuffix(WORD_END)
            self.longest[body[:2]] = max(self.longest.get(body[:2], 1), len(body))
        self.symbols = _byte_symbols()
        self.split = regex.compile(WORD_PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words: dict[str, tuple[int, bytes, str]] = {}
        self.older: dict[str, tuple[int, bytes, str]] = {}
        self.stable: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.merged_words = 0
        self._slow = None
        self.path = path

    # -- one word ---------------------------------------------------------

    def merge(self, chars: list[str]) -> list[str]:
        """Exact BPE of a word given as symbols: the lowest-ranked, leftmost pair first."""
        return self._merge_long(chars) if len(chars) > 48 else self._merge_short(chars)

    def _merge_short(self, chars: list[str]) -> list[str]:
        parts, rank, none = list(chars), self.rank, self.none
        ranks = [rank.get(p, none) for p in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != none:
            i = ranks.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], parts[i]), none)
        return parts

    def _merge_long(self, chars: list[str]) -> list[str]:
        """The same with a heap, so that a word of any length takes n log n steps."""
        parts = list(chars)
        after = list(range(1, len(parts))) + [-1]
        before = list(range(-1, len(parts) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := self.rank.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (r := self.rank.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p]

    @staticmethod
    def _symbols_of(token: str) -> list[str]:
        body = token.removesuffix(WORD_END)
        chars = list(body)
        if body != token:
            chars[-1] += WORD_END
        return chars

    def _propose(self, word: str) -> list[int]:
        """Greedy longest match from the left; the last token carries the word end."""
        out, at, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while at < n:
            for end in range(min(n, at + longest.get(word[at:at + 2], 1)), at, -1):
                t = ids.get(word[at:end] + WORD_END if end == n else word[at:end])
                if t is not None:
                    out.append(t)
                    at = end
                    break
            else:
                raise ValueError(f"no token for {word[at]!r}")
        return out

    def _token_stable(self, t: int) -> bool:
        ok = self.stable.get(t)
        if ok is None:
            ok = self.stable[t] = len(self.merge(self._symbols_of(self.text[t]))) == 1
        return ok

    def _pair_stable(self, key: int) -> bool:
        ok = self.pairs.get(key)
        if ok is None:
            a, b = self.text[key >> 32], self.text[key & 0xFFFFFFFF]
            ok = self.pairs[key] = self.merge(self._symbols_of(a) + self._symbols_of(b)) == [a, b]
        return ok

    def learn(self, words: list[str]) -> None:
        """Encode words not met before: propose all, judge all adjacent pairs at once, merge what fails."""
        if self.older:
            again = [w for w in words if w in self.older]
            self.words.update((w, self.older[w]) for w in again)
            words = [w for w in words if w not in self.words]
        if len(self.pairs) > 2 * self.WORDS:
            self.pairs.clear()
        shown = ["".join(map(self.symbols.__getitem__, w.encode())) for w in words]
        proposed = [self._propose(w) for w in shown]
        lens = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(lens.sum()))
        owner = np.repeat(np.arange(len(proposed)), lens)
        tokens, at = np.unique(flat, return_inverse=True)
        fails = np.bincount(owner, ~np.fromiter(map(self._token_stable, tokens.tolist()), bool, len(tokens))[at], len(proposed))
        side = owner[1:] == owner[:-1]
        keys, at = np.unique(((flat[:-1] << 32) | flat[1:])[side], return_inverse=True)
        fails += np.bincount(owner[1:][side], ~np.fromiter(map(self._pair_stable, keys.tolist()), bool, len(keys))[at], len(proposed))
        for i, w in enumerate(words):
            ids = proposed[i]
            if fails[i]:
                self.merged_words += 1
                chars = list(shown[i])
                chars[-1] += WORD_END
                ids = [self.ids[p] for p in self.merge(chars)]
            self.words[w] = (len(ids), " ".join(map(str, ids)).encode(), " ".join(map(self.text.__getitem__, ids)))

    # -- texts ------------------------------------------------------------

    def split_words(self, text: str) -> list[str]:
        """Words of a text without added tokens."""
        if _PLAIN.fullmatch(text):
            return self.split.findall(text.lower())
        if self._slow is None:
            from tokenizers import Tokenizer
            self._slow = Tokenizer.from_file(self.path)
        t = self._slow
        shown = [w for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))]
        back = {s: b for b, s in enumerate(self.symbols)}
        return [bytes(back[c] for c in w).decode("utf-8", "surrogateescape") for w in shown]

    def pieces(self, texts: list[str]) -> list[list[tuple[int, bytes, str]]]:
        """For each text, per word or added token: its number of ids, its ids as decimal text, its decoded text."""
        if len(self.words) > self.WORDS:
            self.older, self.words = self.words, {}
        chunks = [self.cut.split(t) if self.cut and any(a in t for a in self.added) else [t] for t in texts]
        split = [[c if c in self.added else self.split_words(c) for c in cs] for cs in chunks]
        met = set().union(*(c for cs in split for c in cs if isinstance(c, list)))
        if new := sorted(met.difference(self.words)):
            self.learn(new)
        known, out = self.words, []
        for cs in split:
            if len(cs) == 1 and isinstance(cs[0], list):
                out.append(list(map(known.__getitem__, cs[0])))
            else:
                out.append([p for c in cs for p in ([(1, b"%d" % self.added[c], c)] if isinstance(c, str) else map(known.__getitem__, c))])
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for _, ids, _ in self.pieces([text or ""])[0] for x in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder step: the tokens' strings with one space between."""
        return " ".join(self.text[i] for i in ids)


_CODECS: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """This Python worker's codec: it outlives a task, and with it the words learnt."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, vocab_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """`docs` with `out_col` array<int>: the ids of each text, special tokens not added."""

    @F.pandas_udf("array<int>")
    def ids_of(texts):
        return texts.map(codec_of(vocab_path).encode)

    return docs.withColumn(out_col, ids_of(F.coalesce(text_col, F.lit(""))))


def decode(docs: DataFrame, vocab_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:

    @F.pandas_udf("string")
    def text_of(ids):
        return ids.map(codec_of(vocab_path).decode)

    return docs.withColumn(out_col, text_of(F.coalesce(ids_col, F.array().cast("array<int>"))))


def digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, `keep`, n_tokens, ids_sha256, decoded_sha256): encode, decode and hash in one pass over the texts.

    The ids and the decoded text of a document are joined from its words', which equals
    joining token by token since both put one space between tokens.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocab_path)
        for b in batches:
            n, ids, texts = [], [], []
            column = b.column(b.num_columns - 1)
            for at in range(0, len(column), 128):  # words of so many texts are held at once
                for p in codec.pieces([t or "" for t in column[at:at + 128].to_pylist()]):
                    n.append(sum(x[0] for x in p))
                    ids.append(hashlib.sha256(b" ".join([x[1] for x in p])).hexdigest())
                    texts.append(hashlib.sha256(" ".join([x[2] for x in p]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                                             [*b.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).cast("string").alias("_text"))
    schema = slim.drop("_text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return map_arrow(slim, work, schema)
