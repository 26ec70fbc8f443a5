"""Personal data: fixed detectors as seeds, and contextual patterns learnt from them.

Emails, IPv4 addresses, card numbers and phone numbers found by fixed rules
are the seeds. What they leave of the runs of tokens with a digit or an @ holds the
candidates: every token and every sub-run that may be an identifier (see `pieces`).
All of them stand in lexical patterns: the two words before, and the word
before with the word after. The graph of patterns and instances is aggregated
over the whole corpus and scored in rounds: a pattern's confidence in a kind
is the score-weighted share of its occurrences that are known instances of it,
an instance's score follows from its patterns' confidence. Patterns of enough
confidence and enough different instances then mark the unseen candidates they surround, if
these look like the kind at all (see `plausible`); of found ones that overlap the
surest goes first, then the first and longest. What a fixed rule has
rejected (a failing check digit, a part over 255) is never brought back; a whole phone
number that is one token of several in a rejected match is a candidate of its own.

Null text is empty text. Rows are known by (doc_id, hash of id and text), so a
repeated row gets the same spans; null ids are kept. Nothing found gives
zero counts, the hash of the empty string and an empty span list.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

KINDS = ["email", "ip", "card", "phone"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_HINT = re.compile(r"[0-9@]\S*")
_PLACE = 720_720  # one occurrence of a pattern, in whole numbers that most counts divide
_EDGE = "\"'`()[]{}<>,;:!?*#%&$|.=~_"


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @: the local part is what stands before it, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind number, end) of the seeds, sorted, and the matches that a rule dropped."""
    spans, dropped = [], []
    if "@" in text:
        spans += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
            spans.append((m.start(), 1, m.end())) if ok else dropped.append(m.span())
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = _digits(m.group())
                if 14 <= len(d) <= 19:
                    spans.append((m.start(), 2, m.end())) if luhn(d) else dropped.append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                ok = 10 <= len(_digits(m.group())) <= 15
                spans.append((m.start(), 3, m.end())) if ok else dropped.append(m.span())
    return sorted(spans), dropped


def _context_word(s: str) -> str:
    return re.sub(r"[0-9]+", "0", s.strip(_EDGE).lower())[:40]


def _runs(text: str) -> list[tuple[int, int]]:
    """Runs of tokens with a digit or @ that are one space apart."""
    done = 0
    runs: list[list[int]] = []
    for m in _HINT.finditer(text):
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        if runs and start == runs[-1][1] + 1 and text[runs[-1][1]] == " ":
            runs[-1][1] = m.end()
        else:
            runs.append([start, m.end()])
        done = m.end()
    return [(a, b) for a, b in runs]


def _trim(text: str, a: int, b: int, edge: str = _EDGE) -> tuple[int, int]:
    while a < b and text[a] in edge and text[a] != "(":
        a += 1
    while b > a and text[b - 1] in edge:
        b -= 1
    return a, b


def _patterns(text: str, a: int, b: int) -> list[str]:
    """Pattern of the two words before, and of the words around."""
    after = text[b:b + 80].split()[:2]
    after = [w for w in map(_context_word, after) if w][:1]
    before = [_context_word(w) for w in text[max(0, a - 120):a].split()[-2:]]
    return [f"L {' '.join(before)}", f"A {before[-1] if before else ''} _ {after[0] if after else ''}"]


def pieces(text: str, run: tuple[int, int], taken: list[tuple[int, int]], dropped: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """(start, end, kinds) of what may be an identifier in a run, outside of `taken` (seeds and dropped matches in it).

    A phone number has at most 13 digits and every token one at least, so longer sub-runs than 13 tokens are none.
    """
    out = []
    free, at = [], run[0]
    for s, e in sorted(taken):
        free.append((at, max(at, s)))
        at = max(at, e)
    free.append((at, run[1]))
    for x, y in free:
        # what a seed leaves of a token has the joining signs at its ends too
        edge = _EDGE + "/-+" if (x, y) != run else _EDGE
        tokens = [(x + m.start(), x + m.end()) for m in re.finditer(r"\S+", text[x:y])]
        single = [3 in plausible(text[p:q]) and len(_digits(text[p:q])) >= 10 for p, q in (_trim(text, *t, edge) for t in tokens)]
        for i in range(len(tokens)):
            whole = False  # a shorter one from here is a whole phone number
            for j in range(i, min(i + 13, len(tokens))):
                p, q = _trim(text, tokens[i][0], tokens[j][1], edge)
                if j > i and len(_digits(text[p:q])) > 13:
                    break
                may = plausible(text[p:q])
                if j > i:  # an email or an IP address has no space; a whole phone number doesn't go on
                    may = [k for k in may if k == 2 or k == 3 and not whole and not any(single[i:j + 1])]
                if may:
                    out.append((p, q, may))
                whole = whole or 3 in may and len(_digits(text[p:q])) >= 10
    for s, e in dropped:
        for m in re.finditer(r"\S+", text[s:e]):
            p, q = _trim(text, s + m.start(), s + m.end())
            if q - p < e - s and len(_digits(text[p:q])) in (10, 11) and 3 in plausible(text[p:q]):
                out.append((p, q, [3]))
    return out


def candidates(text: str, seeds: list[tuple[int, int, int]], dropped: list[tuple[int, int]]) -> Iterator[tuple[int, int, int | None, list[int], dict[str, int]]]:
    """(start, end, seed's kind, kinds it may be, pattern -> share): seeds, candidates, and runs that hold neither.

    One that is not alone in its run stands in its own patterns and in those of the run, so that it is found beside
    others. A run is one occurrence of its patterns, of which all that it holds have equal shares.
    """
    spans = sorted([(s, e, k) for s, k, e in seeds] + [(s, e, None) for s, e in dropped], key=lambda x: x[:2])
    first = 0
    for a, b in _runs(text):
        while first < len(spans) and spans[first][1] <= a:
            first += 1
        here, at = [], first
        while at < len(spans) and spans[at][0] < b:
            if spans[at][1] > a:
                here.append(spans[at])
            at += 1
        run = _trim(text, a, b)
        if run[0] == run[1]:
            continue
        outer = _patterns(text, *run)
        found: list[tuple[int, int, int | None, list[int]]] = [(s, e, k, []) for s, e, k in here if k is not None]
        found += [(p, q, None, may) for p, q, may in pieces(text, (a, b), [x[:2] for x in here], [x[:2] for x in here if x[2] is None])]
        if not found:
            found = [(*run, None, [])]
        for p, q, kind, may in found:
            own = outer if (p, q) == run else _patterns(text, p, q)
            yield p, q, kind, may, dict.fromkeys(own, _PLACE) | dict.fromkeys(outer, max(1, _PLACE // len(found)))


def plausible(value: str) -> list[int]:
    """Kinds that an unseen candidate may be: the loosest form of each, without what the fixed rules cover."""
    d = _digits(value)
    out = []
    if value.count("@") == 1 and 0 < value.index("@") < len(value) - 1:
        out.append(0)
    if re.fullmatch(r"(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{0,4}", value):
        out.append(1)
    if re.fullmatch(r"[0-9]{4,6}(?:[ -][0-9]{2,6}){2,3}", value) and 12 <= len(d) <= 13:
        out.append(2)
    if re.fullmatch(r"[(0-9][0-9().\x20/-]+[0-9]", value) and 7 <= len(d) <= 13 and re.search(r"[().\x20/-]", value) and value.count(".") != 3:
        out.append(3)
    return out


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, key, seeds array of (start, kind, end), and the candidates with their patterns."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    pattern = pa.struct([("pattern", pa.string()), ("share", pa.int64())])
    found = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("kind", pa.int32()),
                       ("may", pa.list_(pa.int32())), ("patterns", pa.list_(pattern))])
    out_schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("seeds", pa.list_(span)), ("found", pa.list_(found))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, key, t in zip(*(c.to_pylist() for c in b.columns)):
                text = t or ""
                seeds, dropped = base_spans(text)
                met = []
                for a, e, kind, may, patterns in candidates(text, seeds, dropped) if seeds or _HINT.search(text) else ():
                    # what can't be one only counts as an occurrence: the value's beginning tells it apart
                    value = text[a:e].lower() if may or kind is not None else text[a:min(e, a + 200)].lower()
                    met.append({"start": a, "end": e, "value": value, "kind": kind, "may": may,
                                "patterns": [{"pattern": p, "share": n} for p, n in patterns.items()]})
                rows.append({"doc_id": i, "key": key, "seeds": [dict(zip(("start", "kind", "end"), s)) for s in seeds], "found": met})
            yield pa.RecordBatch.from_pylist(rows, out_schema)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(slim, work, "doc_id long, key long, seeds array<struct<start:int,kind:int,end:int>>,"
                     " found array<struct<start:int,end:int,value:string,kind:int,may:array<int>,patterns:array<struct<pattern:string,share:long>>>>")


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def _score_patterns(edges: DataFrame, known: DataFrame, min_support: int, min_confidence: float) -> DataFrame:
    """(pattern, kind, conf): share of a pattern's occurrences that are known instances of the kind.

    The left join on (value) may be hot for a copied identifier; edges hold one row per (pattern, value).
    """
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    hits = (edges.join(known.withColumnRenamed("value", "kvalue"), F.col("value") == F.col("kvalue"))
            .groupBy("pattern", F.col("kkind").alias("kind")).agg(F.sum(F.col("n") * F.col("score")).alias("hit"), F.count(F.lit(1)).alias("support")))
    return (hits.filter(F.col("support") >= min_support).join(totals, "pattern")
            .withColumn("conf", F.col("hit") / F.col("total")).filter(F.col("conf") >= min_confidence).select("pattern", "kind", "conf"))


def bootstrap(met: DataFrame, rounds: int = 2, min_support: int = 3, min_confidence: float = 0.7, min_score: float = 0.7) -> DataFrame:
    """(doc_id, key, start, kind, end) of unseen identifiers; `met` as from mentions()."""
    each = met.select("doc_id", "key", F.explode("found").alias("f")).select("doc_id", "key", "f.*")
    edges = (each.select("value", "kind", "may", F.explode("patterns").alias("p")).select("value", "kind", "may", "p.*")
             .groupBy("pattern", "value").agg(F.sum("share").alias("n"), F.max("kind").alias("kind"), F.max("may").alias("may")))
    edges, told = cut(edges, "pii-graph", open=F.sum((F.size("may") > 0).cast("long")))
    if not told["open"]:  # no candidate that any kind could claim
        return each.select("doc_id", "key", "start", "kind", "end").filter(F.lit(False))
    seeds = edges.filter("kind is not null").groupBy("value").agg(F.max("kind").alias("kkind")).withColumn("score", F.lit(1.0))
    unseen = edges.filter("kind is null").select("pattern", "value", F.explode("may").alias("mkind"))
    known = seeds
    for _ in range(rounds):
        good = cut(_score_patterns(edges, known, min_support, min_confidence), "pii-patterns")
        fresh = (unseen.join(good.withColumnRenamed("pattern", "p"), F.expr("pattern = p and mkind = kind"))
                 .groupBy("value", F.col("kind").alias("kkind"))
                 .agg((1 - F.exp(F.sum(F.log(1 - F.col("conf") * 0.95)))).alias("score")).filter(F.col("score") >= min_score))
        known = cut(seeds.unionByName(fresh), "pii-known")
    spots = each.filter("kind is null").select("doc_id", "key", "start", "end", F.explode("may").alias("mkind"), "patterns")
    spots = spots.select("doc_id", "key", "start", "end", "mkind", F.explode("patterns.pattern").alias("pattern"))
    hits = spots.join(good.withColumnRenamed("pattern", "p"), F.expr("pattern = p and mkind = kind"))
    found = hits.groupBy("doc_id", "key", "start", "end").agg(F.max(F.struct("conf", "kind")).alias("best"))
    spans = found.groupBy("doc_id", "key").agg(F.collect_list(F.struct(F.round("best.conf", 6).alias("conf"), "start", "end", F.col("best.kind").alias("kind"))).alias("spans"))
    return cut(map_arrow(spans, _clear, "doc_id long, key long, start int, kind int, end int"), "pii-found")


def _clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of spans that overlap in one row the surest goes first, then the first and longest."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    for b in batches:
        rows = []
        for i, key, spans in zip(*(c.to_pylist() for c in b.columns)):
            starts: list[int] = []
            ends: list[int] = []
            for s in sorted(spans, key=lambda s: (-s["conf"], s["start"], -s["end"])):
                at = bisect_left(starts, s["end"])  # kept spans before `at` begin before this one ends
                if not at or ends[at - 1] <= s["start"]:
                    starts.insert(at, s["start"])
                    ends.insert(at, s["end"])
                    rows.append({"doc_id": i, "key": key, "start": s["start"], "kind": s["kind"], "end": s["end"]})
        yield pa.RecordBatch.from_pylist(rows, schema)


def _list(spans):
    """kind:start:end by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(spans)
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, key, n_email, n_ip, n_card, n_phone, base_sha256, spans, span_list (array of start, kind, end)."""
    met = cut(mentions(docs, id_col, text_col), "pii-mentions")
    more = bootstrap(met)
    by_row = more.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
    rows = met.select("doc_id", "key", "seeds").join(by_row, F.expr("d <=> doc_id and k = key"), "left")
    every = F.concat("seeds", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    count = lambda k: F.size(F.filter("seeds", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", "key", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                       F.sha2(_list(F.col("seeds")).cast("binary"), 256).alias("base_sha256"),
                       _list(every).alias("spans"), F.array_sort(every).alias("span_list"))


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every span replaced by its kind in capitals and angle brackets; other columns as they are.

    The seeds are found again where the text is; only rows with learnt spans need the join.
    """
    more = bootstrap(cut(mentions(docs, id_col, text_col), "pii-mentions"))
    by_row = cut(more.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k"))
                 .agg(F.collect_set(F.struct("start", "kind", "end")).alias("_more")), "pii-by-row")
    rows = docs.withColumn("_key", row_key(id_col, text_col))
    rows = rows.join(by_row, (F.col(id_col).cast("long").eqNullSafe(F.col("_d"))) & (F.col("_key") == F.col("_k")), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts = []
            for t, learnt in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if t:
                    spans = base_spans(t)[0] + [(s["start"], s["kind"], s["end"]) for s in learnt or ()]
                    out, done = [], 0
                    for a, k, e in sorted(spans):
                        if e > done:
                            if a >= done:
                                out += [t[done:a], f"<{KINDS[k].upper()}>"]
                            done = e  # overlapping spans: what sticks out goes too
                    t = "".join([*out, t[done:]])
                texts.append(t)
            cols = b.columns[:-1]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])

    return map_arrow(rows.select(*docs.columns, "_more"), work, docs.schema)
