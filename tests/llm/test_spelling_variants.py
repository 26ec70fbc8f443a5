"""Spelling variants against all pairs and plain loops."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from peakview.llm import queries
from peakview.llm import spelling_variants as V

from .test_operators import odd

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plainly(rows, one_in=97):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += len(run) >= 5
    n = {w: c for w, c in n.items() if c >= 3}
    out = {}
    for w in n:
        around = [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(around, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = [form, w, n[w], len(around), n[best] if form else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(v) for w, v in out.items()}


def told(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def texts(seed, n, letters="abeÀéÿ×z"):
    rng = random.Random(seed)
    base = ["".join(rng.choices(letters, k=rng.randint(4, 9))) for _ in range(40)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(30):
            w = rng.choice(base[:rng.randint(1, 40)])
            at = rng.randrange(len(w))
            w = rng.choice([w, w, w.upper(), w[:at] + w[at + 1:], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1:]])
            words.append(w)
        rows.append((i, rng.choice([" ", "-", "1", "\n"]).join(words)))
    return rows


def test_against_all_pairs(spark):
    rows = texts(1, 120) + [(5, None), (6, ""), (None, "abbbbe abbbbe abbbbe"), (7, "short " * 5), (300, "abzdef " * 40 + "abzdee " * 15 + "abbdee " * 5)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for one_in in (97, 2):
        want = plainly(rows, one_in)
        assert len(want) > 100 and any(v[1] not in (w, v[0]) for w, v in want.items() if v[0])
        for options in ({}, {"tile": 3}, {"groups": 4, "tile": 8}, {"groups": 2}):
            assert told(V.variants(df, one_in=one_in, **options)) == want


def test_odd_rows(spark):
    assert told(V.variants(odd(spark))) == {}
    assert V.variants(odd(spark).limit(0)).count() == 0
    assert told(V.variants(odd(spark), min_chars=4)) == {"word": (None, "word", 30_000, 0, None)}


def test_ties_take_the_smallest_and_clashes_do_not_matter(spark):
    rows = [(1, "planet " * 3 + "planer " * 6 + "planes " * 6 + "éclair " * 3 + "eclair " * 9, 1, "x")]
    got = told(V.variants(spark.createDataFrame(rows, "doc_id long, text string, n long, word string"), one_in=10 ** 9))
    assert got["planet"] == ("planer", "planer", 3, 2, 6) and got["planer"][0] is None
    assert got["éclair"] == ("eclair", "eclair", 3, 1, 9)


def test_very_long_words(spark):
    long = "ab" * 100_000
    rows = [(i, t) for i, t in enumerate([long] * 6 + [long + "x"] * 3 + [long[:777] + "z" + long[778:]] * 3 + ["hello"] * 3 + ["hallo"] * 9)]
    got = told(V.variants(spark.createDataFrame(rows, "doc_id long, text string"), one_in=10 ** 9))
    assert got[long][3] == 2 and got[long + "x"][0] == long and got[long[:777] + "z" + long[778:]][1] == long and got["hello"][0] == "hallo"


def test_every_near_pair_has_one_first_block():
    for groups in (2, 3, 4, 5, 6):
        pairs, cover = V.left_out(groups)
        same, adjacent = V.first_block(groups)
        for a in range(groups):
            assert adjacent[1 << a] in cover and a in pairs[adjacent[1 << a]]
            for b in range(groups):
                assert {a, b} <= set(pairs[same[1 << a | 1 << b]])


def test_one_edit():
    rng = random.Random(4)
    for _ in range(2000):
        a = "".join(rng.choices("ab", k=rng.randint(1, 6)))
        b = "".join(rng.choices("ab", k=len(a) + rng.randint(0, 1)))
        rows = [np.frombuffer(w.encode().ljust(8, b"\0"), np.uint8)[None] for w in (a, b)]
        assert bool(V.Gram.one_edit(*rows, np.array([len(b) > len(a)]))[0]) == near(a, b)


def test_sql_on_a_fixture(spark):
    rows = texts(9, 60)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = {w: (form, root, n, n_near, form_n) for w, form, root, n, n_near, form_n in con.execute(queries.SPELLING_SQL).fetchall()}
    assert got == plainly(rows)
