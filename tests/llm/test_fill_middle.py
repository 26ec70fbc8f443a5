"""The fill-in-middle operator against a plain loop over tokens."""

import hashlib
import re

from peakview.llm import fill_middle

from ..conftest import SF0001
from .test_operators import odd

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    units = TOKEN.findall(text)
    n = len(units)
    low, high = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    out = f"<S>{c}<P>{a}<M>{b}" if h4 % 100 < spm else f"<P>{a}<S>{c}<M>{b}"
    return (doc_id, n, "spm" if h4 % 100 < spm else "psm", len(a), len(b), out)


def check(df, **options):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    made = fill_middle.transform(df, **options)
    got = [tuple(r) for r in made.collect()]
    seed, rate, spm = (options.get(k, v) for k, v in (("seed", 42), ("fim_percent", 50), ("spm_percent", 80)))
    want = [plainly(i, t, seed, rate, spm) for i, t in rows]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    back = made.select("doc_id", fill_middle.restored().alias("text")).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in rows)
    return got


def test_documents(spark):
    got = check(spark.read.parquet(f"{SF0001}/documents.parquet"))
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    assert len(check(odd(spark), fim_percent=100)) == odd(spark).count()
    assert check(odd(spark).limit(0)) == []


def test_marks_and_white_space(spark):
    texts = ["a <P> b", "a<", "< P>", "<S", "x <", "S> y", " ", "\n\n", " lead", "trail  ", "a b c d", "\x0b\x0c\r\t", "é ü 漢字 😀 z", "a\x00b c",
             "M> <", "<<S <", "w " * 200_000, "y" * 300_000, " " * 300_000]
    df = spark.createDataFrame([(i * 10 + k, t) for i, t in enumerate(texts) for k in range(4)] + [(0, texts[0])], "doc_id long, text string")
    for options in ({"fim_percent": 100}, {"fim_percent": 100, "spm_percent": 0}, {"fim_percent": 0}, {"seed": 7}):
        check(df, **options)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 5, "x", "y", "k")], "doc_id long, text string, n long, output string, form string, key string")
    made = fill_middle.transform(df, keep=("key", "n", "output", "text"))
    assert made.columns == ["doc_id", "key", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert made.first().key == "k" and made.first().text == "a b c" and made.first().n == 3


def test_digests(spark):
    df = spark.createDataFrame([(i, f"tok{i} b  c\nd e") for i in range(20)] + [(99, None)], "doc_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in fill_middle.digests(df).collect():
        text = None if r.doc_id == 99 else f"tok{r.doc_id} b  c\nd e"
        assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == \
            (*plainly(r.doc_id, text)[:5], sha(plainly(r.doc_id, text)[5]), sha(text or ""))
