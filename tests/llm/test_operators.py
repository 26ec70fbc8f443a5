"""The ten operators against brute force, on driver tables and on odd rows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from peakview.llm import bpe, chat_format, langid, license_scan, mixing, ngram_join, pii, quality_ledger, queries, url_rules, vector_graph

from ..conftest import SF0001

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string"


def texts_of(spark):
    return spark.read.parquet(f"{SF0001}/documents.parquet")


ODD = [(1, None, "en", "a", None, "x"), (2, "", None, None, 0, None), (3, " \n\t ", "en", "a", 3, "k"), (3, " \n\t ", "en", "a", 3, "k"),
       (None, "one two", "en", "b", 7, "k"), (5, "one two", "en", "b", 7, "k"), (6, "word " * 30_000, "en", "a", 1, "k"),
       (7, "12345 !!! ###", "en", "a", 1, "k")]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def roots(pairs, ids):
    par = {i: i for i in ids}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_ngram_join(spark):
    base = "the quick brown fox jumps over the lazy dog and then it runs far away from all of the other animals here".split()
    rng = random.Random(3)
    rows = []
    for i in range(60):  # near copies around the threshold, exact copies, short texts
        w = list(base) * 3
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(5)}"
        rows.append((i, " ".join(w)))
    rows += [(100, "A b c"), (101, "a B\tc"), (102, "a b"), (103, None), (104, ""), (104, "")]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j:j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(links, sets)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), want[i]) for i in sets}
    assert ngram_join.near_duplicates(odd(spark), 4, 85).count() == len(ODD)
    assert ngram_join.near_duplicates(odd(spark).limit(0), 4, 85).count() == 0


def test_vector_graph(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in centres[i % 20]]) for i in range(400)]
    rows += [(900, rows[0][1]), (901, None), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [1.0, None]), (905, [1.0, 2.0]), (906, [1e200] * 8)]
    got = {r.vec_id: r for r in vector_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), per_shard=64).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    fine = {i: [x / max(map(abs, v)) for x in v] for i, v in rows if i < 901 or i in (905, 906)}
    links = [(a, b) for a in fine for b in fine if a < b and len(fine[a]) == len(fine[b]) and cos(fine[a], fine[b]) >= 0.9]
    found = sum(r.n_links for r in got.values()) / 2
    assert found <= len(links) and found >= 0.9 * len(links)
    want = roots(links, [i for i, _ in rows])
    assert sum(got[i].component_id == want[i] for i in got) >= 0.95 * len(got)
    assert all(got[i].n_links == 0 and got[i].kept for i in (901, 902, 903, 904))
    assert vector_graph.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_bpe(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.public_vocabulary()
    lib = tokenizers.Tokenizer.from_file(path)
    lib.no_truncation(), lib.no_padding()
    rng = random.Random(1)
    texts = ["", "<|endoftext|>a <|startoftext|>", "İstanbul ΣΑΣ é", "don't I'LL", "a" * 300]
    texts += ["".join(rng.choice("abcdefgh ilnostru'é<|>ÀİıſΣ́ 　１²!?\n\t\x85") for _ in range(40)) for _ in range(400)]
    codec = bpe.Codec(path)
    assert [codec.encode(t) for t in texts] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    docs = texts_of(spark).unionByName(odd(spark).drop("key"))
    for r in bpe.digests(docs, path).join(docs, "doc_id").filter("doc_id > 7").limit(150).collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd(spark), path), path).filter("doc_id = 5").first()
    assert back.decoded == lib.decode(lib.encode("one two").ids, skip_special_tokens=False)


def test_language_id(spark):
    docs = texts_of(spark)
    told = langid.held_out_predictions(docs).join(docs, "doc_id")
    held = told.filter("held_out")
    assert held.filter("lang_pred = lang").count() >= 0.95 * held.count()
    model = langid.train(docs)
    got = langid.predict(odd(spark), model).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if not r.text or not re.search("[a-z]", r.text)} == {"und"}
    none = langid.predict(odd(spark), langid.train(docs.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_license_scan(spark):
    rows = [(1, "Mit License. The MIT  license!"), (2, "nothing"), (3, None), (4, "word " * 500 + "Licensed under CC BY-NC 4.0."),
            (5, "GNU General Public-License, apache license"), (6, "mit. licenses")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (5, 2, 0, 3, "mit")
    assert (got[5].n_base, got[5].base_labels, got[5].score) == (2, "apache,gpl", 1.0)
    assert got[4].labels == "cc-by-nc" and got[4].score >= 0.9 and got[4].n_base == 0
    assert (got[3].n_words, got[3].first_word, got[3].labels, got[6].n_base) == (0, None, "", 0)
    # every block that meets a template's threshold is found
    index = license_scan.Index(license_scan.TEMPLATES, license_scan.word_order(texts_of(spark)), 90)
    for text in (t for _, t in license_scan.TEMPLATES):
        block = license_scan.words_of(text.encode())
        want = {i for i, (_, words, need) in enumerate(index.templates) if len(words & set(block)) >= need}
        assert set(index.match(block)) == want


def test_pii(spark):
    rows = [(i, f"please call me at +1 (523) 555-{1000 + i} today or tomorrow") for i in range(8)]
    rows += [(20, "please call me at 523-555-1099 today or tomorrow"), (21, None), (22, "a.b@c.example.com x 300.1.1.1 1.2.3.4 y 4111 1111 1111 1111 @@"),
             (23, "9" * 3000 + " " + "a" * 3000), (24, "version 2.0. and 1234567890123456")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert got[20].spans.startswith("phone:18:30") and got[20].n_phone == 0
    assert (got[22].n_email, got[22].n_ip, got[22].n_card) == (1, 1, 1)
    assert got[24].spans == "" and got[21].spans == "" and got[23].n_card == 0
    assert got[21].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert masked[20] == "please call me at <PHONE> today or tomorrow" and masked[21] is None and masked[24] == rows[-1][1]
    # the linear email search equals the plain expression
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("ab.@-_ +") for _ in range(25))
        assert list(pii._emails(t)) == [m.span() for m in plain.finditer(t)]


def test_url_rules(spark):
    pages = [(1, "https://WWW.Example.com/en/a?x=1"), (2, "http://a.net/es/1"), (3, None), (4, "no scheme"), (5, "http://b.org"), (6, "http://x.example.com/en/")]
    pages += [(100 + i, f"http://bad-{i % 2}.org/spam/{i}") for i in range(20)] + [(200 + i, f"http://good.org/news/{i}") for i in range(20)]
    labels = [(100 + i, 0, 0) for i in range(10)] + [(200 + i, 1, 0) for i in range(10)]
    got = {r.page_id: r for r in url_rules.judge(spark.createDataFrame(pages, "page_id long, url string"),
                                                 spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict, got[6].rule, got[6].verdict) == ("net/es/", "block", "example.com/en/", "block")
    assert (got[3].host, got[3].path, got[4].host, got[4].verdict) == ("", "", "", "allow")
    assert got[115].verdict == "block" and got[215].verdict == "allow" and len(got) == len(pages)


def test_quality_ledger(spark):
    docs = texts_of(spark).unionByName(odd(spark).drop("key"))
    rows = {(r.doc_id, r.text): r for r in docs.collect()}
    got = {r.doc_id: r for r in quality_ledger.judged(docs).collect()}
    for (i, text), _ in rows.items():
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[j:j + 8]) for j in range(len(w) - 7)]
        n, covered = Counter(windows), set()
        for j, x in enumerate(windows):
            covered.update(range(j, j + 8) if n[x] > 1 else ())
        if list(r for r, _ in rows).count(i) == 1 and i is not None:
            assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
            assert got[i].base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    book = quality_ledger.ledger(docs)
    cost = {(r.policy, r.rule): r for r in quality_ledger.ablations(book).collect()}
    assert cost["v1-base", "too_few_words"].failed == book.filter("n_words < 20").count()
    assert cost["v1-base", "too_few_words"].dropped == book.filter(~quality_ledger.kept(quality_ledger.POLICIES["v1-base"])).count()


def test_chat_format(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello"), (1, 2, "bob", "hello"), (1, 200, None, None),
            (2, None, "ann", "x"), (None, 1, "ann", "y")]
    got = chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 5 * 3 + 1 + 1
    for conv, who in ((1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann")):
        mine = sorted((r for r in got if r.conv_id == conv and r.perspective == who), key=lambda r: r.seq)
        whole = "".join(r.segment for r in mine)
        assert [r.seq for r in mine] == list(range(len(mine)))
        for r in mine:
            assert whole[r.seg_start:r.seg_end] == r.segment and (r.loss_start is not None) == (r.role == "assistant")
            if r.role == "assistant":
                assert r.speaker == who and whole[r.loss_start:r.loss_end].endswith("<|end|>")


def test_mixing(spark):
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    rows = [(i, "abc"[i % 3] if i % 10 else None) for i in range(3000)] + [(5, "a")]
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), {**weights, mixing.OTHER: 0.1}, block=8, period=11).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    assert all(r.release_slot <= r.slot < r.deadline_slot for r in got)
    share = mixing.shares(weights, 100)
    seen = Counter()
    for t, (s, *_) in enumerate(mixing.edf_period(share), 1):
        seen[s] += 1
        assert all(abs(seen[x] - t * share[x] / 100) < 1 for x in share)
    assert mixing.schedule(spark.createDataFrame([], "doc_id long, source string")).count() == 0


def test_registered(spark):
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]
