"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, fill_middle, langid, license_scan, mixing, ngram_join, pii, quality_classifier, quality_ledger, spelling_variants, url_rules, vector_graph
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@register("op1_url_rules")
def op1(spark, sf):
    return url_rules.judge(read_table(spark, sf, "pages"), read_table(spark, sf, "labels"))


@register("op2_license_scan")
def op2(spark, sf):
    return license_scan.scan(read_table(spark, sf, "documents"))


@register("op3_pii")
def op3(spark, sf):
    return pii.find(read_table(spark, sf, "documents")).drop("key", "span_list")


@register("op4_chat_format")
def op4(spark, sf):
    return chat_format.rotate(read_table(spark, sf, "conversations"))


@register("op5_quality_rules")
def op5(spark, sf):
    return quality_ledger.judged(read_table(spark, sf, "documents"))


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file is on this machine; it is installed on every worker."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op6_bpe")
def op6(spark, sf):
    return bpe.digests(read_table(spark, sf, "documents"), public_vocabulary())


@register("op7_language_id")
def op7(spark, sf):
    return langid.held_out_predictions(read_table(spark, sf, "documents"))


@register("op8_mixing")
def op8(spark, sf):
    return mixing.schedule(read_table(spark, sf, "documents"))


@register("op9_ngram_join")
def op9(spark, sf):
    return ngram_join.near_duplicates(read_table(spark, sf, "documents"), k=4, percent=85).drop("cls")


@register("op10_vector_graph")
def op10(spark, sf):
    return vector_graph.near_duplicates(read_table(spark, sf, "embeddings"))


FILL_MIDDLE_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
drawn AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM cut),
parts AS (
  SELECT *, array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
         array_to_string(units[1 + least(h1 % (n + 1), h2 % (n + 1)):greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
         array_to_string(units[1 + greatest(h1 % (n + 1), h2 % (n + 1)):], '') AS suffix,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN concat('<S>', suffix, '<P>', prefix, '<M>', middle)
              ELSE concat('<P>', prefix, '<S>', suffix, '<M>', middle) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@register("op11_fill_middle", FILL_MIDDLE_SQL)
def op11(spark, sf):
    return fill_middle.digests(read_table(spark, sf, "documents"))


#: crc32 is the usual reflected one, from its polynomial; the runs' letters are below U+0100, so one or two bytes each
SPELLING_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([b::BIGINT] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tab
  FROM range(256) t(b)),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents),
seen AS (SELECT id, run, count(*) AS times FROM runs WHERE length(run) >= 5 GROUP BY id, run),
coded AS (
  SELECT run, times, flatten(list_transform(string_split(id || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT]
           ELSE [(192 + (unicode(ch) >> 6))::BIGINT, (128 + unicode(ch) % 64)::BIGINT] END)) AS bytes
  FROM seen),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce([4294967295::BIGINT] || bytes,
           lambda c, b: xor(c >> 8, tab[xor(c % 256, b) + 1]))) AS h
  FROM coded, bits),
words AS (
  SELECT word, sum(times)::BIGINT AS n
  FROM (SELECT times, CASE WHEN h % 97 = 0 THEN run[1:(h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2:] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
gaps AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS shorter, word[1:i - 1] || '*' || word[i + 1:] AS masked
         FROM words, lateral unnest(range(1, length(word) + 1)) g(i)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.masked = b.masked AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.shorter = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.shorter = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
told AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 2 * w.n THEN b.top END AS form_n,
         CASE WHEN b.top >= 2 * w.n THEN (SELECT min(p.near) FROM pairs p WHERE p.word = w.word AND p.near_n = b.top) END AS form
  FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (
  SELECT word, word AS at FROM told
  UNION SELECT walk.word, told.form FROM walk JOIN told ON told.word = walk.at WHERE told.form IS NOT NULL)
SELECT t.word, t.form, w.at AS root, t.n, t.n_near, t.form_n
FROM told t JOIN walk w ON w.word = t.word JOIN told e ON e.word = w.at WHERE e.form IS NULL
"""


@register("op12_spelling_variants", SPELLING_SQL)
def op12(spark, sf):
    return spelling_variants.variants(read_table(spark, sf, "documents"))


@register("op13_quality_classifier")
def op13(spark, sf):
    return quality_classifier.held_out_scores(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))
