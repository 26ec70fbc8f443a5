"""The pipeline's stages on driver rows with odd ones among them."""

from pyspark.sql import functions as F

import corpus_pipeline as C
from peakview.llm import ngram_join

from ..conftest import SF0001


def test_stages(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    more = [(90001, None, "en", "src0", 0), (90002, "", None, None, 0), (90003, "12 34 !!", "en", "src1", 8)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    first = docs.orderBy("doc_id").limit(1)
    docs = docs.unionByName(first)  # a repeated row
    known = C.known_language(spark, docs, SF0001)
    assert known.columns == docs.columns and known.filter("doc_id > 90000").count() == 0
    assert known.count() >= 0.97 * (docs.count() - 3)
    one = C.one_of_each_group(spark, known, SF0001).cache()
    groups = ngram_join.near_duplicates(known, 5, 80)
    assert one.count() == groups.select("component_id").distinct().count()
    assert {r.doc_id for r in one.collect()} == {r.component_id for r in groups.collect()}
    clean = C.without_personal_data(spark, one, SF0001).cache()
    assert clean.count() == one.count() and clean.filter("text like '%@mail%.example.com%'").count() == 0
    assert clean.filter(F.length("text") != F.col("n_chars")).count() == 0
    mixed = C.mixed_sources(spark, clean, SF0001)
    assert sorted(mixed.collect()) == sorted(clean.collect())
    assert C.encoded(spark, mixed, SF0001).count() == clean.count()
    empty = docs.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, SF0001).count() == 0


def test_clashing_columns_travel(spark):
    names = ["_key", "_pred", "_more", "_position", "_score", "_id", "_source", "_d", "_k", "key", "mix_key", "position", "row_key", "further_column_0",
             "n_tokens", "root", "a.b"]
    words = " ".join(f"word{i} and the house is" for i in range(30))
    docs = spark.createDataFrame([(i, f"{words} {i}" if i < 3 else f"the end of story number {i} is here in the {i * i} town", "en", f"s{i % 2}", 0)
                                  for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")))
    rows = docs
    for name, stage in C.STAGES[:-1]:
        rows = stage(spark, rows, SF0001)
        assert rows.columns == docs.columns, name
        rows = spark.createDataFrame(rows.collect(), rows.schema)
    assert rows.count() == 10  # three near copies, of which one stays
    for r in rows.collect():
        assert all(r[name] == f"{i}-{r.doc_id}" for i, name in enumerate(names))
    assert C.encoded(spark, rows, SF0001).columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_rows_without_an_id_are_mixed(spark):
    rows = [(None, f"text {s} {i}", "en", s, 6) for s in "ab" for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    order = [r.source for r in C.mixed_sources(spark, docs, SF0001).collect()]  # files and rows follow the schedule
    # blocks of 64 take turns: after any number of rows neither source is a block ahead of its share
    assert all(abs(order[:n].count("a") - n / 2) <= C.MIX_BLOCK for n in range(600))
    assert order[:64] == order[:1] * 64 and order[64] != order[0]
