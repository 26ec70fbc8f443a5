"""Corpus pipeline over `documents`: five stages, each written as Parquet and reread by the next.

Every stage but the last returns the columns of `documents`. Rows with null
columns, blank texts and repeated rows pass by the rules in each stage's docstring; an
empty table gives an empty result; further columns are carried along, whatever their names.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakview.llm import bpe, langid, mixing, ngram_join, pii
from peakview.llm.common import cut
from peakview.llm.queries import public_vocabulary
from peakview.session import scratch_path

#: a document goes if its language can't be told at least so surely
LEAST_SCORE = 0.5
MIX_BLOCK = 64
#: the columns a stage reads; any others only travel
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def carrying(stage):
    """A stage that sees further columns under names of their own, so that none clashes with what it makes."""
    @wraps(stage)
    def renamed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        further = iter(range(len(docs.columns)))
        names = {c: c if c in COLUMNS else f"further_column_{next(further)}" for c in docs.columns}
        quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
        out = stage(spark, docs.select(*[quoted(c).alias(safe) for c, safe in names.items()]), sf_dir)
        given = {safe: c for c, safe in names.items()}
        return out.select(*[quoted(c).alias(given.get(c, c)) for c in out.columns])
    return renamed


@carrying
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID trained on the labelled documents: texts without a letter and those of no clear language go."""
    model = langid.train(docs)
    told = langid.predict(docs, model, lang_out="_pred", score_out="_score")
    return told.filter((F.col("_pred") != langid.UNKNOWN) & (F.col("_score") >= LEAST_SCORE)).select(*docs.columns)


@carrying
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates (five words, Jaccard 0.8): of each linked group one row stays.

    It is the row with the smallest doc_id, one without an id after all others; rows of one id with different texts
    are told apart by the hash of id and text. Of equal rows one stays. A text without a word links with nothing: its
    row stays, one for each doc_id, and all of those without an id.
    """
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    # a row is known by its id and the hash of id and text: equal rows have one key, and so one component
    keyed = docs.select("doc_id", "text", pii.row_key().alias("row_key"))
    told = ngram_join.near_duplicates(keyed, k=5, percent=80, key_col="row_key")
    rows = (told.filter("root is not null or doc_id is not null")
            .withColumn("alone", F.expr("case when root is null then doc_id end"))
            .groupBy("root", "alone", "doc_id", "key").agg(F.count(F.lit(1)).alias("n")))
    rows = cut(rows.withColumn("rank", F.struct(F.col("doc_id").isNull().alias("later"), "doc_id", "key")), "rows")
    # `^ 0`: both inputs of the join get an exchange of their own, so a large group may be split over tasks
    first = rows.groupBy("root", "alone").agg(F.min("rank").alias("first")).select(F.expr("root ^ 0").alias("r"), F.expr("alone ^ 0").alias("a"), "first")
    marks = rows.join(first, F.expr("root <=> r and alone <=> a")).select(
        "doc_id", "key", F.expr("key <> first.key or not doc_id <=> first.doc_id").alias("goes"), F.expr("n > 1").alias("again"))
    # few rows have a mark; the texts are shuffled once, by this join
    marked = docs.withColumn("_key", pii.row_key()).alias("d").join(
        marks.filter("goes or again").alias("m"), F.expr("d._key = m.key and d.doc_id <=> m.doc_id"), "left")
    rest = marked.filter("m.goes is null or not m.goes")
    once = rest.filter("m.again is null or not m.again").select(*columns)
    # rows that came more than once: one row of each id and text
    twice = rest.filter("m.again").select(*columns).dropDuplicates(["doc_id", "text"])
    return once.unionByName(twice)


@carrying
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind's name in angle brackets; n_chars follows the text."""
    masked = pii.mask(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


@carrying
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the Pfair mix: the files, and the rows in each, follow the schedule.

    A row is known by the hash of id and text, so rows without an id are mixed like others; equal rows of a source
    share the first of their places.
    """
    keyed = docs.withColumn("mix_key", pii.row_key())
    plan = mixing.schedule(keyed.select("mix_key", "source"), block=MIX_BLOCK, id_col="mix_key")
    plan = plan.groupBy(F.col("doc_id").alias("placed_key"), F.col("source").alias("mix_source")).agg(F.min("position").alias("position"))
    placed = keyed.join(plan, F.expr("mix_key = placed_key") & F.col("source").cast("string").eqNullSafe(F.col("mix_source")))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartitionByRange(parts, "position").sortWithinPartitions("position").select(*docs.columns)


@carrying
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, and the digests of the ids and of the text decoded from them."""
    return bpe.digests(docs, public_vocabulary(), keep=("lang", "source"))


STAGES = [
    ("language_id", known_language),
    ("ngram_join", one_of_each_group),
    ("pii", without_personal_data),
    ("mixing", mixed_sources),
    ("bpe", encoded),
]

#: the first stage trains a model, the second links groups of any depth: SQL can't state them (tests hold them
#: against brute force)
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
