"""The corpus pipeline: language, quality, near-duplicates, mixing, encoding.

Each stage takes the documents that the one before it kept and returns documents (the last one: their encoding).

Null and empty texts, and texts without a letter, go in the first stage; repeated rows count once after the third; null
ids and sources are carried along; rows with equal ids and different texts are different documents.  Stages keep any
further columns of their input, whatever their names.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.llm import bpe, language_id, mixing, near_dedup, quality_rules
from gridmark.llm.queries import vocabulary
from gridmark.llm.store import read, settled, unused, written

LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without a letter, or without a clear winner, go."""
    model = language_id.train(docs.where(~language_id.held_out("doc_id", 3, 1)))
    name = unused(docs, "guess")
    guess = docs.withColumn(name, language_id.identify(model, spark, "text"))
    return guess.where((F.col(f"{name}.lang_pred") != language_id.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_SCORE)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failed lines."""
    judged = quality_rules.judge(docs.select(F.struct("*").alias("doc"), F.col("text"))).where("kept")
    changed = {"text": F.col("cleaned").alias("text"), "n_chars": F.length("cleaned").cast("long").alias("n_chars")}
    return judged.select(*(changed.get(c, F.col(f"doc.`{c}`")) for c in docs.columns))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.deduplicated(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.  A document belongs to its source and to all others under which the
    table ``documents`` holds the text that its id has there; a null source is one like others."""
    members = unused(docs, "members")
    mixed, _ = mixing.mix(docs.join(memberships(spark, sf_dir, members), "doc_id", "left"), F.coalesce(members, F.array("source")))
    return mixed.where("copies > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1), "copies")).alias(unused(docs, "copy"))).select(*docs.columns)


def memberships(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(doc_id, ``name``: sources) of the documents whose text stands under several sources.  Ids that are null or stand
    on several texts have none."""
    docs = read(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"))
    listed = docs.groupBy("digest", "source").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.collect_set(F.struct("source")).alias("s")).where(F.size("s") > 1)
    several = settled(listed.select("digest", F.array_sort(F.transform("s", lambda x: x["source"])).alias("s")))
    own = docs.join(several, "digest").groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b"), F.first("s").alias(name))
    return own.where("doc_id IS NOT NULL AND a = b").select("doc_id", name)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text."""
    return bpe.encoded(docs.select("doc_id", "text"), vocabulary()).select("row.doc_id", "d.*")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("language_id", language), ("quality_rules", quality), ("near_dedup", dedup), ("mixing", mix), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder for the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
