"""Stages of the corpus pipeline: functions of session, documents and table folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, gramjoin, kkpacking, pseudonyms, toxicity
from .common import NO_ID, id_and_text, kept, row_key, stored, table

STAGE_WORDS, STAGE_THRESHOLD = 5, 80


def without(docs: DataFrame, rejected: DataFrame, how: str = "left_anti") -> DataFrame:
    """Documents whose (id, text) key is not among the rejected ``k_id``, ``k_tx``.

    With ``how="left_semi"`` those whose key is.
    """
    names = docs.columns
    rejected = rejected.select("k_id", "k_tx").distinct()
    inner = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row_"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k_id"),
                        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
                        .alias("k_tx"))
    return inner.join(rejected, ["k_id", "k_tx"], how).select("row_.*")


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned on those present, does not reject."""
    texts = id_and_text(docs)
    model = toxicity.learn(texts, table(spark, sf_dir, "labels"))
    scored = toxicity.score(texts.select(*row_key(), "text"), model)
    return without(docs, scored.where(F.col("score") >= toxicity.THRESHOLD))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies: five words, 0.8 or more.

    Of several rows with that id one stays, that of the smallest text hash; NULL ids stay, and
    so do documents without words.
    """
    found = kept(gramjoin.components(id_and_text(docs), STAGE_WORDS, STAGE_THRESHOLD)
                 .where(F.col("component_id").isNotNull() & (F.col("n_shingles") > 0)
                        & (F.col("k_id") != NO_ID)).select("k_id", "k_tx", "component_id"))
    stays = found.where("k_id = component_id").groupBy("component_id").agg(
        F.min("k_tx").alias("first"))
    judged = found.join(stays, "component_id").withColumn(
        "stays", (F.col("k_id") == F.col("component_id")) & (F.col("k_tx") == F.col("first")))
    left = without(docs, judged.where("not stays"))
    twice = kept(judged.where("stays").groupBy("k_id", "k_tx").count().where("count > 1"))
    if twice.isEmpty():
        return left
    return without(left, twice).unionByName(
        without(left, twice, "left_semi").dropDuplicates(["doc_id"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(id_and_text(docs), table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated"))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced; ``n_chars`` stays right, as lengths are kept."""
    return pseudonyms.replaced_column(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kkpacking.pack(id_and_text(docs))


def run(spark: SparkSession, sf_dir: str, stages) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in stages:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
