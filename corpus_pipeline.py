"""From raw documents to a training mixture: five stages, each written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstream.llm import decontaminate, mixing, near_dup, secrets, toxicity
from wardstream.llm.common import crc_of_id, packed, table, written

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones outside the held-out part.

    Whole texts are scored, and equal texts alike; null and empty ones are scored as a window of
    empty words. Repeated rows go or stay together, null ids stay with their text's score.
    """
    learn = F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) != 2
    model = toxicity.fit_sample(docs, table(spark, sf_dir, "labels"), learn)
    scored = toxicity.score_toxicity(packed(docs, "text"), model, id_col="row")
    return scored.where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, linked at a Jaccard similarity of 0.8 or more of their five-word shingles, the
    document with the smallest id stays. Null and empty texts and null ids are in no group; rows of equal id go or stay together.
    """
    return near_dup.drop_near_duplicates(docs, near_dup.Settings(percent=80, least=15)).select(*docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts, however long; documents stay, null texts stay null, and n_chars is counted anew."""
    return recounted(decontaminate.remove_benchmark(docs, table(spark, sf_dir, "benchmark")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; documents stay, null texts stay null, and n_chars is counted anew."""
    return recounted(secrets.redact_secrets(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with how many of their words it takes.

    Null and empty texts have no words and are never taken; a null source is a source; rows of equal
    id are documents of their own with equal keys.
    """
    sizes = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(mixing.quality_weight(table(spark, sf_dir, "labels"), sizes), F.col("quality_weight"), size=F.col("size"))
    return mixed.where("taken > 0")


def recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", cut_benchmark), ("secrets", mask_secrets), ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, one after the other; all but the last are written as Parquet beside the checkpoints."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs) if k < len(STAGES) - 1 else docs
    return docs
