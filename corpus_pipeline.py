"""A corpus pipeline of the operators in tidepool.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import common, decontaminate, jaccard, mixing, pii, toxicity


def measured(docs: DataFrame) -> DataFrame:
    """With n_chars, where docs has it, as the length of the text that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = common.table(spark, sf_dir, "labels")
    return toxicity.reject(docs, toxicity.train(docs, labels, ~common.fold("id", 4)))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Near copies share 4/5 of their 5-word shingles or more, or link in SimHash.
    """
    return jaccard.deduplicate(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    return measured(decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets."""
    return measured(pii.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many of their words, repeats counted."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash_near_dedup", remove_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]

#: The classifier, the connected components and the index can't be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns. Each stage runs once: what it returns is a Parquet table in the shared folder, removed when the next one is written; the last stage's input stays."""
    docs, path = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, now = common.written(stage(spark, docs, sf_dir), name)
        if path is not None:
            common.removed(spark, path)
        path = now
    return STAGES[-1][1](spark, docs, sf_dir)
