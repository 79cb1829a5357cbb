"""The registered queries: each applies one operator to its whole table and derives the stated columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, html_template, importance, language, lm, media, mixing, pii, simhash, toxicity


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = common.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return importance.resample(common.table(spark, sf_dir, "documents"), target).withColumnRenamed("id", "doc_id")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_template.extract(common.table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, ~common.fold("id", 4))
    return toxicity.score(docs, model).select(F.col("id").alias("doc_id"), common.fold("id", 4).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.document_media(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = language.train(docs, ~common.fold("id", 4), spark.conf.get("tidepool.vocabulary", language.VOCABULARY))
    return language.identify(docs, model).select(F.col("id").alias("doc_id"), common.fold("id", 4).alias("held_out"), "lang_pred", "score")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.scores(common.table(spark, sf_dir, "documents"), ~common.fold("id", 7))
    return found.select(F.col("id").alias("doc_id"), common.fold("id", 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_importance, op2_html, op3_toxicity, op4_pii, op5_mixing, op6_media, op7_language, op8_lm, op9_decontamination, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.SQL, "op9_decontamination": decontaminate.SQL}
