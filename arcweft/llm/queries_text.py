"""Queries of the operators on whole pages and texts: op1, op2, op5, op10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweft.llm import bpe, html, langid, toxicity
from arcweft.llm.common import remainder, table, texts


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(texts(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    codec = bpe.Codec(spark, public_tokenizers.path("byte_bpe_50k.json"))
    out = codec.round_trip(texts(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents").withColumn("_fold", remainder(F.col("doc_id"), 3))
    model = langid.train(docs.filter("_fold <> 1 and lang is not null").select("doc_id", "text", "lang"))
    out = langid.identify(docs.select("doc_id", "text", F.coalesce(F.col("_fold") == 1, F.lit(False)).alias("held_out")), model)
    return out.select("doc_id", "held_out", "language.lang_pred", "language.score", "language.rejected")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text").withColumn("_fold", remainder(F.col("doc_id"), 5))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.filter(remainder(F.col("doc_id"), 5) != 0))
    out = toxicity.score(docs.select("doc_id", "text", F.coalesce(F.col("_fold") == 0, F.lit(False)).alias("held_out")), model)
    return out.select("doc_id", "held_out", F.col("toxicity.score"), (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), F.size("toxicity.spans").alias("n_spans"), F.to_json("toxicity.spans").alias("spans"))


QUERIES = {"op1_html_text": op1_html_text, "op2_bpe": op2_bpe, "op5_toxicity": op5_toxicity, "op10_language_id": op10_language_id}
