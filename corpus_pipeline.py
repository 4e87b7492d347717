"""A training corpus from raw documents in five stages, each written as Parquet before the next one reads it.

language_id keeps documents of a known language; toxicity drops documents that score 0.5 or more, by a model of
the labelled rows; near_duplicates keeps the document with the smallest id of each class of 5-word-shingle sets at a
similarity of 0.8 or more; mix takes the documents of each source towards its target, some twice; bpe encodes what is left.
All but the last return the columns of `documents`. Null texts are rejected by the first stage, as no language fits them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweft.llm import bpe, langid, mixing, ngram_join, toxicity
from arcweft.llm.common import free_name, remove, shared_folder, small_batches, table, tidy

#: Scores from which on a document counts as toxic.
TOXIC = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model, found = langid.train(docs.select("doc_id", "text", "lang")), free_name(docs, "language")
    return langid.identify(docs, model, name=found).filter(~F.col(found)["rejected"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model, found = toxicity.train(docs, table(spark, sf_dir, "labels")), free_name(docs, "toxicity")
    return toxicity.score(docs, model, name=found, spans=False).filter(F.col(found)["score"] < TOXIC).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy(spark)
    mixed = mixing.mix(docs)
    tidy(spark)
    return mixed


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    codec = bpe.Codec(spark, public_tokenizers.path("byte_bpe_50k.json"))
    out = codec.round_trip(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("toxicity", drop_toxic), ("near_duplicates", near_duplicates), ("mix", mix), ("bpe", encode)]

#: Trained models and BPE are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What each one writes goes to the shared checkpoint folder, and goes away when the next one has read it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if last:
            remove(spark, last)
        last = f"{folder}/{k}-{name}"
    return docs
