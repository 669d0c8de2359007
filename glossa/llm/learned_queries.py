"""Queries of the operators with a Python stage. SQL can't express them; tests hold them against brute force or held-out rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm._common import crc_bucket, table
from glossa.llm.ann import ann_search
from glossa.llm.language_id import language_id
from glossa.llm.packing import pack_sequences
from glossa.llm.toxicity import THRESHOLD, toxicity


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(True))
    # a text with letters gets a learned language here; that it was rejected is said beside it
    return language_id(docs, ~held, keep_rejected=True).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(True))
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {
    "op1_ann": op1_ann,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op9_toxicity": op9_toxicity,
}
