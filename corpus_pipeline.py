"""The training-corpus pipeline: five stages over ``documents``, each one operator of ``glossa.llm``."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.lineage import shared_folder
from glossa.llm._common import crc_bucket
from glossa.llm.exact_dedup import drop_copies
from glossa.llm.jaccard_join import drop_similar
from glossa.llm.mixing import mixed
from glossa.llm.packing import pack_sequences
from glossa.llm.toxicity import drop_toxic

#: Bytes of an Arrow batch, beyond which only its last row goes. Rows alone (10 000) would let it grow with the texts, in the JVM and in the worker.
BATCH_BYTES = 4 << 20
_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches; a stage's result is executed after the stage returns, so that it can't unset this."""
    now = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    spark.conf.set(_BYTES_KEY, str(min(now, BATCH_BYTES) if now > 0 else BATCH_BYTES))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. Learns from the labels that op9 learns from."""
    bound_batches(spark)
    learn = F.coalesce(crc_bucket(F.col("doc_id"), 4) != 2, F.lit(False))
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return drop_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest doc_id stays."""
    bound_batches(spark)
    return drop_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to three rows each, or none."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2048 tokens; a document that is mixed in twice is packed twice."""
    bound_batches(spark)
    return pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("mixing", mixing),
    ("packing", packing),
]

#: The first stage is a trained classifier, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written as Parquet in the shared checkpoint folder and read again as the next one's input."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(_BYTES_KEY, None)
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    finally:
        if before is None:
            spark.conf.unset(_BYTES_KEY)
        else:
            spark.conf.set(_BYTES_KEY, before)
    return docs
