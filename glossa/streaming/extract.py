"""Incremental extraction with Structured Streaming: new files in, definitions out, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.operators.extract import schwartz_hearst


def extract_new(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Runs the extractor over the Parquet files (doc_id, text) of ``source`` that no earlier run has seen, and stops.

    The extraction has no state, so a batch is a plain map; the checkpoint makes each file count once even if a run is killed.
    """
    docs = spark.readStream.schema("doc_id long, text string").parquet(source)
    query = schwartz_hearst(docs).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ledger_stream(evidence: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Streaming evidence, each (user_id, event_type, event_id) once within ``delay``; the state of older rows is dropped."""
    return evidence.withWatermark(time, delay).dropDuplicatesWithinWatermark(["user_id", "event_type", "event_id"])


def merge_revisions(events: DataFrame, path: str, checkpoint: str) -> None:
    """Keeps the current value of each key of a streaming log (key, expected, revision, value): a table per batch, the highest complete one counts.

    An event applies if it expected the revision before it, as in ``literature.latest_revisions``; the kept state stands for all earlier events. A batch that
    is run again replaces its own table from the one before it, so nothing applies twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("key", "expected", "revision", "value", F.lit(False).alias("base"), F.lit(0).cast("long").alias("conflicts"))
        if number > 0:
            before = spark.read.parquet(f"{path}/v{number - 1}")
            rows = rows.unionByName(before.select("key", F.lit(None).cast("long").alias("expected"), "revision", "value", F.lit(True).alias("base"), "conflicts"))
        w = Window.partitionBy("key").orderBy("revision", F.desc("base"))
        ok = F.col("base") | (F.col("expected") == F.coalesce(F.lag("revision").over(w), F.lit(0)))
        e = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
        applied = F.when(F.col("ok"), F.col("revision"))
        current = e.groupBy("key").agg(F.max(applied).alias("revision"), F.max_by("value", applied).alias("value"), (F.sum("conflicts") + F.count(F.when(~F.col("ok"), 1))).alias("conflicts"))
        current.write.mode("overwrite").parquet(f"{path}/v{number}")

    events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
