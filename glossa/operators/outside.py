"""Seams for external programs and models: a tool run per document, a replay table in place of a service, and scorer artifacts."""

from __future__ import annotations

import hashlib
import json
import subprocess
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tool_outputs(docs: DataFrame, command: list[str], cache: DataFrame | None = None, timeout: float = 60.0) -> DataFrame:
    """doc_id, key, stdout, error of a program that reads a text on standard input.

    ``cache`` (key, stdout) holds earlier outputs by sha256 of command and text; only texts that it lacks are run. A program that fails, or takes
    too long, gives an error instead of an output, not a failed job.
    """
    key = F.sha2(F.concat_ws("\x1f", F.lit(json.dumps(command)), F.coalesce("text", F.lit(""))), 256)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for text in batch.column("text").to_pylist():
                try:
                    done = subprocess.run(command, input=text, capture_output=True, text=True, timeout=timeout, check=True)
                    out.append(done.stdout), errors.append(None)
                except (subprocess.SubprocessError, OSError) as e:
                    out.append(None), errors.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.string()), pa.array(errors, pa.string())], names=["key", "stdout", "error"])

    texts = rows.select("key", "text").dropDuplicates(["key"])
    new = texts if cache is None else texts.join(cache.select("key"), "key", "left_anti")
    made = new.mapInArrow(run, "key string, stdout string, error string")
    if cache is not None:
        made = made.unionByName(cache.select("key", "stdout", F.lit(None).cast("string").alias("error")))
    return rows.select("doc_id", "key").join(made, "key")


def replayed(requests: DataFrame, replay: DataFrame) -> DataFrame:
    """Requests with the recorded response to the same content, and null where none was recorded: a service is never called."""
    key = F.sha2(F.col("request"), 256)
    return requests.withColumn("key", key).join(replay.select(F.sha2("request", 256).alias("key"), "response").dropDuplicates(["key"]), "key", "left").drop("key")


def _digest(body: object) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def save_scorer(spark: SparkSession, weights: dict[str, float], path: str) -> None:
    """Writes a linear scorer with the digests of its weights and of its feature names."""
    body = {"weights": weights, "features": sorted(k for k in weights if k != "bias")}
    line = json.dumps(body | {"sha256": _digest(weights), "schema_sha256": _digest(body["features"])}, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_scorer(spark: SparkSession, path: str, features: list[str]) -> dict[str, float]:
    """Reads a scorer; one that was altered, or that was fitted on other features, is refused."""
    body = json.loads(spark.read.text(path).first()[0])
    if body["sha256"] != _digest(body["weights"]):
        raise ValueError("the scorer's weights don't match their digest")
    if body["schema_sha256"] != _digest(sorted(features)):
        raise ValueError("the scorer was fitted on other features")
    return body["weights"]
