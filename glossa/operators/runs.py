"""Runs: composed corpus builds, kept predictions, sharded processing that can be taken up again, and guarded iterations."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.lineage import checkpoint
from glossa.operators.more import cache_key
from glossa.operators.validate import check_annotations, repeated_ids
from glossa.sources import annotations as an
from glossa.sources import sinks

Normaliser = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def build_corpus(docs: DataFrame, gold: DataFrame, normalisers: Mapping[str, Normaliser], strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, annotations and diagnostics (severity, code, action, doc_id) of a build.

    Normalisers run in order over the annotations (they give the annotations and a row with doc_id per repair). A document with an annotation outside its
    text or inverted is dropped with its annotations; ids that repeat are warned of. ``strict``: an error fails the build.
    """
    found = []
    said = lambda df, severity, code, action: df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(action).alias("action"), "doc_id")
    for name, step in normalisers.items():
        gold, repairs = step(gold, docs)
        found.append(said(repairs, "info", name, "repaired"))
    bad = checkpoint(check_annotations(gold, docs).filter("verdict = 'invalid'").select("doc_id").distinct())
    found += [said(bad, "error", "RECORD_DROPPED", "dropped"), said(repeated_ids(docs), "warning", "DUPLICATE_RECORD_ID", "kept")]
    if strict and not bad.isEmpty():
        raise ValueError(f"strict build: {bad.count()} documents have invalid annotations")
    return docs.join(bad, "doc_id", "left_anti"), gold.join(bad, "doc_id", "left_anti"), reduce(DataFrame.unionByName, found)


def checked_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents and annotations that ``sinks.write_dataset`` wrote; raises if they are not what the manifest says."""
    docs, gold = an.canonical(spark, f"{path}/data")
    said = spark.read.json(f"{path}/manifest").first()
    now = sinks.manifest(docs, gold, said["adapter"]).first()
    for field in ("fingerprint", "documents", "annotations"):
        if said[field] != now[field]:
            raise ValueError(f"the dataset's {field} does not match its manifest")
    return docs, gold


def checked_predictions(spark: SparkSession, path: str, docs: DataFrame, fingerprint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and predictions of an artifact; raises unless it has one resolver, the expected dataset, all documents, and spans in their texts."""
    about = spark.read.schema(an.PREDICTIONS).json(path).agg(
        F.count_distinct("resolver").alias("resolvers"), F.count_distinct(F.coalesce("dataset_fingerprint", F.lit(""))).alias("datasets"), F.max("dataset_fingerprint").alias("dataset")
    ).first()
    if about["resolvers"] != 1 or about["datasets"] != 1:
        raise ValueError("the artifact must have one resolver and one dataset")
    if fingerprint is not None and about["dataset"] != fingerprint:
        raise ValueError("the artifact is of another dataset")
    covered, found = an.predictions(spark, path)
    odd = covered.select("document_id", F.lit(1).alias("a")).join(docs.select("document_id", F.lit(1).alias("b")), "document_id", "full_outer").filter("a IS NULL OR b IS NULL")
    if not odd.isEmpty():
        raise ValueError("the artifact does not cover the documents")
    inside = lambda s, e: F.col(s).isNull() | ((F.col(s) >= 0) & (F.col(s) < F.col(e)) & (F.col(e) <= F.length("text")))
    same = lambda s, e, t: F.col(s).isNull() | F.col(t).isNull() | (F.col("text").substr((F.col(s) + 1).cast("int"), (F.col(e) - F.col(s)).cast("int")) == F.col(t))
    ok = inside("ss", "se") & inside("ls", "le") & same("ss", "se", "sf") & same("ls", "le", "lf")
    if not found.join(docs.select("document_id", "text"), "document_id").filter(~ok).isEmpty():
        raise ValueError("a prediction is not what stands in its text")
    return covered, found


def kept_predictions(docs: DataFrame, resolve: Callable[[DataFrame], DataFrame], root: str, name: str, version: str, config: Mapping[str, object]) -> tuple[DataFrame, bool]:
    """Predictions of a resolver over docs (document_id, text), and whether they were there already.

    They lie under a key of the documents' fingerprint, the resolver's version and its configuration. What is found is validated as
    ``checked_predictions`` does and used if it holds; otherwise the resolver runs, its artifact is written, read back and validated.
    """
    spark = docs.sparkSession
    print_ = sinks.fingerprint(docs.select(F.to_json(F.struct("document_id", "text")).alias("value"))).first()["fingerprint"]
    path = f"{root}/predictions/{cache_key(print_, {'name': name, **config}, version)}"
    try:
        return checked_predictions(spark, path, docs, print_)[1], True
    except (AnalysisException, ValueError):
        sinks.prediction_rows(docs, resolve(docs), name, version, print_).select("value").write.mode("overwrite").text(path)
    return checked_predictions(spark, path, docs, print_)[1], False


def process_sharded(docs: DataFrame, process: Callable[[str, str], str], root: str, shards: int, identity: Mapping[str, object], retries: int = 1, resume: bool = True) -> dict:
    """Runs ``process`` (document id, text -> JSON text) over docs (document_id, text) by shard and gives the run's manifest.

    A document that fails ``retries`` + 1 times is quarantined with its error, not passed on as empty. Output rows hold the shard and the hash of the
    input. The manifest is written last; a run whose manifest is there, complete and of the same identity (processor, shards and documents'
    fingerprint) is not run again (``reused``), any other remainder is overwritten.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("document_id").cast("string").alias("document_id"), "text")
    print_ = sinks.fingerprint(rows.select(F.to_json(F.struct("document_id", "text")).alias("value"))).first()["fingerprint"]
    key = cache_key(print_, {**identity, "shards": shards}, "sharded-run-v1")
    path = f"{root}/{key}"
    if resume:
        try:
            said = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
            if said["complete"] and said["key"] == key:
                return said | {"reused": True}
        except AnalysisException:
            pass

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text in zip(batch.column("document_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                result = error = None
                for _ in range(retries + 1):
                    try:
                        result, error = process(name, text), None
                        break
                    except Exception as e:  # any failure of the given function is a row of the quarantine
                        error = e
                out.append((result, None if error is None else type(error).__name__, None if error is None else str(error)))
            cols = [pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else ([], [], []))]
            yield pa.RecordBatch.from_arrays([batch.column("document_id"), batch.column("sha"), batch.column("shard"), *cols], names=["document_id", "input_sha256", "shard", "output", "error_type", "error"])

    h = F.conv(F.substring(F.sha2("document_id", 256), 1, 16), 16, 10).cast("decimal(20,0)")
    given = rows.select("document_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), (h % shards).cast("int").alias("shard"))
    done = checkpoint(given.mapInArrow(run, "document_id string, input_sha256 string, shard int, output string, error_type string, error string"))
    done.filter("error_type IS NULL").drop("error_type", "error").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/outputs")
    done.filter("error_type IS NOT NULL").drop("output").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/quarantine")
    n = done.agg(F.count(F.lit(1)).alias("documents"), F.count("error_type").alias("failed")).first()
    manifest = {"schema_version": "sharded-run-v1", "complete": True, "key": key, "identity": dict(identity), "shards": shards, "documents": n["documents"], "failed": n["failed"], "path": path}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest | {"reused": False}


def iterate(stages: DataFrame, max_iterations: int = 5, max_stages: int = 50, minimum_gain: float = 0.0, minimum_precision: float = 0.0) -> tuple[DataFrame, dict]:
    """Decisions (iteration, name, accepted, reason) over planned stages, and a manifest (completed, stopped, best).

    stages: iteration (from 1), name, gain, precision, evidence_ids. A stage is refused if any of its evidence belongs to a stage accepted before it, or
    if its precision is too low. Work stops before an iteration that brings the accepted stages over ``max_stages``, or (from the second) whose
    best stage gains no more than ``minimum_gain``. The best iteration has the largest gain, all its stages being precise enough. Evidence stays
    distributed: each stage is one join with the evidence accepted so far.
    """
    spark = stages.sparkSession
    rows = checkpoint(stages)
    plan = rows.select("iteration", "name", "gain", "precision").orderBy("iteration", "name").limit(max_iterations * max_stages + max_stages + 1).collect()
    evidence = checkpoint(rows.select("iteration", "name", F.explode("evidence_ids").alias("id")).distinct())
    accepted: list[tuple[int, str]] = []
    out, best, best_gain, stopped, completed = [], None, float("-inf"), None, 0
    numbers = sorted({r["iteration"] for r in plan})
    for i in numbers[:max_iterations]:
        mine = [r for r in plan if r["iteration"] == i]
        if len(mine) + len(accepted) > max_stages:
            stopped = "stage limit"
            break
        gain = max(r["gain"] for r in mine)
        if i > numbers[0] and gain <= minimum_gain:
            stopped = "no development gain"
            break
        for r in mine:
            seen = spark.createDataFrame(accepted, "iteration int, name string") if accepted else None
            own = evidence.filter((F.col("iteration") == i) & (F.col("name") == r["name"])).select("id")
            used = seen is not None and not own.join(evidence.join(F.broadcast(seen), ["iteration", "name"], "left_semi").select("id"), "id", "left_semi").isEmpty()
            reason = "duplicate or self-supporting evidence" if used else "development precision guard" if r["precision"] < minimum_precision else None
            out.append((i, r["name"], reason is None, reason))
            accepted += [(i, r["name"])] if reason is None else []
        completed = i
        if gain > best_gain and all(r["precision"] >= minimum_precision for r in mine):
            best, best_gain = i, gain
    if stopped is None and len(numbers) > max_iterations:
        stopped = "iteration limit"
    return spark.createDataFrame(out, "iteration int, name string, accepted boolean, reason string"), {"completed": completed, "stopped": stopped, "best": best}
