"""Writers: canonical JSONL, manifests, fingerprints, reports, and review interchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _definition(doc: str = "document_id") -> Column:
    span = lambda s, e: F.when(F.col(s).isNotNull(), F.struct(F.col(e).alias("end"), F.col(s).alias("start")))
    return F.struct(F.col(doc).alias("document_id"), span("ls", "le").alias("long_form"), F.col("lf").alias("long_form_text"), span("ss", "se").alias("short_form"), F.col("sf").alias("short_form_text"))


def canonical_rows(documents: DataFrame, gold: DataFrame) -> DataFrame:
    """document_id and its canonical-v1 JSON line: keys in order, annotations by position."""
    a = gold.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ss", "se", "ls", "le", _definition().alias("d")))).alias("x"))
    none = F.array().cast("array<struct<document_id:string,long_form:struct<end:bigint,start:bigint>,long_form_text:string,short_form:struct<end:bigint,start:bigint>,short_form_text:string>>")
    r = documents.join(a, "document_id", "left").withColumn("gold_annotations", F.coalesce(F.transform("x", lambda v: v["d"]), none))
    line = F.to_json(F.struct(F.struct("document_id", "text").alias("document"), "gold_annotations", F.col("document_id").alias("record_id"), F.lit("canonical-v1").alias("schema_version")))
    return r.select("document_id", line.alias("value"))


def write_canonical(documents: DataFrame, gold: DataFrame, path: str) -> None:
    """JSONL parts, globally ordered by document_id."""
    canonical_rows(documents, gold).orderBy("document_id").select("value").write.text(path)


def fingerprint(rows: DataFrame, column: str = "value") -> DataFrame:
    """n, fingerprint of a set of rows, whatever their order or partitions: digests are added up by parts, then hashed once."""
    h = F.sha2(F.col(column), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)"))
    s = rows.agg(F.count(F.lit(1)).alias("n"), *[part(i).cast("string").alias(f"p{i}") for i in range(8)])
    return s.select("n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[F.coalesce(f"p{i}", F.lit("0")) for i in range(8)]), 256).alias("fingerprint"))


def file_hashes(spark, path: str) -> DataFrame:
    """path, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def manifest(documents: DataFrame, gold: DataFrame, adapter: str, normalisers: tuple[str, ...] = (), diagnostics: DataFrame | None = None) -> DataFrame:
    """One row: adapter, documents, annotations, complete, fingerprint, normalisers, and the numbers of diagnostics by severity if given."""
    n = documents.agg(F.count(F.lit(1)).alias("documents"))
    g = gold.agg(F.count(F.lit(1)).alias("annotations"), F.count(F.when(F.col("ss").isNotNull() & F.col("ls").isNotNull(), 1)).alias("complete"))
    f = fingerprint(canonical_rows(documents, gold)).select("fingerprint")
    out = n.join(g, F.lit(True)).join(f, F.lit(True)).withColumn("adapter", F.lit(adapter)).withColumn("normalisers", F.lit(",".join(normalisers)))
    if diagnostics is not None:
        counts = [F.count(F.when(F.col("severity") == x, 1)).alias(f"{x}s") for x in ("error", "warning", "info")]
        out = out.join(diagnostics.agg(*counts), F.lit(True))
    return out


def write_dataset(documents: DataFrame, gold: DataFrame, path: str, adapter: str, normalisers: tuple[str, ...] = (), diagnostics: DataFrame | None = None) -> None:
    """Canonical rows under ``data``, then the manifest that ``runs.checked_dataset`` holds them against."""
    write_canonical(documents, gold, f"{path}/data")
    manifest(documents, gold, adapter, normalisers, diagnostics).coalesce(1).write.json(f"{path}/manifest")


def candidate_rows(candidates: DataFrame) -> DataFrame:
    """doc_id and its candidates-v1 JSON line: candidates in span order, with their generator."""
    span = lambda s, e: F.struct(F.col(s).alias("start"), F.col(e).alias("end"))
    one = F.struct("ss", "se", "ls", "le", F.struct(span("ss", "se").alias("short_form"), span("ls", "le").alias("long_form"), "generator").alias("c"))
    g = candidates.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias("candidates"))
    return g.select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("document_id"), "candidates", F.lit("candidates-v1").alias("schema_version"))).alias("value"))


def report_rows(report: DataFrame, name: str) -> DataFrame:
    """Any report as JSON lines with its name."""
    return report.select(F.to_json(F.struct(F.lit(name).alias("report"), F.struct(*report.columns).alias("row"))).alias("value"))


def tag_rows(spans: DataFrame) -> DataFrame:
    """document_id and its tagger spans (label, s, e) as a JSON line, in order."""
    one = F.struct(F.col("s").alias("start"), F.col("e").alias("end"), "label")
    g = spans.groupBy(F.col("doc_id").cast("string").alias("document_id")).agg(F.array_sort(F.collect_list(one)).alias("spans"))
    return g.select("document_id", F.to_json(F.struct("document_id", "spans")).alias("value"))


def resolution_rows(article_spans: DataFrame) -> DataFrame:
    """article and its resolved definitions with their sections (``literature.span_sections``) as a JSON line."""
    one = F.struct(F.col("s").alias("start"), F.col("e").alias("end"), F.col("ord").alias("section"), F.col("rs").alias("section_start"), F.col("re").alias("section_end"))
    g = article_spans.groupBy("article").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    return g.select("article", F.to_json(F.struct(F.col("article").cast("string").alias("article_id"), "spans")).alias("value"))


def verify_files(spark, path: str, said: DataFrame) -> DataFrame:
    """file, problem of files against a manifest (file, sha256): missing, changed or unlisted."""
    now = file_hashes(spark, path).select(F.substring_index("path", "/", -1).alias("file"), F.col("sha256").alias("now"))
    both = said.select("file", "sha256").join(now, "file", "full_outer")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("now") != F.col("sha256"), "changed")
    return both.select("file", problem.alias("problem")).filter("problem IS NOT NULL")


def write_published(df: DataFrame, path: str, about: DataFrame) -> None:
    """Data first, its manifest last: a reader that finds the manifest finds all of the data."""
    df.write.parquet(f"{path}/data")
    about.coalesce(1).write.json(f"{path}/manifest")


def write_errors(rows: DataFrame, path: str, separator: str = "\t") -> None:
    rows.write.option("header", True).option("sep", separator).csv(path)


def html_rows(errors: DataFrame) -> DataFrame:
    """HTML table rows of ``reports.error_contexts``."""
    return errors.select(F.format_string("<tr><td>%s</td><td>%s</td><td>%s</td></tr>", F.col("doc_id").cast("string"), "status", "context").alias("value"))


def prediction_rows(docs: DataFrame, predictions: DataFrame, key: str, version: str, dataset: str | None = None) -> DataFrame:
    """document_id and its predictions-v1 JSON line; a document without predictions has an empty list. ``dataset``: the documents' fingerprint."""
    p = predictions.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ss", "se", "ls", "le", _definition().alias("d")))).alias("x"))
    r = docs.select("document_id").join(p, "document_id", "left")
    none = F.array().cast("array<struct<document_id:string,long_form:struct<end:bigint,start:bigint>,long_form_text:string,short_form:struct<end:bigint,start:bigint>,short_form_text:string>>")
    lists = F.coalesce(F.transform("x", lambda v: v["d"]), none)
    return r.select("document_id", F.to_json(F.struct(F.lit(dataset).cast("string").alias("dataset_fingerprint"), "document_id", lists.alias("predictions"), F.col("document_id").alias("record_id"), F.struct(F.lit(key).alias("key"), F.lit(version).alias("version")).alias("resolver"))).alias("value"))


def write_bioc(documents: DataFrame, entities: DataFrame, path: str) -> None:
    """BioC XML: one document element per row, entities as annotations."""
    a = F.collect_list(F.struct(F.col("id").alias("_id"), F.struct(F.col("s").alias("_offset"), (F.col("e") - F.col("s")).alias("_length")).alias("location"), F.col("text").alias("text")))
    e = entities.groupBy("document_id").agg(a.alias("annotation"))
    rows = documents.join(e, "document_id", "left").select(F.col("document_id").alias("id"), F.struct(F.lit(0).alias("offset"), "text", "annotation").alias("passage"))
    rows.write.format("xml").option("rootTag", "collection").option("rowTag", "document").option("attributePrefix", "_").save(path)
