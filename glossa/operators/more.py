"""Structured candidates, outside formats, method summaries, ledgers, packets, readiness and audits."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.evaluate import KEY, rounded

#: Methods that become columns; more of them fail the query, none is left out.
MAX_METHODS = 1000
SHORT = "^[A-Za-z][A-Za-z0-9-]{1,29}$"


def structured_relations(structures: DataFrame, sections: DataFrame, per_group: int = 64, characters: int = 1000) -> DataFrame:
    """article, ss, se, ls, le: pairs of cells of a table row, or of terms and definitions of a list, of which one looks like a short form.

    structures: article, ord, source_path, text. sections: article, ord, start, text. A span is the form's first occurrence in section order.
    Every term of a list pairs with every definition, as they share one group.
    """
    group = F.when(F.col("source_path").rlike(r"/t[hd]\["), F.regexp_replace("source_path", r"/t[hd]\[.*$", "")).when(F.col("source_path").rlike("/(term|def)"), F.regexp_replace("source_path", r"/[^/]*/?(term|def).*$", "/item"))
    s = structures.withColumn("group", group).filter(F.col("group").isNotNull() & F.length("text").between(1, characters))
    s = s.withColumn("rn", F.row_number().over(Window.partitionBy("article", "group").orderBy("ord"))).filter(F.col("rn") <= per_group)
    a = s.select("article", "group", F.col("rn").alias("i"), F.col("text").alias("a"))
    b = s.select("article", "group", F.col("rn").alias("j"), F.col("text").alias("b"))
    p = a.join(b, ["article", "group"]).filter("i < j")
    tokens = lambda c: F.regexp_count(F.col(c), F.lit(r"\S+"))
    first, second = F.col("a").rlike(SHORT) & (tokens("b") >= 2), F.col("b").rlike(SHORT) & (tokens("a") >= 2)
    p = p.filter(first | second).select("article", F.when(first, F.col("a")).otherwise(F.col("b")).alias("sf"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("lf")).distinct()
    forms = p.select("article", F.col("sf").alias("form")).union(p.select("article", "lf")).distinct()
    at = forms.join(sections.select("article", "ord", "start", F.col("text").alias("body")), "article").withColumn("x", F.expr("instr(body, form)")).filter("x > 0")
    where = at.groupBy("article", "form").agg(F.min_by(F.col("start") + F.col("x") - 1, F.col("ord")).cast("long").alias("s"))
    out = p.join(where.select("article", F.col("form").alias("sf"), F.col("s").alias("ss")), ["article", "sf"]).join(where.select("article", F.col("form").alias("lf"), F.col("s").alias("ls")), ["article", "lf"])
    return out.select("article", "ss", (F.col("ss") + F.length("sf")).cast("long").alias("se"), "ls", (F.col("ls") + F.length("lf")).cast("long").alias("le"))


def bytes_to_characters(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, s, e of UTF-8 byte spans (doc_id, bs, be): characters before each byte; a span that cuts a character is left out."""
    raw = F.encode(F.col("text"), "UTF-8")
    chars = lambda b: F.length(F.decode(F.substring(raw, F.lit(1), F.col(b).cast("int")), "UTF-8"))
    r = spans.join(docs.select("doc_id", "text"), "doc_id").withColumn("s", chars("bs").cast("long")).withColumn("e", chars("be").cast("long"))
    whole = lambda c, b: F.octet_length(F.substring(F.col("text"), F.lit(1), F.col(c).cast("int"))) == F.col(b)
    return r.filter(whole("s", "bs") & whole("e", "be")).select("doc_id", "s", "e")


def pair_lines(output: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, ord, sf, lf, precision) of indented ``SF|LF|number`` lines of a tool's output, and the indented lines that are not."""
    lines = output.select("doc_id", F.posexplode(F.split("stdout", "\n", -1)).alias("ord", "line")).filter(F.col("line").rlike(r"^\s+\S"))
    parts = lines.withColumn("p", F.split(F.trim("line"), r"\|", -1)).withColumn("v", F.try_to_number(F.get("p", F.lit(2)), F.lit("9.999999")))
    ok = (F.size("p") == 3) & F.col("v").isNotNull() & (F.get("p", F.lit(0)) != "") & (F.get("p", F.lit(1)) != "")
    good = parts.filter(ok).select("doc_id", "ord", F.get("p", F.lit(0)).alias("sf"), F.get("p", F.lit(1)).alias("lf"), F.col("v").cast("double").alias("precision"))
    return good, parts.filter(~F.coalesce(ok, F.lit(False))).select("doc_id", "ord", "line")


def method_summary(outcomes: DataFrame, docs: DataFrame) -> DataFrame:
    """method, covered, cases, coverage, empty_fp: documents with gold of which a pair was found, and false pairs in documents without gold."""
    has = lambda s: F.count(F.when(F.col("status").isin(*s), 1))
    d = outcomes.groupBy("method", "doc_id").agg(has(["tp"]).alias("tp"), has(["tp", "fn"]).alias("gold"), has(["fp"]).alias("fp"))
    c = d.groupBy("method").agg(F.count(F.when((F.col("gold") > 0) & (F.col("tp") > 0), 1)).alias("covered"), F.count(F.when(F.col("gold") > 0, 1)).alias("cases"), F.coalesce(F.sum(F.when(F.col("gold") == 0, F.col("fp"))), F.lit(0)).alias("empty_fp"))
    return c.select("method", "covered", "cases", rounded(F.col("covered"), F.col("cases")).alias("coverage"), "empty_fp")


def known_relations(predictions: DataFrame, known: DataFrame) -> DataFrame:
    """class, a count per method: predictions by what is known of their key (known: KEY..., decision), queued if nothing is."""
    what = F.when(F.col("ss").isNull() | F.col("ls").isNull(), "incomplete").when(F.col("decision").isNull(), "queued").when(F.col("decision") == "strict", "strict_exact").otherwise(F.concat(F.lit("prior_"), "decision"))
    names = [r[0] for r in predictions.select("method").distinct().orderBy("method").limit(MAX_METHODS + 1).collect()]
    if len(names) > MAX_METHODS:
        raise ValueError(f"more than {MAX_METHODS} methods don't fit the columns of a table")
    return predictions.join(known.select(*KEY, "decision").distinct(), KEY, "left").groupBy(what.alias("class")).pivot("method", names).agg(F.count(F.lit(1))).na.fill(0)


def exclude(frame: DataFrame, ledger: DataFrame) -> DataFrame:
    """record_id of the frame's records that no ledger entry (record_id, text) names by id or by normalised content."""
    content = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256)
    f = frame.select("record_id", content.alias("h"))
    e = ledger.select("record_id", content.alias("h"))
    return f.join(e.select("record_id").distinct(), "record_id", "left_anti").join(e.select("h").distinct(), "h", "left_anti").select("record_id")


def stratified_packet(passages: DataFrame, seed: str, quotas: Mapping[str, int]) -> DataFrame:
    """passage_id, stratum: the passage of smallest hash of each group, then each stratum's quota of those by hash."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("passage_id").cast("string")), 256)
    one = passages.withColumn("h", h).groupBy("stratum", "group").agg(F.min(F.struct("h", "passage_id")).alias("m")).select("stratum", "m.*")
    parts = [one.filter(F.col("stratum") == s).orderBy("h").limit(n) for s, n in quotas.items()]
    return reduce(DataFrame.unionByName, parts).select("passage_id", "stratum")


def difficult_cases(cases: DataFrame, seed: str, n: int) -> DataFrame:
    """case_id of n cases, unresolved or difficult ones first, then by hash."""
    hard = F.when(F.col("unresolved") | F.col("difficult"), 0).otherwise(1)
    return cases.withColumn("hard", hard).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("case_id").cast("string")), 256)).orderBy("hard", "h").limit(n).select("case_id")


def annotation_report(cases: DataFrame) -> DataFrame:
    """dimension, value, n of cases by origin, status and each phenomenon."""
    flat = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("origin", "status")])
    more = F.transform("phenomena", lambda p: F.struct(F.lit("phenomenon").alias("dimension"), p.alias("value")))
    return cases.select(F.inline(F.concat(flat, more))).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def readiness(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """case_id, issue: cases without a decision, with several, with an open one, and decisions for no case."""
    d = decisions.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("decision") == "open").cast("int")).alias("open"))
    c = cases.select("case_id").withColumn("known", F.lit(True)).join(d, "case_id", "full_outer")
    issue = F.when(F.col("known").isNull(), "unknown_case").when(F.col("n").isNull(), "undecided").when(F.col("n") > 1, "several_decisions").when(F.col("open") == 1, "open")
    return c.select("case_id", issue.alias("issue")).filter("issue IS NOT NULL")


def draw(ids: DataFrame, column: str, seed: str, n: int) -> DataFrame:
    """n ids without replacement, the same for the same seed: those with the smallest hashes."""
    return ids.select(column).distinct().orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")), 256)).limit(n)


def crossing_locations(locations: DataFrame) -> DataFrame:
    """annotation_id, n of discontinuous annotations (annotation_id, s, e) whose own parts overlap."""
    w = Window.partitionBy("annotation_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    r = locations.withColumn("reach", F.max("e").over(w))
    return r.filter("s < reach").groupBy("annotation_id").agg(F.count(F.lit(1)).alias("n"))


def best_stage(stages: DataFrame) -> DataFrame:
    """The accepted stage (stage, accepted, metric, precision) with the best metric; a stage that loses precision to the best so far is rolled back."""
    w = Window.orderBy("stage").rowsBetween(Window.unboundedPreceding, -1)  # a row per iteration
    held = stages.filter("accepted").withColumn("before", F.max("precision").over(w)).filter("before IS NULL OR precision >= before")
    return held.agg(F.max(F.struct("metric", (-F.col("stage")).alias("order"), "stage")).alias("m")).select("m.stage", "m.metric")


def corpus_audit(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """what, n: entities by role, those without a span, repeated ids, and relations."""
    rep = entities.groupBy("document_id", "id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.lit("repeated_id").alias("what"))
    rows = entities.select(F.concat(F.lit("role:"), "role").alias("what")).unionByName(entities.filter("s IS NULL").select(F.lit("no_span").alias("what"))).unionByName(rep)
    return rows.unionByName(relations.select(F.lit("relation").alias("what"))).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows; a value that is null, NaN or infinite fails the job."""
    ok = reduce(lambda a, c: a & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), columns, F.lit(True))
    return df.filter(F.assert_true(ok, F.lit("features must be finite")).isNull())


def leaked_fields(df: DataFrame, forbidden: tuple[str, ...] = ("prediction", "score", "confidence")) -> list[str]:
    """Names, nested ones too, of fields of a packet that would give predictions away."""
    found: list[str] = []

    def walk(kind: object, path: str) -> None:
        for f in getattr(kind, "fields", []):
            name = f"{path}{f.name}"
            found.extend([name] if any(x in f.name.lower() for x in forbidden) else [])
            walk(f.dataType, f"{name}.")
        for inner in ("elementType", "valueType"):
            if hasattr(kind, inner):
                walk(getattr(kind, inner), path)

    walk(df.schema, "")
    return found


def with_failures(docs: DataFrame, resolve: Callable[[DataFrame], DataFrame], fails: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predicted documents, predictions and diagnostics of a resolver that must not see some documents: those get an empty record and a diagnostic."""
    bad = docs.filter(fails).select("doc_id", F.lit("error").alias("severity"), F.lit("RESOLVER_EXECUTION_FAILED").alias("code"))
    return docs.select("doc_id"), resolve(docs.filter(~fails)), bad


def cache_key(corpus_fingerprint: str, config: Mapping[str, object], version: str) -> str:
    """Content address of a resolver's predictions."""
    return hashlib.sha256(json.dumps([corpus_fingerprint, config, version], sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def run_sharded(docs: DataFrame, resolve: Callable[[DataFrame], DataFrame], path: str, shards: int) -> DataFrame:
    """Writes predictions by shard of doc_id (first eight bytes of its sha256, modulo shards) and gives shard, documents, predictions.

    A rerun overwrites only the shards it computes. Rows whose text is null go to a quarantine table beside them.
    """
    h = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    shard = (h % shards).cast("int")
    docs.filter("text IS NULL").select("doc_id").write.mode("overwrite").parquet(f"{path}/quarantine")
    out = resolve(docs.filter("text IS NOT NULL")).withColumn("shard", shard)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{path}/predictions")
    n = docs.filter("text IS NOT NULL").groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("documents"))
    p = docs.sparkSession.read.schema(out.schema).parquet(f"{path}/predictions").groupBy("shard").agg(F.count(F.lit(1)).alias("predictions"))
    return n.join(p, "shard", "left").na.fill(0, ["predictions"])
