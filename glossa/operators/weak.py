"""Weak supervision: an evidence ledger, silver labels, and context patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import quoted, text_at

PAIR = ["doc_id", "ss", "se", "ls", "le"]
#: Patterns that may be broadcast.
MOST_PATTERNS = 10_000


def ledger(evidence: DataFrame, columns: list[str]) -> DataFrame:
    """Evidence with a content-derived id, each once."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]
    return evidence.withColumn("evidence_id", F.sha2(F.concat_ws("|", *parts), 256)).dropDuplicates(["evidence_id"])


def silver_labels(evidence: DataFrame, key: list[str], positive_at: float = 1.0, negative_at: float = 1.0, conflict: str = "abstain") -> DataFrame:
    """key, status, confidence, n_evidence: one record per source family (the heaviest, then the first) votes by polarity."""
    first = Window.partitionBy(*key, "family").orderBy(F.desc("weight"), "ord")
    votes = evidence.withColumn("rn", F.row_number().over(first))
    side = lambda p: F.coalesce(F.sum(F.when((F.col("rn") == 1) & (F.col("polarity") == p), F.col("weight"))), F.lit(0.0))
    s = votes.groupBy(*key).agg(side("positive").alias("pos"), side("negative").alias("neg"), F.count(F.lit(1)).alias("n_evidence"))
    pos, neg = F.col("pos") >= positive_at, F.col("neg") >= negative_at
    status = F.when(pos & neg, conflict if conflict != "priority" else "positive").when(pos, "positive").when(neg, "negative").otherwise("abstain")
    total = F.col("pos") + F.col("neg")
    return s.select(*key, status.alias("status"), F.when(total > 0, F.round(F.greatest("pos", "neg") / total, 6)).otherwise(0.0).alias("confidence"), "n_evidence")


def templates(pairs: DataFrame, docs: DataFrame, context: int = 60) -> DataFrame:
    """Pairs with template and direction: both forms masked in ``context`` characters around them, white space collapsed."""
    p = pairs.select(*PAIR).join(docs.select("doc_id", "text"), "doc_id")
    short = F.struct("ss", "se", F.lit("<SF>").alias("tag"))
    long = F.struct(F.col("ls").alias("ss"), F.col("le").alias("se"), F.lit("<LF>").alias("tag"))
    p = p.withColumn("a", F.when(F.col("ss") <= F.col("ls"), short).otherwise(long)).withColumn("b", F.when(F.col("ss") <= F.col("ls"), long).otherwise(short))
    masked = F.concat(
        text_at(F.col("text"), F.greatest(F.lit(0), F.col("a.ss") - context), F.col("a.ss")), "a.tag",
        text_at(F.col("text"), F.col("a.se"), F.col("b.ss")), "b.tag", text_at(F.col("text"), F.col("b.se"), F.col("b.se") + context),
    )
    clean = F.trim(F.regexp_replace(masked, r"\s+", " "))
    return p.select(*PAIR, clean.alias("template"), F.when(F.col("ss") < F.col("ls"), "short_before_long").otherwise("long_before_short").alias("direction"))


def induce(evidence: DataFrame, docs: DataFrame, context: int = 60, max_length: int = 180, min_docs: int = 2, min_pairs: int = 2) -> DataFrame:
    """template, direction, documents, pairs, status of positive evidence. Pairs are told apart by their offsets alone."""
    t = templates(evidence.filter("polarity = 'positive'"), docs, context).filter(F.length("template") <= max_length)
    g = t.groupBy("template", "direction").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct(F.struct("ss", "se", "ls", "le")).alias("pairs"))
    ok = (F.col("documents") >= min_docs) & (F.col("pairs") >= min_pairs)
    return g.withColumn("status", F.when(ok, "promoted").otherwise("rejected_insufficient_support"))


def validate(patterns: DataFrame, pairs: DataFrame, docs: DataFrame, context: int = 60) -> DataFrame:
    """template, held_out, matched, missed: how many held-out templates each pattern covers; short forms are non-blank, long forms anything."""
    t = templates(pairs, docs, context).groupBy("template").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("template", "context")
    total = t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("held_out"))
    literal = quoted(F.col("template"))
    pattern = F.replace(F.replace(literal, F.lit("<SF>"), F.lit(r"\E\S{1,40}\Q")), F.lit("<LF>"), F.lit(r"\E.{1,240}?\Q"))
    p = patterns.select("template").distinct().withColumn("pattern", F.concat(F.lit("(?s)^"), pattern, F.lit("$")))
    # a pattern's literal text before its first or after its last mask stands at that end of the context: the longest of these that a pattern
    # has is the key on which it meets contexts
    plain = F.replace("template", F.lit("<LF>"), F.lit("<SF>"))
    ends = {"start": F.substring_index(plain, "<SF>", 1), "end": F.substring_index(plain, "<SF>", -1)}
    cut = {"start": lambda c, n: F.substring(c, 1, n), "end": lambda c, n: F.right(c, F.lit(n))}
    hits, rest = None, p.withColumn("first", ends["start"]).withColumn("last", ends["end"])
    for side, n in (("start", 24), ("end", 24), ("start", 8), ("end", 8)):
        literal = F.col("first" if side == "start" else "last")
        mine, rest = rest.filter(F.length(literal) >= n), rest.filter(F.length(literal) < n)
        met = mine.withColumn("anchor", cut[side](literal, n)).join(t.withColumn("anchor", cut[side](F.col("context"), n)), "anchor")
        met = met.filter(F.regexp_like("context", F.col("pattern"))).select("template", "n")
        hits = met if hits is None else hits.unionByName(met)
    # patterns with next to no text of their own are tried on every context; they are sent along if a count shows that they are few
    short = F.broadcast(rest) if rest.count() <= MOST_PATTERNS else rest
    met = t.join(short, F.regexp_like("context", F.col("pattern"))).select("template", "n")
    hits = hits.unionByName(met).groupBy("template").agg(F.sum("n").alias("matched"))
    out = p.select("template").join(hits, "template", "left").na.fill(0, ["matched"]).join(F.broadcast(total), F.lit(True))
    return out.select("template", "held_out", "matched", (F.col("held_out") - F.col("matched")).alias("missed"))


def reused_evidence(stages: DataFrame) -> DataFrame:
    """stage, n, reused, accepted: a stage is accepted if none of its evidence (array evidence_ids) was used by an earlier one."""
    e = stages.select("stage", F.explode("evidence_ids").alias("id")).distinct()
    first = e.groupBy("id").agg(F.min("stage").alias("first"))
    c = e.join(first, "id").groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("first") < F.col("stage"), 1)).alias("reused"))
    return c.withColumn("accepted", F.col("reused") == 0)


def candidate_evidence(candidates: DataFrame, docs: DataFrame, family: str, source: str, version: str, polarity: str, weight: float = 1.0) -> DataFrame:
    """Evidence from candidates: their spans, family, source, version, polarity, weight, and the text from the first form's start to the last one's end."""
    a, b = F.least("ss", "ls"), F.greatest("se", "le")
    rows = candidates.select(*PAIR).join(docs.select("doc_id", "text"), "doc_id")
    fixed = {"family": family, "source": source, "version": version, "polarity": polarity, "weight": weight}
    return rows.select(*PAIR, *[F.lit(v).alias(k) for k, v in fixed.items()], text_at(F.col("text"), a, b).alias("local_context"))
