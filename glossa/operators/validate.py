"""Normalisation and validation of annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import strip, text_at


def trim_captured(annotations: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations whose captured texts (sf, lf) are trimmed where the trimmed text is what stands at the span, and the repairs (doc_id, side)."""
    a = annotations.join(docs.select("doc_id", "text"), "doc_id")
    for c, s, e in (("sf", "ss", "se"), ("lf", "ls", "le")):
        a = a.withColumn(f"{c}_fix", (F.col(c) != strip(F.col(c))) & (strip(F.col(c)) == text_at(F.col("text"), F.col(s), F.col(e))))
    fixed = a.withColumn("sf", F.when(F.col("sf_fix"), strip(F.col("sf"))).otherwise(F.col("sf"))).withColumn("lf", F.when(F.col("lf_fix"), strip(F.col("lf"))).otherwise(F.col("lf")))
    repairs = a.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("sf_fix"), "short"), F.when(F.col("lf_fix"), "long")))).alias("side"))
    return fixed.select(*annotations.columns), repairs


def check_annotations(annotations: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, ss, se, ls, le, verdict: invalid (outside the text or inverted), unscoreable (a side is missing), ambiguous (its pair crosses another), ok."""
    a = annotations.select("doc_id", "ss", "se", "ls", "le").join(docs.select("doc_id", F.length("text").alias("n")), "doc_id")
    bad = lambda s, e: F.col(s).isNotNull() & ((F.col(s) < 0) | (F.col(s) > F.col(e)) | (F.col(e) > F.col("n")))
    a = a.withColumn("bad", bad("ss", "se") | bad("ls", "le")).withColumn("half", F.col("ss").isNull() | F.col("ls").isNull())
    whole = a.filter("NOT bad AND NOT half")
    other = whole.select("doc_id", *[F.col(c).alias(f"o{c}") for c in ("ss", "se", "ls", "le")]).distinct()
    meets = lambda s, e, t, f: (F.col(s) < F.col(f)) & (F.col(t) < F.col(e))
    differ = (F.col("ss") != F.col("oss")) | (F.col("se") != F.col("ose")) | (F.col("ls") != F.col("ols")) | (F.col("le") != F.col("ole"))
    any_ = meets("ss", "se", "oss", "ose") | meets("ls", "le", "ols", "ole") | meets("ss", "se", "ols", "ole") | meets("ls", "le", "oss", "ose")
    clash = whole.join(other, "doc_id").filter(differ & any_).select("doc_id", "ss", "se", "ls", "le").distinct().withColumn("clash", F.lit(True))
    v = whole.join(clash, ["doc_id", "ss", "se", "ls", "le"], "left").select("doc_id", "ss", "se", "ls", "le", F.when(F.col("clash"), "ambiguous").otherwise("ok").alias("verdict"))
    rest = a.filter("bad OR half").select("doc_id", "ss", "se", "ls", "le", F.when(F.col("bad"), "invalid").otherwise("unscoreable").alias("verdict"))
    return v.unionByName(rest)


def summary(diagnostics: DataFrame) -> DataFrame:
    """severity, code, action, n, with totals per severity and overall."""
    return diagnostics.rollup("severity", "code", "action").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def repeated_ids(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def replay_select(replay: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., status of wanted rows in a recorded replay: found, missing or repeated."""
    r = replay.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return wanted.select(*keys).distinct().join(r, keys, "left").select(*keys, F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").otherwise("found").alias("status"))
