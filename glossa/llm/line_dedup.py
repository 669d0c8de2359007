"""Line dedup: lines that recur across documents go, but for the document with the largest id (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.lineage import skew_join
from glossa.llm._common import ASCII_SPACE, ascii_lower, checkpoint

MIN_POINTS, MIN_DOCS = 20, 3


def line_keys(text: Column) -> Column:
    """Lines of a non-null text, stripped of ASCII white space at both ends and A-Z lower-cased, in order."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.btrim(x, F.lit(ASCII_SPACE)))


def _hashed(rows: DataFrame, min_points: int) -> DataFrame:
    """(doc_id, fp, pos, h1, h2) of each line whose key is long enough; h1 and h2 make a 128-bit hash of the key."""
    lines = rows.select("doc_id", "fp", F.posexplode(line_keys(F.col("body"))).alias("pos", "line"))
    lines = lines.filter(F.char_length("line") >= min_points)
    return lines.select("doc_id", "fp", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def line_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_text.

    A text is split at ``\\n``; null or empty is one empty line. Keys of at least ``min_points`` code points that occur
    in at least ``min_docs`` different doc_ids lose their lines everywhere but in the largest doc_id that holds
    them, where all of them stay. Rows that repeat a doc_id are one document when documents are counted and each get
    a result row by its own lines; a row with a null doc_id takes no part in the counting and keeps its lines. Long
    texts count whole. An empty table gives an empty result; other columns are ignored.

    Lines are hashed once and the hashes written; (line, document) pairs are made distinct before they are counted; a line of very
    many documents meets them by broadcast; and the texts move once, to meet the positions of their dropped lines.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"), F.xxhash64(body).alias("fp"))
    lines = checkpoint(_hashed(rows.filter(F.col("doc_id").isNotNull()), min_points))
    once = lines.select("h1", "h2", "doc_id").distinct()
    often = once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("owner")).filter(F.col("n") >= min_docs)
    drop = skew_join(lines, checkpoint(often), ["h1", "h2"], "n", "inner").filter(F.col("doc_id") != F.col("owner"))
    drops = drop.groupBy("doc_id", "fp").agg(F.collect_set("pos").alias("drop"))
    held = rows.join(drops, ["doc_id", "fp"], "left").select("doc_id", F.split("body", "\n", -1).alias("raw"), "drop")
    left = F.array_except(F.sequence(F.lit(0), F.size("raw") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("raw")).otherwise(F.transform(left, lambda i: F.get("raw", i)))
    return held.select("doc_id", F.size("raw").alias("n"), kept.alias("kept")).select(
        "doc_id",
        F.col("n").cast("long").alias("n_lines"),
        (F.col("n") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"),
    )
