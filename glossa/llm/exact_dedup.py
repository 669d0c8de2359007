"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is cut where its own content says so: a chunk runs at least ``MIN_CHUNK`` characters and ends at the next
boundary pair, or at ``MAX_CHUNK`` characters if none comes. Equal texts have equal chunks, and an edit moves only the
chunks around it. Each chunk gets a 64-bit identifier. Identifiers are verified against SHA-256 digests over the whole
corpus: should two different chunks share one, they are told apart by an ordinal. A text's recipe is the
ordered list of its verified identifiers, and recipes, not texts, are grouped and compared, so a text is read once, by
the scan, and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.lineage import free_names, skew_join
from glossa.llm._common import checkpoint

MIN_CHUNK, MAX_CHUNK = 256, 4096
#: Rows that ``drop_copies`` drops are broadcast (about 50 bytes each) up to this many, as a count has checked.
BROADCAST_ROWS = 500_000
#: A chunk may end after a line end, or between words at a mark that is met about once in 300 characters of prose, so that chunks fall in
#: step again soon after an edit.
BOUNDARY = "\\n|[aeiou][dlmr] (?=[aeiou])"


def chunks(text: Column, low: int = MIN_CHUNK, high: int = MAX_CHUNK) -> Column:
    """The content-defined chunks of a non-null text, in order; they concatenate to it. Empty text: no chunk."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?:.{{{low},{high - 2}}}?(?:{BOUNDARY})|.{{1,{high}}})"), F.lit(0))


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One checkpointed row per input row: uid, doc_id, text_sha256, chunks array<struct<h, sha>>."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"))
    piece = F.transform(chunks(F.col("body")), lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("sha")))
    return checkpoint(
        rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.sha2("body", 256).alias("text_sha256"), piece.alias("chunks"))
    )


def chunk_store(recipe_rows: DataFrame) -> DataFrame:
    """Distinct chunks (h, sha, n_uses) over all documents."""
    return recipe_rows.select(F.explode("chunks").alias("c")).groupBy("c.h", "c.sha").agg(F.count(F.lit(1)).alias("n_uses"))


def _with_verified_ids(rows: DataFrame) -> DataFrame:
    """Adds ``recipe``, the ordered verified identifiers."""
    store = chunk_store(rows)
    shared = store.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("sha").alias("first")).filter("n > 1").select("h", "first")
    if shared.isEmpty():  # as ever but for about one pair in 2^64: each identifier stands for one chunk
        return rows.withColumn("recipe", F.col("chunks.h"))
    apart = rows.select("uid", F.posexplode("chunks").alias("pos", "c")).select("uid", "pos", "c.h", "c.sha").join(shared, "h", "left")
    # different chunks under one identifier: all but the first take the identifier of their digest
    own = F.when(F.col("first").isNull() | (F.col("first") == F.col("sha")), F.col("h")).otherwise(F.xxhash64(F.lit("apart"), "sha"))
    lists = apart.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pos", own.alias("id")))).getField("id").alias("recipe"))
    return rows.join(lists, "uid", "left").withColumn("recipe", F.coalesce("recipe", F.array().cast("array<bigint>")))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when their recipes are; a null text counts as empty. Of equal texts the row with the largest doc_id
    stays (a null doc_id is smaller than any); of rows that repeat that doc_id exactly one stays. ``group_size``
    counts rows. Long texts are cut into chunks of ``MAX_CHUNK`` characters at most. An empty table gives an empty
    result; other input columns are ignored.

    Recipes are compared once, in the grouping, which starts before the exchange; a group's decision travels back to its rows by
    key and digest, and that of a group with very many rows by broadcast.
    """
    return _decided(docs, doc_id, text).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_chunks")


def _decided(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = _with_verified_ids(recipes(docs, doc_id, text)).withColumn("key", F.xxhash64("recipe"))
    best = F.max(F.struct("doc_id", "uid"))
    groups = rows.groupBy("key", "recipe").agg(best.alias("best"), F.count(F.lit(1)).alias("n"), F.min("text_sha256").alias("text_sha256")).filter("n > 1")
    slim = rows.select("uid", "doc_id", "key", "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))
    joined = skew_join(slim, checkpoint(groups.select("key", "text_sha256", "best", "n")), ["key", "text_sha256"], "n")
    alone = F.col("n").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.uid") == F.col("uid"))).alias("kept"),
        "text_sha256",
        "n_chunks",
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns, whatever their names.

    Null counts as empty text and one such row stays; of rows with one doc_id and text (or no doc_id, if no copy has one), one stays. Long
    texts count whole. An empty table gives an empty table. Texts stay where they are: the dropped (doc_id, digest) pairs
    go to them by broadcast, as long as these are ``BROADCAST_ROWS`` at most, and by a join beyond.
    """
    flags = checkpoint(_decided(docs, doc_id, text).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    digest, gone_id, gone_sha = free_names(docs, "digest", "gone_id", "gone_sha")

    def there(found: DataFrame):
        named = found.select(F.col("doc_id").alias(gone_id), F.unhex("text_sha256").alias(gone_sha))
        few = found.count() <= BROADCAST_ROWS
        return F.broadcast(named) if few else named, F.col(doc_id).eqNullSafe(F.col(gone_id)) & (F.col(digest) == F.col(gone_sha))

    rows = docs.withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    left = rows.join(*there(flags.filter("NOT kept")), "left_anti")
    repeats = flags.filter("kept AND n > 1")
    if not repeats.isEmpty():
        seen = there(repeats)
        left = left.join(*seen, "left_anti").unionByName(left.join(*seen, "left_semi").dropDuplicates([doc_id, digest]))
    return left.drop(digest)
