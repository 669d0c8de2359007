"""URL filters: a blocked Bloom filter passes possible hits of listed URLs to an exact join (DataFrame functions only).

A list entry is a (host, path) prefix: it fits its host and all subdomains where the URL's path starts with its path. The
canonical key of an entry is ``host`` + ``path``. A URL could be listed under any of its host suffixes
with any of the listed path lengths; those keys are tested in a register-blocked Bloom filter (a key picks one 64-bit block
and ``N_BITS`` bits in it), and only the keys that pass go to the exact join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.lineage import skew_join
from glossa.llm._common import ascii_lower, checkpoint

N_BITS = 4
BITS_PER_KEY = 16
#: A filter of up to this many blocks is broadcast (16 bytes a block, and the overhead of a hash table); a larger one is joined.
BROADCAST_BLOCKS = 1 << 17
#: A list of up to this many entries is broadcast to the exact hash join; a larger one is shuffled to it.
BROADCAST_ENTRIES = 100_000


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(n_blocks))


def _mask(key: Column) -> Column:
    h = F.xxhash64(F.lit("bits"), key)
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(N_BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def bloom_filter(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """Blocks (block, bits) of the filter, and how many blocks there may be."""
    n_blocks = max(1, n_keys * BITS_PER_KEY // 64 + 1)
    return keys.groupBy(_block(F.col(key), n_blocks).alias("block")).agg(F.bit_or(_mask(F.col(key))).alias("bits")), n_blocks


def listed(spark: SparkSession, entries: list[tuple[str, str, str]]) -> DataFrame:
    """A list (verdict, host, path) as a DataFrame."""
    names = ("verdict", "host", "path")
    rows = F.array(*[F.struct(*[F.lit(x).cast("string").alias(c) for c, x in zip(names, e, strict=True)]) for e in entries])
    return spark.range(1).select(F.inline(rows.cast("array<struct<verdict: string, host: string, path: string>>")))


def url_filter(
    pages: DataFrame, entries: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per input row: page_id, host, path, rule (host + path of the longest entry that fits, else null), verdict.

    entries: verdict, host, path, one row per (host, path); of repeated entries the smallest verdict counts. The longest is
    the one with the longest host, then the longest path. A null URL, or one without ``://``, has an empty host and
    path and fits nothing but an entry with an empty host and a path of that kind. Repeated pages each get their
    row; an empty table or an empty list is fine; other columns are ignored. Long URLs count whole: of a host only the suffixes
    with as many labels as some entry are made, of a path only the prefixes as long as some entry's.
    """
    want = entries.filter(F.col("host").isNotNull() & F.col("path").isNotNull())
    want = want.groupBy("host", "path").agg(F.min("verdict").alias("entry_verdict")).withColumn("key", F.concat_ws("\x00", "host", "path"))
    labels = F.char_length("host") - F.char_length(F.replace("host", F.lit("."))) + 1
    shape = want.agg(F.count(F.lit(1)), F.sort_array(F.collect_set(F.char_length("path"))), F.sort_array(F.collect_set(labels))).first()
    blocks, n_blocks = bloom_filter(want, "key", shape[0])

    rows = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    counts = F.filter(F.array(*[F.lit(k) for k in shape[2]]).cast("array<int>"), lambda k: k <= labels)
    suffixes = F.transform(counts, lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    lengths = F.filter(F.array(*[F.lit(n) for n in shape[1]]).cast("array<int>"), lambda n: n <= F.char_length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.concat_ws("\x00", s, F.substring(F.col("path"), 1, n)))))
    rows = checkpoint(rows)
    places = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    asked = places.select("host", "path", "n", F.explode(keys).alias("key"))
    asked = asked.withColumn("block", _block(F.col("key"), n_blocks)).withColumn("mask", _mask(F.col("key")))
    possible = asked.join(F.broadcast(blocks) if n_blocks <= BROADCAST_BLOCKS else blocks, "block").filter(F.col("mask").bitwiseAND(F.col("bits")) == F.col("mask"))
    exact = want.select("key", "entry_verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    hits = possible.join(F.broadcast(exact) if shape[0] <= BROADCAST_ENTRIES else exact.hint("shuffle_hash"), "key")
    order = F.struct(F.char_length("rule_host"), F.char_length("rule_path"))
    best = hits.groupBy("host", "path", "n").agg(
        F.max(F.struct(order.alias("o"), F.concat("rule_host", "rule_path").alias("rule"), F.col("entry_verdict").alias("v"))).alias("best")
    )
    return skew_join(rows, checkpoint(best), ["host", "path"], "n").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict")
    )
