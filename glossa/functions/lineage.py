"""Checkpoints in the shared folder, joins on skewed keys, and distributed ranks and components."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def plain_unions(spark: SparkSession) -> None:
    """Lets a union claim no partitioning.

    Spark 4.1.2 lets a union of inputs that are partitioned alike claim their partitioning, though it has the sum of their partitions; joins
    above it were seen to fail, or to repeat rows.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialises ``df`` and cuts its lineage, in the session's ``spark.checkpoint.dir``."""
    plain_unions(df.sparkSession)
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the context's own setting.

    Without either, one machine (a local master, as in tests) gets a temporary folder; a cluster's executors could not read one another's.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="glossa-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Each wanted name, with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key that more rows than this meet is joined by broadcast instead of in one task; there are MAX_HOT such keys at most.
HOT_ROWS, MAX_HOT = 1000, 100_000


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, which has one row per key and in ``weight`` the number of rows of ``left`` that meet it.

    Keys with more than ``HOT_ROWS`` rows, or a ``MAX_HOT``-th of all if that is more, are broadcast: so there are ``MAX_HOT`` of them at
    most, however large the tables are. The rows of the other keys are shuffled. ``how``: left or inner. Both sides are read more than
    once, so they should be checkpoints.
    """
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    limit = max(HOT_ROWS, total // MAX_HOT)
    hot = right.filter(F.col(weight) > limit)
    if hot.isEmpty():
        return left.join(right, keys, how)
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.filter(F.col(weight) <= limit), keys, how)
    return left.join(F.broadcast(hot), keys).select(*cold.columns).unionByName(cold)


def hash_rank(df: DataFrame, digest: Column, name: str = "rank") -> DataFrame:
    """Rows with their 0-based rank by a hex digest, without sorting the table in one task.

    Rows are counted per four-digit prefix; the prefix sums of those 65536 counts give each prefix its first rank.
    """
    digest_, cell, n, first = free_names(df, "digest", "cell", "n_cell", "first_rank")
    rows = df.withColumn(digest_, digest).withColumn(cell, F.substring(digest_, 1, 4))
    before = Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(cell).agg(F.count(F.lit(1)).alias(n)).select(cell, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    within = F.row_number().over(Window.partitionBy(cell).orderBy(digest_))
    ranked = rows.join(F.broadcast(cells), cell).withColumn(name, (F.col(first) + within - 1).cast("long"))
    return ranked.drop(cell, first, digest_)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), root the smallest node reachable: alternating stars until nothing changes.

    Where there are enough edges for a hub to matter, nodes with very many are broadcast to their edges instead of joined in one task.
    """
    edges = checkpoint(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    about = [F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))]
    state = edges.agg(*about).first()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("c")).select("a", F.least("a", "m").alias("m"), "c")
        met = skew_join(both, checkpoint(low), ["a"], "c", "inner") if state[0] > MAX_HOT else both.join(low, "a")
        up = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = checkpoint(down.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(*about).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
