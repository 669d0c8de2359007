"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.lineage import checkpoint, plain_unions

__all__ = ["ASCII_SPACE", "UPPER", "ascii_lower", "checkpoint", "crc_bucket", "shuffle_partitions", "table"]

#: Fixed value: the characters of ``[\x20\x09-\x0D]``.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII values take the cheaper built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def shuffle_partitions(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Partitions for a hand-made exchange: the session's setting, or more if the input's size asks for it."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = -(-size // bytes_each) if size < 1 << 54 else 0  # larger: not known to the planner
    return int(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), wanted))


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))
