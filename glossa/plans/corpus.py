"""The derived corpus: ``documents`` with a definition made from their first words put before the whole text, and its gold spans.

The driver's tables hold no abbreviation definitions, so the text operators run on this construction, which Spark and SQL build alike.
Eight forms, by doc_id: after the long form, reversed, a false parenthesis, with boundary noise, in brackets, nested, a table row,
and with later mentions. Some heads have a letter whose lower-case form is longer before the long form, a string that overlaps itself, or the
characters that end a quotation in a pattern. Texts of fewer than 14 words stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.lineage import plain_unions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; texts in fewer splits than half the cores (one small file) are dealt over all cores, larger inputs stay as they are read."""
    plain_unions(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "documents" and df.rdd.getNumPartitions() * 2 <= cores:
        df = df.repartition(cores)
    return df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, kind, sf, lf, ss, se, ls, le, source, lang; the spans are null where there is no definition."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"), "source", "lang")
    words = lambda c: F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))
    # fifteen words in the first characters settle the first fourteen; otherwise the whole text is read
    head = words(F.substring("body", 1, 400))
    w = d.withColumn("w", F.slice(F.when(F.size(head) >= 15, head).otherwise(words(F.col("body"))), 1, 14))
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    odd = lambda k, x: F.when(F.col("doc_id") % 5 == k, x).otherwise("")
    full = F.size("w") >= 14
    w = w.select(
        "doc_id", "body", "source", "lang", F.when(full, F.pmod("doc_id", F.lit(8))).cast("int").alias("kind"),
        F.concat(part(1, 5), odd(0, " İİ")).alias("pre"), part(6, 3).alias("lf"), F.concat(part(9, 6), odd(1, " axaxaxa"), odd(2, " \\E1")).alias("post"),
        F.upper(F.array_join(F.transform(F.slice("w", 6, 3), lambda x: F.substring(x, 1, 1)), "")).alias("sf"),
    )
    form = F.expr("""CASE kind
        WHEN 0 THEN concat(pre, ' ', lf, ' (', sf, ') ', post) WHEN 1 THEN concat(pre, ' ', sf, ' (', lf, ') ', post)
        WHEN 2 THEN concat(pre, ' ', lf, ' (n = 3) ', post) WHEN 3 THEN concat(pre, ' the ', lf, ' ( ', sf, ' ), ', post, ' (', sf, 'X)')
        WHEN 4 THEN concat(pre, ' ', lf, ' [', sf, '] ', post) WHEN 5 THEN concat(pre, ' (', lf, ' (', sf, ')) ', post)
        WHEN 6 THEN concat(sf, '\t', lf, '\n', pre, ' ', post)
        WHEN 7 THEN concat(pre, ' ', lf, ' (', sf, ') ', post, ' ', sf, ' and ', pre, ' (', sf, ') ', sf) END""")
    w = w.withColumn("n", F.length("pre").cast("long")).withColumn("m", F.length("lf").cast("long")).withColumn("k", F.length("sf").cast("long"))
    ls = F.expr("CASE kind WHEN 0 THEN n + 1 WHEN 1 THEN n + k + 3 WHEN 3 THEN n + 5 WHEN 4 THEN n + 1 WHEN 5 THEN n + 2 WHEN 6 THEN k + 1 WHEN 7 THEN n + 1 END")
    ss = F.expr("CASE kind WHEN 0 THEN n + m + 3 WHEN 1 THEN n + 1 WHEN 3 THEN n + m + 8 WHEN 4 THEN n + m + 3 WHEN 5 THEN n + m + 4 WHEN 6 THEN 0 WHEN 7 THEN n + m + 3 END")
    w = w.withColumn("ls", ls.cast("long")).withColumn("ss", ss.cast("long"))
    there = F.col("ss").isNotNull()
    made = F.struct(
        F.when(F.col("kind").isNull(), F.col("body")).otherwise(F.concat(form, F.lit("\n"), "body")).alias("text"), "kind", F.when(there, F.col("sf")).alias("sf"), F.when(there, F.col("lf")).alias("lf"),
        "ss", (F.col("ss") + F.col("k")).alias("se"), "ls", (F.col("ls") + F.col("m")).alias("le"),
    )
    # a generator of one row: conditions on what was made are tested on it, and not by making it again before
    return w.select("doc_id", "source", "lang", F.inline(F.array(made)))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ss, se, ls, le, sf, lf of the definitions that are there."""
    return corpus(spark, sf_dir).filter("ss IS NOT NULL").select("doc_id", "ss", "se", "ls", "le", "sf", "lf")


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sf_raw, lf_raw, sf_key, lf_key, n: how often a pair is defined in the corpus."""
    pairs = gold(spark, sf_dir).groupBy(F.col("sf").alias("sf_raw"), F.col("lf").alias("lf_raw")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.select("sf_raw", "lf_raw", F.lower("sf_raw").alias("sf_key"), F.lower("lf_raw").alias("lf_key"), "n")


#: DuckDB: common table expressions for the corpus, its gold definitions, the lexicon and the parentheses.
CORPUS = r"""
c0 AS (SELECT doc_id, coalesce(text, '') AS body, source, lang, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')[1:14] AS w FROM documents),
c1 AS (SELECT doc_id, body, source, lang, CASE WHEN len(w) >= 14 THEN (doc_id % 8)::INT END AS kind, array_to_string(w[1:5], ' ') || CASE WHEN doc_id % 5 = 0 THEN ' İİ' ELSE '' END AS pre,
  array_to_string(w[6:8], ' ') AS lf, array_to_string(w[9:14], ' ') || CASE doc_id % 5 WHEN 1 THEN ' axaxaxa' WHEN 2 THEN ' \E1' ELSE '' END AS post,
  upper(array_to_string(list_transform(w[6:8], lambda x: x[1:1]), '')) AS sf FROM c0),
c2 AS (SELECT *, length(pre) AS n, length(lf) AS m, length(sf) AS k, CASE kind
  WHEN 0 THEN concat(pre, ' ', lf, ' (', sf, ') ', post) WHEN 1 THEN concat(pre, ' ', sf, ' (', lf, ') ', post)
  WHEN 2 THEN concat(pre, ' ', lf, ' (n = 3) ', post) WHEN 3 THEN concat(pre, ' the ', lf, ' ( ', sf, ' ), ', post, ' (', sf, 'X)')
  WHEN 4 THEN concat(pre, ' ', lf, ' [', sf, '] ', post) WHEN 5 THEN concat(pre, ' (', lf, ' (', sf, ')) ', post)
  WHEN 6 THEN concat(sf, chr(9), lf, chr(10), pre, ' ', post)
  WHEN 7 THEN concat(pre, ' ', lf, ' (', sf, ') ', post, ' ', sf, ' and ', pre, ' (', sf, ') ', sf) END AS head FROM c1),
c3 AS (SELECT *, CASE kind WHEN 0 THEN n + 1 WHEN 1 THEN n + k + 3 WHEN 3 THEN n + 5 WHEN 4 THEN n + 1 WHEN 5 THEN n + 2 WHEN 6 THEN k + 1
  WHEN 7 THEN n + 1 END AS ls, CASE kind WHEN 0 THEN n + m + 3 WHEN 1 THEN n + 1 WHEN 3 THEN n + m + 8 WHEN 4 THEN n + m + 3 WHEN 5 THEN n + m + 4
  WHEN 6 THEN 0 WHEN 7 THEN n + m + 3 END AS ss FROM c2),
corpus AS (SELECT doc_id, CASE WHEN kind IS NULL THEN body ELSE concat(head, chr(10), body) END AS text, kind, source, lang,
  CASE WHEN ss IS NOT NULL THEN sf END AS sf, CASE WHEN ss IS NOT NULL THEN lf END AS lf, ss, ss + k AS se, ls, ls + m AS le FROM c3),
gold AS (SELECT doc_id, ss, se, ls, le, sf, lf FROM corpus WHERE ss IS NOT NULL),
lexicon AS (SELECT sf AS sf_raw, lf AS lf_raw, lower(sf) AS sf_key, lower(lf) AS lf_key, count(*) AS n FROM gold GROUP BY sf, lf)"""

PARENS = r"""
pa0 AS (SELECT doc_id, text, string_split(text, '(') AS parts FROM corpus WHERE contains(text, '(')),
pa1 AS (SELECT doc_id, text, parts, unnest(range(2, len(parts) + 1)) AS i FROM pa0),
parens AS (SELECT doc_id, text, (list_sum(list_transform(parts[1:i - 1], lambda x: length(x) + 1)) - 1)::BIGINT AS open,
  string_split(parts[i], ')')[1] AS content FROM pa1 WHERE contains(parts[i], ')'))"""

#: DuckDB: the last words before an offset, as ``last_words``; needs a relation ``q`` with text, before and most.
WINDOW = r"""
lw0 AS (SELECT *, reverse(substr(text, 1, before)) AS back FROM q),
lw1 AS (SELECT *, regexp_extract(back, concat('^[^A-Za-z0-9]*([A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*(?:[^A-Za-z0-9]+[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*){0,',
  most - 1, '})'), 1) AS wback, length(regexp_extract(back, '^[^A-Za-z0-9]*')) AS skipped FROM lw0),
lw AS (SELECT * EXCLUDE (back, wback, skipped), reverse(wback) AS win, before - skipped AS wend, before - skipped - length(wback) AS wstart FROM lw1 WHERE wback <> '')"""
