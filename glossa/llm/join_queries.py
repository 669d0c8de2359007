"""Queries of the operators that exchange hashes of words: the Jaccard join, with its SQL, and the language model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from glossa.llm._common import crc_bucket, table
from glossa.llm.jaccard_join import jaccard_join
from glossa.llm.lm_scoring import lm_scores


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), crc_bucket(F.col("doc_id"), 5) == 1)


QUERIES = {"op7_lm_scoring": op7_lm_scoring, "op10_jaccard_join": op10_jaccard_join}

ORACLE_SQL = {
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
often AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM e a JOIN often USING (x) JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * b.n >= 80 * a.n AND 100 * a.n >= 80 * b.n GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
r AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a),
m AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id FROM s JOIN m ON m.node = s.doc_id""",
}
