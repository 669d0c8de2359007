"""Queries of the operators that are DataFrame plans from end to end, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossa.llm._common import table
from glossa.llm.exact_dedup import exact_dedup
from glossa.llm.line_dedup import line_dedup
from glossa.llm.mixing import mix
from glossa.llm.url_filter import listed, url_filter
from pyspark.sql import functions as F

#: The rules of op8 (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), listed(spark, URL_RULES))


QUERIES = {
    "op2_line_dedup": op2_line_dedup,
    "op3_mixing": op3_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op8_url_filter": op8_url_filter,
}

ORACLE_SQL = {
    "op2_line_dedup": r"""
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM raw),
keyed AS (SELECT doc_id, pos, line,
  translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
often AS (SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op3_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  (('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, 1.0::DOUBLE + i % 3 AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () - 0 AS total,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  row_number() OVER (ORDER BY cap / weight, i) AS place FROM w),
l AS (SELECT *, (total - capped) / open_weight AS level FROM o),
level AS (SELECT level FROM l WHERE cap >= level * weight ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM level) * weight, cap)) AS target FROM o),
p AS (SELECT *, least(floor(target / nullif(source_size, 0) + 1e-12), 3) AS whole FROM t),
r AS (SELECT *, greatest(target - whole * source_size, 0) AS rest FROM p),
q AS (SELECT d.*, r.source_size, r.target, coalesce(r.whole, 0) AS whole, r.rest,
  (u / (1 - u)) / (least(rest / r.source_size, 1 - 1e-12) / (1 - least(rest / r.source_size, 1 - 1e-12))) AS q
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM q)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (size * (whole + CASE WHEN size > 0 AND rest > 0 AND whole < 3 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c""",
    "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)""",
    "op8_url_filter": r"""
WITH rules(verdict, host, path) AS (VALUES ('allow','com','/'),('block','example.com','/en/'),('allow','www.example.com','/en/'),
  ('block','net','/es/'),('block','net','/fr/')),
u AS (SELECT page_id, CASE WHEN contains(coalesce(url,''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host) DESC NULLS LAST, length(r.path) DESC NULLS LAST) AS n
  FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1""",
}
