"""Queries of adapters, validation and artifacts over rows derived from the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import validate
from glossa.plans.corpus import corpus, gold, table
from glossa.plans.q_extract import sql
from glossa.sources import annotations as an
from glossa.sources import sinks


def tagged(s: SparkSession, d: str) -> DataFrame:
    """All words of every text with labels by a word's place and length."""
    c = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)).alias("tokens")).filter("size(tokens) > 0")
    k = lambda x, i: (F.length(x) * 7 + i) % 11
    label = lambda x, i: F.when(k(x, i) == 2, "B-short").when(k(x, i) == 3, "I-short").when(k(x, i) == 5, "B-long").when(k(x, i) == 6, "I-long").otherwise("O")
    return c.withColumn("labels", F.transform("tokens", label))


def acronyms(s: SparkSession, d: str) -> DataFrame:
    return tagged(s, d).select("document_id", "tokens", F.pmod("document_id", F.lit(9)).alias("acronym"), F.get("tokens", F.lit(0)).alias("expansion"))


def entities(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Line items as entities of their orders, some ids repeated, and relations between them, some to ids that aren't there."""
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    i = F.col("l_linenumber")
    role = F.when(F.col("p") % 10 == 9, "other").when(i % 2 == 1, "short").otherwise("long")
    e = li.select(F.col("l_orderkey").alias("document_id"), i.cast("long").alias("ord"), F.concat(F.lit("T"), F.when(F.col("p") % 13 == 0, F.lit(1)).otherwise(i).cast("string")).alias("id"), role.alias("role"), (i * 10).cast("long").alias("s"), (i * 10 + 5).cast("long").alias("e"))
    r = li.filter((F.col("l_orderkey") % 3 != 0) & (i % 2 == 1)).select(F.col("l_orderkey").alias("document_id"), i.cast("string").alias("k"), F.concat(F.lit("T"), i.cast("string")).alias("short_id"), F.concat(F.lit("T"), (i + 1).cast("string")).alias("long_id"))
    return e, r


def turns(s: SparkSession, d: str) -> DataFrame:
    """Turns as passages, each at the joined length of those before it less one, so that neighbours overlap by a character."""
    from pyspark.sql import Window

    c = table(s, d, "conversations").groupBy("conv_id", "turn").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    before = F.coalesce(F.sum(F.length("text") - 1).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("i"), F.greatest(before, F.lit(0)).cast("long").alias("offset"), "text")


def snapshot_pairs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = corpus(s, d).filter("kind IS NOT NULL").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    pairs = gold(s, d).select(F.col("doc_id").alias("document_id"), F.lit(0).alias("pair"), "sf", "lf", F.array(F.lit(0), F.lit(1)).alias("passages"))
    return pairs, lines


def captured(s: SparkSession, d: str) -> DataFrame:
    g = gold(s, d)
    return g.withColumn("sf", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "sf")).otherwise(F.col("sf"))).withColumn("lf", F.when(F.col("doc_id") % 4 == 0, F.concat("lf", F.lit("\n"))).otherwise(F.col("lf")))


def crossing(s: SparkSession, d: str) -> DataFrame:
    g = gold(s, d).select("doc_id", "ss", "se", "ls", "le")
    shifted = g.filter("doc_id % 3 = 0").select("doc_id", "ss", "se", (F.col("ls") + 2).alias("ls"), "le")
    half = g.filter("doc_id % 5 = 0").select("doc_id", "ss", "se", F.lit(None).cast("long").alias("ls"), F.lit(None).cast("long").alias("le"))
    out = g.filter("doc_id % 7 = 0").select("doc_id", "ss", (F.col("se") + 1_000_000).alias("se"), "ls", "le")
    return g.unionByName(shifted).unionByName(half).unionByName(out)


def diagnostics(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select(F.when(F.col("event_id") % 4 == 0, "warning").otherwise("info").alias("severity"), F.col("event_type").alias("code"), F.when(F.col("event_id") % 3 == 0, "dropped").alias("action"))


def documents(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = corpus(s, d).select(F.col("doc_id").cast("string").alias("document_id"), "text")
    return c, gold(s, d).withColumn("document_id", F.col("doc_id").cast("string")).drop("doc_id")




QUERIES = {
    "bio_tags_to_spans": lambda s, d: an.bio_tags(tagged(s, d)).withColumn("text", F.sha2("text", 256)),
    "acronym_tokens": lambda s, d: an.acronym_tokens(acronyms(s, d)).drop("text"),
    "relation_pairing": lambda s, d: an.pair_entities(*entities(s, d))[0],
    "relation_diagnostics": lambda s, d: an.pair_entities(*entities(s, d))[1],
    "role_normalise": lambda s, d: table(s, d, "conversations").groupBy(an.role(F.when(F.col("turn") % 3 == 0, "Short_Form").when(F.col("turn") % 3 == 1, F.col("role")).otherwise(F.lit("Expansion")), F.concat(F.lit("sf"), "turn")).alias("role")).agg(F.count(F.lit(1)).alias("n")),
    "passage_render": lambda s, d: an.render(turns(s, d))[0],
    "snapshot_mapping": lambda s, d: an.map_in_passages(*snapshot_pairs(s, d)),
    "trim_repair": lambda s, d: validate.trim_captured(captured(s, d), corpus(s, d))[0],
    "trim_repairs_logged": lambda s, d: validate.trim_captured(captured(s, d), corpus(s, d))[1],
    "validate_overlaps": lambda s, d: validate.check_annotations(crossing(s, d), corpus(s, d)),
    "diagnostics_summary": lambda s, d: validate.summary(diagnostics(s, d)),
    "duplicate_ids": lambda s, d: validate.repeated_ids(table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"))),
    "replay_select": lambda s, d: validate.replay_select(table(s, d, "lineitem").select("l_partkey", "l_suppkey"), table(s, d, "lineitem").select("l_partkey", (F.col("l_suppkey") + F.col("l_partkey") % 2).alias("l_suppkey")), ["l_partkey", "l_suppkey"]),
    "dataset_fingerprint": lambda s, d: sinks.fingerprint(corpus(s, d), "text").select("n"),
    "canonical_rows": lambda s, d: sinks.canonical_rows(*documents(s, d)).select("document_id", F.get_json_object("value", "$.document.text").alias("text"), F.get_json_object("value", "$.gold_annotations[0].short_form.start").cast("long").alias("ss")),
    "html_report": lambda s, d: sinks.html_rows(gold(s, d).select("doc_id", F.lit("fn").alias("status"), F.col("lf").alias("context"))),
}

TOKENS = r"""tk AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS ts FROM documents),
lb AS (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM tk WHERE len(ts) > 0),
ls AS (SELECT doc_id, i, (length(ts[i]) * 7 + i - 1) % 11 AS k, length(ts[i]) AS n, array_to_string(ts, ' ') AS text FROM lb),
lo AS (SELECT *, (sum(n + 1) OVER (PARTITION BY doc_id ORDER BY i) - n - 1)::BIGINT AS p FROM ls)"""
ENT = """li AS (SELECT l_orderkey AS d, l_linenumber AS i, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
en AS (SELECT d, i, 'T' || CASE WHEN p % 13 = 0 THEN 1 ELSE i END AS id, CASE WHEN p % 10 = 9 THEN 'other' WHEN i % 2 = 1 THEN 'short' ELSE 'long' END AS role, (i * 10)::BIGINT AS s, (i * 10 + 5)::BIGINT AS e FROM li),
re AS (SELECT d, 'T' || i AS si, 'T' || (i + 1) AS li FROM li WHERE d % 3 <> 0 AND i % 2 = 1),
o1 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY d, id) AS n FROM en) WHERE n = 1),
rr AS (SELECT re.d, a.i AS ai, a.s AS ss, a.e AS se, b.i AS bi, b.s AS ls, b.e AS le FROM re LEFT JOIN o1 a ON a.d = re.d AND a.id = si LEFT JOIN o1 b ON b.d = re.d AND b.id = re.li),
nr AS (SELECT *, row_number() OVER (PARTITION BY d, role ORDER BY i) AS k FROM en WHERE role <> 'other' AND d NOT IN (SELECT d FROM re)),
pr AS (SELECT 'relation' AS how, d, ss, se, ls, le, ai, bi FROM rr WHERE ai IS NOT NULL AND bi IS NOT NULL
  UNION ALL SELECT 'order', a.d, a.s, a.e, b.s, b.e, a.i, b.i FROM nr a JOIN nr b ON a.d = b.d AND a.k = b.k AND a.role = 'short' AND b.role = 'long'),
us AS (SELECT d, ai AS i FROM pr UNION SELECT d, bi FROM pr), rest AS (SELECT en.* FROM en LEFT JOIN us USING (d, i) WHERE us.d IS NULL)"""

ORACLE_SQL = {
    "bio_tags_to_spans": "WITH " + TOKENS + """, f AS (SELECT doc_id, max(i) FILTER (WHERE k = 2) AS si, max(i) FILTER (WHERE k = 5) AS li FROM lo GROUP BY 1),
z AS (SELECT f.*, (SELECT min(i) FROM lo WHERE lo.doc_id = f.doc_id AND i > si AND k NOT IN (2, 3, 5, 6)) AS sx, (SELECT min(i) FROM lo WHERE lo.doc_id = f.doc_id AND i > li AND k NOT IN (2, 3, 5, 6)) AS lx FROM f)
SELECT z.doc_id AS document_id, sha256(t.text) AS text, a.p AS ss, CASE WHEN si IS NOT NULL THEN coalesce(c.p - 1, length(t.text)) END AS se, b.p AS ls, CASE WHEN li IS NOT NULL THEN coalesce(e.p - 1, length(t.text)) END AS le
FROM z JOIN (SELECT DISTINCT doc_id, text FROM lo) t USING (doc_id) LEFT JOIN lo a ON a.doc_id = z.doc_id AND a.i = si LEFT JOIN lo b ON b.doc_id = z.doc_id AND b.i = li LEFT JOIN lo c ON c.doc_id = z.doc_id AND c.i = sx LEFT JOIN lo e ON e.doc_id = z.doc_id AND e.i = lx""",
    "acronym_tokens": "WITH " + TOKENS + " SELECT lo.doc_id AS document_id, p AS ss, p + n AS se, ts[1] AS lf FROM lo JOIN tk USING (doc_id) WHERE i = doc_id % 9 + 1",
    "relation_pairing": "WITH " + ENT + " SELECT how, d AS document_id, ss, se, ls, le FROM pr UNION ALL SELECT 'partial', d, CASE WHEN role = 'short' THEN s END, CASE WHEN role = 'short' THEN e END, CASE WHEN role = 'long' THEN s END, CASE WHEN role = 'long' THEN e END FROM rest WHERE role <> 'other'",
    "relation_diagnostics": "WITH " + ENT + """ SELECT d AS document_id, code, count(*) AS n FROM (SELECT d, 'BIOC_DUPLICATE_ANNOTATION_ID' AS code FROM en GROUP BY d, id HAVING count(*) > 1
UNION ALL SELECT d, 'BIOC_RELATION_ENDPOINT_UNRESOLVED' FROM rr WHERE ai IS NULL OR bi IS NULL UNION ALL SELECT d, 'BIOC_UNPAIRED_ENTITY' FROM rest) GROUP BY 1, 2""",
    "role_normalise": "SELECT CASE turn % 3 WHEN 0 THEN 'short' WHEN 2 THEN 'long' ELSE 'short' END AS role, count(*) AS n FROM conversations GROUP BY 1",
    "passage_render": """WITH c AS (SELECT conv_id, turn, coalesce(min(text), '') AS text FROM conversations GROUP BY ALL),
p AS (SELECT *, greatest(coalesce(sum(length(text) - 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::BIGINT AS o FROM c),
x AS (SELECT conv_id, turn, o, text, unnest(range(1, length(text) + 1)) AS k FROM p), m AS (SELECT conv_id, o + k - 1 AS p, arg_min(text[k:k], turn) AS ch FROM x GROUP BY 1, 2)
SELECT conv_id AS document_id, string_agg(ch, '' ORDER BY p) AS text FROM m GROUP BY 1""",
    "snapshot_mapping": sql(
        "ln AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM corpus), tw AS (SELECT g.*, CASE WHEN len(l) > 1 THEN l[1] || chr(10) || l[2] ELSE l[1] END AS two, l[1] AS x, coalesce(l[2], '') AS y FROM gold g JOIN ln USING (doc_id))",
        *[f"{c}o AS (SELECT doc_id, list_concat(list_filter(range(0, length(x)), lambda i: substr(x, i + 1, length({c}f)) = {c}f), list_transform(list_filter(range(0, length(y)), lambda i: substr(y, i + 1, length({c}f)) = {c}f), lambda i: i + length(x) + 1)) AS o FROM tw)" for c in ("s", "l")],
        "mp AS (SELECT tw.doc_id, sf, lf, CASE WHEN len(so.o) = 1 AND len(lo.o) = 1 THEN so.o[1] END AS ss, CASE WHEN len(so.o) = 1 AND len(lo.o) = 1 THEN lo.o[1] END AS ls FROM tw JOIN so ON so.doc_id = tw.doc_id JOIN lo ON lo.doc_id = tw.doc_id)",
        select="SELECT doc_id AS document_id, 0 AS pair, ss, ss + length(sf) AS se, ls, ls + length(lf) AS le, CASE WHEN ss IS NULL THEN 'unmapped' ELSE 'mapped' END AS status FROM mp",
    ),
    "trim_repair": sql(select="SELECT doc_id, ss, se, ls, le, sf, lf FROM gold"),
    "trim_repairs_logged": sql(select="SELECT doc_id, 'short' AS side FROM gold WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'long' FROM gold WHERE doc_id % 4 = 0"),
    "validate_overlaps": sql(
        "an AS (SELECT doc_id, ss, se, ls, le FROM gold UNION ALL SELECT doc_id, ss, se, ls + 2, le FROM gold WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, ss, se, NULL, NULL FROM gold WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, ss, se + 1000000, ls, le FROM gold WHERE doc_id % 7 = 0)",
        "av AS (SELECT an.*, (ss < 0 OR ss > se OR se > length(text)) OR coalesce(ls < 0 OR ls > le OR le > length(text), false) AS bad FROM an JOIN (SELECT doc_id, text FROM corpus) USING (doc_id))",
        "wh AS (SELECT * FROM av WHERE NOT bad AND ls IS NOT NULL)",
        select="""SELECT doc_id, ss, se, ls, le, CASE WHEN bad THEN 'invalid' WHEN ls IS NULL THEN 'unscoreable' WHEN EXISTS (SELECT 1 FROM wh o WHERE o.doc_id = a.doc_id AND (o.ss, o.se, o.ls, o.le) <> (a.ss, a.se, a.ls, a.le)
AND ((a.ss < o.se AND o.ss < a.se) OR (a.ls < o.le AND o.ls < a.le) OR (a.ss < o.le AND o.ls < a.se) OR (a.ls < o.se AND o.ss < a.le))) THEN 'ambiguous' ELSE 'ok' END AS verdict FROM av a""",
    ),
    "diagnostics_summary": "SELECT severity, code, action, count(*) AS n, grouping(severity, code, action)::BIGINT AS level FROM (SELECT CASE WHEN event_id % 4 = 0 THEN 'warning' ELSE 'info' END AS severity, event_type AS code, CASE WHEN event_id % 3 = 0 THEN 'dropped' END AS action FROM events) GROUP BY ROLLUP (severity, code, action)",
    "duplicate_ids": "SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1",
    "replay_select": "WITH r AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL), w AS (SELECT DISTINCT l_partkey, l_suppkey + l_partkey % 2 AS l_suppkey FROM lineitem) SELECT w.*, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'found' END AS status FROM w LEFT JOIN r USING (l_partkey, l_suppkey)",
    "dataset_fingerprint": "SELECT count(*) AS n FROM documents",
    "canonical_rows": sql(select="SELECT doc_id::VARCHAR AS document_id, text, ss FROM corpus"),
    "html_report": sql(select="SELECT '<tr><td>' || doc_id || '</td><td>fn</td><td>' || lf || '</td></tr>' AS value FROM gold"),
}
