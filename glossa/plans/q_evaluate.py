"""Queries of matching, metrics and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import evaluate as e
from glossa.operators import extract as x
from glossa.operators import reports as r
from glossa.plans.corpus import PARENS, corpus, gold, table
from glossa.plans.q_extract import JUDGED, MATCH, NESTED, OCC, PRF, REVERSE, SH, TAGS, sql

KEY = e.KEY
GRID = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]


def sh(s: SparkSession, d: str) -> DataFrame:
    return x.schwartz_hearst(corpus(s, d))


def outcomes(s: SparkSession, d: str) -> DataFrame:
    return e.exact_pair(gold(s, d), sh(s, d))


def toy(s: SparkSession, d: str) -> DataFrame:
    return x.toy(corpus(s, d))


def methods(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"sh": sh(s, d), "toy": toy(s, d), "reverse": x.reverse_order(corpus(s, d))}


def lineitems(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two bags over lineitem for matching at scale: the rows, and the rows with some quantities off by one."""
    li = table(s, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return li, li.withColumn("q", F.when(F.col("l_partkey") % 7 == 0, F.col("q") + 1).otherwise(F.col("q")))


def two_scores(s: SparkSession, d: str) -> DataFrame:
    ev = table(s, d, "events")
    part = lambda a: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(a), "event_id"), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    label = (F.col("event_id") % 3 == 0).cast("int")
    return ev.select(((part("a") + label) / 2).alias("s1"), ((part("b") + label) / 2).alias("s2"), label.alias("label"), ((part("c") + label) / 2).alias("score"))


def transfer(s: SparkSession, d: str) -> DataFrame:
    return r.offset_transfer(gold(s, d), sh(s, d).unionByName(toy(s, d), allowMissingColumns=True), corpus(s, d))


def quotes(s: SparkSession, d: str) -> DataFrame:
    g = gold(s, d)
    return g.select("doc_id", F.col("lf").alias("quote"), (F.col("ls") + F.col("doc_id") % 3).alias("s"), F.col("le").alias("e"))


def entities(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    g = gold(s, d)
    lf, sf = g.select("doc_id", F.col("lf").alias("entity")), g.select("doc_id", F.col("sf").alias("entity"))
    return sf.filter("doc_id % 2 = 0"), sh(s, d).select("doc_id", F.col("lf").alias("entity")).unionByName(sf.filter("doc_id % 4 = 0")), lf


def sides(df: DataFrame) -> DataFrame:
    return e.exact_span(df, df)


QUERIES = {
    "match_exact_pair": outcomes,
    "match_exact_span": lambda s, d: e.exact_span(gold(s, d), sh(s, d)),
    "match_bag_lineitem": lambda s, d: e.prf(e.exact_pair(*lineitems(s, d), keys=["l_partkey", "l_suppkey", "q"])),
    "prf_micro": lambda s, d: e.prf(e.exact_span(gold(s, d), sh(s, d)), ["side"]),
    "outcomes_by_doc": lambda s, d: e.by_document(outcomes(s, d)),
    "strata_pivot": lambda s, d: e.strata(outcomes(s, d).join(corpus(s, d).select("doc_id", "lang"), "doc_id"), "lang"),
    "coverage_check": lambda s, d: e.coverage(table(s, d, "documents"), table(s, d, "labels").select((F.col("doc_id") + 5).alias("doc_id"))),
    "compare_union_unique": lambda s, d: e.compare(gold(s, d), methods(s, d)),
    "bootstrap_ci": lambda s, d: e.bootstrap_ci(outcomes(s, d), table(s, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 3).cast("long").alias("group"))),
    "pair_metrics": lambda s, d: e.pair_metrics(gold(s, d).filter("ss > ls"), gold(s, d), sh(s, d).unionByName(toy(s, d), allowMissingColumns=True)),
    "recovery_outcome": lambda s, d: e.recovery(gold(s, d), sh(s, d).unionByName(toy(s, d), allowMissingColumns=True)),
    "dispositions": lambda s, d: e.dispositions(
        sh(s, d).select(*KEY, F.lit("sh").alias("method")).unionByName(toy(s, d).select(*KEY, F.lit("toy").alias("method"))), gold(s, d).filter("ss > ls"), gold(s, d)
    ),
    "baseline_delta": lambda s, d: e.baseline_delta(gold(s, d), toy(s, d), sh(s, d)),
    "endpoint_audit": lambda s, d: e.endpoint_audit(x.bracket_spans(corpus(s, d)), sh(s, d), e.recovery(gold(s, d), sh(s, d)).filter("outcome = 'exact'")),
    "endpoint_ceiling": lambda s, d: e.endpoint_ceiling(gold(s, d), x.bracket_spans(corpus(s, d))),
    "calibrate_threshold": lambda s, d: e.calibrate(two_scores(s, d), GRID),
    "calibrate_joint": lambda s, d: e.calibrate_joint(two_scores(s, d), GRID),
    "eligibility_case": lambda s, d: r.eligibility(corpus(s, d)),
    "candidate_coverage": lambda s, d: r.candidate_coverage(
        gold(s, d), {"parenthetical": x.parenthetical(corpus(s, d)), "nested": x.nested_parenthetical(corpus(s, d)), "reverse": x.reverse_order(corpus(s, d))}
    ),
    "offset_transfer": transfer,
    "agreement_class": lambda s, d: r.agreement(corpus(s, d), {"sh": sh(s, d), "toy": toy(s, d)}),
    "abbrev_tokens": lambda s, d: r.abbreviation_tokens(table(s, d, "documents")),
    "mapping_loss": lambda s, d: r.mapping_loss(gold(s, d), table(s, d, "documents")),
    "availability_prf_gates": lambda s, d: r.availability(outcomes(s, d), table(s, d, "labels").filter("toxic = 1"), {"precision": 0.9, "recall": 0.6}),
    "offset_error_patterns": lambda s, d: r.offset_errors(quotes(s, d), corpus(s, d)),
    "wilson_half_width": lambda s, d: r.wilson_half_width(table(s, d, "documents"), "source"),
    "request_plan": lambda s, d: r.request_plan(table(s, d, "documents"), "source"),
    "downstream_impact": lambda s, d: r.downstream(*entities(s, d)),
    "error_contexts": lambda s, d: r.error_contexts(outcomes(s, d), corpus(s, d)),
}

SIDES = "SELECT doc_id, unnest(['short', 'long']) AS side, unnest([ss, ls]) AS s, unnest([se, le]) AS e FROM "
TOY = r"""ty0 AS (SELECT *, reverse(substr(text, 1, open)) AS back FROM parens WHERE regexp_full_match(content, '[A-Za-z][A-Za-z0-9-]*')),
ty1 AS (SELECT *, length(regexp_extract(back, '^\s*')) AS gap, length(regexp_extract(back, '^\s*([A-Za-z0-9][A-Za-z0-9 -]*[A-Za-z])', 1)) AS n FROM ty0),
toy AS (SELECT doc_id, open + 1 AS ss, open + 1 + length(content) AS se, open - gap - n AS ls, open - gap AS le FROM ty1 WHERE n > 0)"""
BOTH = "pool AS (SELECT doc_id, ss, se, ls, le FROM sh UNION ALL SELECT * FROM toy)"


def bag(name: str, left: str, right: str, keys: str) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    some = keys.split(", ")[0]
    cols = ", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in keys.split(", "))
    return f"""{name}_a AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys}) AS rn FROM {left}), {name}_b AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys}) AS rn FROM {right}),
{name} AS (SELECT {cols}, coalesce(a.rn, b.rn) AS rn, CASE WHEN b.{some} IS NULL THEN 'fn' WHEN a.{some} IS NULL THEN 'fp' ELSE 'tp' END AS status FROM {name}_a a FULL JOIN {name}_b b ON {on} AND a.rn = b.rn)"""


K = "doc_id, ss, se, ls, le"
N = "count(*) FILTER (WHERE status = '{0}') AS {0}"
COUNTS = ", ".join(N.format(x) for x in ("tp", "fp", "fn"))


def frac(a: str, b: str, name: str) -> str:
    return f"CASE WHEN {b} > 0 THEN round(({a})::DOUBLE / ({b}), 6) ELSE 0.0::DOUBLE END AS {name}"


def prf_sql(rel: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"SELECT {g}tp, fp, fn, {frac('tp', 'tp + fp', 'precision')}, {frac('tp', 'tp + fn', 'recall')}, {frac('2 * tp', '2 * tp + fp + fn', 'f1')} FROM (SELECT {g}{COUNTS} FROM {rel} {'GROUP BY ' + by if by else ''})"


OUT = bag("o", "gold", "sh", K)
SCORES = """z AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS label, ('0x' || substr(sha256('a:' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS a,
  ('0x' || substr(sha256('b:' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS b, ('0x' || substr(sha256('c:' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS c FROM events),
y AS (SELECT label, (a + label) / 2 AS s1, (b + label) / 2 AS s2, (c + label) / 2 AS score FROM z),
grid AS (SELECT unnest([0.5::DOUBLE, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS t)"""

ORACLE_SQL = {
    "match_exact_pair": sql(PARENS, SH, OUT, select=f"SELECT {K}, status FROM o"),
    "match_exact_span": sql(PARENS, SH, f"gs AS ({SIDES} gold), ps AS ({SIDES} sh)", bag("o", "gs", "ps", "doc_id, side, s, e"), select="SELECT doc_id, side, s, e, status FROM o"),
    "match_bag_lineitem": "WITH l1 AS (SELECT l_partkey, l_suppkey, l_quantity::BIGINT AS q FROM lineitem), l2 AS (SELECT l_partkey, l_suppkey, q + (l_partkey % 7 = 0)::INT AS q FROM l1),\n" + bag("o", "l1", "l2", "l_partkey, l_suppkey, q") + "\n" + prf_sql("o"),
    "prf_micro": sql(PARENS, SH, f"gs AS ({SIDES} gold), ps AS ({SIDES} sh)", bag("o", "gs", "ps", "doc_id, side, s, e"), select=prf_sql("o", "side")),
    "outcomes_by_doc": sql(PARENS, SH, OUT, select=f"SELECT doc_id, {COUNTS}, {N.format('unscoreable')} FROM o GROUP BY doc_id"),
    "strata_pivot": sql(PARENS, SH, OUT, select=f"SELECT lang, {COUNTS}, {N.format('unscoreable')} FROM o JOIN corpus USING (doc_id) GROUP BY lang"),
    "coverage_check": """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'unknown' ELSE 'duplicate' END AS problem
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT doc_id + 5 AS doc_id, count(*) AS n FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL OR n > 1""",
    "compare_union_unique": sql(
        PARENS, SH, TOY, REVERSE, *[bag(f"o{i}", "gold", m, K) for i, m in enumerate(("sh", "toy", "rev"))],
        f"every AS (SELECT 'sh' AS method, * FROM o0 UNION ALL SELECT 'toy', * FROM o1 UNION ALL SELECT 'reverse', * FROM o2)",
        f"hit AS (SELECT {K}, rn, count(*) AS n, min(method) AS method FROM every WHERE status = 'tp' GROUP BY {K}, rn)",
        f"p AS ({prf_sql('every', 'method')})",
        select="SELECT p.*, (SELECT count(*) FROM hit WHERE n = 1 AND hit.method = p.method) AS unique_correct, round((SELECT count(*) FROM hit)::DOUBLE / (SELECT count(*) FROM gold), 6) AS oracle_recall FROM p",
    ),
    "bootstrap_ci": sql(
        PARENS, SH, OUT, f"u0 AS (SELECT doc_id // 3 AS g, {COUNTS} FROM o GROUP BY 1), u1 AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sha256('boot:' || g)) - 1 AS place, count(*) OVER () AS n FROM u0)",
        "u2 AS (SELECT b, ('0x' || substr(sha256('boot:' || b || ':' || place), 1, 12))::BIGINT % n AS place FROM u1 CROSS JOIN range(1000) t(b))",
        "u3 AS (SELECT b, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM u2 JOIN u1 USING (place) GROUP BY b)",
        f"u4 AS (SELECT b, {frac('tp', 'tp + fp', 'p')}, {frac('tp', 'tp + fn', 'r')}, {frac('2 * tp', '2 * tp + fp + fn', 'f')} FROM u3)",
        "u5 AS (SELECT b, unnest(['precision', 'recall', 'f1']) AS metric, unnest([p, r, f]) AS v FROM u4), u6 AS (SELECT metric, v, row_number() OVER (PARTITION BY metric ORDER BY v, b) - 1 AS i FROM u5)",
        select="SELECT metric, max(v) FILTER (WHERE i = 24) AS lower, max(v) FILTER (WHERE i = 974) AS upper FROM u6 GROUP BY metric",
    ),
    "pair_metrics": sql(
        PARENS, SH, TOY, BOTH, f"bn AS (SELECT *, row_number() OVER (PARTITION BY {K}) AS rn FROM pool)",
        f"j AS (SELECT bn.*, g.ss > g.ls AS strict, g.doc_id IS NOT NULL AS known FROM bn LEFT JOIN (SELECT DISTINCT {K} FROM gold) g ON (bn.doc_id, bn.ss, bn.se, bn.ls, bn.le) = (g.doc_id, g.ss, g.se, g.ls, g.le))",
        "c AS (SELECT count(*) AS n, count(*) FILTER (WHERE rn = 1 AND strict) AS tp, count(*) FILTER (WHERE rn = 1 AND known AND NOT strict) AS outside FROM j)",
        select="SELECT *, n - tp - outside AS fp FROM c",
    ),
    "recovery_outcome": sql(
        PARENS, SH, TOY, BOTH,
        select=f"""SELECT {K}, CASE WHEN EXISTS (SELECT 1 FROM pool b WHERE (b.doc_id, b.ss, b.se, b.ls, b.le) = (g.doc_id, g.ss, g.se, g.ls, g.le)) THEN 'exact'
WHEN EXISTS (SELECT 1 FROM pool b WHERE (b.doc_id, b.ss, b.se) = (g.doc_id, g.ss, g.se)) AND EXISTS (SELECT 1 FROM pool b WHERE (b.doc_id, b.ls, b.le) = (g.doc_id, g.ls, g.le)) THEN 'both_endpoints'
WHEN EXISTS (SELECT 1 FROM pool b WHERE b.doc_id = g.doc_id AND b.ss < g.se AND g.ss < b.se AND b.ls < g.le AND g.ls < b.le) THEN 'overlapping' ELSE 'absent' END AS outcome FROM gold g""",
    ),
    "dispositions": sql(
        PARENS, SH, TOY, f"m AS (SELECT {K}, 'sh' AS method FROM sh UNION ALL SELECT *, 'toy' FROM toy), mn AS (SELECT *, row_number() OVER (PARTITION BY method, {K}) AS rn FROM m)",
        select="""SELECT method, CASE WHEN rn = 1 AND g.ss > g.ls THEN 'correct' WHEN rn = 1 AND g.doc_id IS NOT NULL THEN 'out_of_scope' ELSE 'false_positive' END AS disposition, count(*) AS n
FROM mn LEFT JOIN gold g ON (mn.doc_id, mn.ss, mn.se, mn.ls, mn.le) = (g.doc_id, g.ss, g.se, g.ls, g.le) GROUP BY 1, 2""",
    ),
    "baseline_delta": sql(
        PARENS, SH, TOY, f"d AS (SELECT DISTINCT {K} FROM sh EXCEPT SELECT {K} FROM toy)",
        select=f"SELECT (SELECT count(*) FROM (SELECT * FROM d INTERSECT SELECT {K} FROM gold)) AS added_correct, (SELECT count(*) FROM (SELECT * FROM d EXCEPT SELECT {K} FROM gold)) AS extra_errors",
    ),
    "endpoint_audit": sql(
        PARENS, SH, TAGS.replace("\nq AS (", "\nq2 AS (").replace("FROM q)", "FROM q2)").replace("lw0", "lv0").replace("lw1", "lv1").replace("lw AS", "lv AS").replace("wend FROM lw", "wend FROM lv"),
        f"acc AS (SELECT {K} FROM gold INTERSECT SELECT {K} FROM sh)",
        f"""st AS (SELECT DISTINCT doc_id, CASE WHEN label = 'SF' THEN 'short' ELSE 'long' END AS side, s, e, 'detected' AS stage FROM tags
  UNION ALL SELECT DISTINCT *, 'paired' FROM ({SIDES} sh) UNION ALL SELECT DISTINCT *, 'accepted' FROM ({SIDES} acc))""",
        "c AS (SELECT doc_id, count(*) FILTER (WHERE stage = 'detected') AS detected, count(*) FILTER (WHERE stage = 'paired') AS paired, count(*) FILTER (WHERE stage = 'accepted') AS accepted FROM st GROUP BY doc_id)",
        select="SELECT *, detected - paired AS lost FROM c",
    ),
    "endpoint_ceiling": sql(
        PARENS, TAGS,
        "h AS (SELECT EXISTS (SELECT 1 FROM tags t WHERE label = 'SF' AND t.doc_id = g.doc_id AND t.s = ss AND t.e = se)::INT + EXISTS (SELECT 1 FROM tags t WHERE label = 'LF' AND t.doc_id = g.doc_id AND t.s = ls AND t.e = le)::INT AS n FROM gold g)",
        'c AS (SELECT count(*) FILTER (WHERE n = 2) AS "both", count(*) FILTER (WHERE n = 1) AS one, count(*) FILTER (WHERE n = 0) AS none FROM h)',
        select=f"SELECT *, {frac('"both"', '"both" + one + none', 'strict_ceiling')}, {frac('2 * "both" + one', '2 * ("both" + one + none)', 'endpoint_share')}, {frac('"both" + one', '"both" + one + none', 'any_share')} FROM c",
    ),
    "calibrate_threshold": f"WITH {SCORES}, c AS (SELECT t, count(*) FILTER (WHERE score >= t AND label = 1) AS tp, count(*) FILTER (WHERE score >= t AND label = 0) AS fp, count(*) FILTER (WHERE score < t AND label = 1) AS fn FROM y CROSS JOIN grid GROUP BY t), p AS (SELECT t AS threshold, {frac('tp', 'tp + fp', 'precision')}, {frac('tp', 'tp + fn', 'recall')}, {frac('2 * tp', '2 * tp + fp + fn', 'f1')} FROM c) SELECT * FROM p ORDER BY f1 DESC, precision DESC, threshold DESC LIMIT 1",
    "calibrate_joint": f"WITH {SCORES}, c AS (SELECT g.t AS t1, h.t AS t2, count(*) FILTER (WHERE s1 >= g.t AND s2 >= h.t AND label = 1) AS tp, count(*) FILTER (WHERE s1 >= g.t AND s2 >= h.t) AS k, sum(label) AS al FROM y CROSS JOIN grid g CROSS JOIN grid h GROUP BY 1, 2), p AS (SELECT t1, t2, {frac('tp', 'k', 'precision')}, {frac('tp', 'al', 'recall')}, {frac('2 * tp', 'k + al', 'f1')} FROM c) SELECT * FROM p ORDER BY f1 DESC, precision DESC, t1 DESC, t2 DESC LIMIT 1",
    "eligibility_case": sql(
        select="""SELECT doc_id, CASE WHEN ss IS NULL OR (ss < le AND ls < se) THEN 'unresolved' WHEN greatest(ss, ls) - least(se, le) > 160 OR ss < ls THEN 'diagnostic' ELSE 'strict' END AS scope,
CASE WHEN ss IS NULL THEN 'missing_span' WHEN ss < le AND ls < se THEN 'overlapping_spans' WHEN greatest(ss, ls) - least(se, le) > 160 THEN 'distant' WHEN ss < ls THEN 'reverse_order' ELSE 'local' END AS reason, count(*) AS n FROM corpus GROUP BY ALL"""
    ),
    "candidate_coverage": sql(
        PARENS, JUDGED, REVERSE, NESTED.replace("\nq AS (", "\nq2 AS (").replace("FROM q)", "FROM q2)").replace("lw0", "lv0").replace("lw1", "lv1").replace("lw AS", "lv AS").replace("FROM lw\n", "FROM lv\n"),
        f"every AS (SELECT DISTINCT 'parenthetical' AS pipeline, {K} FROM cand UNION ALL SELECT DISTINCT 'nested', {K} FROM nest UNION ALL SELECT DISTINCT 'reverse', {K} FROM rev)",
        f"c AS (SELECT pipeline, count(*) AS candidates, count(g.doc_id) AS covered FROM every e LEFT JOIN gold g ON (e.doc_id, e.ss, e.se, e.ls, e.le) = (g.doc_id, g.ss, g.se, g.ls, g.le) GROUP BY 1)",
        select=f"SELECT *, {frac('covered', 'candidates', 'precision')}, {frac('covered', '(SELECT count(*) FROM gold)', 'recall')} FROM c",
    ),
    "offset_transfer": sql(
        PARENS, SH, TOY, BOTH, bag("o", "gold", "pool", K),
        "fo AS (SELECT o.*, lower(substr(text, ss + 1, se - ss)) AS sf, lower(substr(text, ls + 1, le - ls)) AS lf FROM (SELECT * FROM o WHERE status <> 'tp') o JOIN (SELECT doc_id, text FROM corpus) USING (doc_id))",
        "wr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sf, lf ORDER BY ss, ls, se, le) AS k FROM fo WHERE status = 'fp')",
        "cr AS (SELECT doc_id, sf, lf, count(*) AS credit FROM fo WHERE status = 'fn' GROUP BY ALL)",
        """ca AS (SELECT w.doc_id, CASE WHEN k <= coalesce(credit, 0) THEN 'same_strings'
  WHEN EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = w.doc_id AND w.ss < g.se AND g.ss < w.se AND w.ls < g.le AND g.ls < w.le) THEN 'boundary'
  WHEN EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = w.doc_id AND w.ss = g.ss AND w.se = g.se) THEN 'short_endpoint'
  WHEN EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = w.doc_id AND w.ls = g.ls AND w.le = g.le) THEN 'long_endpoint' ELSE 'spurious' END AS category
  FROM wr w LEFT JOIN cr ON w.doc_id = cr.doc_id AND w.sf = cr.sf AND w.lf = cr.lf UNION ALL SELECT doc_id, CASE status WHEN 'tp' THEN 'exact' ELSE 'missed' END FROM o WHERE status <> 'fp')""",
        select="SELECT doc_id, category, count(*) AS n FROM ca GROUP BY ALL",
    ),
    "agreement_class": sql(
        PARENS, SH, TOY,
        "a AS (SELECT doc_id, list_sort(list(DISTINCT (ss, se, ls, le))) AS x, list_sort(list(DISTINCT (ss, se))) AS y FROM sh GROUP BY 1), b AS (SELECT doc_id, list_sort(list(DISTINCT (ss, se, ls, le))) AS x, list_sort(list(DISTINCT (ss, se))) AS y FROM toy GROUP BY 1)",
        select="""SELECT c.doc_id, CASE WHEN a.x IS NULL AND b.x IS NULL THEN 'all_empty' WHEN a.x = b.x THEN 'exact_agreement' WHEN a.y = b.y THEN 'boundary_disagreement' ELSE 'relation_disagreement' END AS class
FROM corpus c LEFT JOIN a ON a.doc_id = c.doc_id LEFT JOIN b ON b.doc_id = c.doc_id""",
    ),
    "abbrev_tokens": r"""WITH t AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda x: regexp_replace(x, '^[.,;:()]+|[.,;:()]+$', '', 'g')),
  lambda x: length(x) BETWEEN 2 AND 12 AND (regexp_matches(x, '[0-9]') OR (regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}')))))) AS t FROM documents)
SELECT doc_id, array_to_string(t, ' ') AS tokens, len(t) AS n FROM t""",
    "mapping_loss": sql(
        f"f AS (SELECT g.doc_id, unnest(['short', 'long']) AS role, unnest([sf, lf]) AS form, d.text FROM gold g JOIN documents d ON d.doc_id = g.doc_id), n AS (SELECT role, CASE WHEN instr(text, form) = 0 THEN 0 WHEN instr(substr(text, instr(text, form) + 1), form) = 0 THEN 1 ELSE 2 END AS k FROM f)",
        select="SELECT role, CASE k WHEN 0 THEN 'absent' WHEN 1 THEN 'mapped' ELSE 'repeated' END AS cause, count(*) AS n FROM n GROUP BY ALL",
    ),
    "availability_prf_gates": sql(
        PARENS, SH, OUT, "f AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)",
        """v AS (SELECT 'successful' AS view, status FROM o WHERE doc_id NOT IN (FROM f) UNION ALL SELECT 'adjusted', status FROM o WHERE doc_id NOT IN (FROM f)
  UNION ALL SELECT 'adjusted', 'fn' FROM o WHERE doc_id IN (FROM f) AND status IN ('tp', 'fn'))""",
        select="SELECT *, precision >= 0.9 AND recall >= 0.6 AS passed FROM (" + prf_sql("v", "view") + ")",
    ),
    "offset_error_patterns": sql(
        f"q0 AS (SELECT g.doc_id, g.lf AS quote, g.ls + g.doc_id % 3 AS s, g.le AS e, {OCC.format(t='text', n='g.lf')} AS ats FROM gold g JOIN (SELECT doc_id, text FROM corpus) USING (doc_id))",
        "q1 AS (SELECT *, len(ats) AS k, list_sort(list_transform(ats, lambda p: (abs(p - s), p)))[1][2] AS p FROM q0)",
        select="""SELECT CASE k WHEN 0 THEN 'absent' WHEN 1 THEN 'unique' ELSE 'repeated' END AS multiplicity, CASE WHEN k = 0 THEN 'none' WHEN p = s AND p + length(quote) = e THEN 'both'
WHEN p = s THEN 'start_only' WHEN p + length(quote) = e THEN 'end_only' ELSE 'neither' END AS pattern, s - p AS delta, count(*) AS n FROM q1 GROUP BY ALL""",
    ),
    "wilson_half_width": "SELECT source, count(*) AS n, round(1.96::DOUBLE * sqrt(0.25 / count(*) + 1.96::DOUBLE * 1.96 / (4.0::DOUBLE * count(*) * count(*))) / (1 + 1.96::DOUBLE * 1.96 / count(*)), 6) AS half_width FROM documents GROUP BY source",
    "request_plan": "SELECT source, count(*) AS documents, sum(length(text))::BIGINT AS characters, sum(greatest(1, length(text) // 4))::BIGINT AS tokens, ceil(count(*) / 64)::BIGINT AS requests FROM documents GROUP BY source",
    "downstream_impact": sql(
        PARENS, SH, "b AS (SELECT DISTINCT doc_id, sf AS entity FROM gold WHERE doc_id % 2 = 0), p AS (SELECT doc_id, lf AS entity FROM sh UNION SELECT doc_id, sf FROM gold WHERE doc_id % 4 = 0), g AS (SELECT DISTINCT doc_id, lf AS entity FROM gold)",
        """n AS (SELECT (SELECT count(*) FROM (FROM p EXCEPT FROM b)) AS added, (SELECT count(*) FROM (FROM b EXCEPT FROM p)) AS removed, (SELECT count(*) FROM (FROM p INTERSECT FROM g)) AS r, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng)""",
        select=f"SELECT added, removed, {frac('r', 'np', 'precision')}, {frac('r', 'ng', 'recall')} FROM n",
    ),
    "error_contexts": sql(
        PARENS, SH, OUT,
        select=f"""SELECT {K}, status, replace(replace(replace(replace(replace(substr(text, greatest(least(ss, ls) - 20, 0) + 1, greatest(se, le) + 20 - greatest(least(ss, ls) - 20, 0)),
'&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS context FROM o JOIN (SELECT doc_id, text FROM corpus) USING (doc_id) WHERE status <> 'tp'""",
    ),
}
