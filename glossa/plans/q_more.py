"""Further queries, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import extract as x
from glossa.operators import more
from glossa.operators.evaluate import KEY, exact_pair
from glossa.plans.corpus import PARENS, corpus, gold, table
from glossa.plans.q_evaluate import TOY, bag, frac
from glossa.plans.q_extract import SH, sql


def structures(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns as table rows of two cells (their first word; their next two), and as sections."""
    c = table(s, d, "conversations").groupBy("conv_id", "turn").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    cells = F.array(F.struct(F.lit(1).alias("k"), F.get(w, F.lit(0)).alias("cell")), F.struct(F.lit(2).alias("k"), F.array_join(F.slice(w, 2, 2), " ").alias("cell")))
    st = c.filter(F.size(w) >= 3).select(F.col("conv_id").alias("article"), "turn", F.explode(cells).alias("x"))
    st = st.select("article", (F.col("turn") * 2 + F.col("x.k")).alias("ord"), F.format_string("/table/tr[%d]/td[%d]", "turn", "x.k").alias("source_path"), F.col("x.cell").alias("text"))
    return st, c.select(F.col("conv_id").alias("article"), F.col("turn").alias("ord"), (F.col("turn") * 100_000).cast("long").alias("start"), "text")


def byte_spans(s: SparkSession, d: str) -> DataFrame:
    b = lambda c: F.octet_length(F.substring("text", F.lit(1), F.col(c).cast("int")))
    return corpus(s, d).filter("ss IS NOT NULL").select("doc_id", (b("ls") + F.when(F.col("doc_id") % 50 == 0, 1_000_000).otherwise(0)).cast("long").alias("bs"), b("le").cast("long").alias("be"))


def stdout(s: SparkSession, d: str) -> DataFrame:
    good = F.concat(F.lit("echo\n  "), "sf", F.lit("|"), "lf", F.lit("|0.95\n"))
    return gold(s, d).select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(good, F.lit("  broken|line\n"))).otherwise(good).alias("stdout"))


def methods(s: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*KEY, F.lit(n).alias("method")) for n, p in (("sh", x.schwartz_hearst(corpus(s, d))), ("toy", x.toy(corpus(s, d))))])


def outcomes(s: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [exact_pair(gold(s, d), p).withColumn("method", F.lit(n)) for n, p in (("sh", x.schwartz_hearst(corpus(s, d))), ("toy", x.toy(corpus(s, d))))])


def known(s: SparkSession, d: str) -> DataFrame:
    return gold(s, d).select(*KEY, F.when(F.col("ss") > F.col("ls"), "strict").when(F.col("doc_id") % 2 == 0, "diagnostic").otherwise("rejected").alias("decision"))


def records(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("record_id"), F.coalesce("text", F.lit("")).alias("text"))


def passages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("passage_id"), F.col("lang").alias("stratum"), F.floor(F.col("doc_id") / 4).cast("long").alias("group"))


def cases(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "pages")
    i = F.col("page_id")
    return p.select(i.alias("case_id"), (i % 9 == 0).alias("unresolved"), (i % 7 == 0).alias("difficult"), F.when(i % 2 == 0, "human").otherwise("rule").alias("origin"), F.when(i % 3 == 0, "open").otherwise("done").alias("status"), F.array_compact(F.array(F.when(i % 5 == 0, "nested"), F.when(i % 4 == 0, "reverse"))).alias("phenomena"))


def decisions(s: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    p = table(s, d, "pages").filter(i % 6 != 0)
    one = p.select((i + F.when(i % 10 == 1, 1_000_000).otherwise(0)).alias("case_id"), F.when(i % 4 == 1, "open").otherwise("accept").alias("decision"))
    return one.unionByName(one.filter("case_id % 25 = 0"))


QUERIES = {
    "structured_relations": lambda s, d: more.structured_relations(*structures(s, d)),
    "byte_offsets": lambda s, d: more.bytes_to_characters(byte_spans(s, d), corpus(s, d)),
    "tool_output_pairs": lambda s, d: more.pair_lines(stdout(s, d))[0],
    "tool_output_errors": lambda s, d: more.pair_lines(stdout(s, d))[1],
    "method_summary": lambda s, d: more.method_summary(outcomes(s, d), table(s, d, "documents")),
    "known_relations": lambda s, d: more.known_relations(methods(s, d), known(s, d)),
    "exclusion_ledger": lambda s, d: more.exclude(records(s, d), records(s, d).filter("record_id % 10 = 0")),
    "stratified_packet": lambda s, d: more.stratified_packet(passages(s, d), "seed", {"en": 40, "de": 20, "fr": 10, "es": 5}),
    "difficult_cases": lambda s, d: more.difficult_cases(cases(s, d), "seed", 50),
    "annotation_report": lambda s, d: more.annotation_report(cases(s, d)),
    "review_readiness": lambda s, d: more.readiness(cases(s, d), decisions(s, d)),
}

ORACLE_SQL = {
    "structured_relations": """WITH c AS (SELECT conv_id, turn, coalesce(min(text), '') AS text FROM conversations GROUP BY ALL), w AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+') AS w FROM c),
p AS (SELECT conv_id, w[1] AS a, array_to_string(w[2:3], ' ') AS b FROM w WHERE len(w) >= 3), q AS (SELECT DISTINCT conv_id, a AS sf, b AS lf FROM p WHERE regexp_full_match(a, '[A-Za-z][A-Za-z0-9-]{1,29}')),
f AS (SELECT conv_id, sf AS form FROM q UNION SELECT conv_id, lf FROM q), x AS (SELECT f.conv_id, form, arg_min(turn * 100000 + instr(text, form) - 1, turn) AS p FROM f JOIN c ON f.conv_id = c.conv_id AND contains(text, form) GROUP BY 1, 2)
SELECT q.conv_id AS article, a.p AS ss, a.p + length(sf) AS se, b.p AS ls, b.p + length(lf) AS le FROM q JOIN x a ON a.conv_id = q.conv_id AND a.form = sf JOIN x b ON b.conv_id = q.conv_id AND b.form = lf""",
    "byte_offsets": sql(select="SELECT doc_id, ls AS s, le AS e FROM gold WHERE doc_id % 50 <> 0"),
    "tool_output_pairs": sql(select="SELECT doc_id, 1 AS ord, sf, lf, 0.95::DOUBLE AS precision FROM gold"),
    "tool_output_errors": sql(select="SELECT doc_id, 2 AS ord, '  broken|line' AS line FROM gold WHERE doc_id % 4 = 0"),
    "method_summary": sql(
        PARENS, SH, TOY, *[bag(f"o{i}", "gold", m, "doc_id, ss, se, ls, le") for i, m in enumerate(("sh", "toy"))], "ev AS (SELECT 'sh' AS method, * FROM o0 UNION ALL SELECT 'toy', * FROM o1)",
        "dd AS (SELECT method, doc_id, count(*) FILTER (WHERE status = 'tp') AS tp, count(*) FILTER (WHERE status <> 'fp') AS g, count(*) FILTER (WHERE status = 'fp') AS fp FROM ev GROUP BY ALL)",
        "c AS (SELECT method, count(*) FILTER (WHERE g > 0 AND tp > 0) AS covered, count(*) FILTER (WHERE g > 0) AS cases, coalesce(sum(fp) FILTER (WHERE g = 0), 0)::BIGINT AS empty_fp FROM dd GROUP BY method)",
        select=f"SELECT method, covered, cases, {frac('covered', 'cases', 'coverage')}, empty_fp FROM c",
    ),
    "known_relations": sql(
        PARENS, SH, TOY, "m AS (SELECT 'sh' AS method, doc_id, ss, se, ls, le FROM sh UNION ALL SELECT 'toy', * FROM toy)",
        "k AS (SELECT method, CASE WHEN g.doc_id IS NULL THEN 'queued' WHEN g.ss > g.ls THEN 'strict_exact' WHEN g.doc_id % 2 = 0 THEN 'prior_diagnostic' ELSE 'prior_rejected' END AS class FROM m LEFT JOIN gold g ON (m.doc_id, m.ss, m.se, m.ls, m.le) = (g.doc_id, g.ss, g.se, g.ls, g.le))",
        select="SELECT class, count(*) FILTER (WHERE method = 'sh') AS sh, count(*) FILTER (WHERE method = 'toy') AS toy FROM k GROUP BY class",
    ),
    "exclusion_ledger": r"WITH r AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id AS record_id FROM r WHERE doc_id % 10 <> 0 AND t NOT IN (SELECT t FROM r WHERE doc_id % 10 = 0)",
    "stratified_packet": """WITH o AS (SELECT lang, doc_id // 4 AS g, min(sha256('seed:' || doc_id)) AS h, arg_min(doc_id, sha256('seed:' || doc_id)) AS p FROM documents GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) AS n FROM o) SELECT p AS passage_id, lang AS stratum FROM r WHERE n <= CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 20 WHEN 'fr' THEN 10 WHEN 'es' THEN 5 ELSE 0 END""",
    "difficult_cases": "SELECT page_id AS case_id FROM pages ORDER BY CASE WHEN page_id % 9 = 0 OR page_id % 7 = 0 THEN 0 ELSE 1 END, sha256('seed:' || page_id) LIMIT 50",
    "annotation_report": """WITH c AS (SELECT page_id AS i FROM pages) SELECT 'origin' AS dimension, CASE WHEN i % 2 = 0 THEN 'human' ELSE 'rule' END AS value, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'status', CASE WHEN i % 3 = 0 THEN 'open' ELSE 'done' END, count(*) FROM c GROUP BY ALL
UNION ALL SELECT 'phenomenon', 'nested', count(*) FROM c WHERE i % 5 = 0 UNION ALL SELECT 'phenomenon', 'reverse', count(*) FROM c WHERE i % 4 = 0""",
    "review_readiness": """WITH o AS (SELECT page_id + CASE WHEN page_id % 10 = 1 THEN 1000000 ELSE 0 END AS case_id, CASE WHEN page_id % 4 = 1 THEN 'open' ELSE 'accept' END AS decision FROM pages WHERE page_id % 6 <> 0),
d AS (SELECT case_id, count(*) AS n, bool_or(decision = 'open') AS op FROM (FROM o UNION ALL FROM o WHERE case_id % 25 = 0) GROUP BY 1),
j AS (SELECT coalesce(p.page_id, d.case_id) AS case_id, CASE WHEN p.page_id IS NULL THEN 'unknown_case' WHEN d.case_id IS NULL THEN 'undecided' WHEN n > 1 THEN 'several_decisions' WHEN op THEN 'open' END AS issue FROM pages p FULL JOIN d ON p.page_id = d.case_id)
SELECT * FROM j WHERE issue IS NOT NULL""",
}
