"""Queries of builds, reviews and evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import evaluate as e
from glossa.operators import extract as x
from glossa.operators import fuse, review, runs, weak
from glossa.operators.validate import trim_captured
from glossa.plans.corpus import PARENS, corpus, gold, table
from glossa.plans.q_evaluate import BOTH, TOY
from glossa.plans.q_extract import SH, sql
from glossa.plans.q_literature import PICK

KEY = e.KEY


def every(n: int):
    """doc_id modulo n, as a column."""
    return F.col("doc_id") % n


def cases(s: SparkSession, d: str) -> DataFrame:
    """Documents of the derived corpus as cases."""
    kind, arm = F.when(every(6) == 0, "table_or_list").otherwise("prose"), F.when(every(2) == 0, "pubmed_abstract").otherwise("pmc")
    return corpus(s, d).select(F.col("doc_id").alias("case_id"), "text", kind.alias("source_kind"), arm.alias("arm"), F.floor(F.col("doc_id") / 4).cast("long").alias("group"))


def decisions(s: SparkSession, d: str) -> DataFrame:
    """Gold definitions as reviewers' decisions, in all the ways a decision can be; some definitions twice."""
    g = gold(s, d)
    pick = lambda n, *pairs: F.coalesce(*[F.when(every(n) == k, v) for k, v in pairs[:-1]], F.lit(pairs[-1]))
    one = g.select(
        F.col("doc_id").alias("case_id"), F.lit(1).cast("long").alias("decision_id"), pick(9, (0, "incorrect"), (1, "unsure"), "correct").alias("status"), pick(5, (0, "added"), (1, "corrected"), "assisted").alias("origin"),
        "ss", "se", F.when(every(11) != 0, F.col("ls")).alias("ls"), F.when(every(11) != 0, F.col("le")).alias("le"), F.when(every(7) == 0, F.concat(F.lit(" "), "sf")).otherwise(F.col("sf")).alias("sf"), "lf",
        pick(13, (0, "uncertain"), (1, "other_naming_or_code_relation"), "abbreviation").alias("relation_kind"), (every(17) == 0).alias("source_error"), pick(19, (0, "uncertain"), (1, "discontinuous"), "contiguous").alias("evidence_structure"),
        pick(23, (0, "uncertain"), (1, "figure"), "text_alone").alias("context_requirement"), F.when(every(12) == 0, F.lit("seen twice ")).otherwise("").alias("notes"),
    )
    return one.unionByName(one.filter("case_id % 10 = 3").withColumn("decision_id", F.lit(2).cast("long")))


def states(s: SparkSession, d: str) -> DataFrame:
    return corpus(s, d).filter(every(3) != 0).select(F.col("doc_id").alias("case_id"), F.when(every(5) == 2, "found").otherwise("none").alias("missed_definition"))


def noisy(s: SparkSession, d: str) -> DataFrame:
    """Gold with white space around captured forms, and ends beyond the text."""
    g = gold(s, d)
    sf, lf = F.when(every(3) == 0, F.concat(F.lit(" "), "sf")).otherwise(F.col("sf")), F.when(every(4) == 0, F.concat("lf", F.lit("\n"))).otherwise(F.col("lf"))
    return g.withColumn("sf", sf).withColumn("lf", lf).withColumn("le", F.when(every(17) == 0, F.lit(10_000_000)).otherwise(F.col("le")))


def built(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return runs.build_corpus(corpus(s, d).select("doc_id", "text"), noisy(s, d), {"TRIMMED_FORM": trim_captured})


def choices(s: SparkSession, d: str) -> DataFrame:
    p = F.round(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit("d"), "doc_id"), 256), 1, 8), 16, 10).cast("double") / float(1 << 32), 6)
    choice = F.when(every(5) == 0, "not_definition").when(every(3) == 0, "reverse").otherwise("forward")
    return gold(s, d).select(*KEY, choice.alias("choice"), p.alias("probability"))


def methods(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"sh": x.schwartz_hearst(corpus(s, d)), "toy": x.toy(corpus(s, d))}


def inventory(s: SparkSession, d: str) -> DataFrame:
    """Pages as inventoried sections in all strata."""
    p = F.col("page_id")
    stratum = F.when(p % 5 == 0, "disagreement").when(p % 5 == 1, "agreement").when(p % 5 == 2, "enriched_zero").when(p % 5 == 3, "zero_pool").otherwise("diagnostic")
    return table(s, d, "pages").select(p.alias("case_id"), stratum.alias("stratum"), F.concat(F.lit("arm"), (p % 3).cast("string")).alias("arm"), F.floor(p / 20).cast("long").alias("article"), (p % 4 == 0).alias("has_predictions"))


QUERIES = {
    "candidate_evidence": lambda s, d: weak.candidate_evidence(x.schwartz_hearst(corpus(s, d)), corpus(s, d), "rule", "sh", "1", "positive"),
    "judge_choice": lambda s, d: fuse.judge_choice(choices(s, d)),
    "recovery_by_method": lambda s, d: e.recovery_by_method(gold(s, d), methods(s, d)),
    "decision_eligibility": lambda s, d: review.eligible(decisions(s, d)).select("case_id", "decision_id", "disposition", "reason"),
    "postlock_gold": lambda s, d: review.post_lock(cases(s, d), decisions(s, d))[1],
    "postlock_ledger": lambda s, d: review.post_lock(cases(s, d), decisions(s, d))[2],
    "second_review": lambda s, d: review.second_review(cases(s, d), decisions(s, d), 20261, 0.2),
    "annotation_issues": lambda s, d: review.annotation_issues(decisions(s, d)),
    "audit_inventory": lambda s, d: review.audit_inventory(cases(s, d), decisions(s, d), states(s, d), "audit"),
    "audit_counts": lambda s, d: review.audit_counts(cases(s, d), decisions(s, d), states(s, d)),
    "review_strata_packet": lambda s, d: review.review_packet(inventory(s, d), 20260908),
    "corpus_build": lambda s, d: built(s, d)[1],
    "corpus_build_log": lambda s, d: built(s, d)[2].groupBy("severity", "code", "action").agg(F.count(F.lit(1)).alias("n")),
}

DECIDED = """de0 AS (SELECT doc_id AS case_id, 1 AS decision_id, CASE doc_id % 9 WHEN 0 THEN 'incorrect' WHEN 1 THEN 'unsure' ELSE 'correct' END AS status, CASE doc_id % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'corrected' ELSE 'assisted' END AS origin,
  ss, se, CASE WHEN doc_id % 11 <> 0 THEN ls END AS ls, CASE WHEN doc_id % 11 <> 0 THEN le END AS le, sf, lf FROM gold),
de AS (SELECT * FROM de0 UNION ALL SELECT * REPLACE (2 AS decision_id) FROM de0 WHERE case_id % 10 = 3),
ju AS (SELECT *, CASE WHEN status = 'incorrect' THEN 'unsupported' WHEN status = 'unsure' THEN 'unresolved_support' WHEN ls IS NULL THEN 'incomplete_exact_pair' WHEN case_id % 13 = 0 THEN 'unresolved_relation_kind'
  WHEN case_id % 13 = 1 THEN 'outside_strict_target' WHEN case_id % 17 = 0 THEN 'source_error' WHEN case_id % 19 = 0 THEN 'unresolved_evidence_structure' WHEN case_id % 19 = 1 THEN 'not_representable_as_exact_pair'
  WHEN case_id % 23 = 0 THEN 'unresolved_context' WHEN case_id % 23 = 1 THEN 'requires_non_text_context' ELSE 'eligible_strict_exact_pair' END AS reason FROM de),
el AS (SELECT *, CASE WHEN reason = 'eligible_strict_exact_pair' THEN 'strict' WHEN reason IN ('unsupported', 'outside_strict_target', 'source_error', 'not_representable_as_exact_pair', 'requires_non_text_context') THEN 'diagnostic' ELSE 'unresolved' END AS disposition FROM ju)"""
NOISY = """no AS (SELECT doc_id, ss, se, ls, CASE WHEN doc_id % 17 = 0 THEN 10000000 ELSE le END AS le, doc_id % 3 = 0 AS fs, doc_id % 4 = 0 AND doc_id % 17 <> 0 AS fl, sf, lf FROM gold)"""
REACH = """CASE WHEN EXISTS (SELECT 1 FROM {m} b WHERE (b.doc_id, b.ss, b.se, b.ls, b.le) = (g.doc_id, g.ss, g.se, g.ls, g.le)) THEN 'exact'
WHEN EXISTS (SELECT 1 FROM {m} b WHERE (b.doc_id, b.ss, b.se) = (g.doc_id, g.ss, g.se)) AND EXISTS (SELECT 1 FROM {m} b WHERE (b.doc_id, b.ls, b.le) = (g.doc_id, g.ls, g.le)) THEN 'both_endpoints'
WHEN EXISTS (SELECT 1 FROM {m} b WHERE b.doc_id = g.doc_id AND b.ss < g.se AND g.ss < b.se AND b.ls < g.le AND g.ls < b.le) THEN 'overlapping' ELSE 'absent' END AS {m}"""
K = "doc_id, ss, se, ls, le"

ORACLE_SQL = {
    "candidate_evidence": sql(
        PARENS, SH,
        select=f"SELECT sh.doc_id, ss, se, ls, le, 'rule' AS family, 'sh' AS source, '1' AS version, 'positive' AS polarity, 1.0::DOUBLE AS weight, substr(c.text, least(ss, ls) + 1, greatest(se, le) - least(ss, ls)) AS local_context FROM sh JOIN (SELECT doc_id, text FROM corpus) c USING (doc_id)",
    ),
    "judge_choice": sql(
        f"j AS (SELECT *, round({PICK.format(a='d')}, 6) AS p, doc_id % 3 = 0 AS swap FROM gold WHERE doc_id % 5 <> 0)",
        select="SELECT doc_id, CASE WHEN swap THEN ls ELSE ss END AS ss, CASE WHEN swap THEN le ELSE se END AS se, CASE WHEN swap THEN ss ELSE ls END AS ls, CASE WHEN swap THEN se ELSE le END AS le, max(p) AS confidence FROM j WHERE p >= 0.5 GROUP BY ALL",
    ),
    "recovery_by_method": sql(PARENS, SH, TOY, BOTH, select=f"SELECT {K}, {REACH.format(m='sh')}, {REACH.format(m='toy')} FROM gold g"),
    "decision_eligibility": sql(DECIDED, select="SELECT case_id, decision_id, disposition, reason FROM el"),
    "postlock_gold": sql(DECIDED, select="SELECT case_id, ss, se, ls, le FROM el WHERE disposition = 'strict'"),
    "postlock_ledger": sql(
        DECIDED,
        select="""SELECT c.doc_id AS case_id, CASE WHEN c.doc_id % 6 = 0 THEN 'structural_challenge' WHEN c.doc_id % 2 = 0 THEN 'representative_pubmed_abstract' ELSE 'representative_pmc_prose' END AS stratum,
count(*) FILTER (WHERE disposition = 'strict') AS strict, count(*) FILTER (WHERE disposition = 'diagnostic') AS diagnostic, count(*) FILTER (WHERE disposition = 'unresolved') AS unresolved FROM corpus c LEFT JOIN el ON case_id = c.doc_id GROUP BY c.doc_id""",
    ),
    "second_review": sql(
        DECIDED, """ne AS (SELECT doc_id AS case_id, row_number() OVER (ORDER BY sha256('[20261,"second-review-negative","' || doc_id || '"]')) AS i, count(*) OVER () AS n FROM corpus WHERE doc_id NOT IN (SELECT case_id FROM de))""",
        select="SELECT DISTINCT case_id, 'positive' AS why FROM de UNION ALL SELECT case_id, 'negative_sample' FROM ne WHERE i <= ceil(n / 5)",
    ),
    "annotation_issues": sql(
        DECIDED,
        select="""SELECT case_id, decision_id, 'short_form_boundary_whitespace' AS kind FROM de WHERE case_id % 7 = 0 UNION ALL SELECT case_id, decision_id, 'note_boundary_whitespace' FROM de WHERE case_id % 12 = 0
UNION ALL SELECT case_id, decision_id, 'repeated_exact_pair' FROM de WHERE decision_id = 2 AND ls IS NOT NULL""",
    ),
    "audit_inventory": sql(
        DECIDED,
        """pc AS (SELECT case_id, string_agg(DISTINCT CASE origin WHEN 'added' THEN 'added_pair' WHEN 'corrected' THEN 'corrected_suggestion' END, ',') AS r1, max(CASE WHEN status = 'incorrect' THEN 'rejected_suggestion' END) AS r2,
  bool_and(origin = 'assisted' AND status = 'correct') AS fine, count(*) AS decisions, count(*) FILTER (WHERE origin = 'added') AS additions FROM de GROUP BY case_id)""",
        """co AS (SELECT *, row_number() OVER (PARTITION BY case_id // 4 ORDER BY sha256('audit:' || case_id)) > 1 AS later FROM pc WHERE r1 IS NULL AND r2 IS NULL AND fine AND case_id % 3 <> 0 AND case_id % 5 <> 2)""",
        select="""SELECT case_id, 'targeted' AS role, concat_ws(',', r1, r2) AS reasons, decisions, additions FROM pc WHERE r1 IS NOT NULL OR r2 IS NOT NULL
UNION ALL (SELECT case_id, 'control', 'unchanged_accepted_control', decisions, additions FROM co ORDER BY later, sha256('audit:' || case_id) LIMIT 8)""",
    ),
    "audit_counts": sql(
        DECIDED,
        select="SELECT (SELECT count(*) FROM corpus) AS cases, (SELECT count(*) FROM corpus WHERE doc_id % 3 <> 0) AS annotated, count(*) AS decisions, count(*) FILTER (WHERE origin = 'added') AS additions, count(*) FILTER (WHERE origin = 'corrected') AS corrected, count(*) FILTER (WHERE status = 'incorrect') AS rejections FROM de",
    ),
    "corpus_build": sql(NOISY, select="SELECT doc_id, ss, se, ls, le, sf, lf FROM no WHERE doc_id % 17 <> 0"),
    "corpus_build_log": sql(
        NOISY,
        select="""SELECT 'info' AS severity, 'TRIMMED_FORM' AS code, 'repaired' AS action, sum(fs::INT + fl::INT)::BIGINT AS n FROM no HAVING n > 0 UNION ALL SELECT 'error', 'RECORD_DROPPED', 'dropped', count(DISTINCT doc_id) FROM no WHERE doc_id % 17 = 0 HAVING count(*) > 0
UNION ALL SELECT 'warning', 'DUPLICATE_RECORD_ID', 'kept', count(*) FROM (SELECT doc_id FROM corpus GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0""",
    ),
}
