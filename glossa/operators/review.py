"""Review of cases: eligibility of decisions, what follows a lock, second review, audits, and packets with strata and arms."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.lineage import hash_rank
from glossa.operators.evaluate import KEY


def eligible(decisions: DataFrame) -> DataFrame:
    """Decisions with disposition and reason: strict pairs are scored, diagnostic ones kept outside, unresolved ones await a reviewer.

    Columns read: status, ss, ls, relation_kind, source_error, evidence_structure, context_requirement. The first rule that fits counts.
    """
    c = F.col
    rules: list[tuple[Column, str, str]] = [
        (c("status") == "incorrect", "diagnostic", "unsupported"),
        (c("status").isin("unreviewed", "unsure"), "unresolved", "unresolved_support"),
        (c("ss").isNull() | c("ls").isNull(), "unresolved", "incomplete_exact_pair"),
        (c("relation_kind") == "uncertain", "unresolved", "unresolved_relation_kind"),
        (c("relation_kind") == "other_naming_or_code_relation", "diagnostic", "outside_strict_target"),
        (c("source_error"), "diagnostic", "source_error"),
        (c("evidence_structure") == "uncertain", "unresolved", "unresolved_evidence_structure"),
        (c("evidence_structure") == "discontinuous", "diagnostic", "not_representable_as_exact_pair"),
        (c("context_requirement") == "uncertain", "unresolved", "unresolved_context"),
        (c("context_requirement") != "text_alone", "diagnostic", "requires_non_text_context"),
    ]
    first = F.coalesce(*[F.when(k, F.struct(F.lit(d).alias("d"), F.lit(r).alias("r"))) for k, d, r in rules], F.struct(F.lit("strict").alias("d"), F.lit("eligible_strict_exact_pair").alias("r")))
    return decisions.withColumn("disposition", first["d"]).withColumn("reason", first["r"])


def strata_of(cases: DataFrame) -> DataFrame:
    """Cases with their stratum, from source_kind and arm."""
    abstract = F.when(F.col("arm") == "pubmed_abstract", "representative_pubmed_abstract").otherwise("representative_pmc_prose")
    return cases.withColumn("stratum", F.when(F.col("source_kind") == "table_or_list", "structural_challenge").otherwise(abstract))


def check_lock(lock: Mapping[str, str], packet_fingerprint: str, state_fingerprint: str) -> None:
    """Raises unless the lock names this packet and this state of the annotations, and no prediction was seen before it."""
    wrong = [k for k, v in (("packet", packet_fingerprint), ("state", state_fingerprint)) if lock.get(k) != v]
    if wrong or lock.get("predictions_exposed") not in (False, "false"):
        raise ValueError(f"the lock does not fit: {wrong or ['predictions_exposed']}")


def post_lock(cases: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is frozen after a lock: the predictors' input (case_id, text), strict gold (case_id, spans), and the eligibility ledger.

    The ledger has a row per case: case_id, stratum, strict, diagnostic, unresolved; a case without decisions has zeros and empty gold.
    """
    judged = eligible(decisions)
    gold = judged.filter("disposition = 'strict'").select("case_id", *KEY[1:])
    counts = judged.groupBy("case_id").agg(*[F.count(F.when(F.col("disposition") == d, 1)).alias(d) for d in ("strict", "diagnostic", "unresolved")])
    ledger = strata_of(cases).select("case_id", "stratum").join(counts, "case_id", "left").na.fill(0, ["strict", "diagnostic", "unresolved"])
    return cases.select("case_id", "text"), gold, ledger


def second_review(cases: DataFrame, decisions: DataFrame, seed: int, fraction: float) -> DataFrame:
    """case_id, why: all cases with decisions, and the share (rounded up) of the others with the smallest digests."""
    positive = decisions.select("case_id").distinct()
    rest = cases.select("case_id").join(positive, "case_id", "left_anti")
    name = F.concat(F.lit(f'[{seed},"second-review-negative","'), F.col("case_id").cast("string"), F.lit('"]'))
    most = -(-rest.count() * int(round(fraction * 1_000_000)) // 1_000_000)
    drawn = hash_rank(rest, F.sha2(name, 256), "place").filter(F.col("place") < most)
    found = cases.select("case_id").join(positive, "case_id", "left_semi").select("case_id", F.lit("positive").alias("why"))
    return found.unionByName(drawn.select("case_id", F.lit("negative_sample").alias("why")))


def annotation_issues(decisions: DataFrame) -> DataFrame:
    """case_id, decision_id, kind of what a lock's audit lists: white space at the ends of a captured form or note, and pairs that repeat."""
    ends = lambda c: F.coalesce(F.col(c).rlike(r"^\s|\s$"), F.lit(False))
    n = F.row_number().over(Window.partitionBy("case_id", *KEY[1:]).orderBy("decision_id"))
    again = (n > 1) & F.col("ss").isNotNull() & F.col("ls").isNotNull()
    kinds = ((ends("sf"), "short_form_boundary_whitespace"), (ends("lf"), "long_form_boundary_whitespace"), (ends("notes"), "note_boundary_whitespace"), (again, "repeated_exact_pair"))
    listed = decisions.select("case_id", "decision_id", F.array_compact(F.array(*[F.when(c, k) for c, k in kinds])).alias("kinds"))
    return listed.select("case_id", "decision_id", F.explode("kinds").alias("kind"))


def audit_inventory(cases: DataFrame, decisions: DataFrame, states: DataFrame, seed: str, controls: int = 8) -> DataFrame:
    """case_id, role, reasons, decisions, additions: cases to audit.

    Targeted are all cases with an added, corrected or rejected pair, with their reasons. Controls are cases whose every pair was accepted
    unchanged and in which nothing was missed (states: case_id, missed_definition): ``controls`` of them by digest, one per
    article group first.
    """
    why = (("added_pair", F.col("origin") == "added"), ("corrected_suggestion", F.col("origin") == "corrected"), ("rejected_suggestion", F.col("status") == "incorrect"))
    fine = (F.col("origin") == "assisted") & (F.col("status") == "correct")
    about = [F.max(F.when(c, F.lit(r))).alias(r) for r, c in why]
    per = decisions.groupBy("case_id").agg(*about, F.min(fine.cast("int")).alias("fine"), F.count(F.lit(1)).alias("decisions"), F.count(F.when(F.col("origin") == "added", 1)).alias("additions"))
    per = per.withColumn("reasons", F.array_join(F.array_sort(F.array_compact(F.array(*[F.col(r) for r, _ in why]))), ","))
    rows = cases.select("case_id", "group").join(per, "case_id")
    targeted = rows.filter("reasons <> ''").select("case_id", F.lit("targeted").alias("role"), "reasons", "decisions", "additions")
    pool = rows.filter("reasons = '' AND fine = 1").join(states.filter("missed_definition = 'none'").select("case_id"), "case_id", "left_semi")
    pool = pool.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("case_id").cast("string")), 256))
    later = F.row_number().over(Window.partitionBy("group").orderBy("h")) > 1
    chosen = pool.withColumn("later", later).orderBy("later", "h").limit(controls)
    return targeted.unionByName(chosen.select("case_id", F.lit("control").alias("role"), F.lit("unchanged_accepted_control").alias("reasons"), "decisions", "additions"))


def audit_counts(cases: DataFrame, decisions: DataFrame, states: DataFrame) -> DataFrame:
    """One row: cases, annotated, decisions, additions, corrected, rejections."""
    d = decisions.agg(F.count(F.lit(1)).alias("decisions"), *[F.count(F.when(c, 1)).alias(n) for n, c in (("additions", F.col("origin") == "added"), ("corrected", F.col("origin") == "corrected"), ("rejections", F.col("status") == "incorrect"))])
    return cases.agg(F.count(F.lit(1)).alias("cases")).join(states.agg(F.count_distinct("case_id").alias("annotated")), F.lit(True)).join(d, F.lit(True))


#: How many cases of each category a packet wants, in the order in which they are taken, and how many cases in all.
TARGETS = {"disagreement": 30, "agreement": 10, "enriched_zero": 15, "uniform_zero": 5}
BUDGET = 60


def review_packet(inventory: DataFrame, seed: int, per_article: int = 4) -> DataFrame:
    """case_id, category of a packet: categories in order, arms in turn (the arm with the fewest so far, then by name), by digest within an arm.

    inventory: case_id, stratum (disagreement, agreement, enriched_zero, zero_pool, diagnostic), arm, article, has_predictions. An
    article gives ``per_article`` cases at most, over all categories. The uniform zeros are drawn from all zeros that are left, diagnostic
    cases (those with predictions first) fill the budget. No more than the first ``per_article`` cases of an article and arm can be taken, and
    of the rest of an arm no more than what is wanted and what full articles can hide: that bounded list is dealt on the driver.
    """
    total = sum(TARGETS.values()) + BUDGET
    pools = {"disagreement": ["disagreement"], "agreement": ["agreement"], "enriched_zero": ["enriched_zero"], "uniform_zero": ["enriched_zero", "zero_pool"], "diagnostic": ["diagnostic"]}
    seeds = {"uniform_zero": seed + 1, "diagnostic": seed + 2}
    parts = []
    for name, strata in pools.items():
        h = F.sha2(F.concat(F.lit(f"{seeds.get(name, seed)}:"), F.col("case_id").cast("string")), 256)
        late = ~F.col("has_predictions") if name == "diagnostic" else F.lit(False)
        p = inventory.filter(F.col("stratum").isin(strata)).select(F.lit(name).alias("category"), "case_id", "arm", "article", late.alias("late"), h.alias("h"))
        # a zero that was taken as an enriched one is missing here: so twice the number per article is kept
        p = p.withColumn("i", F.row_number().over(Window.partitionBy("arm", "article").orderBy("late", "h"))).filter(F.col("i") <= 2 * per_article)
        parts.append(p.withColumn("j", F.row_number().over(Window.partitionBy("arm").orderBy("late", "h"))).filter(F.col("j") <= total * (2 * per_article + 1)))
    rows = reduce(DataFrame.unionByName, parts).orderBy("category", "late", "h").collect()
    taken: dict[object, int] = {}
    chosen: dict[object, str] = {}
    for name in pools:
        wanted = TARGETS.get(name, max(0, BUDGET - len(chosen)))
        arms: dict[str, list] = {}
        for r in rows:
            if r.category == name and r.case_id not in chosen:
                arms.setdefault(str(r.arm), []).append(r)
        count = dict.fromkeys(arms, 0)
        while wanted:
            free = {a: next((r for r in rs if taken.get(r.article, 0) < per_article), None) for a, rs in arms.items()}
            open_arms = [a for a, r in free.items() if r is not None]
            if not open_arms:
                break
            arm = min(open_arms, key=lambda a: (count[a], a))
            r = free[arm]
            arms[arm].remove(r)
            taken[r.article] = taken.get(r.article, 0) + 1
            chosen[r.case_id] = name
            count[arm] += 1
            wanted -= 1
    kind = inventory.schema["case_id"].dataType.simpleString()
    return inventory.sparkSession.createDataFrame(list(chosen.items()), f"case_id {kind}, category string")
