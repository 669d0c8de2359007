"""Pairing of detected spans, fusion of methods, grounding of quotes, and outside results mapped to spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import occurrences, place, text_at

KEY = ["doc_id", "ss", "se", "ls", "le"]


def eligible_pairs(tags: DataFrame, docs: DataFrame, max_gap: int = 160, reverse: bool = True) -> DataFrame:
    """doc_id, ss, se, ls, le, cost: short and long spans of a document near enough; cost 0 with a local pattern between them, else the gap.

    Spans are joined through buckets of ``max_gap`` characters, so a document's spans meet only those nearby.
    """
    sf = tags.filter("label = 'SF'").select("doc_id", F.col("s").alias("ss"), F.col("e").alias("se"))
    lf = tags.filter("label = 'LF'").select("doc_id", F.col("s").alias("ls"), F.col("e").alias("le"))
    cells = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / max_gap).cast("long"), F.floor((F.col(e) + max_gap) / max_gap).cast("long")))
    both = sf.withColumn("cell", cells("ss", "se")).join(lf.withColumn("cell", cells("ls", "le")), ["doc_id", "cell"]).drop("cell").distinct()
    first = F.col("le") <= F.col("ss")
    ordered = first | (F.col("se") <= F.col("ls")) if reverse else first
    gap = F.greatest("ss", "ls") - F.least("se", "le")
    p = both.filter(ordered & (gap <= max_gap)).join(docs.select("doc_id", "text"), "doc_id")
    between = text_at(F.col("text"), F.least("se", "le"), F.greatest("ss", "ls"))
    after = text_at(F.col("text"), F.greatest("se", "le"), F.greatest("se", "le") + 2)
    parens = between.rlike(r"^\s*\(\s*$") & after.rlike(r"^\s*[),;]")
    brackets = between.rlike(r"^\s*\[\s*$") & after.rlike(r"^\s*\]")
    local = F.when(first, parens | brackets).otherwise(between.rlike(r"^\s*[,;:]\s*$") | between.rlike(r"^\s*\(\s*[,;]?\s*$"))
    return p.select(*KEY, F.when(local, 0.0).otherwise(gap.cast("double")).alias("cost"))


def pair_shared(pairs: DataFrame, decay: float = 0.05) -> DataFrame:
    """The cheapest long form of each short form; long forms may be shared."""
    best = F.row_number().over(Window.partitionBy("doc_id", "ss", "se").orderBy("cost", "ls", "le"))
    return pairs.withColumn("rn", best).filter("rn = 1").select(*KEY, _score(decay))


def _score(decay: float) -> Column:
    return F.round(F.when(F.col("cost") == 0, 1.0).otherwise(1 / (1 + decay * F.col("cost"))), 6).alias("score")


def pair_one_to_one(pairs: DataFrame, decay: float = 0.05) -> DataFrame:
    """Greedy assignment per document in the order of cost, ss, ls, se, le; both spans are used once. One fold per document."""
    s = F.struct("cost", "ss", "ls", "se", "le")
    grouped = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(s)).alias("p"))
    kind = "array<struct<cost:double,ss:bigint,ls:bigint,se:bigint,le:bigint>>"

    def step(acc, x):
        clash = F.exists(acc, lambda a: ((a["ss"] == x["ss"]) & (a["se"] == x["se"])) | ((a["ls"] == x["ls"]) & (a["le"] == x["le"])))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(x)))

    chosen = grouped.select("doc_id", F.explode(F.aggregate("p", F.array().cast(kind), step)).alias("x")).select("doc_id", "x.*")
    return chosen.select(*KEY, _score(decay))


def _fused(children: dict[str, DataFrame], policy: str) -> DataFrame:
    """KEY, child (the first by priority that has the pair), names of all that have it, accepted."""
    rows = reduce(DataFrame.unionByName, [p.select(*KEY).distinct().withColumn("child", F.lit(n)).withColumn("prio", F.lit(i)) for i, (n, p) in enumerate(children.items())])
    once = rows.groupBy(*KEY).agg(F.min(F.struct("prio", "child")).alias("m"), F.array_sort(F.collect_set("child")).alias("names"))
    once = once.select(*KEY, F.col("m.prio").alias("prio"), F.col("m.child").alias("child"), "names")
    if policy == "retain_all":
        return once.drop("prio").withColumn("accepted", F.lit(True))
    fields = ("prio", *KEY[1:], "child", "names")
    grouped = once.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("p"))
    kind = "prio:int,ss:bigint,se:bigint,ls:bigint,le:bigint,child:string,names:array<string>,accepted:boolean"

    def step(acc, x):
        same = lambda a, s, e: (a[s] == x[s]) & (a[e] == x[e])
        clash = F.exists(acc, lambda a: a["accepted"] & (same(a, "ss", "se") | same(a, "ls", "le")))
        return F.concat(acc, F.array(F.struct(*[x[c].alias(c) for c in fields], (~clash).alias("accepted"))))

    every = F.aggregate("p", F.array().cast(f"array<struct<{kind}>>"), step)
    return grouped.select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.*").drop("prio")


def fuse(children: dict[str, DataFrame], policy: str = "retain_all") -> DataFrame:
    """doc_id, ss, se, ls, le, child, contributors: union of methods in order of priority.

    Equal pairs merge. A pair that shares one span with an accepted one is kept (retain_all) or given up (abstain, priority).
    """
    return _fused(children, policy).filter("accepted").select(*KEY, "child", F.array_join("names", ",").alias("contributors"))


def fuse_log(children: dict[str, DataFrame], policy: str = "retain_all") -> DataFrame:
    """doc_id, ss, se, ls, le, child, accepted, decision: what became of each pair of each method.

    ``accepted`` for the first method that has an accepted pair, ``exact_duplicate_merge`` for the others; pairs given up are ``conflict_abstention``
    under abstain and ``priority_conflict`` under priority.
    """
    lost = "priority_conflict" if policy == "priority" else "conflict_abstention"
    rows = _fused(children, policy).select(*KEY, F.col("child").alias("first"), F.explode("names").alias("child"), "accepted")
    decision = F.when(~F.col("accepted"), lost).when(F.col("child") == F.col("first"), "accepted").otherwise("exact_duplicate_merge")
    return rows.select(*KEY, "child", "accepted", decision.alias("decision"))


def ordinal_pairs(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Outside rows (doc_id, sf, lf, ord) as spans: the k-th row of a pair is the k-th occurrence of both forms, long before short, if counts agree."""
    k = F.row_number().over(Window.partitionBy("doc_id", "sf", "lf").orderBy("ord"))
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "sf", "lf"))
    r = rows.withColumn("k", k).withColumn("n", n).join(docs.select("doc_id", "text"), "doc_id")
    r = r.withColumn("so", occurrences(F.col("text"), F.col("sf"))).withColumn("lo", occurrences(F.col("text"), F.col("lf"))).filter("size(so) = n AND size(lo) = n")
    r = r.withColumn("ss", F.get("so", F.col("k") - 1)).withColumn("ls", F.get("lo", F.col("k") - 1))
    out = r.select("doc_id", "ss", (F.col("ss") + F.length("sf")).cast("long").alias("se"), "ls", (F.col("ls") + F.length("lf")).cast("long").alias("le"))
    return out.filter("le <= ss")


def unique_pairs(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Outside rows (doc_id, sf, lf) as spans where exactly one pair of occurrences has the long form before the short one."""
    r = rows.select("doc_id", "sf", "lf").distinct().join(docs.select("doc_id", "text"), "doc_id")
    r = r.select("doc_id", "sf", "lf", F.explode(occurrences(F.col("text"), F.col("sf"))).alias("ss"), occurrences(F.col("text"), F.col("lf")).alias("lo"))
    r = r.select("doc_id", "sf", "lf", "ss", F.explode("lo").alias("ls")).filter(F.col("ls") + F.length("lf") <= F.col("ss"))
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "sf", "lf"))
    return r.withColumn("n", n).filter("n = 1").select("doc_id", "ss", (F.col("ss") + F.length("sf")).cast("long").alias("se"), "ls", (F.col("ls") + F.length("lf")).cast("long").alias("le"))


def direct_pairs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, i, ss, se, ls, le, code, reason of directly extracted pairs; accepted ones have code ``accepted``, each span pair once.

    pairs: doc_id, i (order), mode, evidence, sf, lf, ss, se, ls, le. In mode ``quote`` the evidence is a quote of the text, and each form stands in it
    exactly once (overlapping occurrences count); exactly one occurrence of it may be left. In mode ``offset`` the spans are given, the forms
    are what stands there, and evidence says ``contiguous`` or ``discontinuous``; the latter is kept out of scoring. A document of
    ``docs`` without a pair has one row, abstained, with i null.
    """
    q = pairs.join(docs.select("doc_id", "text"), "doc_id")
    quote = F.col("mode") == "quote"
    for name, hay, needle in (("a", "text", "evidence"), ("b", "evidence", "sf"), ("c", "evidence", "lf")):
        at, again = place(F.col(hay), F.col(needle))
        q = q.withColumn(name, F.when(quote, at)).withColumn(f"{name}2", again)
    forms = F.col("b").isNotNull() & F.col("c").isNotNull() & ~F.col("b2") & ~F.col("c2") & ((F.col("b") != F.col("c")) | (F.length("sf") != F.length("lf")))
    failed = (
        F.when(F.col("a").isNull(), "evidence_quote is not an exact source substring").when(~forms, "evidence_quote does not contain exactly one occurrence of each form")
        .when(F.col("a2"), "evidence_quote identifies more than one source occurrence")
    )
    q = q.withColumn("failed", F.when(quote, failed))
    start = lambda c, given: F.when(quote & F.col("failed").isNull(), F.col("a") + F.col(c)).when(~quote, F.col(given))
    q = q.withColumn("s1", start("b", "ss")).withColumn("l1", start("c", "ls"))
    q = q.withColumn("s2", F.when(quote, F.col("s1") + F.length("sf")).otherwise(F.col("se"))).withColumn("l2", F.when(quote, F.col("l1") + F.length("lf")).otherwise(F.col("le")))

    def wrong(side: str, s: str, e: str, form: str) -> list[tuple[Column, str]]:
        return [
            (F.col(e) <= F.col(s), f"{side} span must be non-empty"), (F.col(e) > F.length("text"), f"{side} span exceeds document length"),
            (text_at(F.col("text"), F.col(s), F.col(e)) != F.col(form), f"{side} quote does not match the stated occurrence"),
        ]

    checks = [*wrong("short_form", "s1", "s2", "sf"), *wrong("long_form", "l1", "l2", "lf")]
    checks.append(((F.col("s1") == F.col("l1")) & (F.col("s2") == F.col("l2")), "short-form and long-form occurrences must be distinct"))
    problem = F.coalesce(*[F.when(c, m) for c, m in checks])
    code = (
        F.when(F.col("failed").isNotNull(), "quote_grounding_failed").when(~quote & (F.col("evidence") == "discontinuous"), "discontinuous_evidence")
        .when(problem.isNotNull(), "unsupported_output")
    )
    reason = F.coalesce("failed", F.when(code == "unsupported_output", problem))
    spans = [F.col(c).cast("long").alias(n) for c, n in zip(("s1", "s2", "l1", "l2"), KEY[1:], strict=True)]
    judged = q.select("doc_id", "i", *spans, code.alias("code"), reason.alias("reason"))
    again = F.row_number().over(Window.partitionBy(*KEY, F.col("code").isNull()).orderBy("i")) > 1
    judged = judged.withColumn("again", again).withColumn("code", F.coalesce("code", F.when(F.col("again"), "duplicate_output").otherwise("accepted"))).drop("again")
    silent = docs.select("doc_id").join(pairs.select("doc_id").distinct(), "doc_id", "left_anti")
    none = [F.lit(None).cast(judged.schema[c].dataType).alias(c) for c in ("i", *KEY[1:])]
    silent = silent.select("doc_id", *none, F.lit("abstained").alias("code"), F.lit(None).cast("string").alias("reason"))
    return judged.unionByName(silent)


def ground_quotes(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, ss, se, ls, le, verdict of (doc_id, evidence, sf, lf), as quotes of ``direct_pairs``, without removal of repeats."""
    blank = [F.lit(None).cast("long").alias(c) for c in KEY[1:]]
    rows = quotes.select("doc_id", F.monotonically_increasing_id().alias("i"), F.lit("quote").alias("mode"), "evidence", "sf", "lf", *blank)
    out = direct_pairs(rows, docs).filter("code <> 'abstained'")
    there = F.col("code").isin("accepted", "duplicate_output")
    return out.select("doc_id", *[F.when(there, F.col(c)).alias(c) for c in KEY[1:]], F.coalesce("reason", F.lit("grounded")).alias("verdict"))


def judge(answers: DataFrame, t1: float = 0.5, t2: float = 0.5) -> DataFrame:
    """Candidates that a judge's answers (p_definition, orientation, p_orientation) keep; spans swap where the second is the short form."""
    keep = (F.col("p_definition") >= t1) & (F.col("orientation") != "unclear") & (F.col("p_orientation") >= t2)
    swap = F.col("orientation") == "second_is_short_form"
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    kept = answers.filter(keep).select("doc_id", pick("ss", "ls").alias("ss"), pick("se", "le").alias("se"), pick("ls", "ss").alias("ls"), pick("le", "se").alias("le"), F.least("p_definition", "p_orientation").alias("confidence"))
    return kept.groupBy(*KEY).agg(F.round(F.max("confidence"), 6).alias("confidence"))


def judge_choice(answers: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The older policy: candidates whose one choice (forward, reverse, not_definition) is a definition with probability ``threshold`` or more."""
    kept = answers.filter((F.col("choice") != "not_definition") & (F.col("probability") >= threshold))
    swap = F.col("choice") == "reverse"
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    kept = kept.select("doc_id", pick("ss", "ls").alias("ss"), pick("se", "le").alias("se"), pick("ls", "ss").alias("ls"), pick("le", "se").alias("le"), "probability")
    return kept.groupBy(*KEY).agg(F.round(F.max("probability"), 6).alias("confidence"))


def pack_requests(items: DataFrame, most: int = 64, characters: int = 48_000) -> DataFrame:
    """doc_id, request, items, characters: a document's items (i, size) packed in order under both limits."""
    g = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "size"))).alias("p"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("c"), F.array().cast("array<struct<n:int,c:bigint>>").alias("out"))

    def step(acc, x):
        full = (acc["n"] > 0) & ((acc["n"] + 1 > most) | (acc["c"] + x["size"] > characters))
        closed = F.concat(acc["out"], F.array(F.struct(acc["n"].alias("n"), acc["c"].alias("c"))))
        n, c = F.when(full, 1).otherwise(acc["n"] + 1), F.when(full, x["size"]).otherwise(acc["c"] + x["size"])
        return F.struct(n.alias("n"), c.cast("long").alias("c"), F.when(full, closed).otherwise(acc["out"]).alias("out"))

    out = F.aggregate("p", start, step, lambda a: F.concat(a["out"], F.array(F.struct(a["n"].alias("n"), a["c"].alias("c")))))
    return g.select("doc_id", F.posexplode(out).alias("request", "r")).select("doc_id", F.col("request").cast("long").alias("request"), F.col("r.n").cast("long").alias("items"), F.col("r.c").alias("characters"))


def windows(docs: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """doc_id, start, end of overlapping character windows of a tagger."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.length("text") - 1, F.lit(0)).cast("long"), F.lit(size - overlap).cast("long"))
    r = docs.select("doc_id", F.length("text").cast("long").alias("n"), F.explode(starts).alias("start"))
    return r.filter((F.col("start") == 0) | (F.col("start") + overlap < F.col("n"))).select("doc_id", "start", F.least(F.col("start") + size, F.col("n")).alias("end"))


def window_spans(found: DataFrame, docs: DataFrame, labels: tuple[tuple[str, str], ...] = (("AC", "SF"), ("SF", "SF"), ("LF", "LF"))) -> DataFrame:
    """doc_id, label, s, e of a tagger's spans (doc_id, start, label, ws, we) in windows: mapped labels, document offsets, valid ones, each once."""
    name = reduce(lambda c, kv: F.when(F.col("label") == kv[0], kv[1]).otherwise(c), labels, F.lit(None).cast("string"))
    r = found.select("doc_id", name.alias("label"), (F.col("start") + F.col("ws")).alias("s"), (F.col("start") + F.col("we")).alias("e")).join(docs.select("doc_id", F.length("text").alias("n")), "doc_id")
    return r.filter("label IS NOT NULL AND s >= 0 AND s < e AND e <= n").select("doc_id", "label", "s", "e").distinct()


def worker_pairs(results: DataFrame, request: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted pairs of a worker's results (doc_id, sf, lf, accepted) where both forms occur once, and documents of only one of the two sides."""
    pairs = unique_pairs(results.filter("accepted").select("doc_id", "sf", "lf"), request)
    a, b = results.select("doc_id").distinct().withColumn("r", F.lit(1)), request.select("doc_id").distinct().withColumn("q", F.lit(1))
    odd = a.join(b, "doc_id", "full_outer").filter("r IS NULL OR q IS NULL").select("doc_id", F.when(F.col("r").isNull(), "unanswered").otherwise("unasked").alias("problem"))
    return pairs, odd
