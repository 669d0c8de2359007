"""Read-outs over outcomes: eligibility, coverage, transfer, agreement, availability and offset analyses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import occurrences, place, text_at
from glossa.operators.evaluate import KEY, exact_pair, prf, rounded


def eligibility(pairs: DataFrame) -> DataFrame:
    """doc_id, scope, reason, n by an ordered decision list over a pair's spans and the text between them."""
    gap = F.greatest("ss", "ls") - F.least("se", "le")
    e = lambda scope, reason: F.struct(F.lit(scope).alias("scope"), F.lit(reason).alias("reason"))
    scope = (
        F.when(F.col("ss").isNull() | F.col("ls").isNull(), e("unresolved", "missing_span"))
        .when((F.col("ss") < F.col("le")) & (F.col("ls") < F.col("se")), e("unresolved", "overlapping_spans"))
        .when(gap > 160, e("diagnostic", "distant")).when(F.col("ss") < F.col("ls"), e("diagnostic", "reverse_order")).otherwise(e("strict", "local"))
    )
    return pairs.select("doc_id", scope.alias("e")).groupBy("doc_id", F.col("e.scope").alias("scope"), F.col("e.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def candidate_coverage(gold: DataFrame, pipelines: dict[str, DataFrame]) -> DataFrame:
    """pipeline, candidates, covered, precision, recall."""
    n = gold.select(*KEY).distinct().agg(F.count(F.lit(1)).alias("gold"))
    g = gold.select(*KEY).distinct().withColumn("g", F.lit(1))
    rows = reduce(DataFrame.unionByName, [c.select(*KEY).distinct().withColumn("pipeline", F.lit(p)) for p, c in pipelines.items()])
    c = rows.join(g, KEY, "left").groupBy("pipeline").agg(F.count(F.lit(1)).alias("candidates"), F.count("g").alias("covered")).join(F.broadcast(n), F.lit(True))
    return c.select("pipeline", "candidates", "covered", rounded(F.col("covered"), F.col("candidates")).alias("precision"), rounded(F.col("covered"), F.col("gold")).alias("recall"))


def offset_transfer(gold: DataFrame, predictions: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, category, n: exact multiset matches by offset, and what the rest are: same strings elsewhere, boundary, endpoint or spurious."""
    m = exact_pair(gold, predictions)
    text = docs.select("doc_id", "text")
    forms = lambda df: df.join(text, "doc_id").withColumn("sf", F.lower(text_at(F.col("text"), F.col("ss"), F.col("se")))).withColumn("lf", F.lower(text_at(F.col("text"), F.col("ls"), F.col("le")))).drop("text")
    wrong = forms(m.filter("status = 'fp'"))
    missed = forms(m.filter("status = 'fn'"))
    # a false prediction is excused by a missed pair with the same strings, one for one
    by = Window.partitionBy("doc_id", "sf", "lf").orderBy("ss", "ls", "se", "le")
    wrong = wrong.withColumn("k", F.row_number().over(by))
    credit = missed.groupBy("doc_id", "sf", "lf").agg(F.count(F.lit(1)).alias("credit"))
    wrong = wrong.join(credit, ["doc_id", "sf", "lf"], "left")
    g = gold.select("doc_id", *[F.col(c).alias(f"g{c}") for c in KEY[1:]]).distinct()
    ends = wrong.join(g, "doc_id", "left").groupBy(*KEY, "k", "credit", "sf", "lf").agg(
        F.max(((F.col("ss") == F.col("gss")) & (F.col("se") == F.col("gse"))).cast("int")).alias("short"),
        F.max(((F.col("ls") == F.col("gls")) & (F.col("le") == F.col("gle"))).cast("int")).alias("long"),
        F.max(((F.col("ss") < F.col("gse")) & (F.col("gss") < F.col("se")) & (F.col("ls") < F.col("gle")) & (F.col("gls") < F.col("le"))).cast("int")).alias("cross"),
    )
    what = (
        F.when(F.col("k") <= F.coalesce("credit", F.lit(0)), "same_strings").when(F.col("cross") == 1, "boundary").when(F.col("short") == 1, "short_endpoint")
        .when(F.col("long") == 1, "long_endpoint").otherwise("spurious")
    )
    errors = ends.select("doc_id", what.alias("category"))
    rest = m.filter("status <> 'fp'").select("doc_id", F.when(F.col("status") == "tp", "exact").otherwise("missed").alias("category"))
    return errors.unionByName(rest).groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n"))


def agreement(docs: DataFrame, methods: dict[str, DataFrame]) -> DataFrame:
    """doc_id, class: all_empty, exact_agreement, boundary_disagreement (same short forms) or relation_disagreement of several methods."""
    names = list(methods)
    rows = reduce(DataFrame.unionByName, [p.select(*KEY, F.lit(n).alias("method")) for n, p in methods.items()])
    sets = rows.groupBy("doc_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("method") == n, F.struct("ss", "se", "ls", "le")))).alias(n) for n in names])
    sets = docs.select("doc_id").join(sets, "doc_id", "left")
    empty = F.array().cast("array<struct<ss:bigint,se:bigint,ls:bigint,le:bigint>>")
    cols = [F.coalesce(F.col(n), empty) for n in names]
    short = [F.array_sort(F.array_distinct(F.transform(c, lambda x: F.struct(x["ss"], x["se"])))) for c in cols]
    all_same = lambda xs: reduce(lambda a, b: a & b, [x == xs[0] for x in xs[1:]], F.lit(True))
    nothing = reduce(lambda a, b: a & b, [F.size(c) == 0 for c in cols])
    return sets.select("doc_id", F.when(nothing, "all_empty").when(all_same(cols), "exact_agreement").when(all_same(short), "boundary_disagreement").otherwise("relation_disagreement").alias("class"))


def abbreviation_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, tokens, n: distinct blank-separated tokens, stripped of ``.,;:()``, of 2 to 12 characters, that are upper case or have a digit."""
    t = F.transform(F.split("text", r"\s+"), lambda x: F.regexp_replace(x, r"^[.,;:()]+|[.,;:()]+$", ""))
    t = F.filter(t, lambda x: (F.length(x).between(2, 12)) & (x.rlike("[0-9]") | (x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}"))))
    return docs.select("doc_id", F.array_sort(F.array_distinct(t)).alias("t")).select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n"))


def mapping_loss(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """role, cause, n: why a form can't be placed: absent from the text, or repeated in it."""
    forms = pairs.select("doc_id", F.inline(F.array(F.struct(F.lit("short").alias("role"), F.col("sf").alias("form")), F.struct(F.lit("long").alias("role"), F.col("lf").alias("form")))))
    at, again = place(F.col("text"), F.col("form"))
    cause = F.when(at.isNull(), "absent").when(again, "repeated").otherwise("mapped")
    return forms.join(docs.select("doc_id", "text"), "doc_id").groupBy("role", cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def availability(outcomes: DataFrame, failed: DataFrame, gates: dict[str, float]) -> DataFrame:
    """view, tp, fp, fn, precision, recall, f1, passed: with failed documents left out, and with their gold counted as missed."""
    f = failed.select("doc_id").distinct().withColumn("failed", F.lit(True))
    o = outcomes.join(f, "doc_id", "left")
    kept = o.filter("failed IS NULL").select(F.lit("successful").alias("view"), "status")
    lost = o.filter("failed").filter("status IN ('tp', 'fn')").select(F.lit("adjusted").alias("view"), F.lit("fn").alias("status"))
    every = kept.unionByName(kept.withColumn("view", F.lit("adjusted"))).unionByName(lost)
    p = prf(every, ["view"])
    return p.withColumn("passed", reduce(lambda a, b: a & b, [F.col(k) >= v for k, v in gates.items()]))


def offset_errors(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """multiplicity, pattern, delta, n of offered (doc_id, quote, s, e) against where the quote is."""
    at = occurrences(F.col("text"), F.col("quote"))
    q = quotes.join(docs.select("doc_id", "text"), "doc_id").withColumn("at", at).withColumn("k", F.size("at"))
    nearest = F.array_min(F.transform("at", lambda x: F.struct(F.abs(x - F.col("s")).alias("d"), x.alias("x"))))["x"]
    q = q.withColumn("x", F.when(F.col("k") > 0, nearest))
    right_s, right_e = F.col("x") == F.col("s"), (F.col("x") + F.length("quote")) == F.col("e")
    pattern = F.when(F.col("k") == 0, "none").when(right_s & right_e, "both").when(right_s, "start_only").when(right_e, "end_only").otherwise("neither")
    many = F.when(F.col("k") == 0, "absent").when(F.col("k") == 1, "unique").otherwise("repeated")
    return q.groupBy(many.alias("multiplicity"), pattern.alias("pattern"), (F.col("s") - F.col("x")).alias("delta")).agg(F.count(F.lit(1)).alias("n"))


def wilson_half_width(counts: DataFrame, by: str) -> DataFrame:
    """by, n, half_width: the Wilson 95 % half width at p = 0.5."""
    z = 1.96
    n = F.col("n")
    return counts.groupBy(by).agg(F.count(F.lit(1)).alias("n")).withColumn("half_width", F.round(F.lit(z) * F.sqrt(0.25 / n + z * z / (4 * n * n)) / (1 + z * z / n), 6))


def request_plan(docs: DataFrame, by: str, per_request: int = 64) -> DataFrame:
    """by, documents, characters, tokens, requests: sizes of calls to an external judge, a token being four characters, one at least."""
    n = F.length("text")
    c = docs.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.sum(n).cast("long").alias("characters"), F.sum(F.greatest(F.lit(1), F.floor(n / 4))).cast("long").alias("tokens"))
    return c.withColumn("requests", F.ceil(F.col("documents") / per_request).cast("long"))


def downstream(baseline: DataFrame, propagated: DataFrame, gold: DataFrame) -> DataFrame:
    """added, removed, precision, recall of entity sets (doc_id, entity) before and after abbreviations are resolved."""
    cols = ["doc_id", "entity"]
    sets = [x.select(*cols).distinct().withColumn(n, F.lit(1)) for x, n in ((baseline, "b"), (propagated, "p"), (gold, "g"))]
    m = reduce(lambda a, b: a.join(b, cols, "full_outer"), sets)
    has = lambda *c: F.count(F.when(reduce(lambda a, b: a & b, c), 1))
    b, p, g = (F.col(c).isNotNull() for c in "bpg")
    c = m.agg(has(p, ~b).alias("added"), has(b, ~p).alias("removed"), has(p, g).alias("right"), has(p).alias("np"), has(g).alias("ng"))
    return c.select("added", "removed", rounded(F.col("right"), F.col("np")).alias("precision"), rounded(F.col("right"), F.col("ng")).alias("recall"))


def error_contexts(outcomes: DataFrame, docs: DataFrame, width: int = 20) -> DataFrame:
    """Rows of an error report: the pair, its status, and ``width`` characters on both sides, HTML-escaped."""
    a, b = F.greatest(F.least("ss", "ls") - width, F.lit(0)), F.greatest("se", "le") + width
    shown = text_at(F.col("text"), a, b)
    for x, y in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        shown = F.replace(shown, F.lit(x), F.lit(y))
    return outcomes.filter("status IN ('fp', 'fn')").join(docs.select("doc_id", "text"), "doc_id").select(*KEY, "status", shown.alias("context"))
