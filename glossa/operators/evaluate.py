"""Matching predictions to gold, metrics and comparisons of methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.lineage import checkpoint, hash_rank

KEY = ["doc_id", "ss", "se", "ls", "le"]


def _number(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))


def exact_pair(gold: DataFrame, predictions: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Multiset matching: keys..., status tp, fp, fn, or unscoreable where a key column is null; one row per occurrence.

    Copies of a key are numbered on both sides and joined by number, so within a key the smaller count matches and the surplus is fn or fp.
    """
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    sides = [_number(df.filter(whole).select(*keys), keys).withColumn(side, F.lit(True)) for df, side in ((gold, "g"), (predictions, "p"))]
    status = F.when(F.col("g") & F.col("p"), "tp").when(F.col("g"), "fn").otherwise("fp")
    out = sides[0].join(sides[1], [*keys, "rn"], "full_outer").select(*keys, status.alias("status"))
    part = [df.filter(~whole).select(*keys, F.lit("unscoreable").alias("status")) for df in (gold, predictions)]
    return out.unionByName(part[0]).unionByName(part[1])


def one_sided(df: DataFrame) -> DataFrame:
    """Each definition as its short and its long span: doc_id, side, s, e."""
    return df.select("doc_id", F.inline(F.array(F.struct(F.lit("short").alias("side"), F.col("ss").alias("s"), F.col("se").alias("e")), F.struct(F.lit("long").alias("side"), F.col("ls").alias("s"), F.col("le").alias("e")))))


def exact_span(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    return exact_pair(one_sided(gold), one_sided(predictions), ["doc_id", "side", "s", "e"])


def rounded(a: Column, b: Column) -> Column:
    """a / b to six digits, 0 where b is 0."""
    return F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))


def prf(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, over all outcomes or per group."""
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("tp", "fp", "fn")]
    c = outcomes.groupBy(*(by or [])).agg(*counts)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*(by or []), tp, fp, fn, rounded(tp, tp + fp).alias("precision"), rounded(tp, tp + fn).alias("recall"), rounded(2 * tp, 2 * tp + fp + fn).alias("f1"))


def by_document(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("doc_id").agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("tp", "fp", "fn", "unscoreable")])


def strata(outcomes: DataFrame, value: str) -> DataFrame:
    """value x status counts, zero-filled."""
    return outcomes.groupBy(value).pivot("status", ["tp", "fp", "fn", "unscoreable"]).agg(F.count(F.lit(1))).na.fill(0)


def coverage(gold_docs: DataFrame, predicted_docs: DataFrame) -> DataFrame:
    """doc_id, problem: documents missing from, unknown to or repeated in the predictions."""
    g, p = gold_docs.select("doc_id").distinct(), predicted_docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "duplicate")
    return g.withColumn("known", F.lit(True)).join(p, "doc_id", "full_outer").select("doc_id", problem.alias("problem")).filter("problem IS NOT NULL")


def compare(gold: DataFrame, methods: dict[str, DataFrame]) -> DataFrame:
    """method, tp, fp, fn, precision, recall, f1, unique_correct, oracle_recall."""
    rows = reduce(DataFrame.unionByName, [_number(exact_pair(gold, p), [*KEY, "status"]).withColumn("method", F.lit(m)) for m, p in methods.items()])
    scores = prf(rows, ["method"])
    right = rows.filter("status = 'tp'").groupBy(*KEY, "rn").agg(F.count(F.lit(1)).alias("n"), F.min("method").alias("method"))
    alone = right.filter("n = 1").groupBy("method").agg(F.count(F.lit(1)).alias("unique_correct"))
    union = right.agg(F.count(F.lit(1)).alias("found")).join(gold.filter("ss IS NOT NULL AND ls IS NOT NULL").agg(F.count(F.lit(1)).alias("all")), F.lit(True))
    return scores.join(alone, "method", "left").na.fill(0, ["unique_correct"]).join(F.broadcast(union.select(rounded(F.col("found"), F.col("all")).alias("oracle_recall"))), F.lit(True))


def bootstrap_ci(outcomes: DataFrame, groups: DataFrame | None = None, rounds: int = 1000, seed: str = "boot") -> DataFrame:
    """lower and upper of precision, recall and F1: nearest-rank 2.5 % and 97.5 % points over rounds of resampled article groups.

    groups: doc_id, group; None: each document is its own. A round draws as many groups as there are, with replacement: its j-th draw is the group whose
    rank by digest is a hash of (seed, round, j) modulo their number. Groups get their ranks without a sort of all of them, and a round's draws
    are added up before anything is gathered.
    """
    units = by_document(outcomes)
    units = units.withColumn("group", F.col("doc_id")) if groups is None else units.join(groups.select("doc_id", "group").distinct(), "doc_id")
    units = units.groupBy("group").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    units = checkpoint(hash_rank(units, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("group").cast("string")), 256), "place"))
    n = max(1, units.count())
    drawn = units.select(F.col("place").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("b"))
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "b", "j"), 256), 1, 12), 16, 10).cast("long")
    sums = drawn.select("b", (h % n).alias("place")).join(units, "place").groupBy("b").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    values = {"precision": rounded(tp, tp + fp), "recall": rounded(tp, tp + fn), "f1": rounded(2 * tp, 2 * tp + fp + fn)}
    long = sums.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value"), F.col("b").alias("b")) for m, v in values.items()])))
    ranked = long.withColumn("i", F.row_number().over(Window.partitionBy("metric").orderBy("value", "b")) - 1)  # a row per round
    at = lambda p: F.max(F.when(F.col("i") == min(rounds - 1, int(p * (rounds - 1))), F.col("value")))
    return ranked.groupBy("metric").agg(at(0.025).alias("lower"), at(0.975).alias("upper"))


def recovery_by_method(gold: DataFrame, methods: dict[str, DataFrame]) -> DataFrame:
    """Gold pairs with the outcome of ``recovery`` in a column per method."""
    out = gold.select(*KEY).distinct()
    for name, found in methods.items():
        out = out.join(recovery(gold, found).select(*KEY, F.col("outcome").alias(name)).distinct(), KEY)
    return out


def pair_metrics(strict: DataFrame, diagnostic: DataFrame, predictions: DataFrame) -> DataFrame:
    """n, tp, outside, fp against a strict and a diagnostic key set; repeats of a key are false."""
    p = _number(predictions.select(*KEY), KEY)
    s = strict.select(*KEY).distinct().withColumn("s", F.lit(1))
    d = diagnostic.select(*KEY).distinct().withColumn("d", F.lit(1))
    m = p.join(s, KEY, "left").join(d, KEY, "left")
    tp, outside = (F.col("rn") == 1) & F.col("s").isNotNull(), (F.col("rn") == 1) & F.col("s").isNull() & F.col("d").isNotNull()
    c = m.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(tp, 1)).alias("tp"), F.count(F.when(outside, 1)).alias("outside"))
    return c.withColumn("fp", F.col("n") - F.col("tp") - F.col("outside"))


def recovery(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gold keys with how each was recovered: exact, both_endpoints, overlapping, absent."""
    g, p = gold.select(*KEY).distinct(), predictions.select(*KEY).distinct()
    exact = p.withColumn("exact", F.lit(1))
    sides = [p.select("doc_id", *c).distinct().withColumn(n, F.lit(1)) for c, n in ((["ss", "se"], "short"), (["ls", "le"], "long"))]
    q = p.select("doc_id", *[F.col(c).alias(f"p{c}") for c in KEY[1:]])
    crosses = (F.col("pss") < F.col("se")) & (F.col("ss") < F.col("pse")) & (F.col("pls") < F.col("le")) & (F.col("ls") < F.col("ple"))
    near = g.join(q, "doc_id").filter(crosses).select(*KEY).distinct().withColumn("near", F.lit(1))
    m = g.join(exact, KEY, "left").join(sides[0], ["doc_id", "ss", "se"], "left").join(sides[1], ["doc_id", "ls", "le"], "left").join(near, KEY, "left")
    how = F.when(F.col("exact") == 1, "exact").when((F.col("short") == 1) & (F.col("long") == 1), "both_endpoints").when(F.col("near") == 1, "overlapping").otherwise("absent")
    return m.select(*KEY, how.alias("outcome"))


def dispositions(methods: DataFrame, strict: DataFrame, diagnostic: DataFrame) -> DataFrame:
    """method, disposition, n: only the first repeat of a key counts as correct or out of scope."""
    m = methods.withColumn("rn", F.row_number().over(Window.partitionBy("method", *KEY).orderBy("method")))
    m = m.join(strict.select(*KEY).distinct().withColumn("s", F.lit(1)), KEY, "left").join(diagnostic.select(*KEY).distinct().withColumn("d", F.lit(1)), KEY, "left")
    what = F.when((F.col("rn") == 1) & (F.col("s") == 1), "correct").when((F.col("rn") == 1) & (F.col("d") == 1), "out_of_scope").otherwise("false_positive")
    return m.groupBy("method", what.alias("disposition")).agg(F.count(F.lit(1)).alias("n"))


def baseline_delta(gold: DataFrame, baseline: DataFrame, method: DataFrame) -> DataFrame:
    """added_correct, extra_errors of a method over a baseline, as sets of keys."""
    g, b, m = (x.select(*KEY).distinct() for x in (gold, baseline, method))
    new = m.join(b, KEY, "left_anti").join(g.withColumn("g", F.lit(1)), KEY, "left")
    return new.agg(F.count("g").alias("added_correct"), F.count(F.when(F.col("g").isNull(), 1)).alias("extra_errors"))


def endpoint_audit(detected: DataFrame, paired: DataFrame, accepted: DataFrame) -> DataFrame:
    """doc_id, detected, paired, accepted, lost: endpoints (side, span) that taggers found, pairing used, and matching accepted."""
    sets = [one_sided(x).filter("s IS NOT NULL").distinct().withColumn("stage", F.lit(n)) for x, n in ((paired, "paired"), (accepted, "accepted"))]
    tags = detected.select("doc_id", F.when(F.col("label") == "SF", "short").otherwise("long").alias("side"), "s", "e").distinct().withColumn("stage", F.lit("detected"))
    c = reduce(DataFrame.unionByName, sets, tags).groupBy("doc_id").pivot("stage", ["detected", "paired", "accepted"]).agg(F.count(F.lit(1))).na.fill(0)
    return c.withColumn("lost", F.col("detected") - F.col("paired"))


def endpoint_ceiling(gold: DataFrame, detected: DataFrame) -> DataFrame:
    """both, one, none, strict_ceiling, endpoint_share, any_share of gold pairs by detected endpoints."""
    ends = {lab: detected.filter(F.col("label") == lab).select("doc_id", F.col("s").alias(a), F.col("e").alias(b)).distinct().withColumn(f"has_{lab}", F.lit(1)) for lab, a, b in (("SF", "ss", "se"), ("LF", "ls", "le"))}
    m = gold.join(ends["SF"], ["doc_id", "ss", "se"], "left").join(ends["LF"], ["doc_id", "ls", "le"], "left")
    n = F.coalesce("has_SF", F.lit(0)) + F.coalesce("has_LF", F.lit(0))
    c = m.select(n.alias("n")).agg(*[F.count(F.when(F.col("n") == k, 1)).alias(a) for k, a in ((2, "both"), (1, "one"), (0, "none"))])
    total = F.col("both") + F.col("one") + F.col("none")
    return c.select("both", "one", "none", rounded(F.col("both"), total).alias("strict_ceiling"), rounded(2 * F.col("both") + F.col("one"), 2 * total).alias("endpoint_share"), rounded(F.col("both") + F.col("one"), total).alias("any_share"))


def calibrate(scored: DataFrame, grid: list[float]) -> DataFrame:
    """threshold, precision, recall, f1 of the best threshold for (score, label): by F1, precision, threshold, largest first."""
    over = scored.select("label", "score", F.explode(F.array(*[F.lit(g) for g in grid])).alias("threshold"))
    kept = F.col("score") >= F.col("threshold")
    status = F.when(kept & (F.col("label") == 1), "tp").when(kept, "fp").when(F.col("label") == 1, "fn").otherwise("tn")
    p = prf(over.select("threshold", status.alias("status")), ["threshold"])
    return p.agg(F.max(F.struct("f1", "precision", "threshold", "recall")).alias("m")).select("m.threshold", "m.precision", "m.recall", "m.f1")


def calibrate_joint(scored: DataFrame, grid: list[float]) -> DataFrame:
    """t1, t2, precision, recall, f1 of the best pair of thresholds for (s1, s2, label)."""
    a = F.array(*[F.lit(g) for g in grid])
    # counts per pair of grid cells first; the grid is joined to those, not to the rows
    cell = lambda c: F.size(F.filter(a, lambda g: g <= F.col(c)))
    cells = scored.groupBy(cell("s1").alias("i"), cell("s2").alias("j")).agg(F.sum("label").cast("long").alias("pos"), F.count(F.lit(1)).alias("n"))
    pairs = cells.select("i", "j", "pos", "n", F.explode(F.sequence(F.lit(1), F.lit(len(grid)))).alias("k")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(grid)))).alias("l"))
    kept = (F.col("i") >= F.col("k")) & (F.col("j") >= F.col("l"))
    c = pairs.groupBy("k", "l").agg(F.sum(F.when(kept, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("kept"), F.sum("pos").alias("all"))
    tp = F.col("tp")
    c = c.select(F.get(a, F.col("k") - 1).alias("t1"), F.get(a, F.col("l") - 1).alias("t2"), rounded(tp, F.col("kept")).alias("precision"), rounded(tp, F.col("all")).alias("recall"), rounded(2 * tp, F.col("kept") + F.col("all")).alias("f1"))
    return c.agg(F.max(F.struct("f1", "precision", "t1", "t2", "recall")).alias("m")).select("m.t1", "m.t2", "m.precision", "m.recall", "m.f1")
