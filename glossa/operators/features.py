"""Numeric features of candidates: columns over (doc_id, ss, se, ls, le, text, short, long)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.lineage import checkpoint
from glossa.functions.text import WORD_CHARS, count_of, flag, occurrences, ratio, text_at

#: A lexicon of up to this many rows is broadcast, as a count has checked.
BROADCAST_ROWS = 100_000
LETTER, UPPER, LOWER = r"\p{L}", r"\p{Lu}", r"\p{Ll}"


def with_texts(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates with the document's text and their own short and long texts."""
    rows = candidates.join(docs.select("doc_id", "text"), "doc_id")
    return rows.withColumn("short", text_at(F.col("text"), F.col("ss"), F.col("se"))).withColumn("long", text_at(F.col("text"), F.col("ls"), F.col("le")))


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: rows of the usual table, folded over the characters of a."""
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    right = chars(b)
    zero = F.transform(right, lambda _: F.lit(0))

    def row(prev: Column, ch: Column) -> Column:
        # each cell with what stands above it and before that, so that no cell looks anything up
        before = F.slice(F.concat(F.array(F.lit(0)), prev), F.lit(1), F.size(prev))
        above = F.zip_with(prev, before, lambda up, diagonal: F.struct(up.alias("up"), diagonal.alias("diagonal")))
        cells = F.zip_with(right, above, lambda c, x: F.struct(c.alias("c"), x["up"].alias("up"), x["diagonal"].alias("diagonal")))

        def cell(acc: Column, x: Column) -> Column:
            best = F.when(x["c"] == ch, x["diagonal"] + 1).otherwise(F.greatest(x["up"], acc["left"]))
            return F.struct(best.alias("left"), F.concat(acc["out"], F.array(best)).alias("out"))

        return F.aggregate(cells, F.struct(F.lit(0).alias("left"), F.array().cast("array<int>").alias("out")), cell, lambda s: s["out"])

    return F.coalesce(F.array_max(F.aggregate(chars(a), zero, row)), F.lit(0))


def alignment() -> dict[str, Column]:
    norm = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    a, b = norm(F.col("short")), norm(F.col("long"))
    # the subsequence is found once per row; the ratios are taken from the number
    found = F.transform(F.array(F.struct(lcs(a, b).alias("n"), F.length(a).alias("a"), F.length(b).alias("b"))), lambda x: x)
    of = F.get(found, F.lit(0))
    n = of["n"]
    return {"lcs": n.cast("double"), "lcs_short": ratio(n, of["a"]), "lcs_long": ratio(n, of["b"]), "length_ratio": ratio(F.length(a), F.length(b)), "equal": flag(a == b)}


def token_counts() -> dict[str, Column]:
    a, b = count_of(F.col("short"), WORD_CHARS), count_of(F.col("long"), WORD_CHARS)
    return {"short_tokens": a.cast("double"), "long_tokens": b.cast("double"), "token_ratio": ratio(a, b), "token_difference": (b - a).cast("double")}


def capitalization() -> dict[str, Column]:
    out = {}
    for side in ("short", "long"):
        c = F.col(side)
        letters, up, low = count_of(c, LETTER), count_of(c, UPPER), count_of(c, LOWER)
        out |= {
            f"{side}_all_upper": flag((letters > 0) & (low == 0)), f"{side}_initial_upper": flag(c.rlike(rf"^{UPPER}")), f"{side}_all_lower": flag((letters > 0) & (up == 0)),
            f"{side}_mixed_case": flag((up > 0) & (low > 0)), f"{side}_uppercase_ratio": ratio(up, letters),
        }
    return out


def digits_punctuation() -> dict[str, Column]:
    out = {}
    for side in ("short", "long"):
        c = F.col(side)
        d, p = count_of(c, r"\p{Nd}"), count_of(c, r"[^\p{L}\p{N}\s]")
        out |= {
            f"{side}_digits": d.cast("double"), f"{side}_digit_ratio": ratio(d, F.length(c)), f"{side}_punctuation": p.cast("double"),
            f"{side}_punctuation_ratio": ratio(p, F.length(c)), f"{side}_has_digit": flag(d > 0), f"{side}_has_punctuation": flag(p > 0),
        }
    return out


def lengths() -> dict[str, Column]:
    a, b = F.length("short"), F.length("long")
    return {"short_length": a.cast("double"), "long_length": b.cast("double"), "short_over_long": ratio(a, b), "long_over_short": ratio(b, a), "length_difference": (b - a).cast("double"), "short_is_shorter": flag(a < b)}


def positions() -> dict[str, Column]:
    n = F.length("text")
    ss, se, ls, le = (F.col(c) for c in ("ss", "se", "ls", "le"))
    return {
        "short_first": flag(ss <= ls), "long_first": flag(ls < ss), "short_start": ratio(ss, n), "long_start": ratio(ls, n), "short_centre": ratio(ss + se, 2 * n),
        "long_centre": ratio(ls + le, 2 * n), "gap": F.greatest(F.lit(0), F.greatest(ss, ls) - F.least(se, le)).cast("double"),
    }


def cues(words: tuple[str, ...] = ("called", "known as", "abbreviated"), context: int = 80) -> dict[str, Column]:
    a, b = F.greatest(F.least("ss", "ls") - context, F.lit(0)), F.greatest("se", "le") + context
    around = F.lower(text_at(F.col("text"), a, b))
    names = [w.replace(" ", "_") for w in words]
    if len(set(names)) != len(names):
        raise ValueError("cues must have different names")
    return {f"cue_{n}": flag(F.contains(around, F.lit(w.lower()))) for n, w in zip(names, words, strict=True)}


def parenthetical_metadata(labels: tuple[str, ...] = ("parenthetical", "nested", "reverse")) -> dict[str, Column]:
    out = {f"from_{x}": flag(F.col("generator") == x) for x in labels}
    inside = lambda s, e: flag((F.substring(F.col("text"), F.col(s), F.lit(1)) == "(") & (F.col(s) > 0) & (F.substring(F.col("text"), F.col(e) + 1, F.lit(1)) == ")"))
    return out | {"from_other": flag(~F.col("generator").isin(*labels)), "short_in_parens": inside("ss", "se"), "long_in_parens": inside("ls", "le")}


def lexicon_evidence(rows: DataFrame, lexicon: DataFrame, context: int = 80) -> DataFrame:
    """Per candidate: variants, sources, agreement, long_forms, total, exact_pair, short_nearby; lexicon has a ``source_label``.

    A candidate meets one row with the numbers of its short form, not each variant, and then with its long text at most one row of that form's
    long forms. Only numbers are gathered, not the context.
    """
    key = ["doc_id", "ss", "se", "ls", "le"]
    kept = checkpoint(lexicon.filter("sf_key IS NOT NULL").select("sf_key", "sf_raw", "lf_raw", "lf_key", "n", "source_label"))
    raws = kept.filter("lf_raw IS NOT NULL AND sf_raw IS NOT NULL").groupBy("sf_key", "sf_raw").agg(F.count(F.lit(1)).alias("k"))
    forms = kept.groupBy("sf_key").agg(F.count("lf_raw").alias("variants"), F.count_distinct("source_label").alias("sources"), F.count_distinct("lf_key").alias("long_forms"), F.sum("n").alias("total"))
    forms = checkpoint(forms.join(raws.groupBy("sf_key").agg(F.collect_list(F.struct("sf_raw", "k")).alias("raws")), "sf_key", "left"))
    # long forms by their lower case: whether it is a key, and the raw forms that have it
    low = kept.filter("lf_raw IS NOT NULL").select("sf_key", F.explode(F.array(F.struct(F.col("lf_key").alias("low"), F.lit(None).cast("string").alias("raw")), F.struct(F.lower("lf_raw").alias("low"), F.col("lf_raw").alias("raw")))).alias("f"))
    low = low.select("sf_key", "f.*").filter("low IS NOT NULL").groupBy("sf_key", "low").agg(F.max(F.col("raw").isNull()).alias("keyed"), F.collect_set("raw").alias("exact"))

    near = text_at(F.col("text"), F.greatest(F.col("ls") - context, F.lit(0)), F.col("le") + context)
    r = rows.select(*key, "long", near.alias("near"), F.lower("short").alias("sf_key")).join(F.broadcast(forms) if forms.count() <= BROADCAST_ROWS else forms, "sf_key", "left")
    around = F.aggregate("raws", F.lit(0).cast("long"), lambda a, x: (a + F.size(occurrences(F.col("near"), x["sf_raw"])) * x["k"]).cast("long"))
    r = r.select(*key, "sf_key", "long", F.lower("long").alias("low"), "variants", "sources", "long_forms", "total", around.alias("around")).join(low, ["sf_key", "low"], "left")
    pair, of = F.col("keyed") | F.array_contains("exact", F.col("long")), F.xxhash64("sf_key")
    sums = checkpoint(r.groupBy(*key).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("variants", "total")], *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("sources", "long_forms")],
        F.max(flag(F.coalesce(pair, F.lit(False)))).alias("exact_pair"), F.coalesce(F.sum("around"), F.lit(0)).alias("short_nearby"), (F.min(of) != F.max(of)).alias("several"),
    ))
    # a doc_id with several texts may give a span several short forms, whose sources and long forms are counted together
    several = sums.filter("several").select(*key)
    if not several.isEmpty():
        both = rows.select(*key, F.lower("short").alias("sf_key")).join(several, key, "left_semi").distinct().join(kept, "sf_key", "left")
        both = both.groupBy(*key).agg(F.count_distinct("source_label").alias("sources"), F.count_distinct("lf_key").alias("long_forms"))
        sums = sums.filter("NOT several").unionByName(sums.filter("several").drop("sources", "long_forms").join(both, key))
    names = ("variants", "sources", "long_forms", "total", "exact_pair", "short_nearby")
    return sums.select(*key, *names, flag(F.col("sources") > 1).alias("agreement"))


def feature_set(rows: DataFrame, extractors: list[dict[str, Column]], keep: list[str]) -> DataFrame:
    """The features as columns after ``keep``. Names must be unique."""
    names = [n for e in extractors for n in e]
    if len(set(names)) != len(names):
        raise ValueError("feature names must be unique")
    return rows.select(*keep, *[c.alias(n) for e in extractors for n, c in e.items()])


def candidate_index(candidates: DataFrame) -> DataFrame:
    """Position of each candidate in its document, from 0, in span order."""
    w = Window.partitionBy("doc_id").orderBy("ss", "se", "ls", "le")
    return candidates.withColumn("candidate_index", (F.row_number().over(w) - 1).cast("long"))


def linear_score(features: DataFrame, weights: dict[str, float], bias: float) -> Column:
    """Stable sigmoid of a dot product."""
    z = reduce(lambda a, kv: a + F.col(kv[0]) * F.lit(kv[1]), weights.items(), F.lit(bias))
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
