"""Span-pair extraction: rule resolvers and candidate generators as table functions over (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.lineage import checkpoint
from glossa.functions.text import SHORT_FORM, WORD, backwards, fold, last_words, occurrences, openings, scan, starts, strip, text_at

SPANS = ["doc_id", "ss", "se", "ls", "le"]


def _long(c: Column, name: str) -> Column:
    return c.cast("long").alias(name)


def schwartz_hearst(docs: DataFrame, min_sf: int = 2, max_lf_words: int | None = None, case_sensitive: bool = False, ignore_non_alnum: bool = True) -> DataFrame:
    """doc_id, ss, se, ls, le, sf, lf: long form before ``(SF)``, aligned backwards.

    The greedy backward alignment ends at the largest admissible start, so the start is found as the last word start from which
    the characters of the short form follow one another: one greedy pattern instead of a loop.
    """
    low = (lambda c: c) if case_sensitive else fold
    keep = "[^A-Za-z0-9]" if ignore_non_alnum else "[^A-Za-z0-9'-]"
    found = F.filter(openings(F.col("text")), lambda x: x["content"].rlike(f"^{SHORT_FORM}$") & (F.length(x["content"]) >= min_sf))

    def resolve(x: Column) -> Column:
        n = F.length(x["content"])
        most = F.lit(max_lf_words) if max_lf_words else F.least(n + 5, 2 * n)
        return F.struct(x["open"].alias("open"), x["content"].alias("sf"), last_words(F.col("text"), x["open"], most).alias("w"))

    rows = docs.select("doc_id", F.explode(F.transform(found, resolve)).alias("r")).select("doc_id", "r.open", "r.sf", "r.w").filter("w IS NOT NULL")
    chars = F.filter(F.split(low(F.regexp_replace("sf", keep, "")), ""), lambda c: c != "")
    edge = "[^A-Za-z0-9]" if case_sensitive else "[^a-z0-9]"
    pattern = F.concat(F.lit(f"(?s)^((?:.*{edge})?)"), F.array_join(chars, ".*"))
    window = low(F.col("w.window"))
    rows = rows.withColumn("ok", F.regexp_like(window, pattern)).withColumn("skip", F.length(F.call_function("regexp_extract", window, pattern, F.lit(1))))
    rows = rows.filter("ok").withColumn("lf", F.expr("substring(w.window, skip + 1)"))
    return rows.select(
        "doc_id", _long(F.col("open") + 1, "ss"), _long(F.col("open") + 1 + F.length("sf"), "se"), _long(F.col("w.start") + F.col("skip"), "ls"), _long(F.col("w.end"), "le"), "sf", "lf"
    )


def toy(docs: DataFrame) -> DataFrame:
    """doc_id, ss, se, ls, le: the whole run of letters, digits, blanks and hyphens before ``(SF)`` as the long form."""
    found = F.filter(openings(F.col("text")), lambda x: x["content"].rlike(f"^{SHORT_FORM}$"))

    def resolve(x: Column) -> Column:
        piece = lambda k: F.length(backwards(F.col("text"), x["open"], r"^(\s*)([A-Za-z0-9][A-Za-z0-9 -]*[A-Za-z])", k, "[^A-Za-z0-9 -]"))
        return F.struct(x["open"].alias("open"), x["content"].alias("sf"), piece(2).alias("n"), piece(1).alias("gap"))

    rows = docs.select("doc_id", F.explode(F.transform(found, resolve)).alias("r")).select("doc_id", "r.*").filter("n > 0")
    return rows.select(
        "doc_id", _long(F.col("open") + 1, "ss"), _long(F.col("open") + 1 + F.length("sf"), "se"), _long(F.col("open") - F.col("gap") - F.col("n"), "ls"), _long(F.col("open") - F.col("gap"), "le")
    )


def _judged(docs: DataFrame, min_sf: int, max_sf: int, max_words: int) -> DataFrame:
    """Every parenthesis with its verdict and its word window."""

    def judge(x: Column) -> Column:
        s = strip(x["content"])
        lead = F.length(F.regexp_extract(x["content"], r"^\s*", 0))
        w = last_words(F.col("text"), x["open"], F.lit(max_words))
        code = (
            F.when(~s.rlike(f"^{SHORT_FORM}$"), "short_form_invalid").when(F.length(s) < min_sf, "short_form_too_short")
            .when(F.length(s) > max_sf, "short_form_too_long").when(w.isNull(), "missing_long_form_context")
        )
        return F.struct(x["open"].alias("open"), code.alias("code"), (x["open"] + 1 + lead).alias("ss"), F.length(s).alias("n"), w.alias("w"))

    return docs.select("doc_id", F.explode(F.transform(openings(F.col("text")), judge)).alias("r")).select("doc_id", "r.*")


def parenthetical(docs: DataFrame, min_sf: int = 2, max_sf: int = 30, max_words: int = 10) -> DataFrame:
    """doc_id, ss, se, ls, le: one candidate per window of the last 1 to ``max_words`` words before a short form in parentheses."""
    rows = _judged(docs, min_sf, max_sf, max_words).filter("code IS NULL")
    # word starts of the window: lengths of what follows each mark
    marked = F.split(F.regexp_replace("w.window", f"({WORD})", "\x01$1"), "\x01", -1)
    rows = rows.withColumn("parts", F.slice(marked, F.lit(2), F.size(marked) - 1))
    rows = rows.select("doc_id", "ss", "n", "w", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("i"))
    rest = F.aggregate(F.slice("parts", F.size("parts") - F.col("i") + 1, F.col("i")), F.lit(0), lambda a, x: a + F.length(x))
    return rows.select("doc_id", _long(F.col("ss"), "ss"), _long(F.col("ss") + F.col("n"), "se"), _long(F.col("w.end") - rest, "ls"), _long(F.col("w.end"), "le"))


def parenthetical_diagnostics(docs: DataFrame, min_sf: int = 2, max_sf: int = 30, max_words: int = 10) -> DataFrame:
    """doc_id, code, n: the parentheses that gave no candidate, by reason."""
    return _judged(docs, min_sf, max_sf, max_words).filter("code IS NOT NULL").groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n"))


def reverse_order(docs: DataFrame, max_gap: int = 160, max_words: int = 12) -> DataFrame:
    """doc_id, ss, se, ls, le: short form in parentheses, long form the first words of the ``max_gap`` characters after it."""
    found = F.filter(openings(F.col("text")), lambda x: strip(x["content"]).rlike("^[A-Za-z][A-Za-z0-9-]{1,29}$"))

    def resolve(x: Column) -> Column:
        close = x["open"] + 1 + F.length(x["content"])
        after = F.substring(F.col("text"), (close + 2).cast("int"), F.lit(max_gap))
        span = F.regexp_extract(after, f"^([^A-Za-z0-9]*)({WORD}(?:[^A-Za-z0-9]+{WORD}){{0,{max_words - 1}}})", 2)
        lead = F.length(F.regexp_extract(after, "^[^A-Za-z0-9]*", 0))
        return F.struct((x["open"] + 1).alias("ss"), close.alias("se"), (close + 1 + lead).alias("ls"), F.length(span).alias("n"))

    rows = docs.select("doc_id", F.explode(F.transform(found, resolve)).alias("r")).select("doc_id", "r.*").filter("n > 0")
    return rows.select("doc_id", _long(F.col("ss"), "ss"), _long(F.col("se"), "se"), _long(F.col("ls"), "ls"), _long(F.col("ls") + F.col("n"), "le"))


def nested_parenthetical(docs: DataFrame, max_words: int = 12) -> DataFrame:
    """doc_id, ss, se, ls, le: a short form at parenthesis depth two or more, long form the last words before it.

    Depth rises at ``(`` and falls at ``)``, never below zero; it is a running count of the text between parentheses, kept in one fold.
    """
    pieces = F.split(F.col("text"), r"(?=[()])", -1)

    def step(acc: Column, p: Column) -> tuple[dict[str, Column], Column]:
        opens, closes = F.startswith(p, F.lit("(")), F.startswith(p, F.lit(")"))
        depth = F.when(opens, acc["depth"] + 1).when(closes, F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        emitted = F.when(opens & (depth >= 2), F.array(acc["at"])).otherwise(F.array().cast("array<bigint>"))
        return {"at": (acc["at"] + F.length(p)).cast("long"), "depth": depth}, emitted

    deep = scan(pieces, "bigint", {"at": F.lit(0).cast("long"), "depth": F.lit(0)}, step)

    def resolve(o: Column) -> Column:
        content = F.substring_index(F.expr("substring(text, 1)").substr((o + 2).cast("int"), F.length("text")), ")", 1)
        ok = F.contains(F.col("text").substr((o + 2).cast("int"), F.length("text")), F.lit(")")) & strip(content).rlike("^[A-Za-z][A-Za-z0-9-]{1,29}$")
        return F.struct(o.alias("open"), F.when(ok, content).alias("content"), last_words(F.col("text"), o, F.lit(max_words)).alias("w"))

    rows = docs.filter(F.contains("text", F.lit("("))).select("doc_id", F.explode(F.transform(deep, resolve)).alias("r")).select("doc_id", "r.*")
    rows = rows.filter("content IS NOT NULL AND w IS NOT NULL")
    return rows.select("doc_id", _long(F.col("open") + 1, "ss"), _long(F.col("open") + 1 + F.length("content"), "se"), _long(F.col("w.start"), "ls"), _long(F.col("w.end"), "le"))


def table_rows(docs: DataFrame, max_cell: int = 500) -> DataFrame:
    """doc_id, ss, se, ls, le: tab-separated cell pairs of which exactly one looks like a short form, both unique in the text."""
    lines = docs.filter(F.contains("text", F.lit("\t"))).select("doc_id", "text", F.explode(F.split("text", "\n", -1)).alias("line")).filter(F.contains("line", F.lit("\t")))
    cells = lines.withColumn("cells", F.transform(F.split("line", "\t", -1), strip))
    pairs = cells.filter("size(cells) % 2 = 0").select("doc_id", "text", "cells", F.explode(F.sequence(F.lit(0), F.size("cells") - 2, F.lit(2))).alias("i"))
    pairs = pairs.select("doc_id", "text", F.get("cells", F.col("i")).alias("a"), F.get("cells", F.col("i") + 1).alias("b"))
    short = r"^[A-Za-zΑ-Ωα-ω][A-Za-z0-9Α-Ωα-ω-]{1,29}$"
    pairs = pairs.filter((F.length("a").between(1, max_cell)) & F.length("b").between(1, max_cell) & (F.col("a").rlike(short) != F.col("b").rlike(short)))
    first = F.col("a").rlike(short)
    pairs = pairs.withColumn("sf", F.when(first, F.col("a")).otherwise(F.col("b"))).withColumn("lf", F.when(first, F.col("b")).otherwise(F.col("a")))
    pairs = pairs.withColumn("so", occurrences(F.col("text"), F.col("sf"))).withColumn("lo", occurrences(F.col("text"), F.col("lf"))).filter("size(so) = 1 AND size(lo) = 1")
    ss, ls = F.get("so", F.lit(0)), F.get("lo", F.lit(0))
    return pairs.select("doc_id", _long(ss, "ss"), _long(ss + F.length("sf"), "se"), _long(ls, "ls"), _long(ls + F.length("lf"), "le"))


def once(c: Column, name: str) -> Column:
    """A generator of one row with ``c``: what is done with it, as exploding it, does not make it again."""
    return F.inline(F.array(F.struct(c.alias(name))))


#: Characters by which long forms meet texts: the first so many from a form's second word on, the most that it has.
GRAMS = (12, 4, 1)


def lexical_resource(docs: DataFrame, lexicon: DataFrame, max_window: int = 240) -> DataFrame:
    """doc_id, ss, se, ls, le: lexicon pairs whose raw forms both occur in the text, starts at most ``max_window`` apart. A doc_id has one text.

    Short forms meet the texts where they are. What moves is the surroundings of words near a short form that may be in a long form: a long
    form's second word starts where a word of the text starts (a form of one word is looked for at each character), and the
    characters from there are the key, so that forms with one short form do not all meet.
    """
    lead = F.length(F.regexp_extract("lf_raw", "^[A-Za-z0-9]*[^A-Za-z0-9]+", 0))
    forms = lexicon.filter("sf_raw <> '' AND lf_raw <> ''").select("sf_key", "sf_raw", "lf_raw", F.length("lf_raw").alias("m"), F.when(lead < F.length("lf_raw"), lead).otherwise(0).alias("lead"))
    forms = forms.withColumn("g", F.coalesce(*[F.when(F.col("m") - F.col("lead") >= g, g) for g in GRAMS]))
    forms = checkpoint(forms.withColumn("gram", F.expr("substring(lf_raw, lead + 1, g)")).withColumn("inner", F.col("lead") > 0))
    key = ["sf_key", "sf_raw", "inner"]
    keys = checkpoint(
        forms.groupBy(*key).agg(F.array_join(F.collect_set(F.substring("gram", 1, 1)), "").alias("heads"), F.max("lead").alias("most_lead"), F.max("m").alias("most"), F.collect_set("g").alias("gs"))
    )
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z0-9-]{1,29}"), F.lit(0)))
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    if keys.count() <= BROADCAST_ROWS:
        met = texts.select("doc_id", "text", F.explode(tokens).alias("token")).join(F.broadcast(keys), F.lower("token") == F.col("sf_key"))
    else:
        met = texts.select("doc_id", F.explode(tokens).alias("token")).join(keys, F.lower("token") == F.col("sf_key")).drop("token").join(texts, "doc_id")
    met = met.filter(F.contains("text", F.col("sf_raw")))
    # from a form's length before the window, so that a form that overlaps itself shows
    first = lambda ss: F.greatest(ss - max_window - F.col("most"), F.lit(0)).cast("int")
    cut = lambda ss: F.substring(F.col("text"), first(ss) + 1, (ss + max_window + 2 * F.col("most")).cast("int") - first(ss))
    places = F.transform(occurrences(F.col("text"), F.col("sf_raw")), lambda ss: F.struct(ss.alias("ss"), first(ss).alias("base"), cut(ss).alias("cut")))
    kept = ["doc_id", *key, "heads", "most_lead", "most", "gs"]
    near = met.select(*kept, once(places, "p")).select(*kept, F.explode("p").alias("p")).select(*kept, "p.*")
    # second words begin with a letter or digit
    pieces = F.split(F.col("cut"), F.concat(F.lit("(?<![A-Za-z0-9])(?=["), "heads", F.lit("])")), -1)
    at = F.when(F.col("inner"), starts(F.transform(pieces, F.length))).otherwise(F.sequence(F.lit(0), F.length("cut") - 1).cast("array<bigint>"))
    begin = lambda x: F.greatest(x - F.col("most_lead") - F.col("most"), F.lit(0)).cast("int")
    around = lambda x: F.substring(F.col("cut"), begin(x) + 1, (x + F.col("most")).cast("int") - begin(x))
    fits = lambda x: F.contains(F.col("heads"), F.substring(F.col("cut"), x.cast("int") + 1, F.lit(1)))
    words = F.transform(F.filter(at, fits), lambda x: F.struct((F.col("base") + x).alias("word"), (x - begin(x)).cast("int").alias("at"), around(x).alias("around")))
    words = near.select("doc_id", *key, "ss", "gs", once(words, "w")).select("doc_id", *key, "ss", "gs", F.explode("w").alias("w")).select("doc_id", *key, "ss", "w.*", F.explode("gs").alias("g"))
    rows = words.withColumn("gram", F.expr("substring(around, at + 1, g)")).filter("length(gram) = g").join(forms, [*key, "g", "gram"]).withColumn("s", F.col("at") - F.col("lead")).withColumn("ls", (F.col("word") - F.col("lead")).cast("long"))
    rows = rows.filter((F.col("s") >= 0) & (F.abs(F.col("ls") - F.col("ss")) <= max_window) & (F.expr("substring(around, s + 1, m)") == F.col("lf_raw")))
    # the first one among those that overlap it is counted; otherwise the occurrences from the start of the text decide
    sure = F.call_function("locate", F.col("lf_raw"), F.col("around"), F.greatest(F.col("s") - F.col("m") + 2, F.lit(1))) == F.col("s") + 1
    rows = rows.select("doc_id", "ss", _long(F.col("ss") + F.length("sf_raw"), "se"), "ls", _long(F.col("ls") + F.col("m"), "le"), F.when(~sure, F.col("lf_raw")).alias("again"))
    rows = checkpoint(rows)
    out, again = rows.filter("again IS NULL").select(*SPANS), rows.filter("again IS NOT NULL")
    asked = checkpoint(again.select("doc_id", "again").distinct())
    if not (n := asked.count()):
        return out
    counted = texts.join(F.broadcast(asked) if n <= BROADCAST_ROWS else asked, "doc_id").select("doc_id", "again", once(occurrences(F.col("text"), F.col("again")), "at"))
    return out.unionByName(again.join(counted.select("doc_id", "again", F.explode("at").alias("ls")), ["doc_id", "again", "ls"]).select(*SPANS))


#: Short rows are broadcast up to this many, which a count has checked; beyond, they are shuffled.
BROADCAST_ROWS = 100_000


def candidate_pipeline(generators: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Candidates of several generators without repeats (the first generator keeps one), and how many each lost."""
    rows = None
    for i, (name, df) in enumerate(generators.items()):
        part = df.select(*SPANS).withColumn("generator", F.lit(name)).withColumn("ord", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*SPANS).orderBy("ord")))
    return ranked.filter("rn = 1").drop("rn", "ord"), ranked.filter("rn > 1").groupBy("generator").agg(F.count(F.lit(1)).alias("n"))


def bracket_spans(docs: DataFrame) -> DataFrame:
    """doc_id, label (SF or LF), s, e: a rule tagger in place of an external one: capital runs, and word triples before a bracket."""
    sf = docs.select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("t"))
    sf = sf.filter(F.col("t").rlike("^[A-Z]{3}$"))
    sf = sf.select("doc_id", F.lit("SF").alias("label"), F.explode(occurrences(F.col("text"), F.col("t"))).alias("s"), F.length("t").alias("n"))
    found = F.transform(openings(F.col("text")), lambda x: last_words(F.col("text"), x["open"], F.lit(3)))
    lf = docs.select("doc_id", F.explode(found).alias("w")).filter("w IS NOT NULL").select("doc_id", F.lit("LF").alias("label"), F.col("w.start").alias("s"), (F.col("w.end") - F.col("w.start")).alias("n"))
    return sf.unionByName(lf).select("doc_id", "label", "s", (F.col("s") + F.col("n")).cast("long").alias("e")).distinct()


def validate_predictions(predictions: DataFrame, docs: DataFrame) -> DataFrame:
    """Predictions whose spans lie in their document and whose captured texts are what stands there."""
    both = predictions.join(docs.select("doc_id", "text"), "doc_id")
    inside = (F.col("ss") >= 0) & (F.col("ss") <= F.col("se")) & (F.col("se") <= F.length("text")) & (F.col("ls") >= 0) & (F.col("ls") <= F.col("le")) & (F.col("le") <= F.length("text"))
    same = (text_at(F.col("text"), F.col("ss"), F.col("se")) == F.col("sf")) & (text_at(F.col("text"), F.col("ls"), F.col("le")) == F.col("lf"))
    return both.filter(inside & same).drop("text")
