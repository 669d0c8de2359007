"""Articles: segmentation, span mapping, mention links, grouping, sampling and selection."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.lineage import checkpoint, components, hash_rank, skew_join
from glossa.functions.text import WORD_CHARS, fold, matches, quoted


def section_documents(sections: DataFrame) -> DataFrame:
    """One document per section, document_id = article/section/ordinal."""
    return sections.select(F.concat_ws("/", F.col("article").cast("string"), F.lit("section"), F.col("ord").cast("string")).alias("document_id"), "text")


def section_offsets(sections: DataFrame, separator: str = "\n\n") -> DataFrame:
    """article, ord, start, end of each section in the article's joined text."""
    w = Window.partitionBy("article").orderBy("ord")
    end = F.sum(F.length("text") + len(separator)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - len(separator)
    return sections.select("article", "ord", (end - F.length("text")).cast("long").alias("start"), end.cast("long").alias("end"))


def article_documents(sections: DataFrame, separator: str = "\n\n") -> DataFrame:
    """article, text: the sections in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return sections.groupBy("article").agg(F.array_join(F.transform(parts, lambda x: x["text"]), separator).alias("text"))


def span_sections(spans: DataFrame, offsets: DataFrame) -> DataFrame:
    """Spans (article, s, e) with the one section that contains them, offsets within it; spans in none or in several are left out."""
    j = spans.join(offsets, "article").filter("start <= s AND e <= end")
    n = F.count(F.lit(1)).over(Window.partitionBy("article", "s", "e"))
    return j.withColumn("n", n).filter("n = 1").select("article", "s", "e", "ord", (F.col("s") - F.col("start")).alias("rs"), (F.col("e") - F.col("start")).alias("re"))


def link_mentions(
    docs: DataFrame,
    definitions: DataFrame,
    scope: str = "article",
    ordering: str = "nearest_preceding",
    conflict: str = "abstain",
    case_sensitive: bool = False,
    allow_plural: bool = False,
    sections: DataFrame | None = None,
) -> DataFrame:
    """doc_id, sf, s, e, status, definition_start, n: each match of a defined short form, each surface casing scanned anew.

    A match links to the eligible definition of its form whose short form starts last. Eligible are definitions that start at or before the
    match (``ordering`` nearest_preceding) or any (nearest_any), and with ``scope`` section only those in the match's own section
    (sections: doc_id, start, end). Definitions that tie there are ambiguous with ``conflict`` abstain, and linked with nearest. Without an
    eligible one the status is undefined, or abstain with nearest_any. A definition's own short form is a mention too. n is the
    number of definitions tied. ``allow_plural``: an s after the form belongs to the match.

    A document's definitions are one list, so its text is met and searched once per surface, and no match is joined to anything.
    """
    key = (lambda c: c) if case_sensitive else fold
    listed = F.collect_list(F.struct(key(F.col("sf")).alias("key"), F.col("ss").alias("at")))
    d = definitions.filter("ss IS NOT NULL AND sf IS NOT NULL").groupBy("doc_id").agg(listed.alias("defs"), F.collect_set("sf").alias("surfaces"))
    rows = docs.select("doc_id", "text").join(d, "doc_id")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    if sections is not None:
        part = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
        of = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("sections"))
        rows = rows.join(of, "doc_id", "left").withColumn("sections", F.coalesce("sections", none))
    else:
        rows = rows.withColumn("sections", none)
    pattern = lambda c: F.concat(F.lit("" if case_sensitive else "(?iu)"), quoted(c), F.lit("s?" if allow_plural else ""))
    section = lambda s, e: F.get(F.filter("sections", lambda x: (x["start"] <= s) & (e <= x["end"])), F.lit(0))["start"]

    def link(sf: Column, m: Column) -> Column:
        mine = F.filter("defs", lambda x: x["key"] == key(sf))
        if scope == "section":
            mine = F.filter(mine, lambda x: section(x["at"], x["at"] + F.length(sf)) == section(m["s"], m["e"]))
        if ordering == "nearest_preceding":
            mine = F.filter(mine, lambda x: x["at"] <= m["s"])
        return F.transform(mine, lambda x: x["at"])

    def search(sf: Column) -> Column:
        linked = lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), link(sf, m).alias("ats"))
        return F.struct(sf.alias("sf"), F.transform(matches(F.col("text"), pattern(sf)), linked).alias("m"))

    out = rows.select("doc_id", F.explode(F.transform("surfaces", search)).alias("f")).select("doc_id", "f.sf", F.explode("f.m").alias("m"))
    out = out.select("doc_id", "sf", "m.s", "m.e", "m.ats").withColumn("definition_start", F.array_max("ats"))
    n = F.coalesce(F.size(F.filter("ats", lambda x: x == F.col("definition_start"))), F.lit(0))
    lost = "undefined" if ordering == "nearest_preceding" else "abstain"
    status = F.when(F.col("definition_start").isNull(), lost).when((n > 1) & F.lit(conflict == "abstain"), "ambiguous").otherwise("linked")
    return out.select("doc_id", "sf", "s", "e", status.alias("status"), "definition_start", F.when(F.col("definition_start").isNull(), 0).otherwise(n).cast("long").alias("n"))


def _token_sets(frame: DataFrame) -> DataFrame:
    """record_id, t (hashes of its different words, ascending), n, of records with words."""
    hashed = F.transform(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD_CHARS), F.lit(0))), lambda w: F.xxhash64(w))
    return frame.select("record_id", F.array_sort(hashed).alias("t")).withColumn("n", F.size("t")).filter("n > 0")


def similar_pairs(frame: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Links (a, b) of records whose word sets are similar: equal sets in a star, others by a prefix of their rarest words, verified.

    Words are compared by 64-bit hashes. Similar sets share a word of their prefixes and have nearly one size, so prefixes meet by word and
    size band (a band and the next), which keeps apart the many sets that share a frequent word. A word that two sets share first leaves
    room for their overlap after its places; pairs without that room go at once, and whole sets meet for the others alone.
    """
    sets = checkpoint(_token_sets(frame).withColumn("key", F.xxhash64("t")))
    classes = checkpoint(sets.groupBy("key", "t", "n").agg(F.min("record_id").alias("rep"), F.count(F.lit(1)).alias("c")))
    stars = checkpoint(classes.filter("c > 1").select("key", "n", "rep", "c"))
    equal = skew_join(sets.select("record_id", "key", "n"), stars, ["key", "n"], "c", "inner").filter("record_id <> rep")
    equal = equal.select(F.col("record_id").alias("a"), F.col("rep").alias("b"))
    reps = classes.select(F.col("rep").alias("record_id"), "n", "t")
    words = reps.select("record_id", "n", F.explode("t").alias("token"))
    df = checkpoint(words.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    # words of one record match nothing and come first in the order of rarity, so only the others need be ordered
    shared = skew_join(words, df, ["token"], "df", "inner").groupBy("record_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    alone = F.col("n") - F.size("t")
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - alone
    prefix = shared.withColumn("k", keep.cast("int")).filter("k > 0")
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold)).cast("long")
    prefix = prefix.select("record_id", "n", alone.alias("alone"), band.alias("band"), F.posexplode(F.slice("t", F.lit(1), F.col("k"))).alias("i", "x"))
    prefix = checkpoint(prefix.select("record_id", "n", "band", "x.token", (F.col("alone") + F.col("i")).alias("place")))
    left = prefix.withColumn("at", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    right = prefix.select(F.col("record_id").alias("other"), F.col("n").alias("m"), F.col("band").alias("at"), F.col("place").alias("spot"), "token")
    met = left.join(right, ["token", "at"])
    order = (F.col("at") > F.col("band")) | (F.col("record_id") < F.col("other"))
    alike = F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9
    room = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("spot"))
    fits = room >= threshold / (1 + threshold) * (F.col("n") + F.col("m")) - 1e-9
    met = met.filter(order & (F.col("record_id") != F.col("other")) & alike & fits)
    pairs = met.select(F.least("record_id", "other").alias("record_id"), F.greatest("record_id", "other").alias("other")).distinct()
    both = pairs.join(reps.drop("n"), "record_id").join(reps.select(F.col("record_id").alias("other"), F.col("t").alias("more")), "other")
    hit = F.size(F.array_intersect("t", "more"))
    both = both.filter(hit >= threshold * (F.size("t") + F.size("more") - hit) - 1e-9)
    return equal.unionByName(both.select(F.col("other").alias("a"), F.col("record_id").alias("b")))


def group_articles(frame: DataFrame, threshold: float = 0.98) -> DataFrame:
    """record_id, root: records linked by pmid, pmcid, equal normalised text or similar word sets."""
    text = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    keys = [F.when(F.col("pmid").isNotNull(), F.concat(F.lit("pmid:"), "pmid")), F.when(F.col("pmcid").isNotNull(), F.concat(F.lit("pmcid:"), F.regexp_replace(F.lower("pmcid"), "^pmc", ""))), F.when(text != "", F.concat(F.lit("content:"), F.sha2(text, 256)))]
    k = frame.select("record_id", F.explode(F.array(*keys)).alias("key")).filter("key IS NOT NULL")
    low = k.groupBy("key").agg(F.min("record_id").alias("b"))
    same = k.join(low, "key").filter("record_id <> b").select(F.col("record_id").alias("a"), "b")
    roots = components(same.unionByName(similar_pairs(frame, threshold)))
    return frame.select("record_id").join(roots, F.col("record_id") == F.col("node"), "left").select("record_id", F.coalesce("root", "record_id").alias("root"))


def roll_up(frame: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, records, kinds, available, unavailable, overlap, tags per group; the id is a hash of the members' keys.

    If the frame has an official_split, two of them within one group fail the job.
    """
    f = frame.join(groups, "record_id")
    if "official_split" in frame.columns:
        splits = F.size(F.collect_set("official_split").over(Window.partitionBy("root")))
        f = f.withColumn("splits", splits).filter(F.assert_true(F.col("splits") <= 1, F.lit("a group has several official splits")).isNull()).drop("splits")
    key = F.concat(F.lit("record:"), F.col("record_id").cast("string"))
    level = F.when(F.col("teacher_overlap") == "yes", 2).when(F.col("teacher_overlap") == "unknown", 1).otherwise(0)
    g = f.groupBy("root").agg(
        F.concat(F.lit("article-group-"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "|"), 256), 1, 16)).alias("group_id"),
        F.count(F.lit(1)).alias("records"), F.array_join(F.array_sort(F.collect_set("source_kind")), ",").alias("kinds"), F.count(F.when(F.col("available"), 1)).alias("available"),
        F.count(F.when(~F.col("available"), 1)).alias("unavailable"), F.max(level).alias("level"), F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"),
    )
    overlap = F.when(F.col("level") == 2, "yes").when(F.col("level") == 1, "unknown").otherwise("no")
    return g.select("group_id", "records", "kinds", "available", "unavailable", overlap.alias("overlap"), "tags")


def sample_roles(groups: DataFrame, seed: str, challenge: dict[str, int], random: dict[str, float]) -> DataFrame:
    """group_id, role. Challenge roles take the tagged groups of smallest hash (each the same list), random roles contiguous shares of the rest."""
    fixed = F.when(F.col("available") == 0, "unavailable").when(F.col("overlap") == "yes", "excluded:teacher-overlap")
    g = groups.select("group_id", "tags", fixed.alias("fixed"))
    free = g.filter("fixed IS NULL")
    n = free.count()
    most = max(challenge.values(), default=0)
    tagged = free.filter("tags <> ''").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:challenge:"), "group_id"), 256)).orderBy("h").limit(most)
    name, order = next(iter(challenge), None), list(challenge.items())
    ranked = tagged.withColumn("i", F.row_number().over(Window.orderBy("h")))  # at most ``most`` rows
    role = reduce(lambda c, kv: F.when(c.isNull() & (F.col("i") <= kv[1]), kv[0]).otherwise(c), order, F.lit(None).cast("string"))
    first = ranked.select("group_id", role.alias("challenge")).filter("challenge IS NOT NULL") if name else free.limit(0).select("group_id", F.lit("").alias("challenge"))
    g = g.join(F.broadcast(first), "group_id", "left")
    pool = hash_rank(g.filter("fixed IS NULL AND challenge IS NULL").select("group_id"), F.sha2(F.concat(F.lit(f"{seed}:"), "group_id"), 256), "place")
    cuts, at = [], 0
    for role_name, share in random.items():
        cuts.append((role_name, at, at + int(n * share)))
        at += int(n * share)
    drawn = reduce(lambda c, k: F.when((F.col("place") >= k[1]) & (F.col("place") < k[2]), k[0]).otherwise(c), cuts, F.lit(None).cast("string"))
    out = g.join(pool.select("group_id", drawn.alias("drawn")), "group_id", "left")
    return out.select("group_id", F.coalesce("fixed", "challenge", "drawn", F.lit("not-selected")).alias("role"))


def lexicon_view(roles: DataFrame, members: DataFrame, links: DataFrame, allowed: list[str]) -> DataFrame:
    """link, records, n: occurrence links of the records whose group may feed the lexicon."""
    ok = members.join(roles.filter(F.col("role").isin(allowed)), "group_id").select("record_id")
    g = links.join(ok, "record_id").groupBy("link").agg(F.array_sort(F.collect_set("record_id")).alias("r"))
    return g.select("link", F.array_join(F.transform("r", lambda x: x.cast("string")), ",").alias("records"), F.size("r").cast("long").alias("n"))


def frame_summary(frame: DataFrame) -> DataFrame:
    """kind, year, records, available: totals by kind, by year and overall in one pass of grouping sets."""
    g = frame.groupingSets([[F.col("source_kind")], [F.col("year")], []], "source_kind", "year").agg(F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("available"), 1)).alias("available"), F.grouping_id().alias("level"))
    return g.select(F.col("source_kind").alias("kind"), "year", F.col("level").cast("long").alias("level"), "records", "available")


def select_corpus(frame: DataFrame, seed: str, broad: int, enriched: int) -> DataFrame:
    """record_id, decision: an ordered list of exclusions, then a broad and a tagged pool by rank of hash."""
    why = F.when(~F.col("available"), "unavailable").when(F.col("lang") != "en", "language").when(F.length("text") < 200, "short")
    f = frame.select("record_id", "tag", why.alias("why"))
    free = f.filter("why IS NULL").select("record_id", "tag")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("record_id").cast("string")), 256)
    a = hash_rank(free, digest, "place")
    rest = a.filter(F.col("place") >= broad).filter("tag IS NOT NULL").drop("place")
    b = hash_rank(rest, digest, "place").select("record_id", F.lit("enriched").alias("e"), "place").filter(F.col("place") < enriched).drop("place")
    out = f.join(a.select("record_id", F.when(F.col("place") < broad, "broad").alias("b")), "record_id", "left").join(b, "record_id", "left")
    return out.select("record_id", F.coalesce(F.concat(F.lit("excluded:"), "why"), "b", "e", F.lit("not-selected")).alias("decision"))


def prose_passages(docs: DataFrame, minimum: int = 80, target: int = 400, maximum: int = 1200) -> DataFrame:
    """doc_id, i, text: sentences packed in order up to ``target`` characters; a short tail joins the passage before it, overlong ones go."""
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    s = F.filter(F.split(clean, r"(?<=[.!?])\s+(?=[A-Z0-9])", -1), lambda x: x != "")
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        grown = F.when(acc["now"] == "", x).otherwise(F.concat_ws(" ", acc["now"], x))
        full = (acc["now"] != "") & (F.length(grown) > target)
        return F.struct(F.when(full, x).otherwise(grown).alias("now"), F.when(full, F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"]).alias("out"))

    packed = F.aggregate(s, start, step, lambda a: F.when(a["now"] != "", F.concat(a["out"], F.array(a["now"]))).otherwise(a["out"]))
    none = F.array().cast("array<string>")

    def join(acc, x):
        n = F.size(acc)
        merged = F.concat(F.slice(acc, F.lit(1), n - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), x)))
        both = F.concat_ws(" ", F.try_element_at(acc, F.lit(-1)), x)
        kept = F.when(F.length(both) > maximum, F.slice(acc, F.lit(1), n - 1)).otherwise(merged)
        return F.when(F.length(x) >= minimum, F.when(F.length(x) > maximum, acc).otherwise(F.concat(acc, F.array(x)))).when(n > 0, kept).otherwise(acc)

    rows = docs.select("doc_id", F.when(F.length(clean) >= minimum, F.aggregate(packed, none, join)).otherwise(none).alias("p"))
    return rows.select("doc_id", F.posexplode("p").alias("i", "text"))


def shard(ids: DataFrame, column: str, n: int) -> DataFrame:
    """column, shard: the first eight bytes of the id's sha256, modulo n."""
    h = F.conv(F.substring(F.sha2(F.col(column).cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return ids.select(column, (h % n).cast("long").alias("shard"))


def latest_revisions(events: DataFrame, key: str) -> DataFrame:
    """key, revision, value, conflicts of an append-only log (key, expected, revision, value): an event applies if it expected the one before it."""
    w = Window.partitionBy(key).orderBy("revision")
    e = events.withColumn("ok", F.col("expected") == F.coalesce(F.lag("revision").over(w), F.lit(0)))
    return e.groupBy(key).agg(F.max_by("value", F.when(F.col("ok"), F.col("revision"))).alias("value"), F.max(F.when(F.col("ok"), F.col("revision"))).alias("revision"), F.count(F.when(~F.col("ok"), 1)).alias("conflicts"))


def capped_packet(cases: DataFrame, seed: str, per_article: int, size: int) -> DataFrame:
    """case_id of a review packet: cases by rank of hash, at most ``per_article`` of an article."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("case_id").cast("string")), 256)
    r = cases.withColumn("h", h).withColumn("rn", F.row_number().over(Window.partitionBy("article").orderBy("h"))).filter(F.col("rn") <= per_article)
    return r.orderBy("h").limit(size).select("case_id", "article")
