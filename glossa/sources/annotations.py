"""Annotated corpora as DataFrames: BioC, token tags, span lists, delimited pairs, section snapshots, canonical JSONL.

Each reader gives documents (document_id, text) and annotations (document_id, annotation_id, ss, se, ls, le, ...); what is dropped goes to a
diagnostics DataFrame (severity, code, document_id, action). Parsing and pairing are plans over rows, so a corpus of any size streams through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions.text import all_occurrences

SPAN = "struct<start:bigint,end:bigint>"
CANONICAL = f"""record_id string, schema_version string, document struct<document_id:string,text:string>,
gold_annotations array<struct<document_id:string,short_form:{SPAN},long_form:{SPAN},short_form_text:string,long_form_text:string>>"""
PREDICTIONS = f"""dataset_fingerprint string, document_id string, record_id string, resolver struct<key:string,version:string>,
predictions array<struct<document_id:string,short_form:{SPAN},long_form:{SPAN},short_form_text:string,long_form_text:string>>"""
_BIOC_ANNOTATION = "struct<_id:string,infon:array<struct<_key:string,_VALUE:string>>,location:array<struct<_offset:bigint,_length:bigint>>,text:string>"
BIOC_DOCUMENT = f"""id string, passage array<struct<offset:bigint,text:string,annotation:array<{_BIOC_ANNOTATION}>,
relation:array<struct<_id:string,node:array<struct<_refid:string,_role:string>>>>>>, relation array<struct<_id:string,node:array<struct<_refid:string,_role:string>>>>"""


def canonical(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents and gold of a canonical-v1 JSONL folder. Malformed rows and unknown schema versions fail the job."""
    raw = spark.read.schema(CANONICAL).option("mode", "FAILFAST").json(path)
    ok = F.assert_true(F.col("schema_version") == "canonical-v1", F.lit("unknown schema version"))
    raw = raw.filter(ok.isNull())
    docs = raw.select(F.col("document.document_id").alias("document_id"), F.col("document.text").alias("text"), "record_id")
    a = raw.select(F.col("document.document_id").alias("document_id"), F.posexplode("gold_annotations").alias("i", "a"))
    return docs, a.select("document_id", "i", *_spans("a"))


def _spans(a: str) -> list[Column]:
    at = [(f"{a}.short_form.start", "ss"), (f"{a}.short_form.end", "se"), (f"{a}.long_form.start", "ls"), (f"{a}.long_form.end", "le"), (f"{a}.short_form_text", "sf"), (f"{a}.long_form_text", "lf")]
    return [F.col(c).alias(n) for c, n in at]


def predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Predicted documents (those without predictions too) and predictions of a JSONL artifact."""
    raw = spark.read.schema(PREDICTIONS).option("mode", "FAILFAST").json(path)
    p = raw.select("document_id", F.posexplode("predictions").alias("i", "a"))
    return raw.select("document_id"), p.select("document_id", "i", *_spans("a"))


def role(name: Column, identifier: Column) -> Column:
    """short or long from a type name, else from an id's SF or LF prefix, else the name."""
    n = F.translate(F.lower(name), "_-", "  ")
    prefix = F.upper(F.substring(identifier, 1, 2))
    return (
        F.when(n.isin("short", "short form", "shortform", "abbreviation", "sf"), "short").when(n.isin("long", "long form", "longform", "expansion", "lf"), "long")
        .when(prefix == "SF", "short").when(prefix == "LF", "long").otherwise(n)
    )


def bioc_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per BioC document: id, passage, relation."""
    return spark.read.format("xml").schema(BIOC_DOCUMENT).option("rowTag", "document").option("attributePrefix", "_").option("mode", "FAILFAST").load(path)


def bioc_json(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from BioC JSON collections; infons are objects there."""
    ann = "struct<id:string,infons:map<string,string>,locations:array<struct<offset:bigint,length:bigint>>,text:string>"
    rel = "array<struct<id:string,nodes:array<struct<refid:string,role:string>>>>"
    schema = f"documents array<struct<id:string,passages:array<struct<offset:bigint,text:string,annotations:array<{ann}>,relations:{rel}>>,relations:{rel}>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("documents").alias("d"))
    relation = lambda r: F.transform(r, lambda x: F.struct(x["id"].alias("_id"), F.transform(x["nodes"], lambda n: F.struct(n["refid"].alias("_refid"), n["role"].alias("_role"))).alias("node")))
    annotation = lambda a: F.struct(
        a["id"].alias("_id"), F.transform(F.map_entries(a["infons"]), lambda e: F.struct(e["key"].alias("_key"), e["value"].alias("_VALUE"))).alias("infon"),
        F.transform(a["locations"], lambda x: F.struct(x["offset"].alias("_offset"), x["length"].alias("_length"))).alias("location"), a["text"].alias("text"),
    )
    passage = lambda p: F.struct(p["offset"].alias("offset"), p["text"].alias("text"), F.transform(p["annotations"], annotation).alias("annotation"), relation(p["relations"]).alias("relation"))
    return d.select(F.col("d.id").alias("id"), F.transform("d.passages", passage).alias("passage"), relation(F.col("d.relations")).alias("relation"))


def bioc_tables(rows: DataFrame, discontinuous: str = "first") -> tuple[DataFrame, DataFrame, DataFrame]:
    """passages (document_id, i, offset, text), entities (document_id, ord, id, role, s, e, text) and relations (document_id, k, short_id, long_id).

    An entity is where its first location says; one without a location has no span, nor has one with several if ``discontinuous`` is
    "reject". A relation counts if exactly one node is short and one is long.
    """
    p = rows.select(F.col("id").alias("document_id"), F.posexplode("passage").alias("i", "p"))
    passages = p.select("document_id", "i", F.col("p.offset").alias("offset"), F.coalesce("p.text", F.lit("")).alias("text"))
    a = p.select("document_id", "i", F.posexplode("p.annotation").alias("j", "a"))
    kind = F.get(F.filter("a.infon", lambda x: x["_key"] == "type"), F.lit(0))["_VALUE"]
    where = F.get(F.col("a.location"), F.lit(0))
    where = F.when(F.size("a.location") == 1, where) if discontinuous == "reject" else where
    entities = a.select(
        "document_id", (F.col("i") * 100_000 + F.col("j")).alias("ord"), F.col("a._id").alias("id"), role(F.coalesce(kind, F.lit("")), F.col("a._id")).alias("role"),
        where["_offset"].alias("s"), (where["_offset"] + where["_length"]).alias("e"), F.col("a.text").alias("text"),
    )
    listed = rows.select(F.col("id").alias("document_id"), F.explode(F.concat(F.coalesce("relation", F.array().cast(_RELATION)), F.flatten(F.transform("passage", lambda x: F.coalesce(x["relation"], F.array().cast(_RELATION)))))).alias("r"))
    of = lambda r: F.transform(F.filter("r.node", lambda n: role(n["_role"], n["_refid"]) == r), lambda n: n["_refid"])
    both = listed.select("document_id", F.col("r._id").alias("k"), of("short").alias("s"), of("long").alias("l"))
    relations = both.filter("size(s) = 1 AND size(l) = 1").select("document_id", "k", F.get("s", F.lit(0)).alias("short_id"), F.get("l", F.lit(0)).alias("long_id"))
    return passages, entities, relations


_RELATION = "array<struct<_id:string,node:array<struct<_refid:string,_role:string>>>>"


def render(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (document_id, text) with each passage at its offset and blanks between, and conflicts (document_id, n): earlier passages win.

    Only documents whose passages overlap are laid out by character; the others are joined passage by passage.
    """
    reach = F.max(F.col("offset") + F.length("text")).over(Window.partitionBy("document_id").orderBy("offset", "i").rowsBetween(Window.unboundedPreceding, -1))
    p = passages.filter("text <> ''").withColumn("over", F.col("offset") < F.coalesce(reach, F.lit(0)))
    p = p.withColumn("over", F.max("over").over(Window.partitionBy("document_id")))
    gap = lambda xs: F.transform(xs, lambda x, i: F.concat(F.repeat(F.lit(" "), (x["at"] - F.coalesce(F.get(xs, i - 1)["end"], F.lit(0))).cast("int")), x["c"]))
    item = lambda at, c: F.struct(F.col(at).alias("at"), (F.col(at) + F.length(c)).alias("end"), F.col(c).alias("c"))
    plain = p.filter("NOT over").groupBy("document_id").agg(F.array_sort(F.collect_list(item("offset", "text"))).alias("x")).select("document_id", F.array_join(gap(F.col("x")), "").alias("text"))
    c = p.filter("over").select("document_id", "i", "offset", F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("k", "c"))
    at = c.select("document_id", "i", (F.col("offset") + F.col("k")).alias("at"), "c")
    one = at.groupBy("document_id", "at").agg(F.min_by("c", "i").alias("c"), (F.count_distinct("c") > 1).alias("clash"))
    g = one.groupBy("document_id").agg(F.array_sort(F.collect_list(item("at", "c"))).alias("x"), F.count(F.when(F.col("clash"), 1)).alias("n"))
    empty = passages.select("document_id").distinct().join(p.select("document_id").distinct(), "document_id", "left_anti").select("document_id", F.lit("").alias("text"))
    laid = g.select("document_id", F.array_join(gap(F.col("x")), "").alias("text"))
    return plain.unionByName(laid).unionByName(empty), g.filter("n > 0").select("document_id", "n")


def overlay(documents: DataFrame, entities: DataFrame) -> DataFrame:
    """Documents with entity texts written over their spans where the lengths agree, in order."""
    fit = entities.filter("s IS NOT NULL AND length(text) = e - s").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ord", "s", "text"))).alias("x"))
    step = lambda acc, x: F.overlay(acc, x["text"], (x["s"] + 1).cast("int"), F.length(x["text"]))
    joined = documents.join(fit, "document_id", "left")
    return joined.select("document_id", F.when(F.col("x").isNull(), F.col("text")).otherwise(F.aggregate("x", F.col("text"), step)).alias("text"))


def pair_entities(entities: DataFrame, relations: DataFrame, order_fallback: bool = True) -> tuple[DataFrame, DataFrame]:
    """Annotations (document_id, how, ss, se, ls, le) and diagnostics (document_id, code, n).

    A relation pairs its endpoints if both ids are there exactly once. Documents without relations pair short and long entities by order
    (optional). What is left is kept as a one-sided annotation if its role is short or long.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("document_id", "id"))
    e = entities.withColumn("n", n)
    once = e.filter("n = 1")
    side = lambda p, c: once.select("document_id", F.col("id").alias(c), F.col("s").alias(f"{p}s"), F.col("e").alias(f"{p}e"), F.col("ord").alias(f"{p}ord"))
    r = relations.join(side("s", "short_id"), ["document_id", "short_id"], "left").join(side("l", "long_id"), ["document_id", "long_id"], "left")
    good = r.filter("sord IS NOT NULL AND lord IS NOT NULL")
    none = entities.join(relations.select("document_id").distinct(), "document_id", "left_anti") if order_fallback else entities.limit(0)
    k = F.row_number().over(Window.partitionBy("document_id", "role").orderBy("ord"))
    numbered = none.filter("role IN ('short', 'long')").withColumn("k", k)
    half = lambda name, p: numbered.filter(F.col("role") == name).select("document_id", "k", F.col("s").alias(f"{p}s"), F.col("e").alias(f"{p}e"), F.col("ord").alias(f"{p}ord"))
    zipped = half("short", "s").join(half("long", "l"), ["document_id", "k"])
    cols = ["document_id", "ss", "se", "ls", "le", "sord", "lord"]
    pairs = good.select(F.lit("relation").alias("how"), *cols).unionByName(zipped.select(F.lit("order").alias("how"), *cols))
    used = pairs.select("document_id", F.explode(F.array("sord", "lord")).alias("ord")).distinct()
    rest = entities.join(used, ["document_id", "ord"], "left_anti")
    short, long = F.col("role") == "short", F.col("role") == "long"
    partial = rest.filter(short | long).select("document_id", F.lit("partial").alias("how"), F.when(short, F.col("s")).alias("ss"), F.when(short, F.col("e")).alias("se"), F.when(long, F.col("s")).alias("ls"), F.when(long, F.col("e")).alias("le"))
    out = pairs.select("document_id", "how", "ss", "se", "ls", "le").unionByName(partial)
    d = (
        e.filter("n > 1").select("document_id", "id").distinct().select("document_id", F.lit("BIOC_DUPLICATE_ANNOTATION_ID").alias("code"))
        .unionByName(r.filter("sord IS NULL OR lord IS NULL").select("document_id", F.lit("BIOC_RELATION_ENDPOINT_UNRESOLVED").alias("code")))
        .unionByName(rest.select("document_id", F.lit("BIOC_UNPAIRED_ENTITY").alias("code")))
    )
    return out, d.groupBy("document_id", "code").agg(F.count(F.lit(1)).alias("n"))


def bio_tags(rows: DataFrame, separator: str = " ") -> DataFrame:
    """document_id, text, ss, se, ls, le of (document_id, tokens, labels): BIO tags; of several spans of a kind the last counts.

    A span ends before the next tag that is neither inside nor the start of a short or long form, or before the next start of its kind.
    """
    gap = len(separator)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, t: F.struct((acc["at"] + F.length(t) + gap).cast("long").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    r = rows.withColumn("text", F.array_join("tokens", separator)).withColumn("at", F.aggregate("tokens", start, step, lambda a: a["out"]))
    r = r.filter(F.size("tokens") == F.size("labels")).withColumn("low", F.transform("labels", lambda x: F.concat(F.substring(x, 1, 2), F.lower(F.expr("''")), F.lower(F.substring(x, 3, 100)))))
    index = F.sequence(F.lit(0), F.size("labels") - 1)
    kinds = ("B-short", "B-long", "I-short", "I-long")
    for side, kind in (("s", "B-short"), ("l", "B-long")):
        first = F.array_max(F.filter(index, lambda i: F.get("low", i) == kind))  # noqa: B023
        r = r.withColumn(f"{side}i", F.when(F.size("labels") > 0, first))
        stop = F.array_min(F.filter(index, lambda i: (i > F.col(f"{side}i")) & ~F.get("low", i).isin(*kinds)))  # noqa: B023
        r = r.withColumn(f"{side}s", F.get("at", F.col(f"{side}i")))
        r = r.withColumn(f"{side}e", F.when(F.col(f"{side}i").isNotNull(), F.coalesce(F.get("at", stop) - gap, F.length("text").cast("long"))))
    return r.select("document_id", "text", "ss", "se", "ls", "le")


def acronym_tokens(rows: DataFrame, separator: str = " ") -> DataFrame:
    """document_id, text, ss, se, lf of (document_id, tokens, acronym, expansion): the acronym is a token's index, the expansion has no span."""
    before = F.aggregate(F.slice("tokens", F.lit(1), F.col("acronym").cast("int")), F.lit(0).cast("long"), lambda a, t: (a + F.length(t) + len(separator)).cast("long"))
    r = rows.filter((F.col("acronym") >= 0) & (F.col("acronym") < F.size("tokens"))).withColumn("ss", before)
    return r.select("document_id", F.array_join("tokens", separator).alias("text"), "ss", (F.col("ss") + F.length(F.get("tokens", F.col("acronym").cast("int")))).cast("long").alias("se"), F.col("expansion").alias("lf"))


def span_lists(rows: DataFrame) -> DataFrame:
    """document_id, ss, se, ls, le of (document_id, acronyms, long_forms) arrays of [start, end]: one one-sided annotation each."""
    null = F.lit(None).cast("long")
    a = rows.select("document_id", F.explode("acronyms").alias("x")).select("document_id", F.get("x", F.lit(0)).alias("ss"), F.get("x", F.lit(1)).alias("se"), null.alias("ls"), null.alias("le"))
    b = rows.select("document_id", F.explode("long_forms").alias("x")).select("document_id", null.alias("ss"), null.alias("se"), F.get("x", F.lit(0)).alias("ls"), F.get("x", F.lit(1)).alias("le"))
    return a.unionByName(b)


def sdu_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of token-tag files (one JSON array per file)."""
    return spark.read.schema("id string, tokens array<string>, labels array<string>, acronym bigint, expansion string, text string, acronyms array<array<bigint>>, `long-forms` array<array<bigint>>").option("multiLine", True).json(path).withColumnsRenamed({"id": "document_id", "long-forms": "long_forms"})


def delimited(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Annotations of six-column TSV (id, text, ss, se, ls, le), comments and blank lines left out, and the lines that don't parse."""
    schema = "document_id string, text string, ss bigint, se bigint, ls bigint, le bigint, bad string"
    raw = spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").csv(path)
    fine = F.col("bad").isNull() & F.col("le").isNotNull() & (F.col("ss") >= 0) & (F.col("ss") <= F.col("se")) & (F.col("ls") <= F.col("le")) & (F.greatest("se", "le") <= F.length("text"))
    return raw.filter(fine).drop("bad"), raw.filter(~F.coalesce(fine, F.lit(False))).select("document_id", F.lit("DELIMITED_ROW_INVALID").alias("code"))


def templated_pairs(spark: SparkSession, path: str, template: str = "{long} ({short})") -> DataFrame:
    """document_id, text, ss, se, ls, le of two-column TSV (short, long): texts made by a template in which each form stands once."""
    raw = spark.read.schema("short string, long string").option("sep", "\t").option("comment", "#").csv(path).filter("short IS NOT NULL AND long IS NOT NULL")
    first, second = ("short", "long") if template.index("{short}") < template.index("{long}") else ("long", "short")
    head, rest = template.split("{" + first + "}")
    mid, tail = rest.split("{" + second + "}")
    a, b = F.lit(len(head)).cast("long"), (F.length(first) + len(head) + len(mid)).cast("long")
    spans = {first: (a, a + F.length(first)), second: (b, b + F.length(second))}
    text = F.concat(F.lit(head), first, F.lit(mid), second, F.lit(tail))
    names = [x.alias(n) for k, p in (("short", "s"), ("long", "l")) for x, n in zip(spans[k], (f"{p}s", f"{p}e"), strict=True)]
    return raw.select(F.sha2(F.concat_ws("\t", "short", "long"), 256).alias("document_id"), text.alias("text"), *names)


def snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sections, mapped pairs and dropped pairs of a section-snapshot JSONL."""
    pair = f"struct<short_form:{SPAN},long_form:{SPAN},mapping_status:string>"
    raw = spark.read.schema(f"section_id string, text string, pairs array<{pair}>").option("mode", "FAILFAST").json(path)
    p = raw.select(F.col("section_id").alias("document_id"), F.explode("pairs").alias("p"))
    mapped = F.col("p.mapping_status") == "mapped"
    spans = p.filter(mapped).select("document_id", F.col("p.short_form.start").alias("ss"), F.col("p.short_form.end").alias("se"), F.col("p.long_form.start").alias("ls"), F.col("p.long_form.end").alias("le"))
    return raw.select(F.col("section_id").alias("document_id"), "text"), spans, p.filter(~F.coalesce(mapped, F.lit(False))).select("document_id", "p.mapping_status")


def map_in_passages(pairs: DataFrame, passages: DataFrame) -> DataFrame:
    """document_id, pair, ss, se, ls, le, status of (document_id, pair, sf, lf, passages array<int>): each form where it occurs exactly once in the listed passages.

    Passages (document_id, i, text) are joined with line ends; orientation goes by the majority of a document's mapped pairs.
    """
    w = Window.partitionBy("document_id").orderBy("i")
    p = passages.withColumn("base", (F.sum(F.length("text") + 1).over(w) - F.length("text") - 1).cast("long"))
    long = pairs.select("document_id", "pair", "sf", "lf", F.explode("passages").alias("i")).distinct().join(p, ["document_id", "i"])
    find = lambda c: F.transform(all_occurrences(F.col("text"), F.col(c)), lambda x: x + F.col("base"))
    g = long.groupBy("document_id", "pair", "sf", "lf").agg(F.flatten(F.collect_list(find("sf"))).alias("so"), F.flatten(F.collect_list(find("lf"))).alias("lo"))
    one = (F.size("so") == 1) & (F.size("lo") == 1)
    m = g.select("document_id", "pair", "sf", "lf", F.when(one, F.get("so", F.lit(0))).alias("ss"), F.when(one, F.get("lo", F.lit(0))).alias("ls"))
    vote = F.sum(F.when(F.col("ss") < F.col("ls"), 1).when(F.col("ss") > F.col("ls"), -1).otherwise(0)).over(Window.partitionBy("document_id"))
    status = F.when(F.col("ss").isNull(), "unmapped").when(F.sign(F.col("vote")) * (F.col("ls") - F.col("ss")) < 0, "mapped_minority").otherwise("mapped")
    return m.withColumn("vote", vote).select("document_id", "pair", "ss", (F.col("ss") + F.length("sf")).cast("long").alias("se"), "ls", (F.col("ls") + F.length("lf")).cast("long").alias("le"), status.alias("status"))


def frame(spark: SparkSession, path: str) -> DataFrame:
    """Sampling and selection frames; a repeated record_id fails the job."""
    schema = T.StructType.fromDDL("record_id string, text string, pmid string, pmcid string, source_kind string, year int, available boolean, official_split string, teacher_overlap string, challenge_tags array<string>, occurrence_keys array<string>, language string, document_type string, reuse_class string")
    f = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    n = F.count(F.lit(1)).over(Window.partitionBy("record_id"))
    return f.withColumn("n", n).filter(F.assert_true(F.col("n") == 1, F.lit("record ids repeat")).isNull()).drop("n")
