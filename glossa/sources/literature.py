"""Articles and lexical resources: article JSON, PubMed and JATS XML, frequency JSON, ADAM and ALLIE tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = "article_id string, pmid string, pmcid string, title string, sections array<struct<section_id:string,title:string,text:string>>"
PUBMED = """MedlineCitation struct<PMID:struct<_VALUE:string>,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>>>,
PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"""
#: JATS elements that are sections of text, by kind.
JATS = {"p": "paragraph", "caption": "caption", "td": "cell", "th": "header", "fn": "footnote", "term": "term", "def": "definition", "title": "title"}


def article_json(spark: SparkSession, path: str) -> DataFrame:
    """article, ord, section_id, title, text of local article files."""
    a = spark.read.schema(ARTICLE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return a.select(F.col("article_id").alias("article"), F.posexplode("sections").alias("ord", "s")).select("article", "ord", "s.section_id", "s.title", "s.text")


def pubmed_xml(spark: SparkSession, path: str) -> DataFrame:
    """article (PMID), pmcid, ord, section_id, text per AbstractText; a repeated label gets its ordinal as suffix."""
    x = spark.read.format("xml").schema(PUBMED).option("rowTag", "PubmedArticle").option("attributePrefix", "_").load(path)
    pmc = F.get(F.filter("PubmedData.ArticleIdList.ArticleId", lambda i: i["_IdType"] == "pmc"), F.lit(0))["_VALUE"]
    r = x.select(F.coalesce("MedlineCitation.PMID._VALUE", F.lit("")).alias("article"), pmc.alias("pmcid"), F.posexplode("MedlineCitation.Article.Abstract.AbstractText").alias("ord", "a"))
    slug = F.regexp_replace(F.lower(F.coalesce("a._Label", F.lit("abstract"))), "[^a-z0-9]+", "-")
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("article", slug).orderBy("ord"))
    return r.select("article", "pmcid", "ord", F.when(k > 1, F.concat_ws("-", slug, k.cast("string"))).otherwise(slug).alias("section_id"), F.coalesce("a._VALUE", F.lit("")).alias("text"))


def bioc_articles(rows: DataFrame, with_title: bool = False) -> DataFrame:
    """article, ord, offset, length, text of BioC rows; the first passage, the title, is left out by default."""
    p = rows.select(F.col("id").alias("article"), F.posexplode("passage").alias("ord", "p"))
    p = p if with_title else p.filter("ord > 0")
    return p.select("article", "ord", F.col("p.offset").alias("offset"), F.length("p.text").cast("long").alias("length"), F.col("p.text").alias("text"))


def _jats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements in document order with their paths: mixed content, which row readers of XML can't keep in order."""
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                root = ElementTree.fromstring(content)
            except ElementTree.ParseError:
                rows.append((path, 0, None, "error", None, "malformed XML"))
                continue
            article = next((e.text for e in root.iter("article-id") if e.get("pub-id-type") == "pmcid"), None) or path
            stack, order = [(root, root.tag, None)], 0
            while stack:
                node, at, parent = stack.pop()
                kind = JATS.get(node.tag)
                if kind:
                    rows.append((article, order, at, kind, parent, " ".join("".join(node.itertext()).split())))
                    order += 1
                seen: dict[str, int] = {}
                below = []
                for child in node:
                    seen[child.tag] = seen.get(child.tag, 0) + 1
                    below.append((child, f"{at}/{child.tag}[{seen[child.tag]}]", at if kind else parent))
                stack += reversed(below)
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["article", "ord", "source_path", "kind", "parent", "text"])


def jats_xml(spark: SparkSession, path: str) -> DataFrame:
    """article, ord, source_path, kind, parent, text of JATS files, one per article; a malformed file is one row of kind error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_jats, "article string, ord long, source_path string, kind string, parent string, text string")


def frequency_json(spark: SparkSession, path: str, label: str) -> DataFrame:
    """sf_raw, lf_raw, sf_key, lf_key, n, source_label of (gzipped) {SF: {LF: count}} files; a negative count fails the job."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,map<string,bigint>>", {"mode": "FAILFAST"}).alias("m"))
    r = raw.select(F.explode("m").alias("sf_raw", "forms")).select("sf_raw", F.explode("forms").alias("lf_raw", "n"))
    r = r.filter(F.assert_true(F.col("n") >= 0, F.lit("counts must not be negative")).isNull())
    return r.select("sf_raw", "lf_raw", F.lower("sf_raw").alias("sf_key"), F.lower("lf_raw").alias("lf_key"), "n", F.lit(label).alias("source_label"))


def adam_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lexicon rows and malformed rows of lines ``preferred \\t variant:count|... \\t long form:count:score|...``."""
    raw = spark.read.text(path).filter("value <> '' AND NOT startswith(value, '#')").select(F.split("value", "\t", -1).alias("c"))
    good = raw.filter("size(c) >= 3").select(F.get("c", F.lit(0)).alias("sf_raw"), F.explode(F.split(F.get("c", F.lit(2)), "\\|")).alias("x"))
    parts = good.select("sf_raw", F.regexp_extract("x", r"^(.*):(\d+):([0-9.eE+-]+)$", 1).alias("lf_raw"), F.regexp_extract("x", r"^(.*):(\d+):([0-9.eE+-]+)$", 2).alias("n"))
    ok = (F.col("lf_raw") != "") & (F.col("sf_raw") != "")
    lex = parts.filter(ok).groupBy("sf_raw", "lf_raw").agg(F.sum(F.col("n").cast("long")).alias("n"))
    bad = raw.filter("size(c) < 3").select(F.lit("columns").alias("reason")).unionByName(parts.filter(~ok).select(F.lit("long form").alias("reason")))
    return lex.select("sf_raw", "lf_raw", F.lower("sf_raw").alias("sf_key"), F.lower("lf_raw").alias("lf_key"), "n"), bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def allie_xml(spark: SparkSession, path: str) -> DataFrame:
    """sf_raw, lf_raw, sf_key, lf_key, n of item elements; a repeated pair_id fails the job."""
    x = spark.read.format("xml").schema("pair_id string, abbreviation string, long_form string, pair_number bigint").option("rowTag", "item").load(path)
    g = x.groupBy("pair_id").agg(F.count(F.lit(1)).alias("c"), F.first("abbreviation").alias("sf_raw"), F.first("long_form").alias("lf_raw"), F.first("pair_number").alias("n"))
    g = g.filter(F.assert_true(F.col("c") == 1, F.lit("pair ids repeat")).isNull())
    return g.select("sf_raw", "lf_raw", F.lower("sf_raw").alias("sf_key"), F.lower("lf_raw").alias("lf_key"), "n")


def licences(spark: SparkSession, path: str) -> DataFrame:
    """path, url, cc_by of XML articles: the first licence link, and whether it is the attribution licence without further terms."""
    text = F.decode("content", "UTF-8")
    url = F.regexp_extract(text, r"(https?://creativecommons\.org/[A-Za-z0-9./-]+)", 1)
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.when(url != "", url).alias("url"), url.rlike(r"/licenses/by/[0-9.]+/?$").alias("cc_by"))
