"""Readers and writers on small files, streaming, sharded runs, and the queries without the optional parts."""

from __future__ import annotations

import gzip
import json
import subprocess
import sys
from pathlib import Path

import pytest

from glossa.operators.extract import schwartz_hearst
from glossa.operators.more import run_sharded, with_failures
from glossa.sources import annotations as an
from glossa.sources import literature as lit
from glossa.sources import sinks
from glossa.streaming.extract import extract_new
from pyspark.sql import functions as F

BIOC = """<collection><document><id>d1</id><passage><offset>0</offset><text>alpha beta (AB)</text>
<annotation id="LF1"><infon key="type">LongForm</infon><location offset="0" length="10"/><text>alpha beta</text></annotation>
<annotation id="SF1"><infon key="type">ShortForm</infon><location offset="12" length="2"/><text>AB</text></annotation>
<annotation id="X9"><infon key="type">gene</infon><location offset="0" length="5"/><text>alpha</text></annotation>
<relation id="R1"><node refid="LF1" role="LongForm"/><node refid="SF1" role="ShortForm"/></relation></passage>
<passage><offset>20</offset><text>tail</text></passage></document></collection>"""


def test_bioc(spark, tmp_path):
    (tmp_path / "a.xml").write_text(BIOC)
    x = an.bioc_xml(spark, str(tmp_path / "a.xml"))
    js = {"documents": [{"id": "d1", "passages": [{"offset": 0, "text": "alpha beta (AB)", "annotations": [{"id": i, "infons": {"type": t}, "locations": [{"offset": o, "length": n}], "text": w} for i, t, o, n, w in (("LF1", "LongForm", 0, 10, "alpha beta"), ("SF1", "ShortForm", 12, 2, "AB"), ("X9", "gene", 0, 5, "alpha"))], "relations": [{"id": "R1", "nodes": [{"refid": "LF1", "role": "LongForm"}, {"refid": "SF1", "role": "ShortForm"}]}]}, {"offset": 20, "text": "tail", "annotations": [], "relations": []}], "relations": []}]}
    (tmp_path / "a.json").write_text(json.dumps(js))
    for rows in (x, an.bioc_json(spark, str(tmp_path / "a.json"))):
        p, e, r = an.bioc_tables(rows)
        docs, clashes = an.render(p)
        assert docs.first().text == "alpha beta (AB)     tail" and clashes.count() == 0
        pairs, diag = an.pair_entities(e, r)
        assert [tuple(v) for v in pairs.collect()] == [("d1", "relation", 12, 14, 0, 10)]
        assert [tuple(v) for v in diag.collect()] == [("d1", "BIOC_UNPAIRED_ENTITY", 1)]
        assert an.overlay(docs, e.withColumn("text", F.upper("text"))).first().text == "ALPHA BETA (AB)     tail"
        assert [v.text for v in lit.bioc_articles(rows).collect()] == ["tail"]
    sinks.write_bioc(docs, e.filter("id <> 'X9'"), str(tmp_path / "out"))
    again = an.bioc_tables(an.bioc_xml(spark, str(tmp_path / "out")))[1]
    assert {(v.id, v.s, v.e) for v in again.collect()} == {("LF1", 0, 10), ("SF1", 12, 14)}


def test_order_fallback(spark):
    e = spark.createDataFrame([("d", 1, "a", "short", 0, 1, ""), ("d", 2, "b", "long", 2, 3, ""), ("d", 3, "c", "long", 4, 5, "")], "document_id string, ord long, id string, role string, s long, e long, text string")
    none = spark.createDataFrame([], "document_id string, k string, short_id string, long_id string")
    assert sorted((v.how, v.ss, v.ls) for v in an.pair_entities(e, none)[0].collect()) == [("order", 0, 2), ("partial", None, 4)]
    assert {v.how for v in an.pair_entities(e, none, order_fallback=False)[0].collect()} == {"partial"}


def test_overlapping_passages_keep_the_earlier_text(spark):
    p = spark.createDataFrame([("d", 0, 0, "abc"), ("d", 1, 2, "XY"), ("e", 0, 0, "")], "document_id string, i int, offset long, text string")
    docs, clashes = an.render(p)
    assert {v.document_id: v.text for v in docs.collect()} == {"d": "abcY", "e": ""} and [v.n for v in clashes.collect()] == [1]


def test_token_files(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"id": "1", "tokens": ["see", "alpha", "beta", "AB", "x"], "labels": ["O", "B-long", "I-long", "B-short", "O"]}, {"id": "2", "tokens": ["a", "AB"], "acronym": 1, "expansion": "alpha beta"}, {"id": "3", "text": "t", "acronyms": [[0, 1]], "long-forms": [[0, 1], [0, 1]]}]))
    r = an.sdu_json(spark, str(tmp_path / "t.json"))
    assert [tuple(v)[2:] for v in an.bio_tags(r.filter("labels IS NOT NULL")).collect()] == [(15, 17, 4, 17)]  # a start of the other kind does not end a span
    assert [tuple(v) for v in an.acronym_tokens(r.filter("acronym IS NOT NULL")).collect()] == [("2", "a AB", 2, 4, "alpha beta")]
    assert an.span_lists(r.filter("acronyms IS NOT NULL")).count() == 3


def test_delimited_and_snapshot(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("# comment\n\nd\tAB alpha beta\t0\t2\t3\t13\nbad\trow\nd\tAB\t0\t2\t3\t99\n")
    good, bad = an.delimited(spark, str(tmp_path / "a.tsv"))
    assert good.count() == 1 and bad.count() == 2
    pair = lambda s: {"short_form": {"start": 0, "end": 2}, "long_form": {"start": 3, "end": 5}, "mapping_status": s}
    (tmp_path / "s.jsonl").write_text(json.dumps({"section_id": "s", "text": "AB cd", "pairs": [pair("mapped"), pair("ambiguous")]}))
    docs, kept, dropped = an.snapshot(spark, str(tmp_path / "s.jsonl"))
    assert (docs.count(), kept.count(), dropped.count()) == (1, 1, 1)


def test_canonical_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("b", "alpha beta (AB)"), ("a", "nothing")], "document_id string, text string")
    gold = spark.createDataFrame([("b", 12, 14, 0, 10, "AB", "alpha beta"), ("b", 12, 14, None, None, "AB", "other")], "document_id string, ss long, se long, ls long, le long, sf string, lf string")
    sinks.write_canonical(docs, gold, str(tmp_path / "c"))
    d, g = an.canonical(spark, str(tmp_path / "c"))
    assert {v.document_id for v in d.collect()} == {"a", "b"}
    assert sorted((v.ss, v.le) for v in g.collect() if v.le) == [(12, 10)] and g.count() == 2
    m = sinks.manifest(docs, gold, "test").first()
    assert (m.documents, m.annotations, m.complete) == (2, 2, 1) and m.fingerprint == sinks.manifest(docs.repartition(7), gold.orderBy("le"), "x").first().fingerprint
    assert m.fingerprint != sinks.manifest(docs, gold.limit(1), "x").first().fingerprint
    Path(tmp_path / "bad.jsonl").write_text('{"record_id": "x", "schema_version": "v9", "document": {"document_id": "x", "text": ""}}')
    with pytest.raises(Exception, match="unknown schema version"):
        an.canonical(spark, str(tmp_path / "bad.jsonl"))[0].collect()
    sinks.prediction_rows(docs, gold, "k", "1").select("value").write.text(str(tmp_path / "p"))
    who, what = an.predictions(spark, str(tmp_path / "p"))
    assert who.count() == 2 and what.count() == 2
    sinks.write_published(docs, str(tmp_path / "pub"), sinks.manifest(docs, gold, "t"))
    assert spark.read.parquet(str(tmp_path / "pub/data")).count() == 2 and spark.read.json(str(tmp_path / "pub/manifest")).count() == 1
    assert sinks.file_hashes(spark, str(tmp_path / "bad.jsonl")).count() == 1


def test_literature_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"article_id": "a", "sections": [{"section_id": "s1", "title": "T", "text": "x"}, {"section_id": "s2", "text": "y"}]}))
    assert [(v.article, v.ord, v.section_id) for v in lit.article_json(spark, str(tmp_path / "a.json")).collect()] == [("a", 0, "s1"), ("a", 1, "s2")]
    (tmp_path / "p.xml").write_text('<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">77</PMID><Article><ArticleTitle>t</ArticleTitle><Abstract><AbstractText Label="AIM">one</AbstractText><AbstractText Label="AIM">two</AbstractText></Abstract></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pmc">PMC5</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>')
    assert [tuple(v) for v in lit.pubmed_xml(spark, str(tmp_path / "p.xml")).orderBy("ord").collect()] == [("77", "PMC5", 0, "aim", "one"), ("77", "PMC5", 1, "aim-2", "two")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/x.xml").write_text('<article><front><article-id pub-id-type="pmcid">PMC1</article-id><abstract><p>An <italic>alpha</italic> beta.</p></abstract></front><table><tr><td>AB</td><td>alpha beta</td></tr></table></article>')
    (tmp_path / "j/y.xml").write_text("<article>")
    got = lit.jats_xml(spark, str(tmp_path / "j")).collect()
    assert [(v.kind, v.text) for v in got if v.article == "PMC1"] == [("paragraph", "An alpha beta."), ("cell", "AB"), ("cell", "alpha beta")]
    assert [v.source_path for v in got if v.text == "alpha beta"] == ["article/table[1]/tr[1]/td[2]"] and sum(v.kind == "error" for v in got) == 1
    with gzip.open(tmp_path / "f.json.gz", "wt") as out:
        json.dump({"AB": {"alpha beta": 3, "Alpha Beta": 1}}, out)
    assert sorted(v.n for v in lit.frequency_json(spark, str(tmp_path / "f.json.gz"), "s").collect()) == [1, 3]
    (tmp_path / "adam").write_text("#c\nAB\tAB:3\talpha beta:3:0.9|x:y:2:1.0|broken\nshort\n")
    lex, bad = lit.adam_tsv(spark, str(tmp_path / "adam"))
    assert {(v.lf_raw, v.n) for v in lex.collect()} == {("alpha beta", 3), ("x:y", 2)} and {v.reason: v.n for v in bad.collect()} == {"columns": 1, "long form": 1}
    (tmp_path / "al.xml").write_text("<r><item><pair_id>1</pair_id><abbreviation>AB</abbreviation><long_form>a b</long_form><pair_number>4</pair_number></item></r>")
    assert [tuple(v) for v in lit.allie_xml(spark, str(tmp_path / "al.xml")).collect()] == [("AB", "a b", "ab", "a b", 4)]
    (tmp_path / "fr.jsonl").write_text('{"record_id": "1"}\n{"record_id": "1"}\n')
    with pytest.raises(Exception, match="record ids repeat"):
        an.frame(spark, str(tmp_path / "fr.jsonl")).collect()


def test_streaming_sees_each_file_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta (AB) x")], "doc_id long, text string")
    run = lambda: extract_new(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    docs.write.parquet(str(tmp_path / "in"))
    run()
    docs.withColumn("doc_id", F.lit(2).cast("long")).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_sharded_run_and_failures(spark, tmp_path):
    docs = spark.createDataFrame([(i, None if i == 3 else f"alpha beta (AB) {i}") for i in range(20)], "doc_id long, text string")
    for _ in range(2):
        got = run_sharded(docs, schwartz_hearst, str(tmp_path / "s"), 4)
        assert sum(r.predictions for r in got.collect()) == 19
    assert spark.read.parquet(str(tmp_path / "s/quarantine")).count() == 1
    who, p, d = with_failures(docs, schwartz_hearst, F.col("doc_id") < 5)
    assert who.count() == 20 and p.count() == 15 and d.count() == 5


def test_queries_and_sql_go_together():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).first().tp > 0


def test_the_rest_works_without_the_optional_parts(tmp_path):
    root = Path(__file__).parents[1]
    for p in root.rglob("*.py"):
        rel = p.relative_to(root)
        if "llm" not in rel.parts and rel.name != "corpus_pipeline.py" and ".git" not in rel.parts:
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_text(p.read_text())
    code = "import __spark_entry__ as e; assert not e.HAS_LLM and len(e.queries()) > 90 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
