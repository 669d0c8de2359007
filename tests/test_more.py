"""Smaller operators and the configuration."""

from __future__ import annotations

import pytest

from glossa.config import Registry, interpolate, merge
from glossa.operators import fuse, more
from glossa.sources import annotations as an


def test_draws_repeat(spark):
    ids = spark.range(100).withColumnRenamed("id", "uid")
    a, b = ([r.uid for r in more.draw(ids, "uid", s, 10).collect()] for s in ("x", "x"))
    assert a == b and len(set(a)) == 10 and a != [r.uid for r in more.draw(ids, "uid", "y", 10).collect()]


def test_crossing_parts_best_stage_and_audit(spark):
    loc = spark.createDataFrame([("a", 0, 5), ("a", 4, 6), ("b", 0, 2), ("b", 2, 3)], "annotation_id string, s long, e long")
    assert [tuple(r) for r in more.crossing_locations(loc).collect()] == [("a", 1)]
    st = spark.createDataFrame([(1, True, 0.5, 0.9), (2, True, 0.8, 0.7), (3, True, 0.6, 0.95), (4, False, 0.9, 0.99)], "stage int, accepted boolean, metric double, precision double")
    assert more.best_stage(st).first().stage == 3
    e = spark.createDataFrame([("d", "a", "short", 1), ("d", "a", "long", None)], "document_id string, id string, role string, s long")
    assert {r.what: r.n for r in more.corpus_audit(e, e.limit(0)).collect()} == {"role:short": 1, "role:long": 1, "no_span": 1, "repeated_id": 1}


def test_features_must_be_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert more.finite(df.limit(1), ["x"]).count() == 1
    with pytest.raises(Exception, match="finite"):
        more.finite(df, ["x"]).collect()


def test_windows_and_workers(spark):
    docs = spark.createDataFrame([(1, "alpha beta (AB)"), (2, "x")], "doc_id long, text string")
    tags = spark.createDataFrame([(1, 0, "AC", 12, 14), (1, 10, "SF", 2, 4), (1, 0, "LF", 0, 10), (1, 0, "O", 0, 1), (1, 10, "LF", 0, 99)], "doc_id long, start long, label string, ws long, we long")
    assert sorted(tuple(r) for r in fuse.window_spans(tags, docs).collect()) == [(1, "LF", 0, 10), (1, "SF", 12, 14)]
    res = spark.createDataFrame([(1, "AB", "alpha beta", True), (1, "AB", "beta", False), (3, "q", "r", True)], "doc_id long, sf string, lf string, accepted boolean")
    pairs, odd = fuse.worker_pairs(res, docs)
    assert [tuple(r) for r in pairs.collect()] == [(1, 12, 14, 0, 10)] and {(r.doc_id, r.problem) for r in odd.collect()} == {(2, "unanswered"), (3, "unasked")}


def test_templates(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("AB\talpha beta\n# no\n")
    for t in ("{long} ({short}).", "x {short}, or {long}"):
        r = an.templated_pairs(spark, str(tmp_path / "p.tsv"), t).first()
        assert (r.text[r.ss : r.se], r.text[r.ls : r.le]) == ("AB", "alpha beta")


def test_rejected_locations(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<collection><document><id>d</id><passage><offset>0</offset><text>ab cd</text><annotation id="SF1"><location offset="0" length="1"/><location offset="3" length="1"/><text>a c</text></annotation></passage></document></collection>')
    rows = an.bioc_xml(spark, str(tmp_path / "a.xml"))
    assert an.bioc_tables(rows)[1].first().s == 0 and an.bioc_tables(rows, "reject")[1].first().s is None


def test_configuration():
    assert merge({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"b": 3}, "d": [2]}) == {"a": {"b": 3, "c": 2}, "d": [2]}
    assert interpolate({"p": ["${X}/y"]}, {"X": "z"}) == {"p": ["z/y"]}
    with pytest.raises(KeyError):
        interpolate("${NO}", {})
    r = Registry()
    r.add("f", lambda n=1: n)
    assert r.create({"key": "f", "params": {"n": 4}}) == 4
    with pytest.raises(ValueError, match="already"):
        r.add("f", int)
