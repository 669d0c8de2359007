"""External tools, replays, scorer artifacts and licences."""

from __future__ import annotations

import pytest

from glossa.operators.outside import load_scorer, replayed, save_scorer, tool_outputs
from glossa.sources.literature import licences


def test_tools_run_once_per_text_and_fail_softly(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.stdout for r in tool_outputs(docs, ["tr", "a-z", "A-Z"]).collect()}
    assert got == {1: "AB", 2: "AB", 3: ""}
    first = tool_outputs(docs.filter("doc_id = 1"), ["tr", "a-z", "A-Z"]).selectExpr("key", "'kept' AS stdout")
    assert {r.doc_id: r.stdout for r in tool_outputs(docs, ["tr", "a-z", "A-Z"], first).collect()} == {1: "kept", 2: "kept", 3: ""}
    assert {r.error for r in tool_outputs(docs, ["no-such-program"]).collect()} == {"FileNotFoundError"}


def test_replay(spark):
    r = spark.createDataFrame([("q1", "a1")], "request string, response string")
    assert {x.request: x.response for x in replayed(spark.createDataFrame([("q1",), ("q2",)], "request string"), r).collect()} == {"q1": "a1", "q2": None}


def test_scorers_are_checked(spark, tmp_path):
    save_scorer(spark, {"bias": 0.5, "x": 1.0}, str(tmp_path / "m"))
    assert load_scorer(spark, str(tmp_path / "m"), ["x"]) == {"bias": 0.5, "x": 1.0}
    with pytest.raises(ValueError, match="other features"):
        load_scorer(spark, str(tmp_path / "m"), ["y"])
    line = spark.read.text(str(tmp_path / "m")).first()[0].replace("1.0", "2.0")
    spark.createDataFrame([(line,)], "value string").write.text(str(tmp_path / "n"))
    with pytest.raises(ValueError, match="digest"):
        load_scorer(spark, str(tmp_path / "n"), ["x"])


def test_licences(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<article><license href="https://creativecommons.org/licenses/by/4.0/"/></article>')
    (tmp_path / "b.xml").write_text('<article><license href="https://creativecommons.org/licenses/by-nc/4.0/"/></article>')
    assert sorted(r.cc_by for r in licences(spark, str(tmp_path)).collect()) == [False, True]
