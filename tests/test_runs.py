"""Builds, kept predictions, sharded runs, iterations, review packets, revisions and writers, against plain loops."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter

import numpy as np
import pytest

from glossa.functions import text as tx
from glossa.functions.lineage import free_names, skew_join
from glossa.operators import learn, literature, review, runs, validate
from glossa.operators.extract import schwartz_hearst
from glossa.sources import sinks
from glossa.streaming.extract import merge_revisions
from pyspark.sql import functions as F

GOLD = "doc_id long, ss long, se long, ls long, le long, sf string, lf string"


def test_builds(spark):
    docs = spark.createDataFrame([(1, "alpha beta (AB)"), (2, "x"), (2, "y")], "doc_id long, text string")
    gold = spark.createDataFrame([(1, 12, 14, 0, 10, " AB", "alpha beta"), (2, 0, 9, 0, 1, "x", "x")], GOLD)
    d, g, log = runs.build_corpus(docs, gold, {"TRIM": validate.trim_captured})
    assert [r.doc_id for r in d.collect()] == [1] and [(r.doc_id, r.sf) for r in g.collect()] == [(1, "AB")]
    assert {(r.severity, r.code, r.doc_id) for r in log.collect()} == {("info", "TRIM", 1), ("error", "RECORD_DROPPED", 2), ("warning", "DUPLICATE_RECORD_ID", 2)}
    with pytest.raises(ValueError, match="strict"):
        runs.build_corpus(docs, gold, {}, strict=True)


def named(docs, gold):
    return docs.withColumnRenamed("doc_id", "document_id").withColumn("document_id", F.col("document_id").cast("string")), gold.withColumnRenamed("doc_id", "document_id").withColumn("document_id", F.col("document_id").cast("string"))


def test_a_changed_dataset_is_refused(spark, tmp_path):
    docs, gold = named(spark.createDataFrame([(1, "alpha beta (AB)"), (2, "x")], "doc_id long, text string"), spark.createDataFrame([(1, 12, 14, 0, 10, "AB", "alpha beta")], GOLD))
    sinks.write_dataset(docs, gold, str(tmp_path / "d"), "test", ("TRIM",))
    d, g = runs.checked_dataset(spark, str(tmp_path / "d"))
    assert d.count() == 2 and g.count() == 1
    part = next(p for p in sorted((tmp_path / "d" / "data").glob("part-*")) if "alpha" in p.read_text())
    part.write_text(part.read_text().replace("alpha", "alpho"))
    for crc in (tmp_path / "d" / "data").glob(".part-*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="fingerprint"):
        runs.checked_dataset(spark, str(tmp_path / "d"))


def test_predictions_are_kept_and_checked(spark, tmp_path):
    docs = spark.createDataFrame([("1", "alpha beta (AB)"), ("2", "x")], "document_id string, text string")
    calls = []

    def resolve(d):
        calls.append(1)
        return schwartz_hearst(d.withColumnRenamed("document_id", "doc_id")).withColumnRenamed("doc_id", "document_id")

    first, was = runs.kept_predictions(docs, resolve, str(tmp_path), "sh", "1", {"min_sf": 2})
    again, kept = runs.kept_predictions(docs, resolve, str(tmp_path), "sh", "1", {"min_sf": 2})
    assert (was, kept, len(calls)) == (False, True, 1) and [r.ss for r in first.collect()] == [r.ss for r in again.collect()] == [12]
    assert not runs.kept_predictions(docs, resolve, str(tmp_path), "sh", "2", {"min_sf": 2})[1]
    bad = resolve(docs).withColumn("lf", F.lit("other"))
    for rows, match in ((sinks.prediction_rows(docs, bad, "sh", "1", "f"), "stands"), (sinks.prediction_rows(docs.limit(1), resolve(docs), "sh", "1", "f"), "cover"), (sinks.prediction_rows(docs, resolve(docs), "sh", "1", "g"), "another")):
        rows.select("value").write.mode("overwrite").text(str(tmp_path / "bad"))
        with pytest.raises(ValueError, match=match):
            runs.checked_predictions(spark, str(tmp_path / "bad"), docs, "f")


def test_sharded_runs_are_taken_up_again(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), None if i == 3 else f"text {i}") for i in range(20)], "document_id string, text string")

    def process(name, text):
        return json.dumps({"n": len(text)})

    one = runs.process_sharded(docs, process, str(tmp_path), 4, {"processor": "len", "version": "1"})
    assert (one["documents"], one["failed"], one["reused"]) == (20, 1, False)
    out = spark.read.schema("document_id string, input_sha256 string, output string, shard int").parquet(f"{one['path']}/outputs").collect()
    assert len(out) == 19 and all(r.shard == int.from_bytes(hashlib.sha256(r.document_id.encode()).digest()[:8], "big") % 4 for r in out)
    assert [(r.document_id, r.error_type) for r in spark.read.schema("document_id string, error_type string").parquet(f"{one['path']}/quarantine").collect()] == [("3", "TypeError")]
    assert runs.process_sharded(docs, process, str(tmp_path), 4, {"processor": "len", "version": "1"})["reused"]
    assert not runs.process_sharded(docs, process, str(tmp_path), 4, {"processor": "len", "version": "2"})["reused"]


def brute_iterations(stages, max_iterations, max_stages, minimum_gain, minimum_precision):
    accepted, out, seen, best, best_gain, stopped, completed = [], [], set(), None, float("-inf"), None, 0
    numbers = sorted({s[0] for s in stages})
    for i in numbers[:max_iterations]:
        plan = sorted([s for s in stages if s[0] == i], key=lambda s: s[1])
        if len(plan) + len(accepted) > max_stages:
            stopped = "stage limit"
            break
        gain = max(s[2] for s in plan)
        if i > numbers[0] and gain <= minimum_gain:
            stopped = "no development gain"
            break
        for _, name, _, precision, ids in plan:
            why = "duplicate or self-supporting evidence" if seen & set(ids) else "development precision guard" if precision < minimum_precision else None
            out.append((i, name, why is None, why))
            if why is None:
                accepted.append(name)
                seen |= set(ids)
        completed = i
        if gain > best_gain and all(s[3] >= minimum_precision for s in plan):
            best, best_gain = i, gain
    if stopped is None and len(numbers) > max_iterations:
        stopped = "iteration limit"
    return out, {"completed": completed, "stopped": stopped, "best": best}


@pytest.mark.parametrize("limits", [(5, 50, 0.0, 0.5), (2, 50, 0.0, 0.5), (5, 3, 0.0, 0.0), (5, 50, 0.3, 0.0)])
def test_iterations(spark, limits):
    stages = [(1, "a", 0.5, 0.9, ["x", "y"]), (1, "b", 0.2, 0.4, ["z"]), (2, "c", 0.6, 0.8, ["y"]), (2, "d", 0.1, 0.8, ["z", "w"]), (3, "e", 0.2, 0.9, [])]
    df = spark.createDataFrame(stages, "iteration int, name string, gain double, precision double, evidence_ids array<string>")
    got, manifest = runs.iterate(df, *limits)
    assert ([tuple(r) for r in got.collect()], manifest) == brute_iterations(stages, *limits)


def brute_packet(rows, seed, cap):
    rank = lambda s, r: hashlib.sha256(f"{s}:{r[0]}".encode()).hexdigest()
    taken, chosen = Counter(), {}
    for name, strata, target, s in (("disagreement", ("disagreement",), 30, seed), ("agreement", ("agreement",), 10, seed), ("enriched_zero", ("enriched_zero",), 15, seed), ("uniform_zero", ("enriched_zero", "zero_pool"), 5, seed + 1), ("diagnostic", ("diagnostic",), None, seed + 2)):
        pool = sorted((r for r in rows if r[1] in strata and r[0] not in chosen), key=lambda r: (name == "diagnostic" and not r[4], rank(s, r)))
        target = max(0, 60 - len(chosen)) if target is None else target
        counts = Counter()
        while target:
            arms = sorted({r[2] for r in pool if r[0] not in chosen and taken[r[3]] < cap}, key=lambda a: (counts[a], a))
            if not arms:
                break
            r = next(r for r in pool if r[2] == arms[0] and r[0] not in chosen and taken[r[3]] < cap)
            chosen[r[0]] = name
            taken[r[3]] += 1
            counts[r[2]] += 1
            target -= 1
    return chosen


@pytest.mark.parametrize(("cap", "articles"), [(4, 9), (2, 40), (1, 5)])
def test_review_packets_alternate_arms(spark, cap, articles):
    rng = np.random.default_rng(cap)
    strata = ["disagreement", "agreement", "enriched_zero", "zero_pool", "diagnostic"]
    rows = [(i, strata[rng.integers(0, 5)], f"arm{rng.integers(0, 3)}", int(rng.integers(0, articles)), bool(rng.integers(0, 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "case_id long, stratum string, arm string, article long, has_predictions boolean")
    assert {r.case_id: r.category for r in review.review_packet(df, 7, cap).collect()} == brute_packet(rows, 7, cap)


def test_locks():
    review.check_lock({"packet": "p", "state": "s", "predictions_exposed": False}, "p", "s")
    for lock in ({"packet": "p", "state": "t", "predictions_exposed": False}, {"packet": "p", "state": "s", "predictions_exposed": True}):
        with pytest.raises(ValueError, match="lock"):
            review.check_lock(lock, "p", "s")


def test_revisions_of_a_stream(spark, tmp_path):
    batches = [[("a", 0, 1, "x"), ("b", 5, 1, "no")], [("a", 1, 2, "y"), ("a", 1, 3, "late"), ("c", 0, 1, "z")]]
    schema = "key string, expected long, revision long, value string"
    for n in range(2):
        spark.createDataFrame(batches[n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        merge_revisions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.key, r.revision, r.value, r.conflicts) for r in spark.read.parquet(str(tmp_path / "out" / "v1")).collect()}
    assert got == {("a", 2, "y", 1), ("b", None, None, 1), ("c", 1, "z", 0)}


def test_fits_agree_wherever_they_run(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), float(a + b > 0.8)) for a, b in rng.integers(0, 5, (300, 2)) / 4]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    here = learn.logistic_fit(df, ["a", "b"], iterations=30, l2=0.01, balanced=True)
    monkeypatch.setattr(learn, "DRIVER_ROWS", 0)
    there = learn.logistic_fit(df, ["a", "b"], iterations=30, l2=0.01, balanced=True)
    w = [0.0, 0.0, 0.0]
    ones = sum(r[2] for r in rows)
    for _ in range(30):
        g = [0.0, 0.0, 0.0]
        for a, b, y in rows:
            err = (1 / (1 + np.exp(-(w[0] + w[1] * a + w[2] * b))) - y) * len(rows) / (2 * (ones if y else len(rows) - ones))
            g = [g[0] + err, g[1] + err * a, g[2] + err * b]
        w = [w[0] - 0.1 * g[0] / len(rows), *(x - 0.1 * (d / len(rows) + 0.01 * x) for x, d in zip(w[1:], g[1:], strict=True))]
    assert list(here.values()) == pytest.approx(w) and list(there.values()) == pytest.approx(w)


def test_offsets_after_a_letter_that_grows(spark):
    docs = spark.createDataFrame([(1, "gamma İİ alpha beta (AB) then AB and abs"), (2, r"a \E(x) \E")], "doc_id long, text string")
    assert [(r.ls, r.lf) for r in schwartz_hearst(docs).collect()] == [(9, "alpha beta")]
    d = spark.createDataFrame([(1, "AB", 21), (2, r"\E", 2)], "doc_id long, sf string, ss long")
    got = {(r.doc_id, r.s, r.e, r.status) for r in literature.link_mentions(docs, d, allow_plural=True).collect()}
    assert got == {(1, 21, 23, "linked"), (1, 30, 32, "linked"), (1, 37, 40, "linked"), (2, 2, 4, "linked"), (2, 8, 10, "linked")}
    got = {(r.s, r.e) for r in literature.link_mentions(docs, d, case_sensitive=True).filter("doc_id = 1").collect()}
    assert got == {(21, 23), (30, 32)}


def test_mention_policies(spark):
    docs = spark.createDataFrame([(1, "AB x AB. AB y AB")], "doc_id long, text string")
    d = spark.createDataFrame([(1, "AB", 5), (1, "AB", 5), (1, "AB", 14)], "doc_id long, sf string, ss long")
    of = lambda **o: [(r.s, r.status, r.definition_start, r.n) for r in literature.link_mentions(docs, d, **o).orderBy("s").collect()]
    assert of() == [(0, "undefined", None, 0), (5, "ambiguous", 5, 2), (9, "ambiguous", 5, 2), (14, "linked", 14, 1)]
    assert of(conflict="nearest", ordering="nearest_any") == [(s, "linked", 14, 1) for s in (0, 5, 9, 14)]
    parts = spark.createDataFrame([(1, 0, 8), (1, 9, 16)], "doc_id long, start long, end long")
    assert of(scope="section", sections=parts, ordering="nearest_any", conflict="nearest") == [(0, "linked", 5, 2), (5, "linked", 5, 2), (9, "linked", 14, 1), (14, "linked", 14, 1)]


def test_occurrences_of_anything(spark):
    cases = [("aaa", "aa"), ("aXaXa", "aXa"), (r"x\Ey\E", r"\E"), (r"\Q\E\Q", r"\Q"), ("", "a"), ("abc", ""), ("a.b", "."), ("ab" * 700, "ab"), ("(" * 600 + "x)", "(")]
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(cases)], "i int, t string, n string")
    every = lambda t, n: [i for i in range(len(t)) if n and t.startswith(n, i)]
    got = {r.i: (r.a, r.b) for r in df.select("i", tx.all_occurrences(F.col("t"), F.col("n")).alias("a"), tx.occurrences(F.col("t"), F.col("n")).alias("b")).collect()}
    assert got == {i: (every(t, n), [m.start() for m in re.finditer(re.escape(n), t)] if n else []) for i, (t, n) in enumerate(cases)}


def test_words_before_a_far_offset(spark):
    words = "alpha beta-gamma d"
    texts = [words + " " * 600 + "(AB)", words + " -" * 400 + "(AB)", "x" * 3000 + " y (AB)", "w " * 900 + "(AB)", "(AB)", "don't " * 200 + "(AB)"]
    df = spark.createDataFrame([(i, t, t.index("(")) for i, t in enumerate(texts)], "i int, t string, at long")
    got = {r.i: r.w for r in df.select("i", tx.last_words(F.col("t"), F.col("at"), F.lit(3)).alias("w")).collect()}
    for i, t in enumerate(texts):
        found = list(re.finditer("[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*", t[: t.index("(")]))[-3:]
        assert (got[i] is None and not found) or (got[i].start, got[i].end) == (found[0].start(), found[-1].end())


def test_skewed_keys_and_free_names(spark, monkeypatch):
    from glossa.functions import lineage

    monkeypatch.setattr(lineage, "HOT_ROWS", 10)
    left = spark.createDataFrame([(0 if i < 50 else i, i) for i in range(100)], "k int, v int")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m")).filter("k <> 99")
    for how in ("left", "inner"):
        assert sorted(map(str, skew_join(left, right, ["k"], "n", how).collect())) == sorted(map(str, left.join(right, ["k"], how).collect()))
    assert free_names(left.withColumn("_K", F.lit(1)), "k", "z", "z") == ["__k", "z", "_z"]


def test_artifacts_and_file_checks(spark, tmp_path):
    c = spark.createDataFrame([(1, 5, 7, 0, 3, "rule"), (1, 1, 2, 0, 1, "rule")], "doc_id long, ss long, se long, ls long, le long, generator string")
    line = json.loads(sinks.candidate_rows(c).first().value)
    assert [x["short_form"]["start"] for x in line["candidates"]] == [1, 5] and line["schema_version"] == "candidates-v1"
    tags = spark.createDataFrame([(1, "LF", 4, 9), (1, "SF", 0, 2)], "doc_id long, label string, s long, e long")
    assert [x["label"] for x in json.loads(sinks.tag_rows(tags).first().value)["spans"]] == ["SF", "LF"]
    spans = spark.createDataFrame([(1, 4, 9, 2, 1, 6)], "article long, s long, e long, ord long, rs long, re long")
    assert json.loads(sinks.resolution_rows(spans).first().value)["spans"][0]["section"] == 2
    assert json.loads(sinks.report_rows(tags, "tags").first().value)["row"]["label"] == "LF"
    (tmp_path / "a.txt").write_text("a")
    (tmp_path / "b.txt").write_text("b")
    said = spark.createDataFrame([("a.txt", hashlib.sha256(b"a").hexdigest()), ("b.txt", "0"), ("c.txt", "0")], "file string, sha256 string")
    assert {(r.file, r.problem) for r in sinks.verify_files(spark, str(tmp_path), said).collect()} == {("b.txt", "changed"), ("c.txt", "missing")}


def test_ledger_stream_and_error_tables(spark, tmp_path):
    from glossa.streaming.extract import ledger_stream

    rows = [(1, "a", 1, "2024-01-01 00:00:00"), (1, "a", 1, "2024-01-01 00:10:00"), (2, "a", 1, "2024-01-01 00:20:00")]
    df = spark.createDataFrame(rows, "user_id long, event_type string, event_id long, t string").select("user_id", "event_type", "event_id", F.to_timestamp("t").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ledger_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    sinks.write_errors(df.select("user_id", "event_type"), str(tmp_path / "errors"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "errors")).columns == ["user_id", "event_type"]


def test_groups_have_one_official_split(spark):
    schema = "record_id long, source_kind string, available boolean, teacher_overlap string, tag string, official_split string"
    frame = spark.createDataFrame([(1, "a", True, "no", None, "train"), (2, "a", True, "no", None, "test")], schema)
    groups = spark.createDataFrame([(1, 1), (2, 2)], "record_id long, root long")
    assert literature.roll_up(frame, groups).count() == 2
    with pytest.raises(Exception, match="official splits"):
        literature.roll_up(frame, groups.withColumn("root", F.lit(1))).collect()
