"""Matching, fusion and features against plain loops."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from glossa.functions.lineage import components, hash_rank
from glossa.operators import features as f
from glossa.operators import fuse, learn, more, weak
from glossa.operators.evaluate import bootstrap_ci, exact_pair
from glossa.operators.literature import prose_passages, similar_pairs
from pyspark.sql import functions as F

SCHEMA = "doc_id long, ss long, se long, ls long, le long"


def test_bags_match_by_count_and_missing_sides_are_unscoreable(spark):
    rng = random.Random(1)
    draw = lambda n: [(rng.randint(0, 3), *(rng.randint(0, 1) for _ in range(4))) for _ in range(n)]
    g, p = draw(200), draw(180)
    out = Counter((tuple(r)[:5], r.status) for r in exact_pair(spark.createDataFrame([*g, (1, None, None, 2, 3)], SCHEMA), spark.createDataFrame([*p, (1, 1, 2, None, None)], SCHEMA)).collect())
    a, b = Counter(g), Counter(p)
    for k in a | b:
        assert (out[k, "tp"], out[k, "fn"], out[k, "fp"]) == (min(a[k], b[k]), max(0, a[k] - b[k]), max(0, b[k] - a[k]))
    assert sum(n for (_, s), n in out.items() if s == "unscoreable") == 2


def test_bootstrap_interval_holds_the_estimate(spark):
    o = spark.range(400).select((F.col("id") % 90).alias("doc_id"), F.when(F.col("id") % 5 == 0, "fp").when(F.col("id") % 7 == 0, "fn").otherwise("tp").alias("status"))
    r = bootstrap_ci(o).first()
    n = Counter(x.status for x in o.collect())
    assert r.lower < 2 * n["tp"] / (2 * n["tp"] + n["fp"] + n["fn"]) < r.upper


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_common_subsequence(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))), "".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))) for _ in range(300)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", f.lcs(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == lcs(r.a, r.b) for r in got)


def test_greedy_assignment_and_abstaining_union(spark):
    rng = random.Random(3)
    pairs = list({(d, s, s + 2, 100 + t, 103 + t): float(rng.randint(0, 4)) for d in range(20) for s in range(6) for t in range(5) if rng.random() < 0.5}.items())
    rows = [(*k, c) for k, c in pairs]
    want = []
    for d in range(20):
        used = set()
        for k, _ in sorted(((k, c) for k, c in pairs if k[0] == d), key=lambda x: (x[1], x[0][1], x[0][3], x[0][2], x[0][4])):
            if not {("s", *k[1:3]), ("l", *k[3:])} & used:
                used |= {("s", *k[1:3]), ("l", *k[3:])}
                want.append(k)
    got = fuse.pair_one_to_one(spark.createDataFrame(rows, SCHEMA + ", cost double"))
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(want)
    a, b = [k for k, _ in pairs[::2]], [k for k, _ in pairs[1::3]]
    taken, want = {}, []
    for k in [*sorted(a), *sorted(set(b) - set(a))]:
        if not any(k[0] == t[0] and (k[1:3] == t[1:3] or k[3:] == t[3:]) for t in taken):
            taken[k] = 1
    got = fuse.fuse({"a": spark.createDataFrame(a, SCHEMA), "b": spark.createDataFrame(b, SCHEMA)}, "abstain")
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(taken)


def test_requests_are_packed_in_order(spark):
    rng = random.Random(4)
    rows = [(d, i, rng.randint(1, 900)) for d in range(15) for i in range(rng.randint(1, 30))]
    want = []
    for d in range(15):
        n = c = k = 0
        for _, _, size in [r for r in rows if r[0] == d]:
            if n and (n + 1 > 4 or c + size > 2000):
                want.append((d, k, n, c))
                n = c = 0
                k += 1
            n, c = n + 1, c + size
        want.append((d, k, n, c))
    assert sorted(map(tuple, fuse.pack_requests(spark.createDataFrame(rows, "doc_id long, i long, size long"), 4, 2000).collect())) == sorted(want)


def test_prose_is_packed_without_loss(spark):
    text = " ".join(f"Sentence number {i} ends here." for i in range(60)) + " Tail."
    got = [r.text for r in prose_passages(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string"), 80, 200, 400).orderBy("i").collect()]
    assert " ".join(got) == text and all(80 <= len(t) <= 400 for t in got)


def test_similar_word_sets(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(80)]
    base = [rng.sample(vocabulary, 50) for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(8):
            t = list(b)
            if rng.random() < 0.6:
                t[0] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    s = [set(t.split()) for t in texts]
    want = {(i, j) for i in range(len(s)) for j in range(i) if len(s[i] & s[j]) >= 0.95 * len(s[i] | s[j])}
    root = list(range(len(s)))
    for i, j in want:
        root = [root[j] if r == root[i] else r for r in root]
    links = similar_pairs(spark.createDataFrame(list(enumerate(texts)), "record_id long, text string"), 0.95)
    found = {r.node: r.root for r in components(links).collect()}
    mine = [found.get(i, i) for i in range(len(s))]
    assert [[a == b for b in root] for a in root] == [[a == b for b in mine] for a in mine]


def test_ranks_are_global(spark):
    d = spark.range(500).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    got = {r.id: r.rank for r in hash_rank(d, F.col("h")).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [r.id for r in d.orderBy("h").collect()]


def test_gradient_descent_learns(spark):
    rows = spark.range(200).select((F.col("id") % 2).cast("double").alias("label"), ((F.col("id") % 2) * 2 - 1 + F.rand(3)).alias("x"))
    w = learn.logistic_fit(rows, ["x"], iterations=30, rate=1.0)
    assert w["x"] > 1


def test_silver_ties_go_to_the_first_record(spark):
    rows = [(1, "a", 1.0, "positive", 1), (1, "a", 1.0, "negative", 2), (2, "a", 1.0, "positive", 1), (2, "b", 1.0, "negative", 2), (3, "a", 0.4, "abstain", 1)]
    e = spark.createDataFrame(rows, "k long, family string, weight double, polarity string, ord long")
    assert {r.k: r.status for r in weak.silver_labels(e, ["k"]).collect()} == {1: "positive", 2: "abstain", 3: "abstain"}
    assert {r.k: r.status for r in weak.silver_labels(e, ["k"], conflict="priority").collect()}[2] == "positive"


def test_split_problems_and_leaks(spark):
    m = spark.createDataFrame([(1, "train"), (1, "dev"), (2, "test")], "doc_id long, split string")
    rows = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    assert {(r.doc_id, r.problem) for r in learn.split_problems(rows, m).collect()} == {(1, "several"), (3, "unassigned")}
    assert more.leaked_fields(rows.withColumn("x", F.struct(F.lit(1).alias("model_score")))) == ["x.model_score"]
    assert more.cache_key("a", {"b": 1, "a": 2}, "1") == more.cache_key("a", {"a": 2, "b": 1}, "1") != more.cache_key("a", {"a": 2, "b": 1}, "2")


def test_features_need_different_names(spark):
    with pytest.raises(ValueError, match="unique"):
        f.feature_set(spark.range(1), [{"a": F.lit(1)}, {"a": F.lit(2)}], [])
