"""Nearest neighbours, language ID, packing and toxicity."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from glossa.llm.ann import Tables, ann_search
from glossa.llm.language_id import language_id
from glossa.llm.learned_queries import op1_ann, op4_language_id, op9_toxicity
from glossa.llm.packing import WordIds, best_fit, pack_sequences
from glossa.llm import language_id as li
from glossa.llm.toxicity import drop_toxic, evidence, least_evidence, toxicity, train_nnpu
from pyspark.sql import functions as F
from tests.llm.conftest import documents, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.01"


def brute_neighbours(rows, k, ask):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = {}
    for q in (i for i in ok if ask(i)):
        d = sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        out[q] = d[:k]
    return out


def test_neighbours_with_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(60)]
    rows += [(60 + i, rows[0][1]) for i in range(25)]  # ties
    rows += [(200, None), (210, []), (220, [0.0] * 6), (230, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (240, [float("nan")] * 6), (None, [1.0] * 6), (250, [float("inf"), 0.0, 0.0, 0.0, 0.0, 1.0]), (260, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, s int")
    got = ann_search(df, lambda i: i % 10 == 0, probes=5000, tables=4).collect()
    want = brute_neighbours(rows, 10, lambda i: i % 10 == 0)
    for q, near in want.items():
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [(r[2]) for r in mine] == [i for _, i in near] and [r[1] for r in mine] == pytest.approx([d for d, _ in near])
    assert {r.query_id for r in got} == {q for q in want if want[q]}
    assert ann_search(df.limit(0), lambda i: i % 10 == 0).collect() == []


def test_neighbours_recall(spark):
    got = op1_ann(spark, SMALL).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want = brute_neighbours(rows, 10, lambda i: i % 100 == 0)
    hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got)
    assert len(got) == 10 * len(want) and hits >= 0.9 * len(got)


def test_probes_come_in_order_of_estimated_success():
    t = Tables(8, 1.0, 1, 4, 10, 1)
    x = np.random.default_rng(0).standard_normal((5, 8))
    code, at = t.codes(x, 0)
    assert (t.visited(x, 0) == code[:, None]).any(1).all()  # the own bucket is the likeliest
    cost = at[0] ** 2 @ (t.moves == -1).T + (1 - at[0]) ** 2 @ (t.moves == 1).T
    assert set(t.visited(x, 0)[0]) == set((code[0] + t.moves @ t.mixer[0])[np.argsort(cost)[:10]])


def test_short_answers_are_completed_exactly(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(16)]) for i in range(200)], "vec_id long, embedding array<float>")
    got = ann_search(df, lambda i: i < 5, tables=1, hashes=8, probes=1, width=0.05).collect()
    assert len(got) == 50


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = op4_language_id(spark, SMALL).join(docs, "doc_id").filter("held_out")
    n, right = got.count(), got.filter("lang_pred = lang").count()
    assert n > 150 and right >= 0.97 * n


def test_language_of_odd_texts(spark, odd, none):
    got = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in language_id(odd, F.lit(True)).collect()}
    by = {d: p for d, p, _ in got}
    assert by[1] == by[2] == by[3] == "und" and by[16] != "und" and all(0 <= s <= 1 for *_, s in got)
    kept = language_id(odd, F.lit(True), keep_rejected=True).collect()
    assert all(r.lang_pred != "und" or r.score == 0 for r in kept) and all(r.rejected for r in kept if r.score == 0)
    assert language_id(none, F.lit(True)).collect() == []
    assert {r.lang_pred for r in language_id(odd, F.lit(False)).collect()} == {"und"}
    digits = documents(spark, [(1, "123 ... 45", "en", "a"), (2, "éa", "fr", "a"), (3, "plain words here", "en", "a")])
    assert {r.doc_id: r.lang_pred for r in language_id(digits, F.lit(True)).collect()} == {1: "und", 2: "fr", 3: "en"}
    assert {r.lang_pred for r in language_id(digits, F.lit(True), reject_above=-1.0).collect()} == {"und"}


def test_a_cut_off_rejects_the_farther_texts_only(spark):
    docs = documents(spark, [(i, prose(i, 20), "en", "a") for i in range(20)] + [(100 + i, f"zq{i} xw vv", None, "b") for i in range(10)])
    free = {r.doc_id: r.distance for r in language_id(docs, F.lit(True)).collect()}
    cut = (max(free[i] for i in range(20)) + min(free[100 + i] for i in range(10))) / 2
    got = {r.doc_id: r.lang_pred for r in language_id(docs, F.lit(True), reject_above=cut).collect()}
    assert got == {i: "und" if i >= 100 else "en" for i in free}


def test_languages_against_plain_loops(spark):
    """The nearest centroid by dictionaries and loops, from the model's idf and centroids; the centroids by their definition."""
    texts = [(i, " ".join(["der die das und", "le la les et", "the of and to"][i % 3].split(" ")[j % 4] + str("abc"[j % 3]) for j in range(i, i + 12)), ["de", "fr", "en"][i % 3]) for i in range(60)]
    docs = documents(spark, [(i, t, lang, "s") for i, t, lang in texts] + [(99, "жук щука 漢字", None, "s")])
    model = li.fit(docs)
    counts, _ = li.ngram_counts([t for _, t, _ in texts])
    df = [sum(c[g] > 0 for c in counts) for g in range(li.DIM)]
    assert model.idf == pytest.approx([np.log((1 + 60) / (1 + n)) + 1 for n in df], rel=1e-5)

    def vector(c):
        v = {g: float(np.log1p(c[g]) * model.idf[g]) for g in range(li.DIM) if c[g]}
        length = sum(x * x for x in v.values()) ** 0.5
        return {g: x / length for g, x in v.items()}

    vectors = [vector(c) for c in counts]
    cosine = lambda v, c: sum(x * float(c[g]) for g, x in v.items())
    for lang in ("de", "fr", "en"):  # each centroid is the unit mean of the texts of its language that are nearest to it
        own = [c for c, o in zip(model.centroids, model.owner, strict=True) if o == lang]
        mine = [v for v, (_, _, x) in zip(vectors, texts, strict=True) if x == lang]
        for k, c in enumerate(own):
            members = [v for v in mine if max(range(len(own)), key=lambda j: cosine(v, own[j])) == k]
            if members:
                mean = np.zeros(li.DIM)
                for v in members:
                    for g, x in v.items():
                        mean[g] += x
                assert c == pytest.approx(mean / np.linalg.norm(mean), abs=1e-4)
    got = {r.doc_id: r for r in language_id(docs, F.lit(True)).collect()}
    for (i, _, _), v in zip(texts, vectors, strict=True):
        near = [cosine(v, c) for c in model.centroids]
        assert got[i].lang_pred == model.owner[int(np.argmax(near))] and got[i].score == pytest.approx(max(near), abs=1e-4) and not got[i].rejected
    assert got[99].rejected and got[99].lang_pred == "und"


def test_a_prediction_does_not_depend_on_its_neighbours(spark):
    a = documents(spark, [(i, t, "en", "s") for i, t in enumerate(["alpha beta", "der die das", "alpha beta"])])
    m = {r.doc_id: r.score for r in language_id(a, F.col("doc_id") < 2).collect()}
    assert m[0] == m[2]


def exact_ids(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_word_ids_are_the_tokenizers():
    texts = ["", "  \n\t ", "The quick, brown FOX! isn't 'tis it's l'été", "e\u0301te\u0301 A\u030aB İstanbul ẞ ſ ﬁ Ω", "a\u00a0b\u2003c\u200bd", "<|endoftext|> x<|startoftext|>", "中文字 テスト 한국어 🎉🎉x", "1234 5.6e-7 0x", "!!!... ''' \"\" --", "x" * 5000, "Œuvre œ ß ÿ Ÿ À-Ö ×÷ don't. we'll!"]
    random.seed(1)
    alphabet = "abcXYZ éÈñ'.,!-0 9\t\n\u0301\u00a0ß<|>中\U0001f600"
    texts += ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(400)]
    ids, offsets = WordIds(PATH)(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == exact_ids(texts)


def check_packing(got, rows, length, seqs=None):
    want = []
    for i, t, *_ in rows:
        ids = [*exact_ids([t or ""])[0], 0]
        want += [(i, p, p * length, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for p in range(-(-len(ids) // length)) for x in [ids[p * length : (p + 1) * length]]]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= length
    return by


def test_packing(spark, odd, odd_rows, none):
    by = check_packing(pack_sequences(odd, PATH, length=64).collect(), odd_rows, 64)
    total = sum(n for s in by.values() for _, n in s)
    assert len(by) <= 1.15 * total / 64 + 1
    assert pack_sequences(none, PATH).collect() == []


def test_every_capacity_holds(spark):
    rows = [(i, prose(i, 3 + i % 17), "en", "a") for i in range(300)]
    got = pack_sequences(documents(spark, rows), PATH, length=128, max_docs=3, max_attention=1500).collect()
    for s in check_packing(got, rows, 128).values():
        assert len(s) <= 3 and (sum(n * n for _, n in s) <= 1500 or len(s) == 1)
    which, _ = best_fit(np.array([5, 5, 4, 3, 3]), (10, 10, 10_000))
    assert which.max() == 1
    for rule in ("norm", "dot"):
        assert best_fit(np.full(50, 7), (10, 10, 100), rule=rule)[0].max() == 49


def test_nnpu_finds_the_marked_feature():
    rng = np.random.default_rng(0)
    rows = [np.array([0, *rng.integers(1, 40, 6)]) for _ in range(60)] + [np.array(([0] if i % 10 == 0 else []) + list(rng.integers(1, 40, 6))) for i in range(600)]
    w, bias = train_nnpu(rows, np.array([1] * 60 + [0] * 600), 40, 0.1)
    assert w[0] > 2 * np.abs(w[1:]).max() and bias < 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    tp = sum(r.predicted and r.toxic for r in got)
    assert tp >= 0.75 * sum(r.toxic for r in got) and tp >= 0.85 * sum(r.predicted for r in got)


def test_toxicity_of_odd_texts(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(10, 1), (11, 1), (12, 1), (200, 0), (201, 0), (201, None), (None, 1), (202, 0)], "doc_id long, toxic int")
    got = toxicity(odd, labels, F.lit(True)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity(none, labels, F.lit(True)).collect() == []
    quiet = toxicity(odd, labels.limit(0), F.lit(True)).collect()
    assert max(r.score for r in quiet) < 1e-9
    left = drop_toxic(odd, labels, F.lit(True))
    assert left.columns == odd.columns and left.count() == sum(r.score < 0.3 for r in got)


@pytest.mark.parametrize(("prior", "marked"), [(0.02, 0.05), (0.2, 0.05), (0.25, 0.05), (1 / 3, 0.07)])
def test_telling_features_at_any_share_of_toxic_texts(spark, prior, marked):
    rng = np.random.default_rng(5)
    positive = np.repeat([1, 0], [3000, 9000])
    toxic = (positive == 1) | (rng.random(12000) < prior)
    # 0: in a small part of the toxic texts and in no other; 1: twice as frequent in toxic texts; the others in all texts alike
    share = lambda y: np.array([marked if y else 0.0, 0.2 if y else 0.1, *np.geomspace(0.001, 0.5, 50)])
    has = np.array([rng.random(52) < share(y) for y in toxic])
    counts = [(f, int(has[positive == 1, f].sum()), int(has[positive == 0, f].sum())) for f in range(52)]
    df = spark.createDataFrame(counts, "f int, n1 long, n0 long")
    found = df.filter(evidence(F.col("n1"), F.col("n0"), 3000, 9000) > least_evidence(prior)).collect()
    assert [r.f for r in found] == [0]


def test_toxicity_against_plain_loops(spark):
    """Features, their choice, the training and the scores once more, by sets and loops, from the same sample (all rows)."""
    bad = ["blarg fool", "you blarg", "zork off blarg", "a zork thing"]
    rows = [(i, f"{prose(i, 12)} {bad[i % 4]}" if i % 5 == 0 else prose(i, 14), "en", "a") for i in range(400)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, *_ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity(docs, labels, F.lit(True)).collect()}
    import glossa.llm.toxicity as tox

    edge = tox.EDGES
    words_of = lambda t: {w.strip(edge).lower() for w in t.lower().split()}
    features = {i: [f for w in words_of(t) for f in (w, "4" + w[:4], "5" + w[:5])] for i, t, *_ in rows}
    positives, unlabelled = [i for i, *_ in rows if i % 5 == 0], [i for i, *_ in rows]
    n1, n0 = ({} for _ in range(2))
    for ids, n in ((positives, n1), (unlabelled, n0)):
        for i in ids:
            for f in set(features[i]):
                n[f] = n.get(f, 0) + 1
    prior = len(positives) / len(rows)
    sure = lambda f: np.log((n1[f] + 0.5) / (len(positives) + 1) / ((n0.get(f, 0) + 0.5) / (len(unlabelled) + 1))) - 2 * np.sqrt(1 / (n1[f] + 0.5) + 1 / (n0.get(f, 0) + 0.5))
    chosen = sorted(f for f in n1 if n1[f] >= 2 and sure(f) > min(np.log(4), -0.63 * np.log(prior)))
    at = {f: k for k, f in enumerate(chosen)}
    lists = [np.array([at[f] for f in features[i] if f in at], np.int64) for ids in (positives, unlabelled) for i in ids]
    w, bias = train_nnpu(lists, np.repeat([1, 0], [len(positives), len(unlabelled)]), len(chosen), prior)
    for i, *_ in rows:
        z = bias + sum(w[at[f]] for f in features[i] if f in at)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
    assert bias <= np.log(prior / (1 - prior)) + 1e-9


@pytest.mark.parametrize("hot", ["copies", "near copies", "other texts"])
def test_toxicity_with_a_third_of_the_rows_toxic(spark, hot):
    marks = ["blarg", "frumious", "snark", "jabber"]
    rows = [(i, prose(i, 30) + (f" blarg " + prose(i + 7, 9) if i % 20 < 2 else ""), "en", "a") for i in range(2400)]
    texts = {"copies": lambda i: "zork and snark " + prose(3, 30), "near copies": lambda i: f"zork and snark {prose(3, 30)} {prose(i, 2)}", "other texts": lambda i: f"{prose(i + 31, 20)} {marks[i % 4]} {prose(i, 10)}"}
    rows += [(5000 + i, texts[hot](i), "en", "hot") for i in range(1200)]
    docs = documents(spark, rows)
    bad = {i: int(i >= 5000 or i % 20 < 2) for i, *_ in rows}
    labels = spark.createDataFrame(list(bad.items()), "doc_id long, toxic int")
    held = F.col("doc_id") % 3 == 1
    got = toxicity(docs, labels, ~held).filter(held).collect()
    found = {r.doc_id for r in got if r.score >= 0.3}
    want = {r.doc_id for r in got if bad[r.doc_id]}
    assert len(found & want) >= 0.9 * len(want) and len(found - want) <= 0.1 * len(want)


def test_hot_buckets_are_cut_and_rows_are_not_copied_per_query(spark, monkeypatch):
    from glossa.llm import ann

    rng = np.random.default_rng(8)
    same = [float(x) for x in rng.standard_normal(6)]
    rows = [(i, same if i % 3 else [float(x) for x in rng.standard_normal(6)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "BUCKET_ROWS", 40)
    monkeypatch.setattr(ann, "QUERY_BATCH", 7)
    got = ann_search(df, lambda i: i % 30 == 0, probes=6561).collect()
    want = brute_neighbours(rows, 10, lambda i: i % 30 == 0)
    assert {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in want} == {q: [i for _, i in near] for q, near in want.items()}
    sent = []
    real = ann._sent
    monkeypatch.setattr(ann, "_sent", lambda batch, row, cell, n, asks: sent.append((asks, len(real(batch, row, cell, n, asks)))) or real(batch, row, cell, n, asks))
    x = ann._clean(df, "vec_id", "embedding").toArrow().combine_chunks().to_batches()[0]
    f = ann.Tables(6, 1.5, ann.TABLES, ann.HASHES, 100, 7)
    v = ann._matrix(x.column("v"))
    cell = np.concatenate([f.buckets(f.codes(v, t)[0], t) for t in range(ann.TABLES)])
    out = ann._sent(x, np.tile(np.arange(len(v)), ann.TABLES), cell, 1 << 20, False)
    assert sent == [(False, len(out))] and len(out) <= ann.TABLES * len(rows)
