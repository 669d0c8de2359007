"""The Jaccard join and the language model against brute force."""

from __future__ import annotations

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glossa.llm import jaccard_join as jj
from glossa.llm import lm_scoring as lm
from glossa.llm._arrays import mix64, pack, pack_sorted, parts, unpack, unpack_sorted, words
from glossa.functions.lineage import components
from glossa.llm.jaccard_join import Region, drop_similar, jaccard_join, jaccard_links
from glossa.llm.lm_scoring import _pairs, learn_weights, lm_scores
from pyspark.sql import functions as F
from tests.llm.conftest import documents, prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return WORD.findall((t or "").translate(LOW))


def sets(rows):
    out = []
    for _, t, *_ in rows:
        w = tokens(t)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(rows, num=80, den=100):
    s = sets(rows)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and den * both >= num * len(s[i] | s[j]) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for (i, *_), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return Counter((i, len(x), least.get(r) if x else i) for (i, *_), x, r in zip(rows, s, root, strict=True))


def result(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def families(n, size, seed, change):
    """Families of texts that differ in a few words each."""
    rng = np.random.default_rng(seed)
    rows, i = [], 1000
    for f in range(n):
        base = prose(f * 77 + seed, 90).split(" ")
        for _ in range(size):
            w = list(base)
            for at in rng.integers(0, len(w), rng.integers(0, change)):
                w[at] = f"new{rng.integers(0, 50)}"
            rows.append((i, " ".join(w), "en", "s"))
            i += 1
    return rows


def test_links_of_odd_texts(odd, odd_rows, none):
    assert result(jaccard_join(odd)) == brute_components(odd_rows)
    assert jaccard_join(none).collect() == []


@pytest.mark.parametrize("change", [3, 6])
def test_families(spark, change):
    rows = families(12, 14, change, change)
    assert result(jaccard_join(documents(spark, rows))) == brute_components(rows)


@pytest.mark.parametrize("region", [1500, 20])
def test_all_links_are_counted(spark, odd, odd_rows, monkeypatch, region):
    monkeypatch.setattr(jj, "REGION", region)
    for df, rows in ((odd, odd_rows), *((documents(spark, r), r) for r in [families(3, 30, 4, 6)])):
        s = sets(rows)
        want = Counter((rows[i][0], sum(j != i and bool(s[i]) and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]) for j in range(len(s)))) for i in range(len(s)))
        pairs, members = jaccard_links(df)
        assert Counter((r.doc_id, r.n_links) for r in members.collect()) == want
        assert all(r.a > r.b for r in pairs.collect())


def test_a_large_family_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(jj, "REGION", 20)
    rows = families(2, 70, 9, 5)
    assert result(jaccard_join(documents(spark, rows))) == brute_components(rows)


def test_regions_join_exactly():
    rng = np.random.default_rng(5)
    for trial in range(12):
        base = [rng.integers(0, 1 << 40, 60, np.uint64) for _ in range(3)]
        members = []
        for _ in range(120):
            x = base[rng.integers(0, 3)].copy()
            at = rng.integers(0, 60, rng.integers(0, 14))
            x[at] = rng.integers(0, 400, len(at), np.uint64)
            members.append(np.unique(x))
        size = np.array([len(m) for m in members])
        region = Region(size, members, 80, 100)
        region.join(np.arange(len(members)))
        s = [set(m.tolist()) for m in members]
        root = list(range(len(s)))
        for i in range(len(s)):
            for j in range(i):
                if 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]) and root[i] != root[j]:
                    old = root[i]
                    root = [root[j] if r == old else r for r in root]
        same = lambda r: [[a == b for b in r] for a in r]
        assert same(list(region.root)) == same(root), trial


def test_hashes_are_as_wide_for_small_inputs(odd):
    found = jj._classes_and_links(odd, "doc_id", "text", 3, 4, 5, every=False)[0].filter("tokens IS NOT NULL").collect()
    shingles = np.concatenate([np.frombuffer(r.tokens, "<u8") for r in found])
    pairs = _pairs(np.arange(50), np.array([20, 30]), mix64(np.arange(50, dtype=np.uint64)))[0]
    for hashes in (shingles, pairs):
        assert len(hashes) and (hashes & np.uint64(0xFF)).any()


def test_one_of_each_component_stays(odd, odd_rows):
    left = drop_similar(odd)
    assert left.columns == odd.columns
    want = {i for i, _, c in brute_components(odd_rows) if i is not None and i == c}
    ids = [r.doc_id for r in left.collect()]
    assert {i for i in ids if i is not None} == want and len([i for i in ids if i is not None]) == len(want) and ids.count(None) == 2


def test_rows_of_one_doc_id_are_decided_each(spark):
    one, two, three = prose(1, 40), prose(2, 40), prose(3, 40)
    # 7 has a near copy of 1's text and an unrelated text; 8 has two unrelated texts; of the near copies without an id one stays
    rows = [(1, one), (7, one + " more"), (7, two), (8, prose(4, 40)), (8, prose(5, 40)), (8, prose(5, 40)), (None, three), (None, three), (None, three + " more"), (None, one), (None, None), (None, "")]
    left = [(r.doc_id, r.text) for r in drop_similar(documents(spark, [(i, t, "en", "a") for i, t in rows])).collect()]
    assert Counter(x for x in left if x[1] not in (three, three + " more")) == Counter([(1, one), (7, two), (8, prose(4, 40)), (8, prose(5, 40)), (None, None), (None, "")])
    assert len(left) == 7


def test_components_of_a_long_path(spark):
    n = 300
    links = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).orderBy(F.rand(1))
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(1, n + 1)}


def test_blobs_round_trip():
    for v in (np.zeros(0, np.uint64), np.array([5], np.uint64), np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, np.uint64) * 2 + 1)):
        assert (unpack_sorted(pack_sorted(v)) == v).all() and (unpack(pack(v[::-1])) == v[::-1]).all()
        cuts = parts(v, 7)
        assert cuts[0] == 0 and cuts[-1] == len(v) and (np.diff(cuts) >= 0).all()


def test_words_are_split_at_ascii_space_only():
    texts = ["", " ", " a\tb\x0b\x0cc\r\nd ", "x\u00a0y\u2003z", "\n\nq", "Éa B"]
    index, offsets, unique = words(pa.array(texts))
    u = unique.to_pylist()
    assert [[u[i] for i in index[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [tokens(t) for t in texts]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 1


def test_language_model(odd, odd_rows, none):
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = lm_scores(odd, crc).collect()
    toks = [[*tokens(t), None] for _, t, *_ in odd_rows]
    count = Counter(w for (i, *_), t in zip(odd_rows, toks, strict=True) if not held(i) for w in t)
    n, v = sum(count.values()), len(count)
    want = Counter((i, held(i), len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 4)) for (i, *_), t in zip(odd_rows, toks, strict=True))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert lm_scores(none, crc).collect() == []
    assert all(r.train_tokens == 0 and math.isfinite(r.base_score) for r in lm_scores(odd, F.lit(True)).collect())


def test_scores_are_the_interpolated_probabilities(spark):
    rows = [(i, "a b a b c" if i % 2 else "a c b", "en", "s") for i in range(40)]
    got = {r.doc_id: r.score for r in lm_scores(documents(spark, rows), F.col("doc_id") == 3).collect()}
    assert all(s < 0 for s in got.values()) and got[1] == pytest.approx(got[3])
    # every distribution sums to one: the probabilities of all two-token texts over the known words are below one together
    assert 10 ** got[0] + 10 ** got[1] < 1


def test_weights_follow_the_held_out_counts():
    cell = lambda b, c2, c1: (b << 32) + ((c2 + 8192) << 16) + c1 + 8192
    w = learn_weights(np.array([cell(3, 80, 8), cell(5, -4096, 40)]), np.array([1000.0, 1000.0]))
    assert w[3, 0] > 0.9 and w[5, 1] > 0.9 and w.sum(1) == pytest.approx(np.ones(len(w)))


def brute_scores(rows, held):
    """Deleted interpolation by plain loops over tokens."""
    texts = [[None, *tokens(t), ""] for _, t, *_ in rows]
    train = [t for (i, *_), t in zip(rows, texts, strict=True) if not held(i)]
    word = Counter(w for t in train for w in t[1:])
    pair = Counter(p for t in train for p in zip(t, t[1:], strict=False))
    n, v = sum(word.values()), len(word)
    word[None] = word[""]
    group = lambda c: 0 if c <= 0 else int(math.log2(c)) + 1
    weights = {}
    held_out = []
    for t in train:
        for a, b in zip(t, t[1:], strict=False):
            context = word[a] - 1
            held_out.append((group(context), (pair[a, b] - 1) / context if context else 0.0, (word[b] - 1) / (n - 1), 1 / (v + 1)))
    for _ in range(60):
        new = {}
        for g, *p in held_out:
            w = weights.get(g, [0.4, 0.5, 0.1])
            total = sum(x * y for x, y in zip(w, p, strict=True))
            new.setdefault(g, [0.4, 0.5, 0.1])
            new[g] = [old + x * y / total for old, x, y in zip(new[g], w, p, strict=True)]
        weights = {g: [x / sum(w) for x in w] for g, w in new.items()}
    out = []
    for (i, *_), t in zip(rows, texts, strict=True):
        score = 0.0
        for a, b in zip(t, t[1:], strict=False):
            w = weights.get(group(word[a]), [0.4, 0.5, 0.1])
            score += math.log10(w[0] * (pair[a, b] / word[a] if word[a] else 0) + w[1] * word[b] / n + w[2] / (v + 1))
        out.append((i, len(t) - 1, score))
    return out


def test_scores_against_plain_loops(odd, odd_rows):
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    got = sorted([(r.doc_id, r.n_tokens, r.score) for r in lm_scores(odd, crc).collect()], key=key)
    want = sorted(brute_scores(odd_rows, held), key=key)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=0.01, abs=0.02)


def test_scans_that_differ_are_noticed_and_done_again(spark, monkeypatch):
    rows = [(i, prose(i, 20), "en", "s") for i in range(50)]
    want = {(r.doc_id, round(r.score, 6)) for r in lm_scores(documents(spark, rows), F.col("doc_id") == 3).collect()}
    real, calls = lm._assembled_batches, []

    def other(found):
        calls.append(found)
        # the first try sees rows in another order in each scan
        return real(found.orderBy(F.rand()) if len(calls) == 1 else found)

    monkeypatch.setattr(lm, "_assembled_batches", other)
    got = {(r.doc_id, round(r.score, 6)) for r in lm_scores(documents(spark, rows), F.col("doc_id") == 3).collect()}
    assert got == want


@pytest.mark.parametrize("partitions", ["4", "400"])
def test_results_do_not_depend_on_the_number_of_partitions(spark, odd, odd_rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert result(jaccard_join(odd)) == brute_components(odd_rows)
        got = sorted((r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm_scores(odd, F.col("doc_id") % 5 == 1).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted((r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm_scores(odd, F.col("doc_id") % 5 == 1).collect())


def test_cells_part_a_dense_region(spark, monkeypatch):
    monkeypatch.setattr(jj, "REGION", 24)
    monkeypatch.setattr(jj, "CELLS", 4)
    rows = families(1, 220, 11, 9) + families(1, 120, 12, 25)
    assert result(jaccard_join(documents(spark, rows))) == brute_components(rows)


def test_stages_on_an_empty_table(none):
    out = drop_similar(none)
    assert out.columns == none.columns and out.collect() == []


def test_shingles_of_pieces(monkeypatch, odd_rows):
    texts = pa.array([r[1] or "" for r in odd_rows])
    whole = jj.shingles(texts, 5)
    monkeypatch.setattr(jj, "PIECE", 300)
    for x, y in zip(whole, jj.shingles(texts, 5), strict=True):
        assert x.dtype == y.dtype and x.tolist() == y.tolist()
    assert [len(x) for x in jj.shingles(texts[:0], 5)] == [0, 0]
    monkeypatch.setattr(jj, "RUN", 7)
    n = len(texts)
    parted = jj._set_hashes(*whole, n)
    monkeypatch.undo()
    assert all((x == y).all() for x, y in zip(parted, jj._set_hashes(*whole, n), strict=True))


def test_memory_of_a_batch():
    """A batch of 4 MB takes less than 10 times its text in arrays."""
    texts = pa.array([prose(i, 330) for i in range(2200)])
    size = sum(len(t) for t in texts.to_pylist())
    assert 3.7e6 < size < jj.SLICE
    tracemalloc.start()
    try:
        value, own = jj.shingles(texts, 5)
        jj._set_hashes(value, own, len(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 10 * size, peak / size
