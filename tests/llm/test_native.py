"""Line dedup, exact dedup, URL filters and mixing against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossa.llm.exact_dedup import chunks, drop_copies, exact_dedup
from glossa.llm.line_dedup import line_dedup
from glossa.llm.mixing import mix, mixed
from glossa.llm.native_queries import URL_RULES
from glossa.llm.url_filter import bloom_filter, listed, url_filter
from pyspark.sql import functions as F
from tests.llm.conftest import documents, prose

SPACE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows, least=20, docs=3):
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            k = line.translate(LOW).strip(SPACE)
            if len(k) >= least and i is not None:
                holders[k].add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(holders.get(x.translate(LOW).strip(SPACE), ())) < docs or max(holders[x.translate(LOW).strip(SPACE)]) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return Counter(out)


def test_lines(odd, odd_rows, none):
    assert Counter(map(tuple, line_dedup(odd).collect())) == brute_lines(odd_rows)
    assert line_dedup(none).collect() == []


def test_exact(odd, odd_rows, none):
    texts = defaultdict(list)
    for i, t, *_ in odd_rows:
        texts[t or ""].append(i)
    got = exact_dedup(odd).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        group = next(v for k, v in texts.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256 and r.doc_id in v)
        assert r.group_size == len(group)
        assert r.keep_id == max((i for i in group if i is not None), default=None)
    assert sum(r.kept for r in got) == len(texts)
    assert exact_dedup(none).collect() == []


def test_copies_go_and_columns_stay(odd, odd_rows):
    left = drop_copies(odd)
    assert left.columns == odd.columns
    assert Counter((r.text or "") for r in left.collect()) == Counter({t or "": 1 for _, t, *_ in odd_rows})


def test_chunks_join_to_the_text_and_follow_content(spark):
    text = prose(3, 4000)
    df = spark.createDataFrame([(text,), ("inserted " + text,), ("",), ("y" * 9000,)], "t string")
    a, b, c, d = (r[0] for r in df.select(chunks(F.col("t"))).collect())
    assert ["".join(x) for x in (a, b, c, d)] == [text, "inserted " + text, "", "y" * 9000]
    assert len(set(a) & set(b)) >= len(a) - 6 and max(map(len, a + d)) <= 4096


def test_identifiers_that_clash_are_told_apart(spark, monkeypatch):
    from glossa.llm import exact_dedup as m

    real = m.F.xxhash64
    monkeypatch.setattr(m.F, "xxhash64", lambda *c: real(F.lit("apart"), "sha") if len(c) == 2 else (F.lit(7).cast("long") if not isinstance(c[0], str) else real(*c)))
    df = documents(spark, [(1, "a", "en", "s"), (2, "b", "en", "s"), (3, "a", "en", "s")])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(df).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True)}


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:n].translate(LOW), rest[n:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h), len(p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits)[2:] if fits else (None, "allow")
    return host, path, rule, verdict


URLS = [None, "", "nothing", "http://Example.COM/en/x?q#f", "https://www.example.com/en/", "http://a.b.net/es/1", "http://net/fr/", "http://x.net/de/", "http://com", "http://com/", "ftp://xcom/a", "http://a..com/y://z", "://", "http://h?x/en/", "a://b://c.net/es/"]


def test_urls(spark):
    rows = [(i, u, None, "k") for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter(df, listed(spark, URL_RULES)).collect()}
    assert got == {i: brute_url(u) for i, u, *_ in rows}
    assert url_filter(df.limit(0), listed(spark, URL_RULES)).count() == 0
    assert {r.verdict for r in url_filter(df, listed(spark, [])).collect()} == {"allow"}


def test_bloom_filter_passes_every_key_and_few_others(spark):
    from glossa.llm.url_filter import _block, _mask

    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks, n = bloom_filter(keys, "key", 2000)
    ask = keys.unionByName(spark.range(20000).select(F.concat(F.lit("z"), "id").alias("key")))
    ask = ask.withColumn("block", _block(F.col("key"), n)).withColumn("m", _mask(F.col("key")))
    hits = ask.join(blocks, "block").filter(F.col("m").bitwiseAND(F.col("bits")) == F.col("m")).select(F.substring("key", 1, 1).alias("c")).groupBy("c").count()
    hits = {r.c: r["count"] for r in hits.collect()}
    assert hits["k"] == 2000 and hits.get("z", 0) < 2000


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix(odd, odd_rows, none):
    got = mix(odd).collect()
    assert len(got) == len(odd_rows)
    sizes = Counter()
    for _, t, _, s in odd_rows:
        sizes[s] += len([w for w in (t or "").translate(str.maketrans(SPACE, " " * 6)).split(" ") if w])
    want, taken, largest = brute_targets(sizes), Counter(), Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    assert Counter(map(tuple, mix(odd).collect())) == Counter(map(tuple, got))
    assert mix(none).collect() == []


def test_mix_prefers_likelier_documents(spark):
    rows = [(i, "w " * 10, "en", "a" if i < 400 else "b") for i in range(800)]
    df = documents(spark, rows).withColumn("x", (F.col("doc_id") % 2 * 9 + 1).cast("double"))
    got = [r for r in mix(df, weights=(1, 3), inclusion="x").collect() if r.source == "a"]
    odd_taken, even = sum(r.copies for r in got if r.doc_id % 2), sum(r.copies for r in got if not r.doc_id % 2)
    assert odd_taken > 3 * even and sum(r.taken for r in got) == pytest.approx(got[0].target, abs=10)


def test_rows_that_tie_share_the_target(spark):
    rows = [(None if i % 4 == 0 else i, "w " * 10, "en", "a" if i < 800 else "b") for i in range(1600)]
    rows += [(5000, "v " * 7, "en", "c")] * 500 + [(6000 + i, "v " * 7, "en", "c") for i in range(10)]
    df = documents(spark, rows)
    taken, target = Counter(), {}
    for r in mix(df, weights=(1, 2, 1)).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 5 for s in target)
    out = Counter()
    for r in mixed(df, weights=(1, 2, 1)).collect():
        out[r.source] += len(r.text.split())
    assert out == taken


def test_empty_tables_stay_empty(none):
    for f in (mixed, drop_copies):
        out = f(none)
        assert out.columns == none.columns and out.collect() == []


def test_long_hosts_and_many_path_lengths(spark):
    long = ".".join(["a"] * 100_000)
    rows = [(1, f"http://{long}.net/es/x"), (2, "http://x.y/" + "p" * 90), (3, "http://x.y/" + "p" * 3)]
    entries = [("block", "net", "/es/")] + [("block" if i % 2 else "allow", "x.y", "/" + "p" * i) for i in range(1, 100)]
    got = {r.page_id: (r.verdict, r.rule) for r in url_filter(spark.createDataFrame(rows, "page_id long, url string"), listed(spark, entries)).collect()}
    assert got == {1: ("block", "net/es/"), 2: ("allow", "x.y/" + "p" * 90), 3: ("block", "x.y/ppp")}


def test_mixed_rows(odd):
    out = mixed(odd)
    assert out.columns == odd.columns
    assert sum(r.taken for r in mix(odd).collect()) == sum(len([w for w in r.text.translate(str.maketrans(SPACE, " " * 6)).split(" ") if w]) for r in out.collect())


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=2), st.integers(1, 10_000), min_size=1, max_size=9))
def test_targets_share_everything(sizes):
    want = brute_targets(sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
