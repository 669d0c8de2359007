"""Extractors against plain loops, on a small golden set and on random strings."""

from __future__ import annotations

import random
import re

import pytest

from glossa.operators import extract
from glossa.operators.evaluate import exact_pair, exact_span, prf
from glossa.operators.extract import lexical_resource, nested_parenthetical, parenthetical, reverse_order, schwartz_hearst, table_rows
from glossa.plans.q_extract import QUERIES

WORD = re.compile(r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*")
SF = re.compile(r"[A-Za-z][A-Za-z0-9-]*\Z")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def spans(df):
    return sorted((r.doc_id, r.ss, r.se, r.ls, r.le) for r in df.collect())


def loop_definitions(text):
    """Largest word start from which the short form's characters follow in order, tried one by one."""
    for m in re.finditer(r"\(([A-Za-z][A-Za-z0-9-]*)\)", text):
        sf = m[1]
        words = list(WORD.finditer(text[: m.start()]))[-min(len(sf) + 5, 2 * len(sf)) :]
        if len(sf) < 2 or not words:
            continue
        start, end = words[0].start(), words[-1].end()
        want = [c for c in sf.lower() if c.isalnum()]
        for p in sorted((start + r.start() for r in re.finditer("[A-Za-z0-9]+", text[start:end])), reverse=True):
            rest, at = text[p:end].lower(), -1
            if rest[0] != want[0]:
                continue
            for c in want:
                at = rest.find(c, at + 1)
                if at < 0:
                    break
            if at >= 0:
                yield m.start() + 1, m.end() - 1, p, end
                break


def loop_candidates(text):
    for m in re.finditer(r"\(([^()]*)\)", text):
        sf = m[1].strip()
        words = list(WORD.finditer(text[: m.start()]))[-10:]
        if SF.match(sf) and 2 <= len(sf) <= 30 and words:
            ss = m.start() + 1 + len(m[1]) - len(m[1].lstrip())
            yield from ((ss, ss + len(sf), w.start(), words[-1].end()) for w in words)


def loop_nested(text):
    depth = 0
    for i, c in enumerate(text):
        depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
        close = text.find(")", i + 1)
        if c == "(" and depth >= 2 and close >= 0 and re.fullmatch("[A-Za-z][A-Za-z0-9-]{1,29}", text[i + 1 : close].strip()):
            words = list(WORD.finditer(text[:i]))[-12:]
            if words:
                yield i + 1, close, words[0].start(), words[-1].end()


def loop_reverse(text):
    for m in re.finditer(r"\(([^()]*)\)", text):
        words = list(WORD.finditer(text[m.end() : m.end() + 160]))[:12]
        if re.fullmatch("[A-Za-z][A-Za-z0-9-]{1,29}", m[1].strip()) and words:
            yield m.start() + 1, m.end() - 1, m.end() + words[0].start(), m.end() + words[-1].end()


def random_texts(n, seed=7):
    rng = random.Random(seed)
    bits = ["alpha", "beta-carotene", "the", "of", "O'Neil", "AB", "(AB)", "(a b)", "( ab )", "(", ")", "((AC)", "(bc-1)", "é", "αβ", "-", ",", "abc", "x1", "(OB)", "\n", "\t"]
    return [rng.choice(["", " "]).join(rng.choice(bits) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(0, 18))) for _ in range(n)]


@pytest.mark.parametrize(("operator", "loop"), [(schwartz_hearst, loop_definitions), (parenthetical, loop_candidates), (nested_parenthetical, loop_nested), (reverse_order, loop_reverse)])
def test_random_texts(spark, operator, loop):
    texts = random_texts(1200)
    assert spans(operator(frame(spark, texts))) == sorted((i, *s) for i, t in enumerate(texts) for s in loop(t))


def test_null_and_empty_texts_give_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "("), (4, ")("), (5, "()")], "doc_id long, text string")
    for op in (schwartz_hearst, parenthetical, nested_parenthetical, reverse_order, table_rows):
        assert op(df).collect() == []
        assert op(df.limit(0)).collect() == []


GOLD = {
    "Patients had acute renal failure (ARF) at entry.": [("ARF", "acute renal failure")],
    "The α value (n = 3) was low.": [],
    "Both tumor necrosis factor (TNF) and body mass index (BMI) rose.": [("TNF", "tumor necrosis factor"), ("BMI", "body mass index")],
    "We used nested (polymerase chain reaction (PCR)) assays.": [("PCR", "polymerase chain reaction")],
    "ICU (intensive care unit) stays were short.": [("ICU", "intensive care unit")],
    "In the blood pressure group (BPG), nothing; blood pressure (BP).": [("BPG", "blood pressure group")],
}


def test_golden_metrics(spark):
    texts = list(GOLD)
    gold = [(i, t.index(sf), t.index(sf) + len(sf), t.index(lf), t.index(lf) + len(lf)) for i, t in enumerate(texts) for sf, lf in GOLD[t] if lf in t]
    gold += [(5, texts[5].index("(BP)") + 1, texts[5].index("(BP)") + 3, 0, 5)]
    g = spark.createDataFrame(gold, "doc_id long, ss long, se long, ls long, le long")
    p = schwartz_hearst(frame(spark, texts))
    r = prf(exact_pair(g, p)).first()
    assert (r.tp, r.fp, r.fn) == (5, 1, 2) and (r.precision, r.recall) == (0.833333, 0.714286)
    by = {x.side: (x.tp, x.fp, x.fn) for x in prf(exact_span(g, p), ["side"]).collect()}
    assert by == {"short": (6, 0, 1), "long": (5, 1, 2)}


def test_lexicon_pairs_must_be_near(spark):
    lex = spark.createDataFrame([("AB", "alpha beta", "ab", "alpha beta", 3)], "sf_raw string, lf_raw string, sf_key string, lf_key string, n long")
    text = "AB is alpha beta" + " x" * 200 + " AB"
    assert spans(lexical_resource(frame(spark, [text, "alpha beta"]), lex)) == [(0, 0, 2, 6, 16)]


def test_lexicon_broadcasts_nothing_per_document(spark, monkeypatch):
    """What is broadcast is bounded by the lexicon's short forms, however many texts have hits."""
    sent = []
    monkeypatch.setattr(extract.F, "broadcast", lambda df, real=extract.F.broadcast: sent.append(df.count()) or real(df))
    lex = spark.createDataFrame([("ab", "AB", "alpha beta"), ("ab", "AB", "a big one")], "sf_key string, sf_raw string, lf_raw string")
    assert len(spans(lexical_resource(frame(spark, ["AB is alpha beta"] * 40), lex))) == 40
    assert max(sent) <= 2


@pytest.mark.parametrize("most", [100_000, 0])
def test_lexicon_against_brute_force(spark, monkeypatch, most):
    """Forms that overlap themselves, of one word, of odd characters, in and out of the window, tokens in two cases; keys broadcast and shuffled."""
    monkeypatch.setattr(extract, "BROADCAST_ROWS", most)
    lex = [("ab", "AB", "no no no"), ("ab", "AB", "a"), ("ab", "Ab", "]x"), ("ab", "AB", "bé b]"), ("ab", "AB", "no  "), ("no", "no", "AB no"), ("ab", "AB", "😀 no"), ("ab", "AB", "o no no no no no b"), ("ab", "", "no"), ("ab", "AB", "")]
    rng = random.Random(5)
    texts = ["".join(rng.choice(["no ", "AB ", "ab ", "Ab-", "a", "]x", "bé b] ", "😀 ", "no  ", "\n", "zzzz "]) for _ in range(rng.choice([3, 30, 200]))) for _ in range(60)]
    texts += ["", "AB " + "no " * 200, "no " * 90 + "AB", "AB " + "z" * 236 + " no no no", "AB " + "z" * 237 + " no no no"]
    at = lambda text, x: [m.start() for m in re.finditer(re.escape(x), text)] if x else []
    want = [
        (i, ss, ss + len(sf), ls, ls + len(lf))
        for i, text in enumerate(texts) for token in set(re.findall("[A-Za-z][A-Za-z0-9-]{1,29}", text)) for key, sf, lf in lex if key == token.lower()
        for ss in at(text, sf) for ls in at(text, lf) if abs(ls - ss) <= 240
    ]
    assert spans(lexical_resource(frame(spark, texts), spark.createDataFrame(lex, "sf_key string, sf_raw string, lf_raw string"))) == sorted(want)


def test_candidates_broadcast_nothing_per_document(spark, monkeypatch, tmp_path):
    """cand_dedup over texts that all have one short form sends that form, and not a row per text."""
    sent = []
    monkeypatch.setattr(extract.F, "broadcast", lambda df, real=extract.F.broadcast: sent.append(df.count()) or real(df))
    text = " ".join(f"word{chr(97 + i)}" for i in range(14))
    spark.createDataFrame([(8 * i, text, "web", "en") for i in range(40)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["cand_dedup"](spark, str(tmp_path)).groupBy("generator").count().collect()
    assert {r.generator: r["count"] for r in found}["parenthetical"] == 320 and sent and max(sent) <= 2
