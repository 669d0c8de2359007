"""Lexicon evidence against plain loops, and the rows that its joins make."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from glossa.operators import features

ROWS = "doc_id long, ss long, se long, ls long, le long, text string, short string, long string"
LEXICON = "sf_key string, sf_raw string, lf_raw string, lf_key string, n long, source_label string"


def candidate(doc, text, ss, se, ls, le):
    return (doc, ss, se, ls, le, text, text[ss:se], text[ls:le])


def loop_evidence(rows, lexicon, context):
    met = defaultdict(list)
    for *key, text, short, long in rows:
        near = text[max(key[3] - context, 0) : key[4] + context]
        met[tuple(key)] += [(*x[1:], long, near) for x in lexicon if x[0] == short.lower()]
    out = []
    for key, found in met.items():
        sources, forms = {x[4] for x in found} - {None}, {x[2] for x in found} - {None}
        hits = [x for x in found if x[1] is not None]
        pair = any(long == raw or long.lower() == low for _, raw, low, _, _, long, _ in hits)
        out.append((*key, len(hits), len(sources), len(forms), sum(x[3] for x in found), float(pair), sum(x[6].count(x[0]) for x in hits), float(len(sources) > 1)))
    return sorted(out)


@pytest.mark.parametrize("most", [100_000, 0])
def test_lexicon_evidence_against_loops(spark, monkeypatch, most):
    """Repeated candidates, two texts under one doc_id, raw forms of several cases, a key that isn't the lower case, a form without a long form."""
    monkeypatch.setattr(features, "BROADCAST_ROWS", most)
    rng = random.Random(3)
    texts = [(i // 2, "".join(rng.choice(["AB ", "Ab ", "alpha ", "Beta ", "beta ", "cd "]) for _ in range(30))) for i in range(16)]
    rows = []
    for doc, text in texts:
        for _ in range(25):
            ss, ls = rng.randrange(0, 60), rng.randrange(0, 60)
            rows.append(candidate(doc, text, ss, ss + 2, ls, ls + rng.choice([2, 4, 5, 10])))
        ss, ls = text.lower().find("ab "), text.lower().find("beta")
        rows += [candidate(doc, text, ss, ss + 2, ls, ls + 4), candidate(doc, text, 0, 2, 3, 7)] * 2
    lexicon = [
        ("ab", "AB", "beta", "beta", 2, "x"), ("ab", "AB", "Beta", "beta", 1, "y"), ("ab", "Ab", "alpha", "other", 4, "x"), ("ab", "AB", "beta", "beta", 2, "x"),
        ("ab", "AB", None, "lone", 5, "z"), ("cd", "cd", "BETA", "beta", 7, None), ("cd", "cd", "gamma", None, 1, "x"), ("al", "AB", "b a", "b a", 3, "x"), ("be", "be", "Beta", "beta", 1, "y"),
    ]
    found = features.lexicon_evidence(spark.createDataFrame(rows, ROWS), spark.createDataFrame(lexicon, LEXICON), 20)
    found = found.select("doc_id", "ss", "se", "ls", "le", "variants", "sources", "long_forms", "total", "exact_pair", "short_nearby", "agreement")
    assert sorted(map(tuple, found.collect())) == loop_evidence(rows, lexicon, 20)


def test_candidates_do_not_meet_each_variant(spark, monkeypatch):
    """No join makes more rows than there are candidates or forms, however many long forms a short form has."""
    rows = spark.createDataFrame([candidate(i, f"AB is form {i}", 0, 2, 6, 12) for i in range(40)], ROWS)
    lexicon = spark.createDataFrame([("ab", "AB", f"form {i}", f"form {i}", 1, "x") for i in range(30)], LEXICON)
    made, frame = [], type(rows)

    def join(self, *args, real=frame.join):
        out = real(self, *args)
        made.append(out.count())
        return out

    monkeypatch.setattr(frame, "join", join)
    assert features.lexicon_evidence(rows, lexicon).filter("variants = 30").count() == 40
    assert made and max(made) <= 40
