from __future__ import annotations

import pytest

#: Names that the operators use inside; as extra input columns they must not matter.
CLASHING = ["body", "key", "n", "h", "uid", "pos", "chunks", "batch", "token", "p", "score", "raw", "drop", "fp", "size", "copies", "q", "rank", "held_out", "g", "u", "tokens", "kept", "__key", "__rows", "__id", "__gone", "__copies", "__copy", "__sha", "__alone", "row", "digest", "gone_id", "gone_sha", "gone_key", "alone", "copy", "numbered", "id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def documents(spark, rows):
    """Documents (doc_id, text, lang, source) with clashing extra columns."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), *("x" for _ in CLASHING)) for i, t, lang, src in rows], SCHEMA)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    out = []
    for _ in range(n):
        seed = (seed * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[seed // 65536 % len(WORDS)])
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, one source and one text with a third of all rows."""
    base = prose(5, 120)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (None, "no id at all here", "en", None), (None, None, None, None)]
    rows += [(10, base, "en", "a"), (11, base, "en", "a"), (11, base, "en", "a"), (12, base.upper(), "de", "b"), (13, base + "\n", None, "b")]
    rows += [(14, base + " tail words differ", "en", "b"), (15, "x" * 100_000, "fr", "c"), (16, prose(9, 20_000), "fr", "c")]
    rows += [(17, "Ünïcödé ÉCOLE\nThe same line as in others, long enough\n\nÉa", "fr", None), (18, "the same LINE as in others, long enough \nother", "fr", "c")]
    rows += [(19, "\tThe same line as in others, long enough\r\nThe same line as in others, long enough", "fr", "c"), (20, "one two", "en", "d"), (21, "ONE two", "en", "d")]
    rows += [(100 + i, "hot copy of one text, " * 5, "en", "hot") for i in range(20)]
    rows += [(200 + i, prose(i, 40 + i), "en", "hot") for i in range(15)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return documents(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])
