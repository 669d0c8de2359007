"""Queries of features and scoring, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import features as f
from glossa.operators import learn
from glossa.operators.extract import nested_parenthetical, parenthetical, reverse_order
from glossa.plans.corpus import PARENS, corpus, gold, lexicon, table
from glossa.plans.q_extract import AGAIN, JUDGED, REVERSE, sql

KEEP = ["doc_id", "ss", "se", "ls", "le"]


def candidates(s: SparkSession, d: str) -> DataFrame:
    """Candidates of the derived corpus with their texts, of three generators."""
    c = corpus(s, d)
    made = {"parenthetical": parenthetical(c), "reverse": reverse_order(c), "nested": nested_parenthetical(c)}
    rows = reduce(DataFrame.unionByName, [df.select(*KEEP, F.lit(n).alias("generator")) for n, df in made.items()])
    return f.with_texts(rows, c)


def rounded(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in df.columns if c not in keep])


def features(*make) -> object:
    return lambda s, d: rounded(f.feature_set(candidates(s, d), [m() for m in make], KEEP), KEEP)


CAND = JUDGED + ",\n" + REVERSE + ",\n" + AGAIN + r""",
cs AS (SELECT *, substr(text, ss + 1, se - ss) AS short, substr(text, ls + 1, le - ls) AS long FROM (
  SELECT doc_id, ss, se, ls, le, 'parenthetical' AS generator FROM cand UNION ALL SELECT doc_id, ss, se, ls, le, 'reverse' FROM rev UNION ALL SELECT doc_id, ss, se, ls, le, 'nested' FROM nest) JOIN (SELECT doc_id, text FROM corpus) USING (doc_id))"""
K = "doc_id, ss, se, ls, le"


def n_of(c: str, p: str) -> str:
    return f"len(regexp_extract_all({c}, '{p}'))"


def r(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE round(({a})::DOUBLE / ({b})::DOUBLE, 6) END"


def fl(c: str) -> str:
    return f"CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0 END"


def oracle(columns: dict[str, str], *more: str) -> str:
    return sql(PARENS, CAND, *more, select=f"SELECT {K}, " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in columns.items()) + " FROM cs")


def _caps() -> dict[str, str]:
    out = {}
    for c in ("short", "long"):
        le, up, lo = (n_of(c, p) for p in (r"\p{L}", r"\p{Lu}", r"\p{Ll}"))
        out |= {f"{c}_all_upper": fl(f"{le} > 0 AND {lo} = 0"), f"{c}_initial_upper": fl(rf"regexp_matches({c}, '^\p{{Lu}}')"), f"{c}_all_lower": fl(f"{le} > 0 AND {up} = 0"), f"{c}_mixed_case": fl(f"{up} > 0 AND {lo} > 0"), f"{c}_uppercase_ratio": r(up, le)}
    return out


def _digits() -> dict[str, str]:
    out = {}
    for c in ("short", "long"):
        d, p, n = n_of(c, r"\p{Nd}"), n_of(c, r"[^\p{L}\p{N}\s]"), f"length({c})"
        out |= {f"{c}_digits": d, f"{c}_digit_ratio": r(d, n), f"{c}_punctuation": p, f"{c}_punctuation_ratio": r(p, n), f"{c}_has_digit": fl(f"{d} > 0"), f"{c}_has_punctuation": fl(f"{p} > 0")}
    return out


AROUND = "lower(substr(text, greatest(least(ss, ls) - 80, 0) + 1, greatest(se, le) + 80 - greatest(least(ss, ls) - 80, 0)))"
PAREN = "substr(text, {s}, 1) = '(' AND {s} > 0 AND substr(text, {e} + 1, 1) = ')'"


def lexicon_sources(s: SparkSession, d: str) -> DataFrame:
    return lexicon(s, d).withColumn("source_label", F.when(F.col("n") > 1, "often").otherwise("once"))


WEIGHTS = {"short_over_long": -2.0, "short_all_upper": 1.5, "gap": -0.02, "short_in_parens": 0.75}


def scored(s: SparkSession, d: str) -> DataFrame:
    rows = f.feature_set(candidates(s, d), [f.lengths(), f.capitalization(), f.positions(), f.parenthetical_metadata()], KEEP)
    return rows.withColumn("score", f.linear_score(rows, WEIGHTS, 0.25))


SCORE = f"""sc AS (SELECT {K}, 1 / (1 + exp(-(0.25 + -2.0 * (length(short)::DOUBLE / length(long)) + 1.5 * {_caps()["short_all_upper"]}
  + -0.02 * greatest(0, greatest(ss, ls) - least(se, le)) + 0.75 * {fl(PAREN.format(s="ss", e="se"))}))) AS score FROM cs)"""

DATASET = r"""lb AS (SELECT c.doc_id, c.ss, c.se, c.ls, c.le, CASE WHEN g.doc_id IS NOT NULL THEN 1.0 WHEN q.quality = 0 THEN 0.0 END AS label,
  CASE WHEN g.doc_id IS NOT NULL THEN 'gold' WHEN q.quality = 0 THEN 'silver' END AS origin
  FROM cs c LEFT JOIN gold g ON c.doc_id = g.doc_id AND c.ss = g.ss AND c.se = g.se AND c.ls = g.ls AND c.le = g.le LEFT JOIN labels q ON q.doc_id = c.doc_id)"""


def labelled(s: SparkSession, d: str) -> DataFrame:
    silver = table(s, d, "labels").filter("quality = 0").select("doc_id", F.lit(0.0).alias("silver"))
    return learn.label_join(candidates(s, d).select(*KEEP), gold(s, d), silver)


QUERIES = {
    "feat_lcs": features(f.alignment),
    "feat_tokens": features(f.token_counts),
    "feat_caps": features(f.capitalization),
    "feat_digits": features(f.digits_punctuation),
    "feat_length": features(f.lengths),
    "feat_position": features(f.positions),
    "feat_cues": features(lambda: f.cues(("the", "of", "and this"))),
    "feat_paren_meta": features(f.parenthetical_metadata),
    "feat_lexicon": lambda s, d: rounded(f.lexicon_evidence(candidates(s, d), lexicon_sources(s, d)), KEEP),
    "feat_index": lambda s, d: f.candidate_index(parenthetical(corpus(s, d))),
    "label_join": labelled,
    "split_partition": lambda s, d: learn.split_counts(labelled(s, d), learn.hash_split(table(s, d, "documents").select("doc_id"), "split")),
    "threshold_select": lambda s, d: scored(s, d).filter("score >= 0.6").select(*KEEP, F.round("score", 6).alias("score")),
    "logistic_predict": lambda s, d: scored(s, d).select(*KEEP, F.round("score", 6).alias("score")),
    "logistic_fit": lambda s, d: learn.fit_frame(s, learn.logistic_fit(fit_rows(s, d), ["x1", "x2"], balanced=True)),
    "seed_derive": lambda s, d: table(s, d, "documents").select("doc_id", learn.child_seed(F.lit("42"), F.col("source")).cast("string").alias("seed")),
}


def fit_rows(s: SparkSession, d: str) -> DataFrame:
    """Quality labels with two features of the whole text."""
    docs = table(s, d, "documents").select("doc_id", (F.length("text") / 10000.0).alias("x1"), f.ratio(F.regexp_count("text", F.lit("[0-9]")), F.length("text")).alias("x2"))
    return table(s, d, "labels").join(docs, "doc_id").select("x1", "x2", F.col("quality").cast("double").alias("label"))


#: Longest common subsequences, a character of the short form per step: cell j of a row is the best of the cell above and, over the
#: characters up to j that equal the new one, the cell before it above, and one.
LCS = r"""nf AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, ss, se, ls, le, lower(replace(regexp_replace(short, '[^\p{L}\p{N}]', '', 'g'), 'İ', 'i' || chr(775))) AS a, lower(replace(regexp_replace(long, '[^\p{L}\p{N}]', '', 'g'), 'İ', 'i' || chr(775))) AS b FROM cs),
lr AS (SELECT id, 0 AS i, CASE WHEN a = '' THEN []::VARCHAR[] ELSE string_split(a, '') END AS xs, CASE WHEN b = '' THEN []::VARCHAR[] ELSE string_split(b, '') END AS ys, list_transform(CASE WHEN b = '' THEN []::VARCHAR[] ELSE string_split(b, '') END, lambda x: 0::BIGINT) AS prev FROM nf
  UNION ALL SELECT id, i + 1, xs, ys, list_transform(range(1, len(ys) + 1), lambda j: greatest(prev[j], list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN ys[k] = xs[i + 1] THEN 1 + CASE WHEN k > 1 THEN prev[k - 1] ELSE 0 END ELSE 0 END)))) FROM lr WHERE i < len(xs)),
lc AS (SELECT nf.*, coalesce(list_max(prev), 0)::DOUBLE AS n FROM lr JOIN nf USING (id) WHERE i = len(xs))"""

ORACLE_SQL = {
    "feat_lcs": sql(PARENS, CAND, LCS, select=f"SELECT {K}, n AS lcs, {r('n', 'length(a)')} AS lcs_short, {r('n', 'length(b)')} AS lcs_long, {r('length(a)', 'length(b)')} AS length_ratio, {fl('a = b')} AS equal FROM lc").replace("WITH ", "WITH RECURSIVE ", 1),
    "feat_tokens": oracle({"short_tokens": n_of("short", r"[\p{L}\p{N}_]+"), "long_tokens": n_of("long", r"[\p{L}\p{N}_]+"), "token_ratio": r(n_of("short", r"[\p{L}\p{N}_]+"), n_of("long", r"[\p{L}\p{N}_]+")), "token_difference": n_of("long", r"[\p{L}\p{N}_]+") + " - " + n_of("short", r"[\p{L}\p{N}_]+")}),
    "feat_caps": oracle(_caps()),
    "feat_digits": oracle(_digits()),
    "feat_length": oracle({"short_length": "length(short)", "long_length": "length(long)", "short_over_long": r("length(short)", "length(long)"), "long_over_short": r("length(long)", "length(short)"), "length_difference": "length(long) - length(short)", "short_is_shorter": fl("length(short) < length(long)")}),
    "feat_position": oracle({"short_first": fl("ss <= ls"), "long_first": fl("ls < ss"), "short_start": r("ss", "length(text)"), "long_start": r("ls", "length(text)"), "short_centre": r("ss + se", "2 * length(text)"), "long_centre": r("ls + le", "2 * length(text)"), "gap": "greatest(0, greatest(ss, ls) - least(se, le))"}),
    "feat_cues": oracle({f"cue_{w.replace(' ', '_')}": fl(f"contains({AROUND}, '{w}')") for w in ("the", "of", "and this")}),
    "feat_paren_meta": oracle({"from_parenthetical": fl("generator = 'parenthetical'"), "from_nested": fl("generator = 'nested'"), "from_reverse": fl("generator = 'reverse'"), "from_other": "0", "short_in_parens": fl(PAREN.format(s="ss", e="se")), "long_in_parens": fl(PAREN.format(s="ls", e="le"))}),
    "feat_lexicon": sql(
        PARENS, CAND,
        f"""ev AS (SELECT cs.doc_id, ss, se, ls, le, lf_raw, lf_key, n, CASE WHEN lf_raw IS NULL THEN NULL WHEN n > 1 THEN 'often' ELSE 'once' END AS src,
  lf_raw IS NOT NULL AND (long = lf_raw OR lower(long) = lf_key) AS pair,
  CASE WHEN lf_raw IS NULL THEN 0 ELSE len(string_split(substr(text, greatest(ls - 80, 0) + 1, le + 80 - greatest(ls - 80, 0)), sf_raw)) - 1 END AS near FROM cs LEFT JOIN lexicon ON lower(short) = sf_key)""",
        select=f"""SELECT {K}, count(lf_raw) AS variants, count(DISTINCT src) AS sources, count(DISTINCT lf_key) AS long_forms, coalesce(sum(n), 0)::BIGINT AS total,
max(CASE WHEN pair THEN 1.0::DOUBLE ELSE 0 END) AS exact_pair, sum(near)::BIGINT AS short_nearby, CASE WHEN count(DISTINCT src) > 1 THEN 1.0::DOUBLE ELSE 0 END AS agreement FROM ev GROUP BY {K}""",
    ),
    "feat_index": sql(PARENS, JUDGED, select=f"SELECT {K}, row_number() OVER (PARTITION BY doc_id ORDER BY ss, se, ls, le) - 1 AS candidate_index FROM cand"),
    "label_join": sql(PARENS, CAND, DATASET, select=f"SELECT {K}, label::DOUBLE AS label, origin FROM lb WHERE label IS NOT NULL"),
    "split_partition": sql(
        PARENS, CAND, DATASET,
        """sp AS (SELECT doc_id, ('0x' || substr(sha256('split:' || doc_id::VARCHAR), 1, 8))::BIGINT % 10 AS b FROM documents)""",
        select="SELECT CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'dev' ELSE 'test' END AS split, origin, count(*) AS n FROM lb JOIN sp USING (doc_id) WHERE label IS NOT NULL GROUP BY ALL",
    ),
    "threshold_select": sql(PARENS, CAND, SCORE, select=f"SELECT {K}, round(score, 6) AS score FROM sc WHERE score >= 0.6"),
    "logistic_predict": sql(PARENS, CAND, SCORE, select=f"SELECT {K}, round(score, 6) AS score FROM sc"),
    "logistic_fit": """WITH RECURSIVE f0 AS (SELECT length(text) / 10000.0::DOUBLE AS x1, CASE WHEN length(text) = 0 THEN 0 ELSE len(regexp_extract_all(text, '[0-9]'))::DOUBLE / length(text) END AS x2, quality::DOUBLE AS label FROM labels JOIN documents USING (doc_id)),
fr AS MATERIALIZED (SELECT x1, x2, label, count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY label)) AS w FROM f0),
g AS (SELECT 0 AS k, 0.0::DOUBLE AS b, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 UNION ALL
  SELECT k + 1, b - 0.1 * avg((p - label) * w), w1 - 0.1 * avg((p - label) * w * x1), w2 - 0.1 * avg((p - label) * w * x2) FROM (SELECT fr.*, g.*, 1 / (1 + exp(-(b + w1 * x1 + w2 * x2))) AS p FROM fr CROSS JOIN g WHERE k < 500) GROUP BY k, b, w1, w2)
SELECT unnest(['bias', 'x1', 'x2']) AS name, unnest([round(b, 6), round(w1, 6), round(w2, 6)]) AS weight FROM g WHERE k = 500""",
    "seed_derive": "SELECT doc_id, ('0x' || substr(sha256('42:' || source), 1, 16))::UBIGINT::VARCHAR AS seed FROM documents",
}
