"""Queries of the extractors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators import extract as x
from glossa.operators.evaluate import exact_pair, prf
from glossa.plans.corpus import CORPUS, PARENS, WINDOW, corpus, gold, lexicon

SH = r"""q AS (SELECT *, open AS before, least(length(content) + 5, 2 * length(content)) AS most FROM parens
  WHERE regexp_full_match(content, '[A-Za-z][A-Za-z0-9-]*') AND length(content) >= 2),""" + WINDOW + r""",
sh0 AS (SELECT *, lower(replace(win, 'İ', 'ı')) AS low, concat('(?s)^((?:.*[^a-z0-9])?)', array_to_string(string_split(lower(regexp_replace(content, '[^A-Za-z0-9]', '', 'g')), ''), '.*')) AS pat FROM lw),
sh1 AS (SELECT *, length(regexp_extract(low, pat, 1)) AS skip FROM sh0 WHERE regexp_matches(low, pat)),
sh AS (SELECT doc_id, open + 1 AS ss, open + 1 + length(content) AS se, wstart + skip AS ls, wend AS le, content AS sf, substr(win, skip + 1) AS lf FROM sh1)"""

JUDGED = r"""q AS (SELECT *, open AS before, 10 AS most, regexp_replace(content, '^\s+|\s+$', '', 'g') AS s FROM parens),""" + WINDOW + r""",
judged AS (SELECT q.doc_id, q.open, q.open + 1 + length(regexp_extract(q.content, '^\s*')) AS ss, length(q.s) AS n, lw.wstart, lw.wend, lw.win,
  CASE WHEN NOT regexp_full_match(q.s, '[A-Za-z][A-Za-z0-9-]*') THEN 'short_form_invalid' WHEN length(q.s) < 2 THEN 'short_form_too_short'
  WHEN length(q.s) > 30 THEN 'short_form_too_long' WHEN lw.win IS NULL THEN 'missing_long_form_context' END AS code
  FROM q LEFT JOIN lw ON q.doc_id = lw.doc_id AND q.open = lw.open),
par_words AS (SELECT doc_id, ss, ss + n AS se, wend, string_split(regexp_replace(win, '([A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*)', chr(1) || '\1', 'g'), chr(1))[2:] AS ps
  FROM judged WHERE code IS NULL),
cand AS (SELECT doc_id, ss, se, (wend - list_sum(list_transform(ps[len(ps) - i + 1:], lambda p: length(p))))::BIGINT AS ls, wend AS le
  FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM par_words))"""

REVERSE = r"""rv AS (SELECT *, open + 1 + length(content) AS cl FROM parens WHERE regexp_full_match(regexp_replace(content, '^\s+|\s+$', '', 'g'), '[A-Za-z][A-Za-z0-9-]{1,29}')),
rv1 AS (SELECT *, substr(text, cl + 2, 160) AS after FROM rv),
rv2 AS (SELECT *, length(regexp_extract(after, '^[^A-Za-z0-9]*')) AS lead,
  length(regexp_extract(after, '^([^A-Za-z0-9]*)([A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*(?:[^A-Za-z0-9]+[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*){0,11})', 2)) AS n FROM rv1),
rev AS (SELECT doc_id, open + 1 AS ss, cl AS se, cl + 1 + lead AS ls, cl + 1 + lead + n AS le FROM rv2 WHERE n > 0)"""

NESTED = r"""nc AS (SELECT doc_id, text, string_split(text, '') AS cs FROM corpus WHERE contains(text, '(')),
ne AS (SELECT doc_id, text, unnest(range(1, len(cs) + 1)) AS i, unnest(cs) AS c FROM nc),
nd AS (SELECT doc_id, text, i, c, sum(CASE c WHEN '(' THEN 1 ELSE -1 END) OVER w AS s FROM ne WHERE c IN ('(', ')') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
nm AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY i)) AS depth FROM nd),
nq AS (SELECT doc_id, text, i - 1 AS open, substr(text, i + 1) AS after FROM nm WHERE c = '(' AND depth >= 2),
q AS (SELECT *, string_split(after, ')')[1] AS content, open AS before, 12 AS most FROM nq WHERE contains(after, ')')),""" + WINDOW + r""",
nest AS (SELECT doc_id, open + 1 AS ss, open + 1 + length(content) AS se, wstart AS ls, wend AS le FROM lw
  WHERE regexp_full_match(regexp_replace(content, '^\s+|\s+$', '', 'g'), '[A-Za-z][A-Za-z0-9-]{1,29}'))"""

#: The same beside another use of its helper relations.
AGAIN = NESTED.replace("\nq AS (", "\nq2 AS (").replace("FROM q)", "FROM q2)").replace("lw0", "lv0").replace("lw1", "lv1").replace("lw AS", "lv AS").replace("FROM lw\n", "FROM lv\n")

#: Offsets of all non-overlapping occurrences; needs text and needle expressions.
OCC = "list_transform(range(1, len(string_split({t}, {n}))), lambda i: (list_sum(list_transform(string_split({t}, {n})[1:i], lambda p: length(p))) + (i - 1) * length({n}))::BIGINT)"

TABLE = rf"""tl AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM corpus WHERE contains(text, chr(9))),
tc AS (SELECT doc_id, text, list_transform(string_split(line, chr(9)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS cells FROM tl WHERE contains(line, chr(9))),
tp AS (SELECT doc_id, text, cells, unnest(range(1, len(cells), 2)) AS i FROM tc WHERE len(cells) % 2 = 0),
tq AS (SELECT doc_id, text, cells[i] AS a, cells[i + 1] AS b, regexp_full_match(cells[i], '[A-Za-zΑ-Ωα-ω][A-Za-z0-9Α-Ωα-ω-]{{1,29}}') AS fa,
  regexp_full_match(cells[i + 1], '[A-Za-zΑ-Ωα-ω][A-Za-z0-9Α-Ωα-ω-]{{1,29}}') AS fb FROM tp),
tr AS (SELECT doc_id, text, CASE WHEN fa THEN a ELSE b END AS sf, CASE WHEN fa THEN b ELSE a END AS lf FROM tq
  WHERE fa <> fb AND length(a) BETWEEN 1 AND 500 AND length(b) BETWEEN 1 AND 500),
ts AS (SELECT *, {OCC.format(t="text", n="sf")} AS so, {OCC.format(t="text", n="lf")} AS lo FROM tr),
tab AS (SELECT doc_id, so[1] AS ss, so[1] + length(sf) AS se, lo[1] AS ls, lo[1] + length(lf) AS le FROM ts WHERE len(so) = 1 AND len(lo) = 1)"""

LEXICAL = rf"""lx0 AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]{{1,29}}')) AS token FROM corpus),
lx1 AS (SELECT c.doc_id, text, sf_raw, lf_raw FROM lx0 JOIN lexicon ON lower(token) = sf_key JOIN corpus c ON c.doc_id = lx0.doc_id WHERE contains(text, lf_raw)),
lx2 AS (SELECT doc_id, sf_raw, lf_raw, unnest({OCC.format(t="text", n="sf_raw")}) AS ss, {OCC.format(t="text", n="lf_raw")} AS lo FROM lx1),
lx3 AS (SELECT doc_id, sf_raw, lf_raw, ss, unnest(lo) AS ls FROM lx2),
lex AS (SELECT doc_id, ss, ss + length(sf_raw) AS se, ls, ls + length(lf_raw) AS le FROM lx3 WHERE abs(ls - ss) <= 240)"""

TAGS = rf"""tg0 AS (SELECT doc_id, text, unnest(list_filter(list_distinct(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')), lambda x: regexp_full_match(x, '[A-Z]{{3}}'))) AS t FROM corpus),
tg1 AS (SELECT doc_id, length(t) AS n, unnest({OCC.format(t="text", n="t")}) AS s FROM tg0),
q AS (SELECT *, open AS before, 3 AS most FROM parens),{WINDOW},
tags AS (SELECT DISTINCT doc_id, 'SF' AS label, s, s + n AS e FROM tg1 UNION SELECT doc_id, 'LF', wstart, wend FROM lw)"""


def sql(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join([CORPUS, *parts]) + "\n" + select


QUERIES = {
    "sh_extract": lambda s, d: x.schwartz_hearst(corpus(s, d)),
    "sh_prf": lambda s, d: prf(exact_pair(gold(s, d), x.schwartz_hearst(corpus(s, d)))),
    "toy_extract": lambda s, d: x.toy(corpus(s, d)),
    "cand_parenthetical": lambda s, d: x.parenthetical(corpus(s, d)),
    "cand_parenthetical_diag": lambda s, d: x.parenthetical_diagnostics(corpus(s, d)),
    "cand_reverse": lambda s, d: x.reverse_order(corpus(s, d)),
    "cand_nested": lambda s, d: x.nested_parenthetical(corpus(s, d)),
    "cand_table": lambda s, d: x.table_rows(corpus(s, d)),
    "cand_lexical": lambda s, d: x.lexical_resource(corpus(s, d), lexicon(s, d)),
    "cand_dedup": lambda s, d: x.candidate_pipeline(
        {"parenthetical": x.parenthetical(corpus(s, d)), "nested": x.nested_parenthetical(corpus(s, d)), "lexical": x.lexical_resource(corpus(s, d), lexicon(s, d)), "table": x.table_rows(corpus(s, d))}
    )[0],
    "prediction_validate": lambda s, d: x.validate_predictions(
        gold(s, d).withColumn("se", F.when(F.col("doc_id") % 3 == 0, F.col("se") + 1).otherwise(F.col("se"))), corpus(s, d)
    ),
    "plod_tags": lambda s, d: x.bracket_spans(corpus(s, d)),
}

S5 = "SELECT doc_id, ss, se, ls, le FROM "
MATCH = r"""mg AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ss, se, ls, le) AS rn FROM gold),
mp AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ss, se, ls, le) AS rn FROM sh),
outcome AS (SELECT CASE WHEN mp.doc_id IS NULL THEN 'fn' WHEN mg.doc_id IS NULL THEN 'fp' ELSE 'tp' END AS status,
  coalesce(mg.doc_id, mp.doc_id) AS doc_id FROM mg FULL JOIN mp ON mg.doc_id = mp.doc_id AND mg.ss = mp.ss AND mg.se = mp.se AND mg.ls = mp.ls AND mg.le = mp.le AND mg.rn = mp.rn)"""
PRF = """SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END AS recall,
CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1
FROM (SELECT count(*) FILTER (WHERE status = 'tp') AS tp, count(*) FILTER (WHERE status = 'fp') AS fp, count(*) FILTER (WHERE status = 'fn') AS fn FROM outcome)"""
ORACLE_SQL = {
    "sh_extract": sql(PARENS, SH, select="SELECT * FROM sh"),
    "sh_prf": sql(PARENS, SH, MATCH, select=PRF),
    "toy_extract": sql(
        PARENS,
        r"""t0 AS (SELECT *, reverse(substr(text, 1, open)) AS back FROM parens WHERE regexp_full_match(content, '[A-Za-z][A-Za-z0-9-]*')),
t1 AS (SELECT *, length(regexp_extract(back, '^\s*')) AS gap, length(regexp_extract(back, '^\s*([A-Za-z0-9][A-Za-z0-9 -]*[A-Za-z])', 1)) AS n FROM t0)""",
        select="SELECT doc_id, open + 1 AS ss, open + 1 + length(content) AS se, open - gap - n AS ls, open - gap AS le FROM t1 WHERE n > 0",
    ),
    "cand_parenthetical": sql(PARENS, JUDGED, select=S5 + "cand"),
    "cand_parenthetical_diag": sql(PARENS, JUDGED, select="SELECT doc_id, code, count(*) AS n FROM judged WHERE code IS NOT NULL GROUP BY ALL"),
    "cand_reverse": sql(PARENS, REVERSE, select=S5 + "rev"),
    "cand_nested": sql(NESTED, select=S5 + "nest"),
    "cand_table": sql(TABLE, select=S5 + "tab"),
    "cand_lexical": sql(LEXICAL, select=S5 + "lex"),
    "cand_dedup": "WITH "
    + ",\n".join([CORPUS, PARENS, JUDGED, LEXICAL, TABLE, AGAIN])
    + """, every AS (SELECT *, 'parenthetical' AS generator, 0 AS o FROM cand UNION ALL SELECT *, 'nested', 1 FROM nest
UNION ALL SELECT *, 'lexical', 2 FROM lex UNION ALL SELECT *, 'table', 3 FROM tab)
SELECT doc_id, ss, se, ls, le, arg_min(generator, o) AS generator FROM every GROUP BY doc_id, ss, se, ls, le""",
    "prediction_validate": sql(
        select="""SELECT g.doc_id, g.ss, g.se + (g.doc_id % 3 = 0)::INT AS se, g.ls, g.le, g.sf, g.lf FROM gold g JOIN corpus c ON g.doc_id = c.doc_id
WHERE substr(text, g.ss + 1, g.se + (g.doc_id % 3 = 0)::INT - g.ss) = g.sf AND substr(text, g.ls + 1, g.le - g.ls) = g.lf"""
    ),
    "plod_tags": sql(PARENS, TAGS, select="SELECT * FROM tags"),
}
