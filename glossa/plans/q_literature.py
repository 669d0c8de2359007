"""Queries of weak supervision, literature, fusion and resolver post-processing, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import extract as x
from glossa.operators import fuse, literature, weak
from glossa.plans.corpus import CORPUS, PARENS, corpus, gold, lexicon, table
from glossa.plans.q_evaluate import TOY
from glossa.plans.q_extract import OCC, SH, TAGS, sql

KEY = ["doc_id", "ss", "se", "ls", "le"]


def evidence(s: SparkSession, d: str) -> DataFrame:
    """Events as a ledger: family, weight, polarity per user."""
    polarity = F.when(F.col("event_id") % 5 == 0, "negative").when(F.col("event_id") % 7 == 0, "abstain").otherwise("positive")
    return table(s, d, "events").select("user_id", F.col("event_type").alias("family"), F.round(F.col("value"), 3).alias("weight"), polarity.alias("polarity"), F.col("event_id").alias("ord"))


def pair_evidence(s: SparkSession, d: str) -> DataFrame:
    g = gold(s, d)
    return g.withColumn("polarity", F.when(F.col("doc_id") % 9 == 0, "negative").otherwise("positive"))


def sections(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select(F.col("conv_id").alias("article"), F.col("turn").alias("ord"), F.coalesce("text", F.lit("")).alias("text"))


def section_spans(s: SparkSession, d: str) -> DataFrame:
    """Spans in the joined articles: the inner part of each turn, and some that cross a boundary."""
    o = literature.section_offsets(sections(s, d))
    return o.select("article", (F.col("start") + 1).alias("s"), F.when(F.col("ord") % 3 == 0, F.col("end") + 3).otherwise(F.greatest(F.col("end") - 1, F.col("start") + 1)).alias("e")).distinct()


def definitions(s: SparkSession, d: str) -> DataFrame:
    """Gold definitions, some of them twice at one place, some again later."""
    g = gold(s, d)
    again = g.filter("doc_id % 6 = 1")
    later = g.filter("doc_id % 5 = 2").withColumn("ss", F.col("ss") + 40).withColumn("ls", F.col("ls") + 40)
    return g.unionByName(again).unionByName(later)


def halves(s: SparkSession, d: str) -> DataFrame:
    """Two sections per text: its first 60 characters, and what follows."""
    n = F.length("text").cast("long")
    c = corpus(s, d)
    first = c.select("doc_id", F.lit(0).cast("long").alias("start"), F.least(n, F.lit(60)).alias("end"))
    return first.unionByName(c.filter(n > 60).select("doc_id", F.lit(60).cast("long").alias("start"), n.alias("end")))


def frame(s: SparkSession, d: str) -> DataFrame:
    """Documents as a sampling frame."""
    i = F.col("doc_id")
    return table(s, d, "documents").select(
        i.alias("record_id"), F.coalesce("text", F.lit("")).alias("text"), "lang", F.col("source").alias("source_kind"), (F.lit(1990) + F.pmod(i, F.lit(7))).alias("year"),
        F.when(i % 11 == 0, F.floor(i / 22).cast("string")).alias("pmid"), F.when(i % 13 == 0, F.concat(F.lit("PMC"), F.floor(i / 26).cast("string"))).alias("pmcid"),
        (i % 10 != 3).alias("available"), F.when(i % 17 == 0, "yes").when(i % 19 == 0, "unknown").otherwise("no").alias("teacher_overlap"), F.when(i % 4 == 0, "hard").when(i % 9 == 0, "nested").alias("tag"),
    )


def groups(s: SparkSession, d: str) -> DataFrame:
    """Groups by source and residue, cheaper than the linked ones, for the sampling queries."""
    return frame(s, d).select("record_id", F.floor(F.col("record_id") / 3).cast("long").alias("root"))


def rolled(s: SparkSession, d: str) -> DataFrame:
    return literature.roll_up(frame(s, d), groups(s, d))


def members(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d).select("record_id", F.concat(F.lit("g"), F.floor(F.col("record_id") / 3).cast("string")).alias("group_id"))


def tags(s: SparkSession, d: str) -> DataFrame:
    return x.bracket_spans(corpus(s, d))


def methods(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"sh": x.schwartz_hearst(corpus(s, d)), "toy": x.toy(corpus(s, d))}


def outside_rows(s: SparkSession, d: str) -> DataFrame:
    g = gold(s, d).select("doc_id", "sf", "lf")
    return g.withColumn("ord", F.lit(1)).unionByName(g.filter("doc_id % 7 = 0").withColumn("ord", F.lit(2)))


def quotes(s: SparkSession, d: str) -> DataFrame:
    """Evidence around each definition, some of it altered; a string that overlaps itself, and one with the end of a quotation."""
    c = corpus(s, d).filter("ss IS NOT NULL")
    ev = F.expr("substring(text, cast(least(ss, ls) AS INT) + 1, cast(greatest(se, le) - least(ss, ls) AS INT) + 1)")
    own = c.select("doc_id", F.when(F.col("doc_id") % 6 == 0, F.concat(ev, F.lit("?"))).otherwise(ev).alias("evidence"), "sf", "lf")
    line = lambda e, a, b: [F.lit(x).alias(n) for x, n in ((e, "evidence"), (a, "sf"), (b, "lf"))]
    twice = c.filter("doc_id % 5 = 1").select("doc_id", *line("axaxa", "xax", "a"))
    end = c.filter("doc_id % 5 = 2").select("doc_id", *line("\\E1", "E1", "\\E"))
    return own.unionByName(twice).unionByName(end)


def extracted(s: SparkSession, d: str) -> DataFrame:
    """The quotes as pairs of a direct extraction, and gold pairs with their offsets: some shifted, discontinuous, too long or repeated."""
    blank = [F.lit(None).cast("long").alias(c) for c in KEY[1:]]
    q = quotes(s, d).select("doc_id", (F.when(F.col("evidence") == "axaxa", 1).when(F.col("sf") == "E1", 2).otherwise(0)).cast("long").alias("i"), F.lit("quote").alias("mode"), "evidence", "sf", "lf", *blank)
    g = gold(s, d).filter("doc_id % 7 <> 0")
    kind = F.when(F.col("doc_id") % 4 == 1, "discontinuous").otherwise("contiguous")
    o = g.select("doc_id", F.lit(3).cast("long").alias("i"), F.lit("offset").alias("mode"), kind.alias("evidence"), "sf", "lf", (F.col("ss") + (F.col("doc_id") % 9 == 0).cast("long")).alias("ss"), F.when(F.col("doc_id") % 11 == 0, F.col("ss")).otherwise(F.col("se") + (F.col("doc_id") % 9 == 0).cast("long")).alias("se"), "ls", F.when(F.col("doc_id") % 13 == 0, F.lit(10_000_000)).otherwise(F.col("le")).alias("le"))
    same = g.filter("doc_id % 10 = 3").select("doc_id", F.lit(4).cast("long").alias("i"), F.lit("offset").alias("mode"), F.lit("contiguous").alias("evidence"), "sf", F.col("sf").alias("lf"), "ss", "se", F.col("ss").alias("ls"), F.col("se").alias("le"))
    return q.unionByName(o).unionByName(same)


def answers(s: SparkSession, d: str) -> DataFrame:
    p = lambda a: F.round(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(a), "doc_id"), 256), 1, 8), 16, 10).cast("double") / float(1 << 32), 6)
    o = F.when(F.col("doc_id") % 5 == 0, "unclear").when(F.col("doc_id") % 3 == 0, "second_is_short_form").otherwise("first_is_short_form")
    return gold(s, d).select(*KEY, p("d").alias("p_definition"), o.alias("orientation"), p("o").alias("p_orientation"))


def turns(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("i"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))


def revisions(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    return o.select(F.col("l_orderkey").alias("order"), F.when(F.col("l_partkey") % 5 == 0, F.col("l_linenumber")).otherwise(F.col("l_linenumber") - 1).alias("expected"), F.col("l_linenumber").alias("revision"), F.col("l_partkey").alias("value"))


LINKS = lambda s, d: frame(s, d).select("record_id", F.col("source_kind").alias("link"))
CHALLENGE, RANDOM = {"challenge_a": 12, "challenge_b": 20}, {"train": 0.5, "test": 0.2}

QUERIES = {
    "evidence_dedup": lambda s, d: weak.ledger(evidence(s, d).drop("ord"), ["user_id", "family", "polarity"]).select("user_id", "family", "polarity", "evidence_id"),
    "silver_labels": lambda s, d: weak.silver_labels(evidence(s, d), ["user_id"], 60.0, 50.0),
    "template_extract": lambda s, d: weak.templates(gold(s, d), corpus(s, d)),
    "pattern_induce": lambda s, d: weak.induce(pair_evidence(s, d), corpus(s, d)),
    "pattern_validate": lambda s, d: weak.validate(weak.induce(pair_evidence(s, d).filter("doc_id % 16 < 8"), corpus(s, d)), gold(s, d).filter("doc_id % 16 >= 8"), corpus(s, d)),
    "reused_evidence": lambda s, d: weak.reused_evidence(table(s, d, "events").groupBy((F.col("event_id") % 40).alias("stage")).agg(F.collect_set("user_id").alias("evidence_ids"))),
    "mention_link": lambda s, d: literature.link_mentions(corpus(s, d), definitions(s, d), allow_plural=True),
    "mention_link_section": lambda s, d: literature.link_mentions(corpus(s, d), definitions(s, d), scope="section", ordering="nearest_any", conflict="nearest", case_sensitive=True, sections=halves(s, d)),
    "segment_sections": lambda s, d: literature.section_documents(sections(s, d)),
    "segment_article": lambda s, d: literature.article_documents(sections(s, d)),
    "section_offsets": lambda s, d: literature.section_offsets(sections(s, d)),
    "span_to_section": lambda s, d: literature.span_sections(section_spans(s, d), literature.section_offsets(sections(s, d))),
    "group_components": lambda s, d: literature.group_articles(frame(s, d)),
    "group_rollup": rolled,
    "sample_roles": lambda s, d: literature.sample_roles(rolled(s, d), "seed", CHALLENGE, RANDOM),
    "lexicon_view": lambda s, d: literature.lexicon_view(members(s, d).select("group_id").distinct().withColumn("role", F.when(F.col("group_id").endswith("1"), "train").otherwise("test")), members(s, d), LINKS(s, d), ["train"]),
    "lexicon_summary": lambda s, d: lexicon(s, d).agg(F.count(F.lit(1)).alias("variants"), F.count_distinct("sf_key").alias("short_forms"), F.sum("n").alias("total")),
    "lexicon_merge": lambda s, d: lexicon(s, d).groupBy("sf_key").agg(F.sum("n").alias("n"), F.count_distinct("lf_key").alias("long_forms")),
    "frequency_priority": lambda s, d: gold(s, d).select("doc_id", F.lower("sf").alias("sf_key")).join(lexicon(s, d), "sf_key").groupBy("doc_id").agg(F.sum("n").alias("priority")),
    "frame_summary": lambda s, d: literature.frame_summary(frame(s, d)),
    "select_corpus": lambda s, d: literature.select_corpus(frame(s, d), "seed", 100, 60),
    "prose_pack": lambda s, d: literature.prose_passages(table(s, d, "documents")),
    "shard_route": lambda s, d: literature.shard(table(s, d, "documents"), "doc_id", 16),
    "latest_revisions": lambda s, d: literature.latest_revisions(revisions(s, d), "order"),
    "review_packet": lambda s, d: literature.capped_packet(table(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("case_id"), F.col("conv_id").alias("article")), "seed", 4, 60),
    "pairing_eligible": lambda s, d: fuse.eligible_pairs(tags(s, d), corpus(s, d)),
    "pairing_shared": lambda s, d: fuse.pair_shared(fuse.eligible_pairs(tags(s, d), corpus(s, d))),
    "pairing_one_to_one": lambda s, d: fuse.pair_one_to_one(fuse.eligible_pairs(tags(s, d), corpus(s, d))),
    "hybrid_union": lambda s, d: fuse.fuse(methods(s, d)),
    "hybrid_abstain": lambda s, d: fuse.fuse(methods(s, d), "abstain"),
    "bioadi_ordinal": lambda s, d: fuse.ordinal_pairs(outside_rows(s, d), corpus(s, d)),
    "ab3p_unique": lambda s, d: fuse.unique_pairs(outside_rows(s, d), corpus(s, d)),
    "direct_extraction": lambda s, d: fuse.direct_pairs(extracted(s, d), corpus(s, d)),
    "hybrid_priority_log": lambda s, d: fuse.fuse_log(methods(s, d), "priority"),
    "quote_grounding": lambda s, d: fuse.ground_quotes(quotes(s, d), corpus(s, d)),
    "judge_policy": lambda s, d: fuse.judge(answers(s, d)),
    "request_chunks": lambda s, d: fuse.pack_requests(turns(s, d), 3, 1500),
    "tagger_windows": lambda s, d: fuse.windows(table(s, d, "documents").select("doc_id", "text")),
}

TEMPLATE = """tm AS (SELECT g.doc_id, g.ss, g.se, g.ls, g.le, {pol} AS polarity, trim(regexp_replace(CASE WHEN ss <= ls THEN substr(text, greatest(0, ss - {c}) + 1, ss - greatest(0, ss - {c})) || '<SF>' || substr(text, se + 1, ls - se) || '<LF>' || substr(text, le + 1, {c})
  ELSE substr(text, greatest(0, ls - {c}) + 1, ls - greatest(0, ls - {c})) || '<LF>' || substr(text, le + 1, ss - le) || '<SF>' || substr(text, se + 1, {c}) END, '\\s+', ' ', 'g')) AS template,
  CASE WHEN ss < ls THEN 'short_before_long' ELSE 'long_before_short' END AS direction FROM gold g JOIN (SELECT doc_id, text FROM corpus) USING (doc_id))"""
SECTIONS = "se AS (SELECT conv_id AS article, turn AS ord, coalesce(text, '') AS text FROM conversations), off AS (SELECT article, ord, (sum(length(text) + 2) OVER w - 2 - length(text))::BIGINT AS start, (sum(length(text) + 2) OVER w - 2)::BIGINT AS \"end\" FROM se WINDOW w AS (PARTITION BY article ORDER BY ord))"
FRAME = """fr AS (SELECT doc_id AS record_id, coalesce(text, '') AS text, lang, source AS source_kind, 1990 + doc_id % 7 AS year, CASE WHEN doc_id % 11 = 0 THEN (doc_id // 22)::VARCHAR END AS pmid,
  CASE WHEN doc_id % 13 = 0 THEN 'PMC' || (doc_id // 26) END AS pmcid, doc_id % 10 <> 3 AS available, CASE WHEN doc_id % 17 = 0 THEN 'yes' WHEN doc_id % 19 = 0 THEN 'unknown' ELSE 'no' END AS teacher_overlap,
  CASE WHEN doc_id % 4 = 0 THEN 'hard' WHEN doc_id % 9 = 0 THEN 'nested' END AS tag FROM documents)"""
ROLLED = """ro AS (SELECT 'article-group-' || substr(sha256(string_agg('record:' || record_id, '|' ORDER BY 'record:' || record_id)), 1, 16) AS group_id, count(*) AS records, string_agg(DISTINCT source_kind, ',' ORDER BY source_kind) AS kinds,
  count(*) FILTER (WHERE available) AS available, count(*) FILTER (WHERE NOT available) AS unavailable, CASE max(CASE teacher_overlap WHEN 'yes' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END) WHEN 2 THEN 'yes' WHEN 1 THEN 'unknown' ELSE 'no' END AS overlap,
  coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag), '') AS tags FROM fr GROUP BY record_id // 3)"""
PAIRS = r"""ep0 AS (SELECT a.doc_id, a.s AS ss, a.e AS se, b.s AS ls, b.e AS le FROM tags a JOIN tags b ON a.doc_id = b.doc_id AND a.label = 'SF' AND b.label = 'LF' AND (b.e <= a.s OR a.e <= b.s)),
ep1 AS (SELECT e.*, greatest(ss, ls) - least(se, le) AS gap, substr(text, least(se, le) + 1, greatest(ss, ls) - least(se, le)) AS btw, substr(text, greatest(se, le) + 1, 2) AS aft FROM ep0 e JOIN (SELECT doc_id, text FROM corpus) USING (doc_id) WHERE greatest(ss, ls) - least(se, le) <= 160),
ep AS (SELECT doc_id, ss, se, ls, le, CASE WHEN CASE WHEN le <= ss THEN (regexp_matches(btw, '^\s*\(\s*$') AND regexp_matches(aft, '^\s*[),;]')) OR (regexp_matches(btw, '^\s*\[\s*$') AND regexp_matches(aft, '^\s*\]'))
  ELSE regexp_matches(btw, '^\s*[,;:]\s*$') OR regexp_matches(btw, '^\s*\(\s*[,;]?\s*$') END THEN 0.0::DOUBLE ELSE gap::DOUBLE END AS cost FROM ep1)"""
SCORE = "round(CASE WHEN cost = 0 THEN 1.0::DOUBLE ELSE 1 / (1 + 0.05::DOUBLE * cost) END, 6) AS score"
OUTSIDE = f"""orow AS (SELECT doc_id, sf, lf, 1 AS ord FROM gold UNION ALL SELECT doc_id, sf, lf, 2 FROM gold WHERE doc_id % 7 = 0),
oc AS (SELECT r.*, row_number() OVER w AS k, count(*) OVER (PARTITION BY r.doc_id, sf, lf) AS n, {OCC.format(t="text", n="sf")} AS so, {OCC.format(t="text", n="lf")} AS lo FROM orow r JOIN (SELECT doc_id, text FROM corpus) USING (doc_id) WINDOW w AS (PARTITION BY r.doc_id, sf, lf ORDER BY ord))"""
DEFINED = "df AS (SELECT doc_id, sf, ss AS p FROM gold UNION ALL SELECT doc_id, sf, ss FROM gold WHERE doc_id % 6 = 1 UNION ALL SELECT doc_id, sf, ss + 40 FROM gold WHERE doc_id % 5 = 2)"
#: Matches of each surface: the pieces between them and the matches themselves give the offsets.
MENTION = """sm AS (SELECT DISTINCT doc_id, sf FROM df), m0 AS (SELECT doc_id, sf, regexp_split_to_array(text, {flags}regexp_escape(sf){plural}) AS ps, regexp_extract_all(text, {flags}regexp_escape(sf){plural}) AS hs FROM sm JOIN (SELECT doc_id, text FROM corpus) USING (doc_id)),
m1 AS (SELECT doc_id, sf, ps, hs, unnest(range(1, len(hs) + 1)) AS i FROM m0),
m AS (SELECT doc_id, sf, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hs[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s, length(hs[i]) AS k, s + k AS e FROM m1),
mm AS (SELECT m.doc_id, m.sf, m.s, m.e, df.p, {scope} AS ok FROM m JOIN df ON df.doc_id = m.doc_id AND {same}){sect}"""
QUOTES = r"""e0 AS (SELECT doc_id, text, sf, lf, 0 AS i, substr(text, least(ss, ls) + 1, greatest(se, le) - least(ss, ls) + 1) || CASE WHEN doc_id % 6 = 0 THEN '?' ELSE '' END AS ev FROM corpus WHERE ss IS NOT NULL
  UNION ALL SELECT doc_id, text, 'xax', 'a', 1, 'axaxa' FROM corpus WHERE ss IS NOT NULL AND doc_id % 5 = 1 UNION ALL SELECT doc_id, text, 'E1', '\E', 2, '\E1' FROM corpus WHERE ss IS NOT NULL AND doc_id % 5 = 2),
e1 AS (SELECT *, instr(text, ev) AS a, instr(ev, sf) AS b, instr(ev, lf) AS c, a > 0 AND instr(substr(text, a + 1), ev) > 0 AS a2, b > 0 AND instr(substr(ev, b + 1), sf) = 0 AND c > 0 AND instr(substr(ev, c + 1), lf) = 0 AND (b <> c OR length(sf) <> length(lf)) AS once FROM e0),
e2 AS (SELECT *, CASE WHEN a = 0 THEN 'evidence_quote is not an exact source substring' WHEN NOT once THEN 'evidence_quote does not contain exactly one occurrence of each form' WHEN a2 THEN 'evidence_quote identifies more than one source occurrence' ELSE 'grounded' END AS verdict FROM e1),
e3 AS (SELECT doc_id, i, CASE WHEN verdict = 'grounded' THEN a + b - 2 END AS ss, ss + length(sf) AS se, CASE WHEN verdict = 'grounded' THEN a + c - 2 END AS ls, ls + length(lf) AS le, verdict FROM e2)"""
#: The greedy folds step by step: one row per group and step, the state in lists.
ONE_TO_ONE = """po AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cost, ss, ls, se, le) AS rn FROM ep),
pr AS (SELECT DISTINCT doc_id, 0::BIGINT AS rn, []::STRUCT(ss BIGINT, se BIGINT, ls BIGINT, le BIGINT, cost DOUBLE)[] AS acc FROM po UNION ALL
  SELECT p.doc_id, p.rn, CASE WHEN len(list_filter(acc, lambda a: (a.ss = p.ss AND a.se = p.se) OR (a.ls = p.ls AND a.le = p.le))) > 0 THEN acc ELSE list_append(acc, {'ss': p.ss, 'se': p.se, 'ls': p.ls, 'le': p.le, 'cost': p.cost}) END FROM pr JOIN po p ON p.doc_id = pr.doc_id AND p.rn = pr.rn + 1),
pd AS (SELECT doc_id, unnest(arg_max(acc, rn)) AS a FROM pr GROUP BY doc_id)"""
FUSED = """fu AS (SELECT DISTINCT doc_id, ss, se, ls, le, 'sh' AS child, 0 AS o FROM sh UNION ALL SELECT DISTINCT *, 'toy', 1 FROM toy),
f1 AS (SELECT doc_id, ss, se, ls, le, min(o) AS o, arg_min(child, o) AS child, string_agg(child, ',' ORDER BY child) AS contributors FROM fu GROUP BY doc_id, ss, se, ls, le),
fo AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o, ss, se, ls, le) AS rn FROM f1),
fr AS (SELECT DISTINCT doc_id, 0::BIGINT AS rn, []::STRUCT(ss BIGINT, se BIGINT, ls BIGINT, le BIGINT, rn BIGINT)[] AS acc FROM fo UNION ALL
  SELECT p.doc_id, p.rn, CASE WHEN len(list_filter(acc, lambda a: (a.ss = p.ss AND a.se = p.se) OR (a.ls = p.ls AND a.le = p.le))) > 0 THEN acc ELSE list_append(acc, {'ss': p.ss, 'se': p.se, 'ls': p.ls, 'le': p.le, 'rn': p.rn}) END FROM fr JOIN fo p ON p.doc_id = fr.doc_id AND p.rn = fr.rn + 1),
fa AS (SELECT doc_id, unnest(arg_max(acc, rn)) AS a FROM fr GROUP BY doc_id),
fz AS (SELECT fo.*, a IS NOT NULL AS accepted FROM fo LEFT JOIN fa ON fa.doc_id = fo.doc_id AND fa.a.rn = fo.rn)"""
PROSE = r"""p0 AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents WHERE length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 80),
p1 AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?]) ([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') AS ss FROM p0),
ps AS MATERIALIZED (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM p1),
pk AS (SELECT doc_id, i, length(s) AS now, 1 AS pid FROM ps WHERE i = 1 UNION ALL
  SELECT ps.doc_id, ps.i, CASE WHEN now + 1 + length(s) > 400 THEN length(s) ELSE now + 1 + length(s) END, CASE WHEN now + 1 + length(s) > 400 THEN pid + 1 ELSE pid END FROM pk JOIN ps ON ps.doc_id = pk.doc_id AND ps.i = pk.i + 1),
pp AS MATERIALIZED (SELECT doc_id, pid, string_agg(s, ' ' ORDER BY i) AS s, length(string_agg(s, ' ' ORDER BY i)) AS n FROM ps JOIN pk USING (doc_id, i) GROUP BY ALL),
pj AS (SELECT DISTINCT doc_id, 0 AS pid, []::STRUCT(ids INTEGER[], n BIGINT)[] AS acc FROM pp UNION ALL
  SELECT pp.doc_id, pp.pid, CASE WHEN pp.n >= 80 THEN CASE WHEN pp.n > 1200 THEN acc ELSE list_append(acc, {'ids': [pp.pid], 'n': pp.n}) END WHEN len(acc) = 0 THEN acc
    WHEN acc[-1].n + 1 + pp.n > 1200 THEN acc[1:len(acc) - 1] ELSE list_append(acc[1:len(acc) - 1], {'ids': list_append(acc[-1].ids, pp.pid), 'n': acc[-1].n + 1 + pp.n}) END FROM pj JOIN pp ON pp.doc_id = pj.doc_id AND pp.pid = pj.pid + 1),
pf AS (SELECT doc_id, arg_max(acc, pid) AS acc FROM pj GROUP BY doc_id), pu AS (SELECT doc_id, unnest(acc).ids AS ids, generate_subscripts(acc, 1) - 1 AS i FROM pf),
pv AS (SELECT doc_id, i, unnest(ids) AS pid FROM pu)"""
CHUNKS = """ci AS MATERIALIZED (SELECT conv_id AS doc_id, length(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(coalesce(text, ''))) AS rn FROM conversations),
cr AS (SELECT DISTINCT doc_id, 0::BIGINT AS rn, 0 AS n, 0::BIGINT AS c, 0::BIGINT AS request FROM ci UNION ALL
  SELECT ci.doc_id, ci.rn, CASE WHEN n > 0 AND (n + 1 > 3 OR c + size > 1500) THEN 1 ELSE n + 1 END, CASE WHEN n > 0 AND (n + 1 > 3 OR c + size > 1500) THEN size ELSE c + size END, request + (n > 0 AND (n + 1 > 3 OR c + size > 1500))::INT
  FROM cr JOIN ci ON ci.doc_id = cr.doc_id AND ci.rn = cr.rn + 1)"""
PICK = "('0x' || substr(sha256('{a}:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
WITHF = "WITH " + FRAME + ",\n"


def recursive(query: str) -> str:
    return query.replace("WITH ", "WITH RECURSIVE ", 1)


ORACLE_SQL = {
    "pairing_one_to_one": recursive(sql(PARENS, TAGS, PAIRS, ONE_TO_ONE, select=f"SELECT doc_id, a.ss AS ss, a.se AS se, a.ls AS ls, a.le AS le, {SCORE.replace('cost', 'a.cost')} FROM pd")),
    "hybrid_abstain": recursive(sql(PARENS, SH, TOY, FUSED, select="SELECT doc_id, ss, se, ls, le, child, contributors FROM fz WHERE accepted")),
    "hybrid_priority_log": recursive(sql(
        PARENS, SH, TOY, FUSED,
        select="SELECT fz.doc_id, fz.ss, fz.se, fz.ls, fz.le, fu.child, accepted, CASE WHEN NOT accepted THEN 'priority_conflict' WHEN fu.child = fz.child THEN 'accepted' ELSE 'exact_duplicate_merge' END AS decision FROM fz JOIN fu ON (fz.doc_id, fz.ss, fz.se, fz.ls, fz.le) = (fu.doc_id, fu.ss, fu.se, fu.ls, fu.le)",
    )),
    "prose_pack": "WITH RECURSIVE " + PROSE + " SELECT pv.doc_id, pv.i, string_agg(s, ' ' ORDER BY pid) AS text FROM pv JOIN pp USING (doc_id, pid) GROUP BY ALL",
    "request_chunks": "WITH RECURSIVE " + CHUNKS + " SELECT doc_id, request, count(*) AS items, sum(size)::BIGINT AS characters FROM cr JOIN ci USING (doc_id, rn) GROUP BY ALL",
    "evidence_dedup": "SELECT DISTINCT user_id, event_type AS family, p AS polarity, sha256(user_id || '|' || event_type || '|' || p) AS evidence_id FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'negative' WHEN event_id % 7 = 0 THEN 'abstain' ELSE 'positive' END AS p FROM events)",
    "silver_labels": """WITH e AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'negative' WHEN event_id % 7 = 0 THEN 'abstain' ELSE 'positive' END AS p, round(value, 3) AS w FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY w DESC, event_id) AS rn FROM e),
s AS (SELECT user_id, coalesce(sum(w) FILTER (WHERE rn = 1 AND p = 'positive'), 0) AS pos, coalesce(sum(w) FILTER (WHERE rn = 1 AND p = 'negative'), 0) AS neg, count(*) AS n_evidence FROM r GROUP BY 1)
SELECT user_id, CASE WHEN pos >= 60 AND neg >= 50 THEN 'abstain' WHEN pos >= 60 THEN 'positive' WHEN neg >= 50 THEN 'negative' ELSE 'abstain' END AS status,
CASE WHEN pos + neg > 0 THEN round(greatest(pos, neg) / (pos + neg), 6) ELSE 0.0 END AS confidence, n_evidence FROM s""",
    "template_extract": sql(TEMPLATE.format(c=60, pol="''"), select="SELECT doc_id, ss, se, ls, le, template, direction FROM tm"),
    "pattern_induce": sql(
        TEMPLATE.format(c=60, pol="CASE WHEN doc_id % 9 = 0 THEN 'negative' ELSE 'positive' END"),
        select="SELECT template, direction, count(DISTINCT doc_id) AS documents, count(DISTINCT (ss, se, ls, le)) AS pairs, CASE WHEN count(DISTINCT doc_id) >= 2 AND count(DISTINCT (ss, se, ls, le)) >= 2 THEN 'promoted' ELSE 'rejected_insufficient_support' END AS status FROM tm WHERE polarity = 'positive' AND length(template) <= 180 GROUP BY 1, 2",
    ),
    "pattern_validate": sql(
        TEMPLATE.format(c=60, pol="CASE WHEN doc_id % 9 = 0 THEN 'negative' ELSE 'positive' END"),
        "pt AS (SELECT DISTINCT template FROM tm WHERE polarity = 'positive' AND doc_id % 16 < 8 AND length(template) <= 180), ho AS (SELECT template AS context FROM tm WHERE doc_id % 16 >= 8)",
        r"pp AS (SELECT template, '(?s)^' || replace(replace(regexp_escape(template), regexp_escape('<SF>'), '\S{1,40}'), regexp_escape('<LF>'), '.{1,240}?') || '$' AS pat FROM pt)",
        r"ph AS MATERIALIZED (SELECT template, pat, context FROM (SELECT *, string_split(replace(template, '<LF>', '<SF>'), '<SF>') AS ends FROM pp) JOIN ho ON starts_with(context, ends[1]) AND ends_with(context, ends[-1])), pm AS (SELECT template, count(*) AS n FROM ph WHERE regexp_matches(context, pat) GROUP BY 1)",
        select="SELECT template, (SELECT count(*) FROM ho) AS held_out, coalesce(n, 0) AS matched, (SELECT count(*) FROM ho) - coalesce(n, 0) AS missed FROM pp LEFT JOIN pm USING (template)",
    ),
    "reused_evidence": "WITH e AS (SELECT DISTINCT event_id % 40 AS stage, user_id FROM events), f AS (SELECT user_id, min(stage) AS first FROM e GROUP BY 1) SELECT stage, count(*) AS n, count(*) FILTER (WHERE first < stage) AS reused, count(*) FILTER (WHERE first < stage) = 0 AS accepted FROM e JOIN f USING (user_id) GROUP BY stage",
    "mention_link": sql(
        DEFINED, MENTION.format(flags="'(?i)' || ", plural=" || 's?'", same="lower(df.sf) = lower(m.sf)", scope="true", sect=""),
        "mn AS (SELECT doc_id, sf, s, e, max(p) FILTER (WHERE p <= s) AS definition_start, list(p) AS ps FROM mm GROUP BY ALL)",
        select="SELECT doc_id, sf, s, e, CASE WHEN definition_start IS NULL THEN 'undefined' WHEN len(list_filter(ps, lambda q: q = definition_start)) > 1 THEN 'ambiguous' ELSE 'linked' END AS status, definition_start, CASE WHEN definition_start IS NULL THEN 0 ELSE len(list_filter(ps, lambda q: q = definition_start)) END::BIGINT AS n FROM mn",
    ),
    "mention_link_section": sql(
        DEFINED, MENTION.format(flags="", plural="", same="df.sf = m.sf", scope="CASE WHEN m.e <= 60 THEN 0 WHEN m.s >= 60 THEN 1 END = CASE WHEN df.p + length(df.sf) <= 60 THEN 0 WHEN df.p >= 60 THEN 1 END", sect=""),
        "mn AS (SELECT doc_id, sf, s, e, max(p) FILTER (WHERE ok) AS definition_start, list(p) FILTER (WHERE ok) AS ps FROM mm GROUP BY ALL)",
        select="SELECT doc_id, sf, s, e, CASE WHEN definition_start IS NULL THEN 'abstain' ELSE 'linked' END AS status, definition_start, CASE WHEN definition_start IS NULL THEN 0 ELSE len(list_filter(ps, lambda q: q = definition_start)) END::BIGINT AS n FROM mn",
    ),
    "segment_sections": "SELECT conv_id || '/section/' || turn AS document_id, coalesce(text, '') AS text FROM conversations",
    "segment_article": "SELECT conv_id AS article, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id",
    "section_offsets": f"WITH {SECTIONS} SELECT * FROM off",
    "span_to_section": f"""WITH {SECTIONS}, sp AS (SELECT DISTINCT article, start + 1 AS s, CASE WHEN ord % 3 = 0 THEN "end" + 3 ELSE greatest("end" - 1, start + 1) END AS e FROM off),
j AS (SELECT sp.article, s, e, ord, s - start AS rs, e - start AS re, count(*) OVER (PARTITION BY sp.article, s, e) AS n FROM sp JOIN off ON sp.article = off.article AND start <= s AND e <= "end") SELECT article, s, e, ord, rs, re FROM j WHERE n = 1""",
    "group_components": "WITH RECURSIVE " + FRAME + r""",
nt AS (SELECT record_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t, pmid, pmcid, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS ws FROM fr),
ky AS (SELECT record_id, 'content:' || t AS k FROM nt WHERE t <> '' UNION ALL SELECT record_id, 'pmid:' || pmid FROM nt WHERE pmid IS NOT NULL UNION ALL SELECT record_id, 'pmcid:' || pmcid FROM nt WHERE pmcid IS NOT NULL),
jp AS (SELECT a.record_id AS a, b.record_id AS b FROM nt a JOIN nt b ON a.record_id < b.record_id AND len(a.ws) > 0 AND len(b.ws) >= 0.98 * len(a.ws) AND len(a.ws) >= 0.98 * len(b.ws)
  AND len(list_intersect(a.ws, b.ws)) >= 0.98 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) - 1e-9),
l AS (SELECT a.record_id AS a, b.record_id AS b FROM ky a JOIN ky b USING (k) UNION SELECT a, b FROM jp UNION SELECT b, a FROM jp),
r AS (SELECT record_id AS node, record_id AS other FROM fr UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a)
SELECT node AS record_id, min(other) AS root FROM r GROUP BY node""",
    "group_rollup": WITHF + ROLLED + "\nSELECT * FROM ro",
    "sample_roles": WITHF + ROLLED + """, x AS (SELECT *, CASE WHEN available = 0 THEN 'unavailable' WHEN overlap = 'yes' THEN 'excluded:teacher-overlap' END AS fixed FROM ro),
c AS (SELECT group_id, row_number() OVER (ORDER BY sha256('seed:challenge:' || group_id)) AS i FROM x WHERE fixed IS NULL AND tags <> ''),
ch AS (SELECT group_id, CASE WHEN i <= 12 THEN 'challenge_a' ELSE 'challenge_b' END AS role FROM c WHERE i <= 20),
p AS (SELECT group_id, row_number() OVER (ORDER BY sha256('seed:' || group_id)) - 1 AS i, (SELECT count(*) FROM x WHERE fixed IS NULL) AS n FROM x WHERE fixed IS NULL AND group_id NOT IN (SELECT group_id FROM ch)),
rd AS (SELECT group_id, CASE WHEN i < floor(n * 0.5) THEN 'train' WHEN i < floor(n * 0.5) + floor(n * 0.2::DOUBLE) THEN 'test' END AS role FROM p)
SELECT x.group_id, coalesce(fixed, ch.role, rd.role, 'not-selected') AS role FROM x LEFT JOIN ch USING (group_id) LEFT JOIN rd ON rd.group_id = x.group_id""",
    "lexicon_view": "SELECT source AS link, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS records, count(*) AS n FROM documents WHERE ends_with('g' || (doc_id // 3), '1') GROUP BY source",
    "lexicon_summary": sql(select="SELECT count(*) AS variants, count(DISTINCT sf_key) AS short_forms, sum(n)::BIGINT AS total FROM lexicon"),
    "lexicon_merge": sql(select="SELECT sf_key, sum(n)::BIGINT AS n, count(DISTINCT lf_key) AS long_forms FROM lexicon GROUP BY 1"),
    "frequency_priority": sql(select="SELECT doc_id, sum(n)::BIGINT AS priority FROM gold JOIN lexicon ON lower(sf) = sf_key GROUP BY 1"),
    "frame_summary": WITHF.rstrip(",\n") + " SELECT source_kind AS kind, year, grouping(source_kind, year)::BIGINT AS level, count(*) AS records, count(*) FILTER (WHERE available) AS available FROM fr GROUP BY GROUPING SETS ((source_kind), (year), ())",
    "select_corpus": WITHF + """x AS (SELECT record_id, tag, CASE WHEN NOT available THEN 'unavailable' WHEN lang <> 'en' THEN 'language' WHEN length(text) < 200 THEN 'short' END AS why, sha256('seed:' || record_id) AS h FROM fr),
a AS (SELECT *, row_number() OVER (ORDER BY h) AS i FROM x WHERE why IS NULL), b AS (SELECT record_id, row_number() OVER (ORDER BY h) AS j FROM a WHERE i > 100 AND tag IS NOT NULL)
SELECT x.record_id, CASE WHEN x.why IS NOT NULL THEN 'excluded:' || x.why WHEN i <= 100 THEN 'broad' WHEN j <= 60 THEN 'enriched' ELSE 'not-selected' END AS decision FROM x LEFT JOIN a USING (record_id) LEFT JOIN b ON b.record_id = x.record_id""",
    "shard_route": "SELECT doc_id, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 16))::UBIGINT % 16)::BIGINT AS shard FROM documents",
    "latest_revisions": """WITH e AS (SELECT l_orderkey AS "order", l_linenumber AS revision, l_partkey AS value, CASE WHEN l_partkey % 5 = 0 THEN l_linenumber ELSE l_linenumber - 1 END AS expected FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)),
o AS (SELECT *, expected = coalesce(lag(revision) OVER (PARTITION BY "order" ORDER BY revision), 0) AS ok FROM e)
SELECT "order", arg_max(value, revision) FILTER (WHERE ok) AS value, max(revision) FILTER (WHERE ok) AS revision, count(*) FILTER (WHERE NOT ok) AS conflicts FROM o GROUP BY "order\"""",
    "review_packet": """WITH c AS (SELECT conv_id * 100 + turn AS case_id, conv_id AS article, sha256('seed:' || (conv_id * 100 + turn)) AS h FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY h) AS rn FROM c) SELECT case_id, article FROM r WHERE rn <= 4 ORDER BY h LIMIT 60""",
    "pairing_eligible": sql(PARENS, TAGS, PAIRS, select="SELECT * FROM ep"),
    "pairing_shared": sql(PARENS, TAGS, PAIRS, select=f"SELECT doc_id, ss, se, ls, le, {SCORE} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ss, se ORDER BY cost, ls, le) AS rn FROM ep) WHERE rn = 1"),
    "hybrid_union": sql(
        PARENS, SH, TOY, "u AS (SELECT DISTINCT doc_id, ss, se, ls, le, 'sh' AS child, 0 AS o FROM sh UNION ALL SELECT DISTINCT *, 'toy', 1 FROM toy)",
        select="SELECT doc_id, ss, se, ls, le, arg_min(child, o) AS child, string_agg(child, ',' ORDER BY child) AS contributors FROM u GROUP BY doc_id, ss, se, ls, le",
    ),
    "bioadi_ordinal": sql(OUTSIDE, select="SELECT doc_id, so[k] AS ss, so[k] + length(sf) AS se, lo[k] AS ls, lo[k] + length(lf) AS le FROM oc WHERE len(so) = n AND len(lo) = n AND lo[k] + length(lf) <= so[k]"),
    "ab3p_unique": sql(
        OUTSIDE, "z AS (SELECT DISTINCT doc_id, sf, lf, unnest(so) AS ss, lo FROM oc), y AS (SELECT doc_id, sf, lf, ss, unnest(lo) AS ls FROM z), w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, sf, lf) AS c FROM y WHERE ls + length(lf) <= ss)",
        select="SELECT doc_id, ss, ss + length(sf) AS se, ls, ls + length(lf) AS le FROM w WHERE c = 1",
    ),
    "quote_grounding": sql(QUOTES, select="SELECT doc_id, ss, se, ls, le, verdict FROM e3"),
    "direct_extraction": sql(
        QUOTES,
        """of AS (SELECT doc_id, 3 AS i, doc_id % 4 = 1 AS apart, sf, lf, ss + (doc_id % 9 = 0)::INT AS ss, CASE WHEN doc_id % 11 = 0 THEN ss ELSE se + (doc_id % 9 = 0)::INT END AS se, ls, CASE WHEN doc_id % 13 = 0 THEN 10000000 ELSE le END AS le FROM gold WHERE doc_id % 7 <> 0
  UNION ALL SELECT doc_id, 4, false, sf, sf, ss, se, ss, se FROM gold WHERE doc_id % 7 <> 0 AND doc_id % 10 = 3)""",
        """oj AS (SELECT of.*, CASE WHEN se <= ss THEN 'short_form span must be non-empty' WHEN se > length(text) THEN 'short_form span exceeds document length' WHEN substr(text, ss + 1, se - ss) <> sf THEN 'short_form quote does not match the stated occurrence'
  WHEN le <= ls THEN 'long_form span must be non-empty' WHEN le > length(text) THEN 'long_form span exceeds document length' WHEN substr(text, ls + 1, le - ls) <> lf THEN 'long_form quote does not match the stated occurrence'
  WHEN ss = ls AND se = le THEN 'short-form and long-form occurrences must be distinct' END AS problem FROM of JOIN (SELECT doc_id, text FROM corpus) USING (doc_id))""",
        """ev AS (SELECT doc_id, i, ss, se, ls, le, CASE WHEN verdict <> 'grounded' THEN 'quote_grounding_failed' END AS code, CASE WHEN verdict <> 'grounded' THEN verdict END AS reason FROM e3
  UNION ALL SELECT doc_id, i, ss, se, ls, le, CASE WHEN apart THEN 'discontinuous_evidence' WHEN problem IS NOT NULL THEN 'unsupported_output' END, CASE WHEN NOT apart THEN problem END FROM oj),
en AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ss, se, ls, le, code ORDER BY i) AS rn FROM ev)""",
        select="""SELECT doc_id, i::BIGINT AS i, ss, se, ls, le, CASE WHEN code IS NOT NULL THEN code WHEN rn = 1 THEN 'accepted' ELSE 'duplicate_output' END AS code, reason FROM en
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, 'abstained', NULL FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM ev)""",
    ),
    "judge_policy": sql(
        f"j AS (SELECT *, round({PICK.format(a='d')}, 6) AS pd, round({PICK.format(a='o')}, 6) AS po, doc_id % 3 = 0 AS swap FROM gold WHERE doc_id % 5 <> 0)",
        select="SELECT doc_id, CASE WHEN swap THEN ls ELSE ss END AS ss, CASE WHEN swap THEN le ELSE se END AS se, CASE WHEN swap THEN ss ELSE ls END AS ls, CASE WHEN swap THEN se ELSE le END AS le, max(least(pd, po)) AS confidence FROM j WHERE pd >= 0.5 AND po >= 0.5 GROUP BY ALL",
    ),
    "tagger_windows": "WITH w AS (SELECT doc_id, length(coalesce(text, '')) AS n, unnest(range(0, greatest(length(coalesce(text, '')), 1), 1800)) AS start FROM documents) SELECT doc_id, start, least(start + 2000, n) AS \"end\" FROM w WHERE start = 0 OR start + 200 < n",
}
