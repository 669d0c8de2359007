"""Mixing sources to target weights by Pareto order sampling.

A source that is to fill ``target`` words and has ``size`` words takes every document floor(target / size) times, for
certain. The rest is a fixed-size sample without replacement: document i has an inclusion probability p_i, draws a
uniform number u_i from its id, and is ranked by the odds of u_i over the odds of p_i; documents are taken
in that order until the rest of the words is reached. The order is never sorted as a whole: two rounds of counting words
per rank cell find the cell in which the words run out, and only that cell's documents are sorted, like rows as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm._common import checkpoint

MAX_REPEATS = 3
#: Fixed value: the weights of sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: Rank cells per round; the documents of one cell of the second round are sorted together.
CELLS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def _targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size): capped shares, excess reshared by weight."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("i", F.row_number().over(by_name) - 1)
    w = w.withColumn("weight", F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("i"), F.lit(len(weights)))))
    w = w.withColumn("cap", (max_repeats * F.col("source_size")).cast("double"))
    # sources reach their cap in the order of cap / weight; the first that does not sets the level for the others
    order = Window.orderBy(F.col("cap") / F.col("weight"), "i")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("total", F.sum("source_size").over(everything))
    w = w.withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.col("open_weight"))
    w = w.withColumn("open_level", F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level")))
    w = w.withColumn("level", F.coalesce(F.first("open_level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(float("inf"))))
    return w.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _rows(docs: DataFrame, doc_id: str, text: str, source: str, seed: str, inclusion: str | None) -> list:
    """doc_id, source, size, fp (text hash), x (weight of inclusion) and u (the draw) of a row, as columns."""
    body = F.coalesce(F.col(text), F.lit(""))
    fp = F.xxhash64(body)
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    x = F.greatest(F.coalesce(F.col(inclusion).cast("double"), F.lit(1.0)), F.lit(1e-9)) if inclusion else F.lit(1.0)
    name = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), fp.cast("string")))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), name)), 1, 12), 16, 10).cast("double")
    u = (draw + 0.5) / float(1 << 48)
    return [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), fp.alias("fp"), x.alias("x"), u.alias("u")]


_ROW = ["doc_id", "source", "size", "fp", "x", "u"]


def _placed(rows: DataFrame, plan: DataFrame, carried: list[str]) -> DataFrame:
    """Rows with their source's plan, their rank q (null: not sampled) and its cells c1 and c2."""
    # sources are few next to documents, and the join is on them: a plain equi-join, broadcast if the plan is small
    p = F.least(F.col("rest") / F.col("mass") * F.col("x"), F.lit(1.0) - 1e-12)
    q = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    placed = rows.join(_small(plan), F.col("source").eqNullSafe(F.col("s0"))).select(
        *carried, F.when((F.col("size") > 0) & (F.col("rest") > 0), q).alias("q")
    ).withColumn("place", F.col("q") / (1 + F.col("q")))
    placed = placed.withColumn("c1", F.least(F.floor(F.col("place") * CELLS), F.lit(CELLS - 1)))
    return placed.withColumn("c2", F.least(F.floor((F.col("place") * CELLS - F.col("c1")) * CELLS), F.lit(CELLS - 1)))


def _plan(rows: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """One checkpointed row per source: s0, source_size, mass, target, whole, rest, and where the words run out: cells cut1 and cut2 and ``last``.

    ``last`` is the last group of like rows (q, doc_id, size, fp) that is taken, wholly or in part, and ``partly`` how many of its rows,
    null for all.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("x")).alias("mass"))
    plan = _targets(sizes.select("source", "source_size"), weights, max_repeats)
    plan = plan.withColumnRenamed("source", "s0").join(sizes.select("source", "mass"), F.col("source").eqNullSafe(F.col("s0")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.least(F.floor(ratio + 1e-12), F.lit(max_repeats)).cast("long"))
    plan = plan.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    plan = checkpoint(plan.drop("source"))
    live = _placed(rows, plan, [*_ROW, "rest"]).filter(F.col("q").isNotNull())

    def crossing(cells: DataFrame, cell: str, start: str) -> DataFrame:
        """The cell of each source in which ``rest`` words are reached, and the words before it."""
        upto = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
        c = cells.withColumn("upto", F.col(start) + F.sum("words").over(upto))
        c = c.filter(F.col("upto") > F.col("rest"))
        return c.groupBy("source").agg(F.min(F.struct(cell, (F.col("upto") - F.col("words")).alias("before"))).alias("m"))

    first = live.groupBy("source", "c1").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")).withColumn("zero", F.lit(0).cast("long"))
    cut1 = checkpoint(crossing(first, "c1", "zero").select(F.col("source").alias("s1"), F.col("m.c1").alias("cut1"), F.col("m.before").alias("before1")))
    in1 = live.join(_small(cut1), F.col("source").eqNullSafe(F.col("s1"))).filter("c1 = cut1")
    second = in1.groupBy("source", "c2").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before1").alias("before1"))
    cut2 = crossing(second, "c2", "before1").select(F.col("source").alias("s2"), F.col("m.c2").alias("cut2"), F.col("m.before").alias("before2"))
    in2 = in1.join(_small(checkpoint(cut2)), F.col("source").eqNullSafe(F.col("s2"))).filter("c2 = cut2")
    # rows alike in all that orders them are one group with a count, however many there are
    groups = in2.groupBy("source", "q", "doc_id", "size", "fp").agg(F.count(F.lit(1)).alias("m"), *[F.first(c).alias(c) for c in ("rest", "before2", "cut1", "cut2")])
    before = Window.partitionBy("source").orderBy("q", "doc_id", "size", "fp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.col("before2") + F.coalesce(F.sum(F.col("size") * F.col("m")).over(before), F.lit(0)))
    wanted = F.floor((F.col("rest") - F.col("before")) / F.col("size") + 0.5)
    groups = groups.withColumn("taken", F.least(F.greatest(wanted, F.lit(0)), F.col("m")).cast("long"))
    rank = F.struct("q", "doc_id", "size", "fp")
    last = F.max(F.when(F.col("taken") > 0, F.struct(rank.alias("r"), F.when(F.col("taken") < F.col("m"), F.col("taken")).alias("partly")))).alias("last")
    edge = groups.groupBy("source", "cut1", "cut2").agg(last).select(F.col("source").alias("s3"), "cut1", "cut2", F.col("last.r").alias("last"), F.col("last.partly").alias("partly"))
    joined = plan.join(_small(checkpoint(edge)), F.col("s0").eqNullSafe(F.col("s3")), "left").drop("s3")
    return checkpoint(joined)


def _copies(placed: DataFrame) -> DataFrame:
    """Adds ``copies``, and ``numbered``: true for rows of a group that is taken in part (they have the copies of a row not taken)."""
    me = F.struct("q", "doc_id", "size", "fp")
    edge = (F.col("c1") == F.col("cut1")) & (F.col("c2") == F.col("cut2"))
    inside = (F.col("c1") < F.col("cut1")) | ((F.col("c1") == F.col("cut1")) & (F.col("c2") < F.col("cut2"))) | (edge & F.coalesce(me <= F.col("last"), F.lit(False)))
    numbered = F.coalesce(F.col("q").isNotNull() & edge & (me == F.col("last")) & F.col("partly").isNotNull(), F.lit(False))
    # a source without a crossing cell is wanted to its last word
    sampled = F.col("q").isNotNull() & ~numbered & F.when(F.col("cut1").isNull(), F.lit(True)).otherwise(inside)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(sampled, 1).otherwise(0)).otherwise(0).cast("long")
    return placed.withColumn("copies", copies).withColumn("numbered", numbered)


def _with_numbered(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of groups taken in part: the first ``partly`` of each get one copy more. Numbered partition by partition, not in one task."""
    if plan.filter("partly IS NOT NULL").isEmpty():
        return rows
    alike = checkpoint(rows.filter("numbered")).withColumn("at", F.monotonically_increasing_id())
    alike = alike.withColumn("part", F.shiftright("at", 33))
    counts = alike.groupBy("source", "part").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = checkpoint(counts.select(F.col("source").alias("s5"), F.col("part").alias("part5"), before.alias("ahead")))
    place = F.row_number().over(Window.partitionBy("source", "part").orderBy("at"))
    alike = alike.withColumn("place_", place).join(_small(counts), F.col("source").eqNullSafe(F.col("s5")) & (F.col("part") == F.col("part5")))
    alike = alike.withColumn("copies", F.col("copies") + (F.col("ahead") + F.col("place_") <= F.col("partly")).cast("long"))
    return rows.filter("NOT numbered").unionByName(alike.select(*rows.columns))


_PLANNED = ["source_size", "target", "whole", "rest", "cut1", "cut2", "last", "partly"]


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: str = "mix",
    inclusion: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, copies, taken (= size * copies).

    size is the number of words of the text (null: 0). Sources in code-point order, null last, weigh ``weights``,
    repeating, and share the sum of all sizes; a target stops at ``max_repeats`` times its source's size, the excess
    goes to the other sources by weight. ``inclusion`` names a positive column that makes some documents likelier
    to be sampled than others (inclusion probability in proportion, 1 at most); without it all documents of a source
    are equally likely. The document at which the words run out is taken if more than half of it is wanted.
    Draws depend on seed and doc_id alone (of rows without a doc_id: on the text), so reruns agree; rows that tie in rank go by
    doc_id, size and text hash, and of rows alike in all of these as many are taken as are wanted, so a source's words
    come within half a document of its target however often a row repeats. Documents without words take nothing.
    Long texts count whole. An empty table gives an empty result; other columns are ignored.
    """
    rows = checkpoint(docs.select(*_rows(docs, doc_id, text, source, seed, inclusion)))
    plan = _plan(rows, weights, max_repeats)
    out = _with_numbered(_copies(_placed(rows, plan, [*_ROW, *_PLANNED])), plan)
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: str = "mix",
    inclusion: str | None = None,
) -> DataFrame:
    """The mix itself: the rows of ``docs``, all their columns, whatever their names, as often as ``mix`` takes them.

    Nulls, ties, repeated rows, long texts and documents without words as in ``mix``; an empty table gives an empty table.
    The plan, a row per source, goes to the documents; texts don't move.
    """
    rows = checkpoint(docs.select(*_rows(docs, doc_id, text, source, seed, inclusion)))
    plan = _plan(rows, weights, max_repeats)
    whole = docs.select(*_rows(docs, doc_id, text, source, seed, inclusion), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    out = _with_numbered(_copies(_placed(whole, plan, [*_ROW, *_PLANNED, "row"])), plan)
    out = out.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns])


#: A side of one row per source is broadcast up to this many rows, which a count has checked; beyond, it is shuffled.
BROADCAST_ROWS = 100_000


def _small(per_source: DataFrame) -> DataFrame:
    return F.broadcast(per_source) if per_source.count() <= BROADCAST_ROWS else per_source
