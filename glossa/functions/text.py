"""Column helpers for text with positions. Offsets are 0-based code points; spans are half-open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of a word, a short form and the like.
WORD = "[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"
SHORT_FORM = "[A-Za-z][A-Za-z0-9-]*"
#: Unicode word characters, in a form that Java and RE2 read alike.
WORD_CHARS = r"[\p{L}\p{N}_]+"


def text_at(text: Column, start: Column, end: Column) -> Column:
    """The characters [start, end) of text."""
    return F.substring(text, start + 1, end - start)


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def fold(c: Column) -> Column:
    """Lower case, character by character: offsets stay. (The one letter whose lower-case form is longer becomes another that is no ASCII letter.)"""
    return F.lower(F.translate(c, "İ", "ı"))


def quoted(needle: Column) -> Column:
    """A pattern that matches the needle, whatever is in it."""
    return F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


#: Results of a fold are gathered in pieces of this many, so that a long fold doesn't copy all of them at each step.
PIECE = 256


def scan(items: Column, kind: str, state: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]]) -> Column:
    """array<kind>: what ``step(state, item)`` emits (an array) over the items, in order; it also gives the next state."""
    none = F.array().cast(f"array<{kind}>")
    begin = F.struct(*[c.alias(n) for n, c in state.items()], none.alias("now"), F.array().cast(f"array<array<{kind}>>").alias("done"))

    def one(acc: Column, x: Column) -> Column:
        after, out = step(acc, x)
        now, full = F.concat(acc["now"], out), F.size(acc["now"]) >= PIECE
        kept = (F.when(full, out).otherwise(now), F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))
        return F.struct(*[c.alias(n) for n, c in after.items()], kept[0].alias("now"), kept[1].alias("done"))

    return F.aggregate(items, begin, one, lambda acc: F.concat(F.flatten(acc["done"]), acc["now"]))


def starts(sizes: Column) -> Column:
    """array<bigint>: for each size the sum of those before it."""
    return scan(sizes, "bigint", {"at": F.lit(0).cast("long")}, lambda acc, n: ({"at": (acc["at"] + n).cast("long")}, F.array(acc["at"])))


def openings(text: Column) -> Column:
    """array<struct<open, content>>: each ``(`` with no other parenthesis before its ``)``; open is its offset, content what is inside."""
    parts = F.split(text, r"\(", -1)
    at = starts(F.transform(parts, lambda p: F.length(p) + 1))
    found = F.filter(F.zip_with(at, parts, lambda x, p: F.struct((x - 1).alias("open"), p.alias("part"))), lambda x: (x["open"] >= 0) & F.contains(x["part"], F.lit(")")))
    return F.transform(found, lambda x: F.struct(x["open"].alias("open"), F.substring_index(x["part"], ")", 1).alias("content")))


#: Characters before an offset that are looked at first.
TAIL = 512


def backwards(text: Column, before: Column, pattern: Column | str, group: int, open_end: str) -> Column:
    """What the pattern finds, group by group, in the text before an offset, read backwards.

    The last ``TAIL`` characters come first. They settle it if what is left of them after the match has a character of ``open_end``, beyond
    which the match can't go; otherwise the whole text before the offset is read.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    n = F.least(before, F.lit(TAIL)).cast("int")
    tail = F.reverse(F.substring(text, (before - n + 1).cast("int"), n))
    whole = F.call_function("regexp_extract", tail, pattern, F.lit(0))
    rest = F.substring(tail, F.length(whole) + 1, F.lit(TAIL))
    settled = (before <= TAIL) | (F.length(whole) > 0) & rest.rlike(open_end)
    return F.when(settled, F.call_function("regexp_extract", tail, pattern, F.lit(group))).otherwise(
        F.call_function("regexp_extract", F.reverse(F.substring(text, F.lit(1), before.cast("int"))), pattern, F.lit(group))
    )


def last_words(text: Column, before: Column, most: Column) -> Column:
    """struct<start, end, words>: the span of the last ``most`` words that end at or before offset ``before``, and the window itself.

    Without a word ``start`` is null.
    """
    # a word is the same read backwards; a further word after the match shows that the match is not cut short
    pattern = F.concat(F.lit(f"^([^A-Za-z0-9]*)({WORD}(?:[^A-Za-z0-9]+{WORD}){{0,"), (most - 1).cast("string"), F.lit("})"))
    window = backwards(text, before, pattern, 2, "[A-Za-z0-9]")
    end = (before - F.length(backwards(text, before, pattern, 1, "[A-Za-z0-9]"))).cast("long")
    return F.when(
        F.length(window) > 0, F.struct((end - F.length(window)).cast("long").alias("start"), end.alias("end"), F.reverse(window).alias("window"))
    )


def occurrences(text: Column, needle: Column) -> Column:
    """Offsets of all occurrences of needle, without overlaps, from the left; empty for an empty needle."""
    parts = F.split(text, quoted(needle), -1)
    # the part after an occurrence starts where it ends; the text is split once
    after = F.slice(starts(F.transform(parts, lambda p: F.length(p) + F.length(needle))), F.lit(2), F.lit(1 << 30))
    return F.when(F.length(needle) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(after, lambda x: x - F.length(needle)))


def all_occurrences(text: Column, needle: Column) -> Column:
    """Offsets of all occurrences of needle, overlapping ones too; empty for an empty needle."""
    parts = F.split(text, F.concat(F.lit("(?="), quoted(needle), F.lit(")")), -1)
    at = starts(F.transform(parts, F.length))
    found = F.filter(at, lambda x: (x > 0) | F.startswith(text, needle))
    return F.when(F.length(needle) == 0, F.array().cast("array<bigint>")).otherwise(found)


def place(text: Column, needle: Column) -> tuple[Column, Column]:
    """Offset of the first occurrence of needle (null without one, and for an empty needle), and whether there is another, maybe overlapping it."""
    first = F.when(F.length(needle) > 0, F.call_function("locate", needle, text, F.lit(1)))
    return F.when(first > 0, first - 1), F.when(first > 0, F.call_function("locate", needle, text, first + 1) > 0).otherwise(False)


def matches(text: Column, pattern: Column) -> Column:
    """array<struct<s, e>>: the spans of all matches of a pattern that never matches nothing."""
    parts = F.split(text, pattern, -1)
    hits = F.call_function("regexp_extract_all", text, pattern, F.lit(0))
    sizes = F.transform(hits, F.length)
    at = starts(F.zip_with(F.slice(parts, F.lit(1), F.size(hits)), sizes, lambda p, n: F.length(p) + n))
    s = F.zip_with(at, F.slice(parts, F.lit(1), F.size(hits)), lambda x, p: (x + F.length(p)).cast("long"))
    return F.zip_with(s, sizes, lambda x, n: F.struct(x.alias("s"), (x + n).cast("long").alias("e")))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))
