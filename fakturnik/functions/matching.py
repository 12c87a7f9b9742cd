"""All matches of a pattern with their groups and byte spans, as one array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A typed match: value, confidence, half-open UTF-8 byte span, source text.
FOUND = "array<struct<text:string,groups:array<string>,start:int,end:int>>"


def find_all(text: Column, pattern: str, groups: int) -> Column:
    """Every match in order: its text, its groups ('' where a group took no part) and its byte span.

    The text is marked with control signs around each match and split at them, so the pattern runs once.
    """
    clean = F.translate(text, "\u0001\u0002", "  ")
    mark = "\u0001$0" + "".join(f"\u0002${g}" for g in range(1, groups + 1)) + "\u0001"
    parts = F.split(F.regexp_replace(clean, pattern, mark), "\u0001")
    pieces = F.transform(parts, lambda p, i: F.struct((i % 2 == 1).alias("hit"), F.split(p, "\u0002").alias("f")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(FOUND).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        whole = F.get(piece.f, F.lit(0))
        end = acc.pos + F.octet_length(whole)
        hit = F.struct(whole.alias("text"), F.slice(piece.f, 2, groups).alias("groups") if groups else F.array().cast("array<string>").alias("groups"), acc.pos.alias("start"), end.alias("end"))
        return F.struct(end.alias("pos"), F.when(piece.hit, F.array_append(acc.out, hit)).otherwise(acc.out).alias("out"))

    return F.when(text.isNotNull(), F.aggregate(pieces, start, step, lambda acc: acc.out))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def group(hit: Column, at: int) -> Column:
    return F.get(hit.groups, F.lit(at - 1))


def typed(hits: Column, value, confidence: float) -> Column:
    """Matches as struct<value, confidence, start, end, source>; those without a value are left out."""
    made = F.transform(hits, lambda h: F.struct(value(h).alias("value"), F.lit(confidence).cast("float").alias("confidence"), h.start.alias("start"), h.end.alias("end"), h.text.alias("source")))
    return F.filter(made, lambda m: m.value.isNotNull())


def and_then(first: Column, later: Column, same=lambda a, b: a.value == b.value) -> Column:
    """The first matches and those of the later ones whose value is new (the first of each value among the later)."""
    new = lambda f, l: F.filter(l, lambda m: ~F.exists(f, lambda k: same(k, m)))
    once = lambda l: F.filter(l, lambda m, i: ~F.exists(F.slice(l, 1, i), lambda k: same(k, m)))
    return let(first, lambda f: F.concat(f, let(new(f, later), once)))


def first(matches: Column) -> Column:
    return F.get(matches, F.lit(0)).value


def capture(text: Column, pattern: str, at: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, at), F.lit(""))


def stripped(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines as editors count them: a final newline opens no line, a carriage return before a newline goes."""
    return F.transform(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"), lambda t: F.regexp_replace(t, r"\r\z", ""))
