"""Spans of pattern matches as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<entity_type:string,start:int,end:int,score:double,text:string>"
SPANS = f"array<{SPAN}>"
#: Marks around matches while they are cut out; the scan copy of a text has none of its own.
OPEN, CLOSE, FILLER = "\u0001", "\u0002", "\u0003"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(entity: str | Column, start: Column, end: Column, score: float | Column, text: Column) -> Column:
    kind = F.lit(entity) if isinstance(entity, str) else entity
    value = F.lit(float(score)) if isinstance(score, (int, float)) else score
    return F.struct(kind.alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"), value.cast("double").alias("score"), text.alias("text"))


def _ends(pieces: Column, between: int = 0) -> Column:
    """Where each piece ends, if ``between`` characters lie between two. Integers only: structs are built once, later."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        return F.struct((end + between).alias("at"), F.array_append(state["out"], end).alias("out"))

    return F.aggregate(pieces, start, step, lambda s: s["out"])


def with_value(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_spans(text: Column, pattern: str, entity: str, score: float | Column) -> Column:
    """All matches of ``pattern`` from left to right, with code-point offsets. Digits, spaces and word classes are
    Unicode's. The pattern may look around but must not capture.

    Matches are bracketed by marks, the text is cut at the marks (every second piece is a match), and the lengths of the
    pieces add up to offsets. Texts without a match are read once.
    """
    copy = F.translate(text, OPEN + CLOSE, FILLER * 2)
    pieces = F.split(F.regexp_replace(copy, f"(?U)({pattern})", f"{OPEN}$1{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)

    def found(p: Column) -> Column:
        hit = lambda ends: F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), lambda i: span(entity, F.get(ends, i - 1), F.get(ends, i), score, F.get(p, i)))
        return F.when(F.size(p) > 2, with_value(_ends(p), hit)).otherwise(no_spans())

    return F.when(text.rlike(f"(?U){pattern}"), with_value(pieces, found)).otherwise(no_spans())


def find_literal(text: Column, word: str, entity: str, score: float) -> Column:
    """All occurrences of ``word`` that don't overlap, from left to right."""
    quoted = "".join(f"\\x{{{ord(c):x}}}" for c in word)
    hit = lambda ends: F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda e: span(entity, e, e + len(word), score, F.lit(word)))
    found = lambda p: with_value(_ends(p, len(word)), hit)
    return F.when(F.contains(text, F.lit(word)), with_value(F.split(text, quoted, -1), found)).otherwise(no_spans())


def overlap(a: Column, b: Column) -> Column:
    """Whether two spans share a character; spans that touch don't."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])
