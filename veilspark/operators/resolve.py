"""Which of overlapping spans stay: folds over sorted arrays, in the row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.spans import no_spans, overlap, with_value


def _sorted(spans: Column, *keys) -> Column:
    """By keys, each a function of a span; spans that tie keep their order."""
    numbered = F.transform(spans, lambda s, i: F.struct(*[k(s).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(numbered), lambda x: x["s"])


def merge_phones(spans: Column) -> Column:
    """By start and falling score, a span stays unless it overlaps one that has stayed. Those end in order, so only the
    last of them can reach it."""
    ordered = _sorted(spans, lambda s: s["start"], lambda s: -s["score"])
    return F.aggregate(ordered, no_spans(), lambda kept, s: F.when((F.size(kept) > 0) & overlap(F.get(kept, F.size(kept) - 1), s), kept).otherwise(F.array_append(kept, s)))


def drop_contained(spans: Column) -> Column:
    """Spans of score 0 go, and those inside a span of the same type that comes before by score, start and length."""
    ordered = _sorted(F.filter(spans, lambda s: s["score"] > 0), lambda s: -s["score"], lambda s: s["start"], lambda s: s["start"] - s["end"])
    inside = lambda s, k: (k["entity_type"] == s["entity_type"]) & (k["start"] <= s["start"]) & (s["end"] <= k["end"])
    return F.aggregate(ordered, no_spans(), lambda kept, s: F.when(F.exists(kept, lambda k: inside(s, k)), kept).otherwise(F.array_append(kept, s)))


def by_priority(spans: Column, priorities: Mapping[str, int] | None = None) -> Column:
    """By start and end, a span that overlaps the last one kept replaces it if its type's number is smaller, else goes."""
    numbers = C.PRIORITIES if priorities is None else priorities
    table = F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv]) if numbers else None
    number = lambda s: F.coalesce(F.element_at(table, s["entity_type"]), F.lit(C.NO_PRIORITY)) if table is not None else F.lit(C.NO_PRIORITY)

    def step(kept: Column, s: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        clash = (F.size(kept) > 0) & overlap(last, s)
        return F.when(~clash, F.array_append(kept, s)).when(number(s) < number(last), F.array_append(F.slice(kept, 1, F.size(kept) - 1), s)).otherwise(kept)

    fold = lambda found: F.aggregate(_sorted(found, lambda s: s["start"], lambda s: s["end"]), no_spans(), step)
    return with_value(spans, lambda found: F.when(F.size(found) <= 1, found).otherwise(fold(found)))


def best_by_position(spans: Column) -> Column:
    """Of spans at one position the most probable."""
    ordered = _sorted(spans, lambda s: -s["score"])
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"])
    best = F.aggregate(ordered, no_spans(), lambda kept, s: F.when(F.exists(kept, lambda k: same(k, s)), kept).otherwise(F.array_append(kept, s)))
    return _sorted(best, lambda s: s["start"], lambda s: s["end"])
