"""Recognizers: text column in, array of spans out. Built-ins are native columns."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from ..config import PiiConfig
from ..functions import validators as V
from ..functions.spans import find_literal, find_spans, no_spans, span
from .resolve import best_by_position, drop_contained, merge_phones

#: No pattern hit can be in a text without a mail sign or six digits that only separators part.
GUARD = r"(?U)@|\d(?:[\s\-]*\d){5}"


class Recognizer(Protocol):
    """A custom recognizer: the types it finds, and its spans (as :data:`veilspark.functions.spans.SPANS`)."""

    entities: tuple[str, ...]

    def spans(self, text: Column) -> Column: ...


def phone_spans(text: Column, config: PiiConfig | None = None) -> Column:
    """Three scans; hits that aren't numbers, or that adjoin five more digits, go; overlapping ones are merged."""
    ok = lambda s: V.is_phone(s["text"]) & ~V.in_digit_run(text, s["start"], s["end"])
    hits = [F.filter(find_spans(text, p, C.PHONE, score), ok) for p, score in C.PHONE_PATTERNS]
    return merge_phones(F.concat(*hits))


def id_card_spans(text: Column, config: PiiConfig | None = None) -> Column:
    """Numbers of 18 digits, and of 19 that are one digit too long (a reading error): those whole."""
    config = config or PiiConfig()
    pattern = C.ID_CARD_X_PATTERN if config.allow_x_check_digit else C.ID_CARD_PATTERN
    plain = F.filter(find_spans(text, pattern, C.ID_CARD, C.ID_CARD_SCORE), lambda s: V.is_id_card(s["text"], config.as_of))
    longer = F.filter(find_spans(text, C.ID_CARD_LONG_PATTERN, C.ID_CARD, C.ID_CARD_LONG_SCORE), lambda s: V.is_repairable_id_card(s["text"], config.as_of))
    return F.concat(plain, longer)


def bank_card_spans(text: Column, config: PiiConfig | None = None) -> Column:
    hits = F.filter(find_spans(text, C.BANK_CARD_PATTERN, C.BANK_CARD, 0.0), lambda s: V.is_bank_card(s["text"]))
    return F.transform(hits, lambda s: s.withField("score", V.bank_card_score(s["text"])))


def passport_spans(text: Column, config: PiiConfig | None = None) -> Column:
    """Scans take either case, as pattern recognizers do; only upper-case numbers pass the check after that."""
    hits = F.concat(*[find_spans(text, f"(?i:{p})", C.PASSPORT, score) for p, score in C.PASSPORT_PATTERNS])
    return F.filter(drop_contained(hits), lambda s: V.is_passport(s["text"]))


def email_spans(text: Column, config: PiiConfig | None = None) -> Column:
    hits = F.filter(find_spans(text, C.EMAIL_PATTERN, C.EMAIL, 0.0), lambda s: V.is_email(s["text"]))
    return F.transform(hits, lambda s: s.withField("score", V.email_score(s["text"])))


def extracted_spans(text: Column, found: Column, keys: tuple[str, ...], entity: str, least: int = 1, all_occurrences: bool = False) -> Column:
    """Spans of a model's extractions (map of key to array of text and probability): where each value first occurs."""
    items = F.flatten(F.array(*[F.coalesce(F.element_at(found, F.lit(k)), F.array().cast("array<struct<text:string,probability:double>>")) for k in keys]))
    long = F.filter(items, lambda x: F.length(x["text"]) >= F.lit(max(1, least)))

    def place(x: Column) -> Column:
        at = F.position(x["text"], text)
        return span(entity, at - 1, at - 1 + F.length(x["text"]), F.coalesce(x["probability"], F.lit(0.85)), x["text"])

    def places(x: Column) -> Column:
        pieces = F.split(text, F.concat(F.lit("\\Q"), x["text"], F.lit("\\E")), -1)
        start = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))
        step = lambda s, p: F.struct(
            (s["at"] + F.length(p) + F.length(x["text"])).alias("at"),
            F.array_append(s["out"], span(entity, s["at"] + F.length(p), s["at"] + F.length(p) + F.length(x["text"]), F.coalesce(x["probability"], F.lit(0.85)), x["text"])).alias("out"),
        )
        return F.aggregate(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), start, step, lambda s: s["out"])

    hits = F.flatten(F.transform(long, places)) if all_occurrences else F.filter(F.transform(long, place), lambda s: s["start"] >= 0)
    return F.coalesce(best_by_position(hits), no_spans())


def address_spans(text: Column, config: PiiConfig | None = None) -> Column:
    config = config or PiiConfig()
    if not config.ie_column:
        return no_spans()
    return extracted_spans(text, F.col(config.ie_column), C.ADDRESS_KEYS, C.ADDRESS, C.MIN_ADDRESS, config.all_occurrences)


def name_spans(text: Column, config: PiiConfig | None = None) -> Column:
    """Listed names anywhere (score 1) and extracted names that aren't allowed; a listed name wins its position."""
    config = config or PiiConfig()
    listed = F.concat(*[find_literal(text, n, C.NAME, 1.0) for n in config.name_deny_list]) if config.name_deny_list else no_spans()
    if not config.ie_column:
        return listed
    found = extracted_spans(text, F.col(config.ie_column), C.NAME_KEYS, C.NAME, 1, config.all_occurrences)
    taken = lambda s: F.exists(listed, lambda x: (x["start"] == s["start"]) & (x["end"] == s["end"]))
    return F.concat(listed, F.filter(found, lambda s: ~s["text"].isin(list(config.name_allow_list)) & ~taken(s)))


PATTERN_RECOGNIZERS = {C.PHONE: phone_spans, C.ID_CARD: id_card_spans, C.BANK_CARD: bank_card_spans, C.PASSPORT: passport_spans, C.EMAIL: email_spans}
OTHER_RECOGNIZERS = {C.ADDRESS: address_spans, C.NAME: name_spans}


def scan(text: Column, config: PiiConfig) -> Column:
    """Spans of all wanted types; types that aren't wanted aren't planned. One cheap test lets most texts skip all patterns."""
    patterns = [f(text, config) for e, f in PATTERN_RECOGNIZERS.items() if config.wants(e)]
    parts = [F.when(text.rlike(GUARD), F.concat(*patterns)).otherwise(no_spans())] if patterns else []
    parts += [f(text, config) for e, f in OTHER_RECOGNIZERS.items() if config.wants(e)]
    parts += [F.coalesce(r.spans(text), no_spans()) for r in config.recognizers if any(config.wants(e) for e in r.entities)]
    return F.concat(*parts) if parts else no_spans()
