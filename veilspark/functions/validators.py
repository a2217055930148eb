"""Checks of candidate values as native columns."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .spans import with_value

#: Eight digits that are a day of the calendar: months of 31 and 30 days, February, and its 29th in leap years.
CALENDAR_DAY = (
    r"^(?:\d{4}(?:(?:0[13578]|1[02])(?:0[1-9]|[12]\d|3[01])|(?:0[469]|11)(?:0[1-9]|[12]\d|30)|02(?:0[1-9]|1\d|2[0-8]))"
    r"|(?:\d\d(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)0229)\z"
)


def no_spaces(value: Column) -> Column:
    """Without ASCII spaces; other white space stays and makes a value invalid."""
    return F.replace(value, F.lit(" "))


def is_phone(value: Column) -> Column:
    bare = F.regexp_replace(value, r"(?U)[\s\-+]", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "^86", ""), "^0086", "")
    return bare.rlike(r"(?U)^1[3-9]\d{9}$")


def in_digit_run(text: Column, start: Column, end: Column, least: int = 5) -> Column:
    """Whether ``least`` or more digits adjoin a match, on both sides together."""
    left = F.substring(text, F.greatest(start - least, F.lit(0)) + 1, F.least(start, F.lit(least)))
    right = F.substring(text, end + 1, F.lit(least))
    run = lambda part, pattern: F.length(F.regexp_extract(part, pattern, 0))
    return run(left, r"(?U)\d*$") + run(right, r"(?U)^\d*") >= least


def is_birth_date(value: Column, as_of: datetime.date | Column | None = None) -> Column:
    """Eight digits that are a day of the calendar from 1900 to ``as_of`` (today by default)."""
    digits = lambda day: F.date_format(day, "yyyyMMdd")  # noqa: E731  in the order of days; no exception for each wrong date
    latest = digits(F.current_date()) if as_of is None else digits(as_of) if isinstance(as_of, Column) else F.lit(as_of.isoformat().replace("-", ""))
    return F.coalesce(value.rlike(CALENDAR_DAY) & value.between(F.lit("19000101"), latest), F.lit(False))


def has_check_digit(value: Column) -> Column:
    """Whether the last of 18 characters is the weighted sum of the others, mod 11."""
    total = reduce(lambda a, b: a + b, [F.substring(value, i + 1, 1).try_cast("int") * w for i, w in enumerate(C.CHECK_WEIGHTS)])
    return F.coalesce(F.substr(F.lit(C.CHECK_CHARACTERS), total % 11 + 1, F.lit(1)) == F.upper(F.substring(value, 18, 1)), F.lit(False))


def is_id_card(value: Column, as_of: datetime.date | Column | None = None) -> Column:
    province = lambda bare: F.substring(bare, 1, 2).isin([str(p) for p in C.PROVINCES])
    born = lambda bare: with_value(F.substring(bare, 7, 8), lambda day: is_birth_date(day, as_of))
    return with_value(no_spaces(value), lambda bare: (F.length(bare) == 18) & bare.rlike(r"^\d{17}[\dXx]$") & province(bare) & born(bare) & has_check_digit(bare))


def is_repairable_id_card(value: Column, as_of: datetime.date | Column | None = None) -> Column:
    """Whether 19 digits are a valid number once one of them is left out."""
    places = F.array(*[F.lit(i) for i in C.REPAIR_ORDER])
    without = lambda bare, i: F.concat(F.substr(bare, F.lit(1), i), F.substr(bare, i + 2, F.lit(19)))
    return with_value(no_spaces(value), lambda bare: (F.length(bare) == 19) & F.exists(places, lambda i: is_id_card(without(bare, i), as_of)))


def is_bank_card(value: Column) -> Column:
    bare = no_spaces(value)
    return bare.rlike(r"^\d{16,19}$") & F.coalesce(F.call_function("luhn_check", bare), F.lit(False))


def bank_card_score(value: Column) -> Column:
    known, other = C.BANK_CARD_SCORES
    return F.when(F.substring(no_spaces(value), 1, 6).isin(list(C.BANK_BINS)), F.lit(known)).otherwise(F.lit(other))


def is_passport(value: Column) -> Column:
    return F.length(value).between(6, 15) & value.rlike(r"^(?:[EG][A-Z]\d{8}|[A-Z]{1,2}\d{6,10}|[CH]\d{8,10})$")


def is_email(value: Column) -> Column:
    local, domain = F.regexp_extract(value, r"(?s)^(.*)@[^@]*$", 1), F.substring_index(value, "@", -1)
    dots = ~local.startswith(".") & ~local.endswith(".") & ~domain.startswith(".") & ~domain.endswith(".")
    return value.contains("@") & F.length(local).between(1, 64) & F.length(domain).between(1, 255) & dots & ~value.contains("..")


def email_score(value: Column) -> Column:
    known, other = C.EMAIL_SCORES
    return F.when(F.lower(F.substring_index(value, "@", -1)).isin(list(C.MAIL_DOMAINS)), F.lit(known)).otherwise(F.lit(other))


def needs_extraction(text: Column) -> Column:
    """Whether a text may hold names or addresses: two characters or more, not only digits, not only ASCII words, no label."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    labels = "|".join(C.LABELS)
    return (F.length(bare) >= 2) & ~bare.rlike(r"(?U)^[\d\s\-+\.]+$") & ~bare.rlike(r"(?U)^[a-zA-Z0-9\s\-_\.@]+$") & ~bare.rlike(f"(?iU)^(?:{labels})")


def is_stopword(word: Column) -> Column:
    return F.lower(word).isin(list(C.STOPWORDS))


def is_punctuation(word: Column) -> Column:
    return word.isin(list(C.PUNCTUATION))


def is_supported_language(language: Column) -> Column:
    return language.isin(list(C.LANGUAGES))


def request_error(text: Column, threshold: Column | None = None, keep_prefix: Column | None = None, keep_suffix: Column | None = None) -> Column:
    """Why a request row is invalid, or null."""
    checks = F.when(text.isNull() | (F.length(text) < 1), F.lit("text is empty")).when(F.length(text) > C.MAX_TEXT, F.lit("text is too long"))
    if threshold is not None:
        checks = checks.when((threshold < 0) | (threshold > 1), F.lit("score_threshold must be from 0 to 1"))
    for name, value in (("keep_prefix", keep_prefix), ("keep_suffix", keep_suffix)):
        if value is not None:
            checks = checks.when(value < 0, F.lit(f"{name} must not be negative"))
    return checks


def image_error(path: Column, size: Column | None = None) -> Column:
    """Why an image file is refused, or null."""
    kind = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    checks = F.when(~kind.isin(list(C.IMAGE_FORMATS)), F.concat(F.lit("unsupported image format: "), kind))
    return checks.when(size > C.MAX_IMAGE_BYTES, F.lit("image is too large")) if size is not None else checks
