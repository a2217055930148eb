"""Rule-based tokens, keywords and context words as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def tokens(text: Column) -> Column:
    """Runs of Chinese characters, of ASCII letters, of digits, and any other single character but white space."""
    return F.regexp_extract_all(text, F.lit(f"(?U){C.TOKEN_PATTERN}"), F.lit(0))


def token_offsets(found: Column) -> Column:
    """Running sums of token lengths. White space between tokens isn't counted, so offsets fall behind the text's."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(found, start, lambda s, t: F.struct((s["at"] + F.length(t)).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])


def keywords(found: Column) -> Column:
    return F.transform(F.filter(found, lambda t: (F.length(t) > 0) & ~t.isin(list(C.NO_KEYWORDS))), lambda t: F.lower(t))


def any_said(near: Column, words: tuple[str, ...]) -> Column:
    """Whether a keyword holds one of the words."""
    listed = F.array(*[F.lit(w) for w in words])
    return F.exists(near, lambda k: F.exists(listed, lambda w: k.contains(w)))


def boost(spans: Column, text: Column, entity_words: dict[str, tuple[str, ...]]) -> Column:
    """Raise the score of spans after one of their type's context words, among the few keywords before them."""

    def raised(s: Column) -> Column:
        before = keywords(tokens(F.substr(text, F.lit(1), s["start"])))
        near = F.slice(before, F.greatest(F.size(before) - (C.CONTEXT_WINDOW - 1), F.lit(1)), C.CONTEXT_WINDOW)
        said = F.lit(False)
        for entity, words in entity_words.items():
            said = F.when(s["entity_type"] == entity, any_said(near, words)).otherwise(said)
        score = F.when(said, F.least(F.greatest(s["score"] + C.CONTEXT_BOOST, F.lit(C.CONTEXT_FLOOR)), F.lit(1.0))).otherwise(s["score"])
        return s.withField("score", score)

    return F.transform(spans, raised)
