"""Detection as SQL functions."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .. import constants as C


def register(spark: SparkSession) -> None:
    """``SELECT * FROM pii_candidates('...')``, also LATERAL: unchecked pattern hits of a text, for exploration in SQL.
    The plans of this package use native columns instead."""

    @udtf(returnType="entity_type string, start int, end int, score double, value string")
    class Candidates:
        def eval(self, text: str):
            patterns = [*((p, s, C.PHONE) for p, s in C.PHONE_PATTERNS), (C.ID_CARD_PATTERN, C.ID_CARD_SCORE, C.ID_CARD), (C.BANK_CARD_PATTERN, C.BANK_CARD_SCORES[1], C.BANK_CARD)]
            patterns += [*((p, s, C.PASSPORT) for p, s in C.PASSPORT_PATTERNS), (C.EMAIL_PATTERN, C.EMAIL_SCORES[1], C.EMAIL)]
            for pattern, score, entity in patterns:
                for m in re.finditer(pattern, text or ""):
                    yield entity, m.start(), m.end(), score, m[0]

    spark.udtf.register("pii_candidates", Candidates)
