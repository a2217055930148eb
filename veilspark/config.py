"""Settings of a detection or anonymization plan. Immutable: a change gives a new object, so plans can't race."""

from __future__ import annotations

import dataclasses
import datetime
from collections.abc import Mapping
from dataclasses import dataclass, field

from . import constants as C


@dataclass(frozen=True)
class PiiConfig:
    """entities: types to look for (None: all). score_threshold: replaces the thresholds by type. The default threshold
    is a floor that always holds. as_of: latest birth date (None: today). context_boost: raise scores after context words."""

    entities: tuple[str, ...] | None = None
    score_threshold: float | None = None
    thresholds: Mapping[str, float] = field(default_factory=lambda: dict(C.THRESHOLDS))
    default_threshold: float = C.DEFAULT_THRESHOLD
    priorities: Mapping[str, int] = field(default_factory=lambda: dict(C.PRIORITIES))
    allow_list: tuple[str, ...] = ()
    name_allow_list: tuple[str, ...] = ()
    name_deny_list: tuple[str, ...] = ()
    context_boost: bool = False
    allow_x_check_digit: bool = False
    all_occurrences: bool = False
    as_of: datetime.date | None = None
    recognizers: tuple = ()
    ie_column: str | None = None

    def __post_init__(self) -> None:
        own = {e for r in self.recognizers for e in r.entities}
        unknown = set(self.entities or ()) - set(C.ENTITIES) - own
        if unknown:
            raise ValueError(f"unknown entity types: {sorted(unknown)}")
        if self.score_threshold is not None and not 0 <= self.score_threshold <= 1:
            raise ValueError("score_threshold must be from 0 to 1")

    def replace(self, **changes) -> PiiConfig:
        return dataclasses.replace(self, **changes)

    def wants(self, entity: str) -> bool:
        return self.entities is None or entity in self.entities

    def add_recognizer(self, recognizer) -> PiiConfig:
        return self.replace(recognizers=(*self.recognizers, recognizer))

    def update_name_lists(self, allow: list[str] | None = None, deny: list[str] | None = None) -> PiiConfig:
        """New name lists; blank entries and white space around names are dropped. None leaves a list as it is."""
        tidy = lambda names: tuple(n.strip() for n in names if n and n.strip())
        return self.replace(
            name_allow_list=self.name_allow_list if allow is None else tidy(allow), name_deny_list=self.name_deny_list if deny is None else tidy(deny)
        )

    def threshold_of(self, entity: str) -> float:
        return self.thresholds.get(entity, self.default_threshold)

    @classmethod
    def from_env(cls, env: Mapping[str, str], **changes) -> PiiConfig:
        """Settings by case-insensitive names: SCORE_THRESHOLD_<PHONE|ID_CARD|...|DEFAULT>, NAME_ALLOW_LIST, NAME_DENY_LIST."""
        low = {k.lower(): v for k, v in env.items()}
        short = {"phone": C.PHONE, "id_card": C.ID_CARD, "bank_card": C.BANK_CARD, "passport": C.PASSPORT, "email": C.EMAIL, "name": C.NAME, "address": C.ADDRESS}
        limits = dict(C.THRESHOLDS) | {e: float(low[f"score_threshold_{s}"]) for s, e in short.items() if f"score_threshold_{s}" in low}
        base = cls(thresholds=limits, default_threshold=float(low.get("score_threshold_default", C.DEFAULT_THRESHOLD)), **changes)
        split = lambda k: low[k].split(",") if k in low else None
        return base.update_name_lists(split("name_allow_list"), split("name_deny_list"))


def supported_entities(language: str = "zh") -> list[str]:
    if language not in C.LANGUAGES:
        raise ValueError(f"unsupported language: {language}")
    return list(C.ENTITIES)
