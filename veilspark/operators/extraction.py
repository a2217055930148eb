"""Names and addresses by a pluggable extraction model, over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokenize import tokens
from ..functions.validators import needs_extraction

RESULT = "map<string,array<struct<text:string,probability:double>>>"
Model = Callable[[list[str]], list[dict[str, list[dict]]]]


def with_extractions(df: DataFrame, make_model: Callable[[], Model], text_col: str = "text", out: str = "ie", batch: int = 32, prefilter: bool = True, keys: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` with a model's extractions as a map column. ``make_model`` runs once in each Python worker.

    Texts that can't hold a name or an address reach the worker as null and the model not at all. A model that fails
    on a batch leaves its rows empty; nothing is raised. ``keys``: only these are asked for (None: all that it finds).
    The column is the cache of a batch: whatever reads it later costs no call of the model.
    """

    @F.pandas_udf(RESULT)
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for texts in parts:
            found: list[dict] = [{} for _ in range(len(texts))]
            at = [i for i, t in enumerate(texts) if t]
            unique = list(dict.fromkeys(texts.iloc[i] for i in at))
            known: dict[str, dict] = {}
            for k in range(0, len(unique), batch):
                try:
                    known |= dict(zip(unique[k : k + batch], model(unique[k : k + batch]), strict=True))
                except Exception:  # noqa: BLE001  a model's own failures must not fail the job
                    continue
            for i in at:
                found[i] = known.get(texts.iloc[i], {})
            yield pd.Series(found)

    text = F.col(text_col)
    found = extract(F.when(needs_extraction(text), text) if prefilter else text)
    return df.withColumn(out, F.map_filter(found, lambda k, v: k.isin(list(keys))) if keys is not None else found)


def with_tokens(df: DataFrame, make_tokenizer: Callable[[], Callable[[str], list[str]]] | None = None, text_col: str = "text", out: str = "tokens") -> DataFrame:
    """``df`` with the tokens of each text by a pluggable tokenizer, made once in each Python worker; by the native rules
    without one, and for texts on which it fails. Null texts have no tokens."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    if make_tokenizer is None:
        return df.withColumn(out, tokens(text))

    @F.pandas_udf("array<string>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make_tokenizer()

        def one(t: str):
            try:
                return tokenizer(t) if t else []
            except Exception:  # noqa: BLE001  a tokenizer's own failures must not fail the job
                return None

        for texts in parts:
            yield texts.map(one)

    return df.withColumn(out, F.coalesce(cut(text), tokens(text)))


class ListModel:
    """A stand-in for a neural model: values of given lists that a text contains, with a fixed probability."""

    def __init__(self, values: dict[str, list[str]], probability: float = 0.9):
        self.values, self.probability = values, probability

    def __call__(self, texts: list[str]) -> list[dict[str, list[dict]]]:
        return [{k: [{"text": v, "probability": self.probability} for v in vs if v in t] for k, vs in self.values.items()} for t in texts]
