"""Quality rules whose cutoffs are certified on labelled documents.

Each rule rejects a document whose measure exceeds a cutoff. Good labelled documents are halved by a hash of their id.
The first half proposes, for each stratum, a short sequence of ever stricter sets of cutoffs. The second half, which
had no part in that, certifies them: the exact (Clopper-Pearson) upper bound of the share of good documents that all
rules of a set together reject must stay within ``alpha``. Sets are tested from the mildest on and testing stops at
the first failure (fixed sequence: no further correction inside a stratum); the error level ``delta`` is divided among
the strata (Bonferroni). So with confidence 1 - delta the rules reject, in every stratum, at most ``alpha`` of the good
documents that the base rules let pass; what the base rules reject comes on top and isn't bounded. Where nothing is certified (few labels) the rules are off and only the base rules reject.

Measures are of whole texts. Null texts have no words; rows with null ids have no label; a null stratum is one of its
own; a document with several labels counts by its lowest quality. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, key_filter, materialise, mix, signed, slices, split_words, texts_of, window_hashes, word_hashes

#: Words of a window for repetition.
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: Ladders of cutoffs from mild to strict. Fixed beforehand: they do not depend on the data.
LADDERS = {
    "symbol_share": [2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05],
    "shout_share": [2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05],
    "upper_share": [0.95, 0.8, 0.6, 0.45, 0.35, 0.25, 0.18, 0.12],
    "dup_line_share": [0.9, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05],
    "repeat_share": [0.25, 0.2, 0.15, 0.1, 0.07, 0.04],
    "twin_share": [0.8, 0.6, 0.45, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05],
    "mean_word_chars": [60.0, 40.0, 30.0, 22.0, 17.0, 14.0, 12.0, 11.0],
    "digit_share": [0.8, 0.6, 0.45, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05],
}
#: Sets to propose, mildest first: the share of good documents that a rule may reject in the proposing half, and steps back from there.
SETS = [(0.0, 2), (0.0, 1), (0.0, 0), (0.0005, 0), (0.002, 0)]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_upper", "n_digits", "n_twins")


def _count(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def repeated_words(rows: np.ndarray, hashes: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """Words in windows that occur twice or more in their text, for each of n texts."""
    if len(hashes) < window:
        return np.zeros(n, np.int64)
    inside = rows[window - 1 :] == rows[: len(rows) - window + 1]
    start = np.flatnonzero(inside)
    with np.errstate(over="ignore"):
        key = mix(window_hashes(hashes, window)[start] + mix(rows[start].astype(np.uint64), 3), 4)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[start[twice]] += 1
    np.subtract.at(edge, start[twice] + window, 1)
    return np.bincount(rows[np.cumsum(edge[:-1]) > 0], minlength=n).astype(np.int64)


def _lines(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal to an earlier one."""
    lists = pc.split_pattern(texts, "\n")
    flat = lists.flatten()
    row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.match_substring_regex(flat, r"[^\x20\x09-\x0D]")
    row = row[full.to_numpy(zero_copy_only=False)]
    coded = flat.filter(full).dictionary_encode()
    key = row * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False)
    distinct = np.unique(key) // (len(coded.dictionary) + 1)
    lines = np.bincount(row, minlength=n)
    return lines, lines - np.bincount(distinct, minlength=n)


def _measure(known):
    """Counts of each text; with a filter of ids, of the rows that it lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if known is not None:
                b = b.filter(pa.array(known.value.passes(column(b, "hash").to_numpy().view(np.uint64))))
            yield from map(_counts, slices(iter([b]), "text"))

    return run


def _counts(b: pa.RecordBatch) -> pa.RecordBatch:
    texts, n = texts_of(b), b.num_rows
    words, row = split_words(texts)
    hashes = word_hashes(words)
    lines, dups = _lines(texts, n)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    twins = row[1:][(hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])]
    out = {
        "n_words": np.bincount(row, minlength=n), "word_chars": np.bincount(row, weights=chars, minlength=n), "n_symbols": _count(texts, SYMBOLS), "n_dup_lines": dups,
        "n_repeat_words": repeated_words(row, hashes, n), "n_lines": lines, "n_shouts": _count(texts, "[!?]"), "n_upper": _count(texts, r"\p{Lu}"), "n_digits": _count(texts, "[0-9]"),
        "n_twins": np.bincount(twins, minlength=n),
    }
    return pa.RecordBatch.from_arrays([column(b, "row"), *[pa.array(out[k].astype(np.int64)) for k in COUNTS]], names=["row", *COUNTS])


def measures(docs: DataFrame, carry: list[str], known=None) -> DataFrame:
    """A struct ``row`` of the ``carry`` columns, the counts, the rules' measures and base_failed for every row of ``docs``
    (of those whose hashed doc_id a filter lets through, if there is one)."""
    packed = docs.select(F.struct(*carry).alias("row"), F.xxhash64("doc_id").alias("hash"), "text")
    out = packed.mapInArrow(_measure(known), f"row {packed.schema['row'].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in COUNTS))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return out.select(
        "row", *COUNTS, share("n_symbols", "n_words").alias("symbol_share"), share("n_shouts", "n_words").alias("shout_share"), share("n_upper", "word_chars").alias("upper_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"), share("n_twins", "n_words").alias("twin_share"),
        share("word_chars", "n_words").alias("mean_word_chars"), share("n_digits", "word_chars").alias("digit_share"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def binomial_upper(k: int, n: int, delta: float) -> float:
    """Exact upper confidence bound of a share of which k of n were seen: P(X <= k) = delta at the bound."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - _beta_tail(k + 1, n - k, mid) > delta else (low, mid)
    return high


def choose(counts: dict[str, list[int]], n: int, budget: float, back: int = 0) -> dict[str, float | None]:
    """For each rule the strictest cutoff that rejects at most ``budget`` of n good documents, ``back`` steps of the ladder milder; None: the rule is off."""
    out: dict[str, float | None] = {}
    for rule, ladder in LADDERS.items():
        fits = [i for i, k in enumerate(counts[rule]) if n and k <= budget * n]
        out[rule] = ladder[max(fits) - back] if fits and max(fits) >= back else None
    return out


def certify(tried: list[tuple[int, int]], n: int, alpha: float, delta: float) -> int | None:
    """The last level of a fixed sequence of (level, rejected of n) whose exact bounds all keep to ``alpha``."""
    best = None
    for level, k in sorted(tried):
        if binomial_upper(int(k), int(n), delta) > alpha:
            break
        best = level
    return best


def _rejected(prefix: str = "max_"):
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(k) > F.col(f"{prefix}{k}"), F.lit(False)) for k in LADDERS])


def _stratum(name: str):
    """A key for a stratum; null is a stratum of its own, and not the empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col("row")[name].cast("string")), F.lit("null")).alias("stratum")


def cutoffs(docs: DataFrame, labels: DataFrame, stratum: str, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """stratum and a cutoff (or null) for each rule.

    Only labelled documents are measured: a filter of fixed size keeps nearly all others out, a join the rest. Those that
    fail the base rules are gone whatever the method says; they take no part.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    measured = measures(docs, ["doc_id", stratum], key_filter(good.select(F.xxhash64("doc_id"))))
    known = measured.where("not base_failed").select("row.doc_id", _stratum(stratum), *LADDERS)
    held = known.join(good, "doc_id")
    held = materialise(held.select("stratum", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0).alias("first"), *LADDERS), "rule-holdout")
    tried = [F.sum((F.col(rule) > c).cast("long")).alias(f"{rule}_{i}") for rule, ladder in LADDERS.items() for i, c in enumerate(ladder)]
    seen = held.where("first").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *tried)
    names = [f"max_{k}" for k in LADDERS]

    def propose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for x in f.to_dict("records"):
                for level, (budget, back) in enumerate(SETS):
                    found = choose({r: [x[f"{r}_{i}"] for i in range(len(ladder))] for r, ladder in LADDERS.items()}, int(x["n"]), budget, back)
                    rows.append({"stratum": x["stratum"], "level": level, **{f"max_{k}": v for k, v in found.items()}})
            yield pd.DataFrame(rows, columns=["stratum", "level", *names]).astype({k: "float64" for k in names})

    proposed = materialise(seen.mapInPandas(propose, "stratum string, level int, " + ", ".join(f"{k} double" for k in names)), "rule-proposals")
    strata = max(1, proposed.where("level = 0").count())
    second = held.where("not first").join(proposed, "stratum").groupBy("stratum", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(_rejected().cast("long")).alias("k"))
    listed = second.groupBy("stratum").agg(F.max("n").alias("n"), F.collect_list(F.struct("level", "k")).alias("tried"))

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(x["stratum"], certify([(t["level"], t["k"]) for t in x["tried"]], x["n"], alpha, delta / strata)) for x in f.to_dict("records")]
            yield pd.DataFrame([r for r in rows if r[1] is not None], columns=["stratum", "level"]).astype({"level": "int32"})

    return materialise(listed.mapInPandas(settle, "stratum string, level int").join(proposed, ["stratum", "level"]), "rule-cutoffs")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", carry: list[str] | None = None, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """doc_id, counts, measures, base_failed, kept, and a struct ``row`` of the ``carry`` columns for every row of ``docs``.

    Extra columns may have any names: they stay inside ``row``.
    """
    chosen = cutoffs(docs, labels, stratum, alpha, delta)
    table = measures(docs, list(dict.fromkeys(["doc_id", stratum, *(carry or [])]))).withColumn("stratum", _stratum(stratum))
    judged = table.join(chosen, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~_rejected())
    return judged.select("row.doc_id", *COUNTS, *LADDERS, "base_failed", "kept", "row")
