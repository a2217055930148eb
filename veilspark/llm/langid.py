"""Language of whole texts, and of the spans of mixed ones.

Training counts character n-grams (1 to 3, padded words, lower case) for each language over all training rows, and
which scripts its letters are in. A word gets a score for each language: the log probability of its grams under the
language's smoothed counts. The scripts of a word's letters, by ranges of code points, narrow the candidates: a
language none of whose training letters are in a script can't claim words in it. Viterbi over the words of a text with
a penalty for each switch labels spans; the language of most letters in the best path is the text's. Its score is the
share of those letters, tempered by how far the path's language beats the others for each word.

Gram counts are kept in ``BUCKETS`` hashed cells for each language, and every language of a training row is told apart.
The model grows with their number only and is broadcast; with more than ``MOST`` of them training stops with an error.
Null texts, and texts without a letter, are ``und`` with score 0. Rows without a language don't train. If there is
nothing to learn from, everything is ``und``. Repeated rows and null ids are just rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, buffers, column, mix, slices, texts_of

BUCKETS = 1 << 15
#: Most languages that a broadcast model has room for (128 kB each); more are an error.
MOST = 1024
#: Languages whose counts a task holds at a time, and for which slices of texts have their full size.
LANGUAGES = 64
#: Log probability that a switch of language costs.
SWITCH = 12.0
#: First code points of ranges of scripts, in order. Fixed values of the Unicode standard.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0x20000, "han"),
    (0x30000, "other"),
]
NAMES = sorted({n for _, n in SCRIPTS})
_STARTS = np.array([s for s, _ in SCRIPTS])
_KIND = np.array([NAMES.index(n) for _, n in SCRIPTS])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters and marks with a letter, lower case, and the row each comes from."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(spaced, " "), " ")
    flat = lists.flatten()
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.match_substring_regex(flat, r"\p{L}")
    return flat.filter(full), row[full.to_numpy(zero_copy_only=False)]


def grams_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its number for each gram, the gram's bucket, and a bit set of the scripts of its letters."""
    n = len(words)
    padded = pc.binary_join_element_wise(" ", words, " ", "")
    raw, _ = buffers(padded)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = pc.utf8_length(padded).to_numpy(zero_copy_only=False).astype(np.int64)
    word = np.repeat(np.arange(n), size)
    letter = points != 32
    kind = _KIND[np.searchsorted(_STARTS, points.astype(np.int64), side="right") - 1]
    scripts = np.zeros(n, np.int64)
    np.bitwise_or.at(scripts, word[letter], np.int64(1) << kind[letter])
    of, cell = [], []
    with np.errstate(over="ignore"):
        key = points.copy()
        for k in (1, 2, 3):
            if k > 1:
                key = key[:-1] * BASE + points[k - 1 :] if len(key) > 1 else key[:0]
            same = word[: len(key)] == word[k - 1 : k - 1 + len(key)]
            if k == 1:
                same = same & letter
            of.append(word[: len(key)][same])
            cell.append((mix(key[same], k) >> np.uint64(49)).astype(np.int64) % BUCKETS)
    return np.concatenate(of), np.concatenate(cell), scripts


def _count(languages: list[str]):
    number = {x: k for k, x in enumerate(languages)}

    def rows(sums: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"language": pa.array(list(sums), pa.int32()), "counts": pa.array([c.astype("<i8").tobytes() for c, _ in sums.values()], pa.binary()), "scripts": pa.array([s.astype("<i8").tobytes() for _, s in sums.values()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in slices(batches, "text"):
            lang = np.array([number.get(x, -1) for x in column(b, "lang").to_pylist()])
            words, row = words_of(texts_of(b))
            if not len(words):
                continue
            coded = words.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            of, cell, bits = grams_of(coded.dictionary)
            for k in np.unique(lang[row]):
                if k not in sums:
                    if len(sums) >= LANGUAGES:
                        yield rows(sums)
                        sums = {}
                    sums[k] = np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES), np.int64)
                counts, scripts = sums[k]
                times = np.bincount(code[lang[row] == k], minlength=len(coded.dictionary))
                counts += np.bincount(cell, weights=times[of], minlength=BUCKETS).astype(np.int64)
                scripts += [int(times[(bits >> s) & 1 > 0].sum()) for s in range(len(NAMES))]
        if sums:
            yield rows(sums)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for k, c, s in zip(*(x.to_pylist() for x in b.columns), strict=True):
            new = [np.frombuffer(c, "<i8"), np.frombuffer(s, "<i8")]
            sums[k] = [x + y for x, y in zip(sums[k], new, strict=True)] if k in sums else new
    yield pa.RecordBatch.from_pydict({"language": pa.array(list(sums), pa.int32()), "counts": pa.array([v[0].tobytes() for v in sums.values()], pa.binary()), "scripts": pa.array([v[1].tobytes() for v in sums.values()], pa.binary())})


class Model:
    """languages, log probabilities of cells, and the scripts that each language's words use."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        self.log = np.empty((BUCKETS, len(languages)), np.float32)
        for k, c in enumerate(counts):
            self.log[:, k] = np.log((c + 0.1) / (c.sum() + 0.1 * BUCKETS))
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.scripts = (np.int64(1) << np.arange(len(NAMES))) @ (share > 0.001).T.astype(np.int64)


def train(docs: DataFrame) -> Model | None:
    """A model of all rows of ``docs`` (text, lang) with a language."""
    docs = docs.where("lang is not null and text is not null").select("text", "lang")
    languages = sorted(r[0] for r in docs.select("lang").distinct().limit(MOST + 1).collect())
    if not languages:
        return None
    if len(languages) > MOST:
        raise ValueError(f"more than {MOST} languages in the training rows; their gram counts don't fit a broadcast")
    schema = "language int, counts binary, scripts binary"
    rows = docs.mapInArrow(_count(languages), schema).repartition(len(languages), "language").mapInArrow(_add, schema).toLocalIterator()  # at most MOST rows of fixed size
    counts, scripts = np.zeros((len(languages), BUCKETS)), np.zeros((len(languages), len(NAMES)))
    for r in rows:
        counts[r[0]], scripts[r[0]] = np.frombuffer(r[1], "<i8"), np.frombuffer(r[2], "<i8")
    return Model(languages, counts, scripts)


def viterbi(scores: np.ndarray, off: np.ndarray, switch: float, code: np.ndarray | None = None) -> np.ndarray:
    """The best language of each word. ``scores``: words by languages, or distinct words if ``code`` has the number of
    each word; texts lie between offsets. All texts advance together, longest first, so each step is over the texts that
    still have a word. What is kept of a step is a bit for each language (whether it stays) and where a switch is from."""
    code = np.arange(len(scores)) if code is None else code
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    size, first = size[order], off[:-1][order]
    steps = int(size.max(initial=0))
    active = np.searchsorted(-size, -np.arange(steps), side="left")
    back, jumped = np.zeros((len(code), -(-scores.shape[1] // 8)), np.uint8), np.zeros(len(code), np.int32)
    best = np.zeros((len(size), scores.shape[1]), np.float32)
    for t in range(steps):
        k = active[t]
        at = first[:k] + t
        now = best[:k]
        top = now.argmax(axis=1)
        jump = now[np.arange(k), top] - switch
        stay = now >= jump[:, None]
        back[at], jumped[at] = np.packbits(stay, axis=1), top
        best[:k] = np.where(stay, now, jump[:, None]) + scores[code[at]]
    path = np.zeros(len(code), np.int64)
    state = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        now = path[at] = state[:k].copy()
        state[:k] = np.where(back[at, now >> 3] >> (7 - (now & 7)).astype(np.uint8) & 1, now, jumped[at])
    return path


def label(model: Model, texts: pa.Array, switch: float = SWITCH):
    """(row, word length, language and number of each word, score for each language of each distinct word)"""
    words, row = words_of(texts)
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    of, cell, bits = grams_of(coded.dictionary)
    score = np.zeros((len(coded.dictionary), len(model.languages)), np.float32)
    for k in range(len(model.languages)):
        score[:, k] = np.bincount(of, weights=model.log[cell, k], minlength=len(score))
    able = (bits[:, None] & ~model.scripts[None, :]) == 0
    score = np.where(able | ~able.any(axis=1, keepdims=True), score, np.float32(-1e4))
    off = np.searchsorted(row, np.arange(len(texts) + 1))
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    return row, length, viterbi(score, off, switch, code), code, score


def _predict(model, switch: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in slices(batches, "text", (2 << 20) * LANGUAGES // max(LANGUAGES, len(m.languages))):
            n, count = b.num_rows, len(m.languages)
            row, length, path, code, score = label(m, texts_of(b), switch)
            letters = np.bincount(row * count + path, weights=length, minlength=n * count).reshape(n, count)
            total = letters.sum(axis=1)
            best = letters.argmax(axis=1)
            sums = np.stack([np.bincount(row, weights=score[code, k], minlength=n) for k in range(count)], axis=1) / np.maximum(np.bincount(row, minlength=n), 1)[:, None]
            sure = 1 / np.exp(np.clip(sums - sums[np.arange(n), best][:, None], -50, 50)).sum(axis=1)
            value = letters[np.arange(n), best] / np.maximum(total, 1) * np.clip(sure, 0, 1)
            turns = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
            start, end = turns, np.append(turns[1:], len(row))
            first = np.searchsorted(row, row[turns])
            spans = pa.StructArray.from_arrays([pa.array((start - first).astype(np.int32)), pa.array((end - first).astype(np.int32)), pa.array(m.languages).take(pa.array(path[turns]))], names=["first_word", "end_word", "lang"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[turns], np.arange(n + 1)).astype(np.int32)), spans)
            names = [x for x in b.schema.names if x != "text"]
            pred = [m.languages[k] if t else "und" for k, t in zip(best, total, strict=True)]
            yield pa.RecordBatch.from_arrays([*[column(b, x) for x in names], pa.array(pred), pa.array(np.where(total > 0, value, 0.0)), lists], names=[*names, "lang_pred", "score", "spans"])

    return run


def predict(docs: DataFrame, model: Model | None, carry: list[str], switch: float = SWITCH) -> DataFrame:
    """The ``carry`` columns, lang_pred, score and spans (words from 0, letters only) of every row of ``docs``."""
    if model is None:
        spans = F.array().cast("array<struct<first_word:int,end_word:int,lang:string>>")
        return docs.select(*carry, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), spans.alias("spans"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST * BUCKETS numbers
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, "text").mapInArrow(_predict(shared, switch), f"{kinds}, lang_pred string, score double, spans array<struct<first_word:int,end_word:int,lang:string>>")
