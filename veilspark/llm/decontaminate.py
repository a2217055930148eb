"""Benchmark passages in documents, with edits, by q-gram filtering on diagonals and banded alignment.

Texts and items are compared as lower-cased letters and digits; anything else between them is one space. An item of m
characters leaks where a stretch of a text is within e = ``RATE`` * m edits of all of it. By the q-gram lemma such a
stretch shares at least m - q + 1 - q*e q-grams with the item, and e edits shift them by at most e diagonals. So hits
are counted in bands of 2(e+1) diagonals that overlap by half; bands that reach the bound are verified by an alignment
held to the band. Items for which the bound wouldn't be positive have shorter grams, of m // (e+1) characters. Nothing
within the budget is missed. Items of fewer than q characters and no edits are searched for as whole words.

Items are read in blocks of bounded size, each broadcast in turn and held against all documents, whole. Documents don't
move. Null texts and items, and items without a letter or digit, never match. An item that several
rows hold is reported for each; of several stretches of a text the one with the fewest edits counts, then the first.
Repeated and null doc_ids are separate documents. Either table may be empty, and ids may have any type. What repeats
itself in a text and in an item is counted in chunks, so memory doesn't grow with the product of their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import BASE, buffers, column, mix, slices, texts_of, window_hashes

#: Greatest length of a gram, and edits allowed for each character of an item.
Q, RATE = 10, 0.08
#: Characters of the items of a block.
BLOCK_CHARS = 1_000_000
#: Shared grams that are listed at a time.
HITS = 1_000_000
_POINTS = mix(np.arange(1 << 16, dtype=np.uint64), 17)
_BITS = 20


def normalise(texts: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " "), " ")


def code_points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings one after the other, and the n+1 offsets."""
    raw, _ = buffers(strings)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(pc.utf8_length(strings).to_numpy(zero_copy_only=False), dtype=np.int64)])


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return window_hashes(_POINTS[points & 0xFFFF] + (points >> 16).astype(np.uint64) * BASE, q)


def _slot(grams: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (grams * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _BITS)


class Grams:
    """The grams of one length of some items of a block by hash, with the item and the place of each."""

    def __init__(self, points: np.ndarray, off: np.ndarray, which: np.ndarray, q: int):
        self.q = q
        fits = np.diff(off)[which] - q + 1
        item = np.repeat(which, fits)
        place = np.arange(len(item)) - np.repeat(np.cumsum(fits) - fits, fits)
        grams = gram_hashes(points, q)[off[:-1][item] + place]
        order = np.argsort(grams, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.first = np.unique(grams[order], return_index=True)
        self.last = np.append(self.first[1:], len(grams))
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[_slot(self.grams)] = True

    def hits(self, points: np.ndarray, off: np.ndarray, most: int = HITS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, diagonal) of every shared gram, about ``most`` at a time: texts and items that repeat one gram have
        as many as their lengths multiplied."""
        if len(points) < self.q:
            return
        grams = gram_hashes(points, self.q)
        at = np.flatnonzero(self.maybe[_slot(grams)])
        k = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        same = self.grams[k] == grams[at]
        at, k = at[same], k[same]
        text = np.searchsorted(off, at, side="right") - 1
        inside = at + self.q <= off[text + 1]
        at, k, text = at[inside], k[inside], text[inside]
        if not len(k):
            return
        total = self.last[k] - self.first[k]
        cut = np.flatnonzero(np.diff(np.cumsum(total) // most, prepend=-1))
        for i, j in zip(cut, [*cut[1:], len(k)], strict=True):
            count, begin = total[i:j], self.first[k[i:j]]
            one = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
            yield np.repeat(text[i:j], count), self.item[one], np.repeat(at[i:j] - off[text[i:j]], count) - self.place[one]


class Items:
    """A block of items and their grams; those of fewer than q characters and no edits are ``words``."""

    def __init__(self, ids: list, texts: list[str], q: int, rate: float):
        self.ids = ids
        points, off = code_points(normalise(pa.array([t or "" for t in texts], pa.string())))
        self.points = [points[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        size = np.diff(off)
        self.size = size
        self.edits = (rate * size).astype(np.int64)
        own = np.minimum(q, size // (self.edits + 1))
        self.bound = size - own + 1 - own * self.edits
        word = (size < q) & (self.edits == 0)
        indexed = lambda of: [Grams(points, off, np.flatnonzero(of & (own == k)), int(k)) for k in np.unique(own[of & (own > 0)])]
        self.grams, self.words = indexed(~word), indexed(word)

    def whole_words(self, points: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, first place) of ``words`` between spaces or ends of a text."""
        for g in self.words:
            found = [(np.zeros(0, np.int64),) * 3, *g.hits(points, off)]
            text, item, place = (np.concatenate(x) for x in zip(*found, strict=True))
            start, end = off[text] + place, off[text] + place + g.q
            left = (start == off[text]) | (points[np.maximum(start - 1, 0)] == 32)
            right = (end == off[text + 1]) | (points[np.minimum(end, len(points) - 1)] == 32)
            text, item, place = (x[left & right] for x in (text, item, place))
            order = np.lexsort((place, item, text))
            text, item, place = text[order], item[order], place[order]
            for k in np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0)):
                yield int(text[k]), int(item[k]), int(place[k])

    def regions(self, points: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first diagonal of a band, hits in it) where the lemma's bound is reached."""
        # diagonals reach from minus the longest item to the longest text; bands are counted chunk by chunk of hits
        least = -int(self.size.max(initial=0)) - 2
        span = int(np.diff(off).max(initial=0)) - least + 1
        found, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for g in self.grams:
            for text, item, diagonal in g.hits(points, off):
                band = diagonal // (self.edits[item] + 1)
                pair = text * len(self.size) + item
                new, times = np.unique(np.concatenate([pair * span + band - x - least for x in (0, 1)]), return_counts=True)
                found, of = np.unique(np.concatenate([found, new]), return_inverse=True)
                count = np.bincount(of, weights=np.concatenate([count, times]), minlength=len(found)).astype(np.int64)
        i = found // span % len(self.size)
        enough = count >= self.bound[i]
        for key, c in zip(found[enough], count[enough], strict=True):
            t, i = divmod(int(key // span), len(self.size))
            yield t, i, int((key % span + least) * (self.edits[i] + 1)), int(c)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, free_start: bool = True) -> tuple[int, int]:
    """Fewest edits between all of ``item`` and a stretch of ``text`` on diagonals low to high, and where that ends."""
    far = 1 << 28
    diagonals = np.arange(low, high + 1)
    steps = np.arange(len(diagonals))
    cost = np.where((diagonals >= 0) & (diagonals <= len(text)), 0 if free_start else np.abs(diagonals), far)
    padded = np.concatenate([text.astype(np.int64), [-1]])
    for i, c in enumerate(item, 1):
        j = i + diagonals
        same = padded[np.clip(j - 1, 0, len(text))] == c
        step = np.where(j >= 1, cost + ~same, far)
        step[:-1] = np.minimum(step[:-1], cost[1:] + 1)
        step = np.minimum.accumulate(step - steps) + steps
        cost = np.where((j >= 0) & (j <= len(text)), step, far)
    best = int(np.argmin(cost))
    return int(cost[best]), int(len(item) + diagonals[best])


def _find(items: Items, points: np.ndarray, off: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """For (text, item): (edits, start, end, shared grams) of the best stretch."""
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for t, i, low, shared in items.regions(points, off):
        text, item, e = points[off[t] : off[t + 1]], items.points[i], int(items.edits[i])
        exact = next((d for d in range(max(low, 0), low + 2 * (e + 1)) if d + len(item) <= len(text) and text[d] == item[0] and np.array_equal(text[d : d + len(item)], item)), None)
        if exact is not None:
            found = (0, exact, exact + len(item), shared)
        else:
            edits, end = align(item, text, low - e, low + 2 * (e + 1) + e)
            if edits > e:
                continue
            # the start: the same alignment backwards from the end
            _, size = align(item[::-1], text[max(0, end - len(item) - e) : end][::-1], -e, e, free_start=False)
            found = (edits, end - size, end, shared)
        best[t, i] = min(best.get((t, i), found), found)
    for t, i, start in items.whole_words(points, off):
        best[t, i] = (0, start, start + len(items.points[i]), 1)
    return best


def blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the items, in blocks of about ``limit`` characters."""
    ids, texts, size = [], [], 0
    for item_id, text in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        ids.append(item_id)
        texts.append(text)
        size += len(text)
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _searcher(block, q: int, rate: float):
    """The search of a slice; the index is built once in each task."""
    built: list[Items] = []

    def search(b: pa.RecordBatch) -> dict[tuple[int, int], tuple[int, int, int, int]]:
        if not built:
            built.append(Items(*block.value, q, rate))
        points, off = code_points(normalise(texts_of(b)))
        return _find(built[0], points, off)

    return search


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits, start, end (in the cleaned text), shared_grams, item_chars for each leak."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_arrow = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {id_type}, item_id {item_type}, edits int, start int, end int, shared_grams int, item_chars int"
    out = None
    for block in blocks(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(block)  # bounded by block_chars

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search, items = _searcher(shared, q, rate), None
            for b in slices(batches, "text"):
                found = search(b)
                items = shared.value
                keys = list(found)
                rows = column(b, "doc_id").take(pa.array([t for t, _ in keys], pa.int64()))
                sizes = [len(normalise(pa.array([items[1][i]]))[0].as_py()) for _, i in keys]
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array([items[0][i] for _, i in keys], item_arrow), *[pa.array([found[k][x] for k in keys], pa.int32()) for x in range(4)], pa.array(sizes, pa.int32())],
                    names=["doc_id", "item_id", "edits", "start", "end", "shared_grams", "item_chars"],
                )

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts hold no item."""
    names = docs.columns
    for block in blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = _searcher(shared, q, rate)
            for b in slices(batches, "text"):
                hit = {t for t, _ in search(b)}
                keep = pa.array([k not in hit for k in range(b.num_rows)])
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns], names=b.schema.names)

        packed = docs.select(F.struct(*names).alias("row"), "text")
        kind = packed.schema["row"].dataType.simpleString()
        docs = packed.mapInArrow(run, f"row {kind}, text string").select("row.*")
    return docs
