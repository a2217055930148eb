"""Exact removal of repeated byte strings by fingerprints of sampled suffixes, grouped by a distributed sort.

A string counts as repeated if it has ``length`` bytes (50) and also starts in a document with a smaller id.
Suffixes are taken at anchors: in each window of ``length`` bytes the anchor is the ``GRAM``-byte string with the
least hash (the leftmost of equals), so equal windows have equal anchors at equal places, and about one byte in
sixteen starts a suffix. Each anchor stands for the run of neighbouring windows that chose it.

1. Suffixes get a sort key (two leading bytes, then a fingerprint of the leading ``GRAM`` bytes) and a second
   fingerprint of all bytes that their windows cover. Splitters sampled from the keys deal them out in ranges.
2. Each range is sorted by one column after the other (Spark's sort compares the key, then within equal keys the
   fingerprint, then the id) and read once, comparing neighbours; the state of one row crosses batch boundaries.
   Equal suffixes of a larger id are repeated. A suffix whose key occurs with several fingerprints is unsettled.
3. Unsettled suffixes (edges of shared passages, places of edits) whose anchor has half a window's further bytes on
   either side in common with a suffix of the key in another text are compared window by window: their hashes (96 bits)
   are dealt out, sorted, and read once like the suffixes.

Within one slice only the least id of equal suffixes travels, the others are settled on the spot: a passage that a
third of all documents share sends one row for each slice. Texts are never cut, and no key's rows meet in one list.

Null texts count as empty. A null id is larger than all others; rows with equal ids don't cover each other, and each
row gets its own result. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, byte_values, column, discard, materialise, mix, signed, slices, texts_of, window_hashes

#: Bytes of an anchor.
GRAM = 16
#: Texts whose suffixes are sampled for the splitters, and splitters for each shuffle partition.
SAMPLE_ROWS, RANGES = 128, 4
#: Windows whose anchors are taken at a time (about 100 bytes of arrays for each).
STRETCH = 1 << 19
#: Suffixes of a range that are compared at a time.
BLOCK_ROWS = 100_000
#: Rows of an Arrow batch: texts on one side of a shuffle, suffixes on the other.
ARROW = 5000
NULL_ID = 2**63 - 1
SUFFIX = "h long, c long, id long, place long"
U32 = np.uint64(32)


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    n, width = len(x) - w + 1, 1
    while 2 * width <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:n], x[w - width : w - width + n])


def _stretch(raw: np.ndarray, at: np.ndarray, row: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The anchors of windows that start at ``at`` in ``raw``; ``row``: the text of each."""
    w = length - GRAM + 1
    values = byte_values(raw)
    gram = mix(window_hashes(values, GRAM), 1)
    anchor = (_window_min((gram >> U32 << U32) | np.arange(len(gram), dtype=np.uint64), w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    a = anchor[at]
    del anchor
    first = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    last = np.append(first[1:], len(at)) - 1
    count = last - first + 1
    pos, begin, end = a[first], at[first], at[last]
    lead = (raw[pos].astype(np.uint64) << np.uint64(56)) | (raw[pos + 1].astype(np.uint64) << np.uint64(48))
    h = lead | (gram[pos] >> np.uint64(16))
    del gram, a
    whole = window_hashes(values, length)
    with np.errstate(over="ignore"):
        c = mix(mix(whole[begin], 2) * np.uint64(3) + mix(whole[end], 3) + mix((count * 64 + pos - begin).astype(np.uint64), 4), 5)
    del whole
    c = (c << np.uint64(6)) | count.astype(np.uint64)
    half = w // 2
    longer = window_hashes(values, GRAM + half)
    before, after = pos - half >= begin, pos + GRAM + half <= end + length
    sides = [np.where(ok, (mix(mix(longer[np.where(ok, x, 0)], 6), seed) >> np.uint64(48)) | np.uint64(1), np.uint64(0)).astype(np.int64) for ok, x, seed in ((before, pos - half, 12), (after, pos, 13))]
    return {"h": h, "c": c, "row": row[first], "start": begin, "count": count, "sides": (sides[0] << 16) | sides[1]}


def suffixes(raw: np.ndarray, off: np.ndarray, length: int, most: int = STRETCH) -> dict[str, np.ndarray]:
    """The anchors of all windows of texts that lie one after the other in ``raw`` (``off``: n+1 offsets).

    h: sort key; c: fingerprint of what the windows cover, with their number in the low six bits; row: the text;
    start: first window in it; count: windows; sides: two 16-bit hashes, of the anchor with as many bytes before it as
    half a window needs and with as many after it (0: the windows don't reach so far). Windows that are equal have one
    of the two in common.

    Arrays of eight bytes for each byte exist for ``most`` windows at a time, however long a text is. A stretch that
    ends inside a text gives back its last run of windows, with which the next one begins, so runs are as in one piece.
    """
    keys = ("h", "c", "row", "start", "count", "sides")
    parts = [{k: np.zeros(0, np.uint64 if k in "hc" else np.int64) for k in keys}]
    at = int(off[0]) if len(off) else 0
    while at <= len(raw) - length:
        end = min(at + most + length - 1, len(raw))
        near = np.arange(np.searchsorted(off, at, side="right") - 1, np.searchsorted(off, end - length, side="right"))
        row = np.repeat(near, np.diff(np.clip(off[near[0] : near[-1] + 2], at, end - length + 1)))
        start = np.flatnonzero(np.arange(at + length, end + 1) <= off[row + 1])
        more = end < len(raw) and len(start) > 0 and start[-1] == len(row) - 1
        if len(start):
            found = _stretch(raw[at:end], start, row[start], length)
            found["start"] = found["start"] + at
            if more:
                last = int(found["start"][-1])
                found = {k: v[:-1] for k, v in found.items()}
            parts.append(found)
        at = last if more else end - length + 1
    out = {k: np.concatenate([p[k] for p in parts]) for k in keys}
    return out | {"start": out["start"] - off[out["row"]]}


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return column(batch, "id").to_numpy(zero_copy_only=False).astype(np.int64)


def _places(start: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Start in the high half. The low half has the sides of a suffix; where ids repeat, a tag of the text instead,
    which tells rows of equal ids apart."""
    return (start << 32) | low


def _merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unite overlapping or touching spans of each document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    big = end.max() + 2
    _, code = np.unique(doc, return_inverse=True)
    reach = np.maximum.accumulate(end + code * big)
    new = np.ones(len(doc), bool)
    new[1:] = (start + code * big)[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return doc[head], start[head], np.maximum.reduceat(end + code * big, head) - code[head] * big


def _deal(length: int, splitters: np.ndarray, unique: bool):
    """Suffixes of each slice with the number of their range; what a slice settles by itself comes as spans (c is null, h the number of windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            raw, off = buffers(texts_of(b))
            s = suffixes(raw, off, length)
            ids, low = _ids(b)[s["row"]], s["sides"] if unique else column(b, "tag").to_numpy(zero_copy_only=False)[s["row"]]
            order = np.lexsort((ids, s["c"], s["h"]))
            h, c, i = s["h"][order], s["c"][order], ids[order]
            head = np.ones(len(h), bool)
            head[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            least = i[np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))] if len(h) else i
            local = (i != least)
            equal = ~head & ~local  # the same id again: it needs the same answer, so it travels too
            go = np.sort(order[head | equal])  # neighbours of a text together: they compress better
            yield pa.RecordBatch.from_pydict({
                "range": np.searchsorted(splitters, s["h"][go]).astype(np.int32), "h": signed(s["h"][go]), "c": signed(s["c"][go]), "id": ids[go],
                "place": _places(s["start"][go], low[go])})
            done = order[local]
            if len(done):
                r, a, e = _merge(s["row"][done], s["start"][done], s["start"][done] + s["count"][done])
                i, t = _ids(b)[r], column(b, "tag").to_numpy(zero_copy_only=False)[r]
                yield pa.RecordBatch.from_pydict({
                    "range": (r % (len(splitters) + 1)).astype(np.int32), "h": e - a, "c": pa.nulls(len(r), pa.int64()), "id": i,
                    "place": _places(a, t)})

    return run


def _shared(key: np.ndarray, side: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether rows of another id have the same side under the same key."""
    both = (key << 16) | side
    order = np.lexsort((ids, both))
    one, who = both[order], ids[order]
    head = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
    tail = np.append(head[1:], len(one)) - 1
    out = np.empty(len(key), bool)
    out[order] = np.repeat(who[head] != who[tail], tail - head + 1)
    return out & (side != 0)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(settled, h, c, id, place) of about ``size`` rows, cut between keys unless one key has more rows than that."""
    held: list[tuple] = []
    for b in batches:
        if not b.num_rows:
            continue
        c = column(b, "c")
        held.append((c.is_null().to_numpy(zero_copy_only=False), column(b, "h").to_numpy(), c.fill_null(0).to_numpy(), _ids(b), column(b, "place").to_numpy()))
        if sum(len(x[0]) for x in held) >= size:
            block = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            turns = np.flatnonzero(np.diff(block[1])) + 1
            cut = turns[-1] if len(turns) else len(block[1])
            yield tuple(x[:cut] for x in block)
            held = [tuple(x[cut:] for x in block)] if cut < len(block[1]) else []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _compare(prune: bool):
    """Neighbours of a sorted range: spans that are settled (open is false), and suffixes to be looked at (open)."""

    def out(i, place, count, is_open):
        return pa.RecordBatch.from_pydict({"id": i, "place": place, "count": count.astype(np.int32), "open": np.full(len(i), is_open)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past = None  # (h, c, least id) of the last row, and the number of its key's fingerprints so far (2: or more)
        pending = None  # the first suffix of the last key, while that has one fingerprint only
        for ready, h, c, ids, place in _blocks(batches, BLOCK_ROWS):
            if ready.any():
                yield out(ids[ready], place[ready], h[ready], False)
                h, c, ids, place = (x[~ready] for x in (h, c, ids, place))
            if not len(h):
                continue
            count = c & 63
            new_h = np.ones(len(h), bool)
            new_h[1:] = h[1:] != h[:-1]
            new_h[0] = past is None or past[0] != h[0]
            new_c = new_h.copy()
            new_c[1:] |= c[1:] != c[:-1]
            new_c[0] |= past is not None and past[1] != c[0]
            group = np.maximum.accumulate(np.where(new_c, np.arange(len(h)), -1))
            least = np.where(group >= 0, ids[np.maximum(group, 0)], past[2] if past else 0)
            later = ids > least
            yield out(ids[later], place[later], count[later], False)
            # the rows of the least id stand for their fingerprint
            part = np.flatnonzero(~later)
            key = np.cumsum(new_h)  # 0: the key of the block before
            last = key[-1]
            kinds = np.zeros(last + 1, np.int64)
            np.add.at(kinds, key[new_c], 1)
            kinds[0] += past[3] if past and key[0] == 0 else 0
            if pending is not None and key[0] == 0 and kinds[0] > 1:
                yield out(*pending, True)
            if pending is not None and (key[0] != 0 or kinds[0] > 1):
                pending = None
            many = part[kinds[key[part]] > 1]
            if prune and len(many):
                low = place[many] & 0xFFFFFFFF
                partial = (key[many] == 0) | (new_h.sum() <= 1)  # a key that goes beyond this block stays whole
                many = many[partial | _shared(key[many], low >> 16, ids[many]) | _shared(key[many], low & 0xFFFF, ids[many])]
            if len(many):
                yield out(ids[many], place[many], count[many], True)
            end = part[(key[part] == last) & (kinds[last] <= 1)]
            if len(end):
                now = (ids[end], place[end], count[end])
                pending = now if pending is None or key[0] != 0 or last > 0 else tuple(np.concatenate(x) for x in zip(pending, now, strict=True))
            elif last > 0:
                pending = None
            past = (h[-1], c[-1], least[-1], min(2, kinds[last]))

    return run


def windows_at(raw: np.ndarray, at: np.ndarray, length: int, second: bool = False, most: int = STRETCH) -> np.ndarray:
    """Hashes of the windows of ``raw`` that start at ``at``; only stretches with one of them are hashed."""
    order = np.argsort(at, kind="stable")
    ahead, out = at[order], np.empty(len(at), np.uint64)
    for low in range(0, len(raw), most):
        i, j = np.searchsorted(ahead, (low, low + most))
        if i < j:
            out[order[i:j]] = window_hashes(byte_values(raw[low : low + most + length - 1], second), length)[ahead[i:j] - low]
    return out


def _windows(length: int):
    """Hashes (96 bits) of the windows of unsettled suffixes. Of equal ones in a slice those of the least id travel; the
    others are settled and come as spans (count is their length in windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            raw, off = buffers(texts_of(b))
            lists = column(b, "asked")
            flat = lists.flatten()
            starts, counts = (np.array(flat.field(k)).astype(np.int64) for k in ("start", "count"))
            row = np.repeat(np.arange(b.num_rows), np.diff(np.array(lists.offsets)))
            if not len(row):
                continue
            at = np.repeat(starts + off[row], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            rows = np.repeat(row, counts)
            w = signed(mix(windows_at(raw, at, length), 8))
            v = (mix(windows_at(raw, at, length, True), 9) >> U32).astype(np.uint32).view(np.int32)
            ids, tags = _ids(b), column(b, "tag").to_numpy(zero_copy_only=False)
            order = np.lexsort((ids[rows], v, w))
            head = np.ones(len(order), bool)
            head[1:] = (w[order][1:] != w[order][:-1]) | (v[order][1:] != v[order][:-1])
            own = ids[rows][order]
            least = own == own[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            go = np.sort(order[least])
            yield pa.RecordBatch.from_pydict({"w": w[go], "v": v[go], "id": ids[rows[go]], "place": _places(at[go] - off[rows[go]], tags[rows[go]]), "count": np.zeros(len(go), np.int32)})
            done = order[~least]
            if len(done):
                r, a, e = _merge(rows[done], at[done], at[done] + 1)
                yield pa.RecordBatch.from_pydict({"w": signed(mix(a.astype(np.uint64), 10)), "v": np.zeros(len(r), np.int32), "id": ids[r], "place": _places(a - off[r], tags[r]), "count": (e - a).astype(np.int32)})

    return run


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted windows those whose id isn't the least of their equals; the last row's state crosses batches."""
    past = None
    for b in batches:
        if not b.num_rows:
            continue
        w, v, ids, place, count = (column(b, k).to_numpy() for k in ("w", "v", "id", "place", "count"))
        ready = count > 0
        if ready.any():
            yield pa.RecordBatch.from_pydict({"id": ids[ready], "place": place[ready], "count": count[ready]})
            w, v, ids, place = (x[~ready] for x in (w, v, ids, place))
        if not len(w):
            continue
        head = np.ones(len(w), bool)
        head[1:] = (w[1:] != w[:-1]) | (v[1:] != v[:-1])
        head[0] = past is None or past[:2] != (w[0], v[0])
        group = np.maximum.accumulate(np.where(head, np.arange(len(w)), -1))
        first = np.where(group >= 0, ids[np.maximum(group, 0)], past[2] if past else 0)
        late = ids > first
        yield pa.RecordBatch.from_pydict({"id": ids[late], "place": place[late], "count": np.ones(int(late.sum()), np.int32)})
        past = (w[-1], v[-1], first[-1])


def _kept(length: int, with_text: bool):
    """Apply spans to the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            raw, off = buffers(texts_of(b))
            lists = column(b, "found")
            flat = lists.flatten()
            starts, counts = (np.array(flat.field(k)).astype(np.int64) for k in ("start", "count"))
            row = np.repeat(np.arange(b.num_rows), np.diff(np.array(lists.offsets)))
            row, start, end = _merge(row, starts, starts + counts + length - 1)
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            removed, spans, kept = np.zeros(b.num_rows, np.int64), np.diff(cut), []
            for k in range(b.num_rows):
                text, last, parts = raw[off[k] : off[k + 1]], 0, []
                for a, e in zip(start[cut[k] : cut[k + 1]], end[cut[k] : cut[k + 1]], strict=True):
                    parts.append(text[last:a].tobytes())
                    last = e
                    removed[k] += e - a
                kept.append(b"".join([*parts, text[last:].tobytes()]))
            yield pa.RecordBatch.from_pydict({
                "doc_id": column(b, "doc_id"), "n_bytes": np.diff(off), "n_removed": removed, "n_spans": spans.astype(np.int64),
                "kept_text": pa.array([x.decode("utf-8", "ignore") for x in kept] if with_text else [None] * len(kept), pa.string()),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), "row": column(b, "row")})

    return run


def _splitters(docs: DataFrame, length: int, n: int) -> np.ndarray:
    """Keys that part the suffixes of a sample of texts evenly. They only balance the ranges; any would do."""
    sample = docs.select("text").limit(SAMPLE_ROWS).toArrow().column("text").combine_chunks()
    sample = pa.chunked_array([sample]).combine_chunks() if len(sample) else pa.array([], pa.string())
    raw, off = buffers(sample.fill_null("") if len(sample) else sample)
    h = np.sort(suffixes(raw, off, length)["h"])
    return np.unique(h[np.linspace(0, len(h) - 1, n + 1).astype(np.int64)[1:-1]]) if len(h) else np.zeros(0, np.uint64)


def remove_repeats(docs: DataFrame, length: int = 50, carry: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_text, kept_sha256 for each row of ``docs`` (doc_id, text).

    kept_sha256 is of the remaining bytes. kept_text is what they say; where a removed span began or ended inside a
    UTF-8 character, the rest of that character is left out of it. ``carry``: names of further columns to hand on, in
    a struct column ``row``.
    """
    spark = docs.sparkSession
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    text = F.coalesce(F.col("text"), F.lit(""))
    unique = docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    keyed = docs.select(
        "doc_id", F.col("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"),
        (F.lit(0).cast("long") if unique else F.crc32(text)).alias("tag"), F.struct(*[F.col(c) for c in carry] if carry else [F.lit(0).alias("none")]).alias("row"),
    )
    plain = keyed.select("text", "id", "tag")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = plain.mapInArrow(_deal(length, _splitters(docs, length, RANGES * parts), unique), f"range int, {SUFFIX}")
    ordered = dealt.repartition(parts, "range").sortWithinPartitions("h", "c", "id").drop("range")
    seen = materialise(ordered.mapInArrow(_compare(unique), "id long, place long, count int, open boolean"), "suffix-runs", tidy=True, rows=ARROW)
    by_text = (F.col("id"), F.shiftright("place", 32).cast("int").alias("start"), (F.lit(0).cast("long") if unique else F.col("place").bitwiseAND(2**32 - 1)).alias("tag"))

    def per_text(spans: DataFrame, name: str) -> DataFrame:
        return spans.select(*by_text, "count").groupBy("id", "tag").agg(F.collect_list(F.struct("start", "count")).alias(name))

    asked = per_text(seen.where("open"), "asked")
    windows = plain.join(asked, ["id", "tag"]).mapInArrow(_windows(length), "w long, v int, id long, place long, count int")
    late = windows.repartition(parts, "w").sortWithinPartitions("w", "v", "id").mapInArrow(_least, "id long, place long, count int")
    spans = materialise(seen.where("not open").select("id", "place", "count").unionByName(late), "suffix-spans", tidy=True, rows=ARROW)
    discard(seen)
    found = per_text(spans, "found")
    none = F.array().cast("array<struct<start:int,count:int>>")
    whole = keyed.join(found, ["id", "tag"], "left").withColumn("found", F.coalesce("found", none))
    row = whole.schema["row"].dataType.simpleString()
    return whole.mapInArrow(_kept(length, with_text), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_text string, kept_sha256 string, row {row}")
