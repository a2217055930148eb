"""Best-fit-decreasing packing of tokenised documents into sequences of fixed length.

Pieces longer than all others come first; each goes to the open sequence with the least room that still holds it. A
segment tree over remaining capacities finds that room in logarithmic time. Pieces of one length are alike, so the
whole corpus is packed exactly as one from a table of lengths (at most ``capacity`` rows, whatever the data): the plan
says, for ranks of a length, which sequences and offsets they get, and every piece finds its place by its rank. No
text or id moves: ranks come from counts for each partition and length, and only those are joined.

Null texts count as empty: one piece with the end id. Repeated and null doc_ids are separate documents. An empty table
packs into nothing.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialise, slices, texts_of
from .tokens import Encoder

CAPACITY = 1024
END = 2


class RoomTree:
    """Segment tree over remaining capacities 0 to n: which of them have open sequences."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, room: int, count: int) -> None:
        k = room + self.size
        while k:
            self.open[k] += count
            k >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of an open sequence that is at least ``need``."""
        k = need + self.size
        while not self.open[k]:
            while k & 1:  # a right child: go up to where a subtree lies further right
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.size:
            k = 2 * k if self.open[2 * k] else 2 * k + 1
        return k - self.size


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, pieces in each sequence, first offset) that place all pieces.

    ``lengths``: pieces by length. Equal to best fit one piece at a time: no sequence has room between the tightest
    fit and the length, so the one just used is the tightest again while it holds another piece of that length.
    """
    tree, groups, runs, used = RoomTree(capacity), defaultdict(list), [], 0

    def keep(room: int, first: int, count: int) -> None:
        if count:
            groups[room].append((first, count))
            tree.add(room, count)

    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, count = capacity, used, -(-left // (capacity // length))
                used += count
            else:
                first, count = groups[room].pop()
                tree.add(room, -count)
            each = room // length
            taken = min(left, count * each)
            runs.append((length, rank, first, each, capacity - room))
            full, rest = divmod(taken, each)
            keep(room - each * length, first, full)
            keep(room - rest * length, first + full, 1 if rest else 0)
            keep(room, first + full + (rest > 0), count - full - (rest > 0))
            rank, left = rank + taken, left - taken
    return runs


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = Encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in slices(batches, "text"):
            ids, off = encoder.encode(texts_of(b), end)
            total = np.diff(off)
            count = -(-total // capacity)
            row = np.repeat(np.arange(b.num_rows), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            head = total - capacity * (count - 1)  # only the first piece may be shorter
            start = np.where(piece > 0, head[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, head[row])
            order = np.argsort(length, kind="stable")
            sorted_length = length[order]
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - np.searchsorted(sorted_length, sorted_length) + seen[sorted_length]
            seen += np.bincount(length, minlength=capacity + 1)
            at = off[row] + start
            little = ids.astype("<u4")
            sums = [zlib.crc32(little[i : i + k].tobytes()) for i, k in zip(at, length, strict=True)]
            out = {"doc_id": column(b, "doc_id").take(pa.array(row)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": np.array(sums, np.int64), "part": np.full(len(row), part, np.int32), "rank": rank}
            if with_ids:
                cuts = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(out)

    return run


def _place(runs: list[tuple[int, int, int, int, int]]):
    """Sequence and offset of pieces from their length and rank. The number of runs does not grow with the data."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    key = (table[:, 0] << 48) | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = column(b, "length").to_numpy(), column(b, "rank").to_numpy()
            of = table[np.searchsorted(key, (length << 48) | rank, side="right") - 1]
            step, each = rank - of[:, 1], of[:, 3]
            names = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[column(b, n) for n in names], pa.array(of[:, 2] + step // each), pa.array(of[:, 4] + step % each * length)], names=[*names, "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset for each piece of each row of ``docs``.

    Only documents of more than ``capacity`` tokens (end id included) are cut. ``tokenizer``: path of a tokenizer file.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    extra = ", ids array<int>" if with_ids else ""
    made = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, end, with_ids), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part int, rank long{extra}")
    pieces = materialise(made, "packing-pieces")
    counts = materialise(pieces.groupBy("part", "length").count(), "packing-counts")
    lengths = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    # partitions by lengths grow with the data, so they are merged with the pieces and never broadcast
    ranked = pieces.join(ahead.hint("merge"), ["part", "length"]).withColumn("rank", (F.col("rank") + F.col("ahead")).cast("long"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return ranked.select(*names, "rank").mapInArrow(_place(plan(lengths, capacity)), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long{extra}, sequence_id long, offset long")
