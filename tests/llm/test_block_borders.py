"""Suffixes of one key that fill several blocks, against the same rows in one block."""

import random
import string
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.conftest import sentence
from veilspark.llm import suffix_dedup


def test_a_key_of_several_blocks_is_compared_as_in_one(monkeypatch):
    for letter in string.ascii_lowercase:
        texts = [f"1 {letter * 50} 2", f"3 {letter * 400} 4", f"5 {letter * 90} 6"]
        batch = pa.RecordBatch.from_pydict({"id": pa.array([1, 2, 3]), "text": texts, "tag": pa.array([0, 0, 0])})
        dealt = pa.Table.from_batches(list(suffix_dedup._deal(50, np.zeros(0, np.uint64), True)(iter([batch])))).drop(["range"])
        rows = dealt.sort_by([("h", "ascending"), ("c", "ascending"), ("id", "ascending")])
        found = {}
        for size in (5, 10**6):
            monkeypatch.setattr(suffix_dedup, "BLOCK_ROWS", size)
            out = pa.Table.from_batches(list(suffix_dedup._compare(True)(iter(rows.to_batches(max_chunksize=3))))).to_pylist()
            found[size] = Counter((r["id"], r["place"], r["count"], r["open"]) for r in out)
        assert not found[10**6] - found[5], letter
        assert {k: n for k, n in found[5].items() if not k[3]} == {k: n for k, n in found[10**6].items() if not k[3]}


def test_stretches_give_the_anchors_of_one_piece():
    rng = random.Random(7)
    texts = [sentence(rng, n) for n in (0, 3, 400, 12, 90)] + ["a" * 700, "", "é" * 120, "x"]
    raw, off = suffix_dedup.buffers(pa.array(texts))
    whole = suffix_dedup.suffixes(raw, off, 50, 10**9)
    for most in (60, 100, 777):
        parts = suffix_dedup.suffixes(raw, off, 50, most)
        assert all(np.array_equal(whole[k], parts[k]) for k in whole)
    at = np.array([500, 3, 700, 3, 0])
    expected = suffix_dedup.window_hashes(suffix_dedup.byte_values(raw), 50)[at]
    assert np.array_equal(suffix_dedup.windows_at(raw, at, 50, most=64), expected)
