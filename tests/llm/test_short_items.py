"""Benchmark items of few characters, at their full budget of edits."""

import random

import pyarrow as pa

from tests.llm import brute
from tests.llm.conftest import sentence
from veilspark.llm import decontaminate as dc
from veilspark.llm import langid


def test_short_items_have_their_full_budget(spark):
    rng = random.Random(40)
    items = {m: "".join(rng.choice("bcdfgjklmpqvxz") for _ in range(m)) for m in [*range(1, 45), 60]} | {100: "x1 b2", 101: "...", 102: None}
    rows = []
    for m, item in items.items():
        budget = int(dc.RATE * len(item or ""))
        for n in {0, budget, budget + 1}:
            chars = list(item or "")
            for k in range(n if len(chars) > 12 else 0):
                chars[(2 * k + 1) * len(chars) // (2 * n)] = "y"
            rows.append((len(rows), f"{sentence(rng, 5)} {''.join(chars).upper()}, {sentence(rng, 5)}"))
    rows += [(len(rows), "see " + items[5] + "s" + items[6]), (len(rows) + 1, items[7]), (len(rows) + 2, f"{items[8]} {items[8]}"), (len(rows) + 3, ""), (len(rows) + 4, None)]
    clean = lambda t: dc.normalise(pa.array([t or ""], pa.string()))[0].as_py()
    expected = {}
    for k, t in rows:
        for i, x in items.items():
            text, item = clean(t), clean(x)
            if item and len(item) < dc.Q:
                if f" {item} " in f" {text} ":
                    expected[k, i] = 0
            elif item and (n := brute.edit_substring(item, text)) <= int(dc.RATE * len(item)):
                expected[k, i] = n
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = dc.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id): r.edits for r in found} == expected and len(found) == len(expected)
    for r in found:
        if r.edits == 0:
            assert clean(rows[r.doc_id][1])[r.start : r.end] == clean(items[r.item_id])
    assert {(i, n) for (_, i), n in expected.items()} >= {(13, 1), (19, 1), (27, 2), (38, 3), (5, 0), (1, 0), (100, 0)}
    assert {r.doc_id for r in dc.clean(docs, bench).collect()} == {k for k, _ in rows} - {k for k, _ in expected}


def test_texts_that_repeat_a_gram_are_counted_in_chunks(monkeypatch):
    """A thousand equal letters in an item and many more in a text: hits come in chunks and regions are as of all at once."""
    items = dc.Items([1, 2], ["a" * 1000, "ab" * 60], dc.Q, dc.RATE)
    points, off = dc.code_points(pa.array(["a" * 3000, "ab" * 100 + "a" * 40, "b", "aab" * 400]))
    whole = sorted(items.regions(points, off))
    sizes = []
    for g in items.grams:
        chunk = list(g.hits(points, off, 5000))
        sizes += [len(x[0]) for x in chunk]
    assert max(sizes) <= 5000 + 1000 and len(sizes) > 100
    monkeypatch.setattr(dc.Grams.hits, "__defaults__", (5000,))
    assert sorted(items.regions(points, off)) == whole and whole


def test_marks_without_a_letter_are_no_words():
    words, _ = langid.words_of(pa.array(["\u0301 \u0301\u0302 12", "e\u0301t\u0301"]))
    assert words.to_pylist() == ["e\u0301t\u0301"]
