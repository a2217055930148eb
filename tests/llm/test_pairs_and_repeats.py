import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tests.llm.conftest import sentence
from veilspark.llm import decontaminate, graph, jaccard_orders, suffix_dedup


def test_suffix_dedup(odd_docs, odd_rows, no_docs):
    found = suffix_dedup.remove_repeats(odd_docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute.remove_repeats(odd_rows)))
    texts = suffix_dedup.remove_repeats(odd_docs.where("doc_id = 12")).first()
    assert texts.kept_text == "é" * 200 and texts.n_removed == 0
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_suffix_dedup_unique_ids(spark, monkeypatch):
    """Small blocks: keys cross their boundaries."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_ROWS", 7)
    rng = random.Random(2)
    parts = [sentence(rng, 8) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for i in rng.sample(range(1000), 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = suffix_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, found)) == sorted(brute.remove_repeats(rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=90), min_size=1, max_size=6))
def test_equal_windows_choose_equal_anchors(texts):
    raw, off = suffix_dedup.buffers(pa.array(texts, pa.string()))
    s = suffix_dedup.suffixes(raw, off, 50)
    assert s["count"].sum() == sum(max(0, len(t) - 49) for t in texts)
    seen = {}
    for h, row, start, count in zip(s["h"], s["row"], s["start"], s["count"], strict=True):
        for k in range(count):
            w = texts[row][start + k : start + k + 50]
            assert seen.setdefault(w, h) == h


def test_jaccard_components(odd_docs, odd_rows, no_docs):
    found = jaccard_orders.join_components(odd_docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute.components(odd_rows)))
    assert jaccard_orders.join_components(no_docs).count() == 0


@pytest.mark.parametrize("crowd", [1, 64])
def test_jaccard_finds_links_that_stars_miss(spark, monkeypatch, crowd):
    """Chains of sets near the limit, with a passage that all share; with all pairs made in blocks, and with none."""
    monkeypatch.setattr(jaccard_orders, "CROWD", crowd)
    monkeypatch.setattr(jaccard_orders, "CROWD_BYTES", 3000)
    rng = random.Random(4)
    passage = sentence(rng, 40)
    rows, k = [], 0
    for _ in range(25):
        text = sentence(rng, rng.randint(5, 12)).split()
        for _ in range(6):
            rows.append((k, passage + " " + " ".join(text)))
            text[rng.randrange(len(text))] = f"w{k}"
            text.append(f"v{k}")
            k += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_orders.join_components(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found)) == sorted(brute.components(rows))


def test_graph(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)] + [(200, k) for k in range(201, 220)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and {found[i] for i in (100, 101, 102)} == {100} and {found[i] for i in range(200, 220)} == {200}


def test_decontamination(spark, odd_docs, no_docs):
    rng = random.Random(6)
    items = [(1, sentence(rng, 30)), (2, sentence(rng, 50).upper()), (3, None), (4, "short"), (5, sentence(rng, 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def edited(text, n):
        chars = list(text)
        for _ in range(n):
            at = rng.randrange(len(chars))
            kind = rng.randrange(3)
            chars[at : at + 1] = [["q"], [], [chars[at], "z"]][kind]
        return "".join(chars)

    rows = [(k, sentence(rng, 20) + " " + edited(items[i][1].lower(), n) + ". " + sentence(rng, 20)) for k, (i, n) in enumerate([(0, 0), (1, 0), (4, 0), (0, 3), (1, 5), (4, 6), (0, 9), (1, 14), (4, 30), (0, 60)])]
    rows += [(50, None), (51, ""), (52, sentence(rng, 4000)), (53, items[0][1] + " " + items[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(docs, bench, block_chars=200).collect()}
    clean = lambda t: decontaminate.normalise(pa.array([t]))[0].as_py()
    expected = {}
    for k, t in rows:
        for i, x in items:
            if t and x and len(clean(x)) >= decontaminate.Q and len(t) < 5000:
                size = len(clean(x))
                budget = min(int(decontaminate.RATE * size), (size - decontaminate.Q) // decontaminate.Q)
                n = brute.edit_substring(clean(x), clean(t))
                if n <= budget:
                    expected[k, i] = n
    assert found == expected and len(expected) >= 8
    kept = {r.doc_id for r in decontaminate.clean(docs, bench, block_chars=200).collect()}
    assert kept == {k for k, _ in rows} - {k for k, _ in expected}
    assert decontaminate.clean(odd_docs, bench).columns == odd_docs.columns and decontaminate.clean(odd_docs, bench).count() == odd_docs.count()
    assert decontaminate.leaks(no_docs, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0
