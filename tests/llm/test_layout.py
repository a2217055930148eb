import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import sentence
from veilspark.llm import packing, pipeline, slots
from veilspark.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_shards(spark, odd_docs, odd_rows, no_docs, tmp_path):
    rows = slots.shard(odd_docs, 4, 64).collect()
    sizes = Counter((r.doc_id, r["size"], r.text_crc32) for r in rows)
    assert sizes == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in odd_rows)
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in places.values()) and all(0 <= s < 4 for s in places)
    assert slots.shard(no_docs, 4, 64).count() == 0


def test_shards_are_those_of_the_rule(spark):
    """Slots, the edited map and places, recomputed row by row."""
    rng = random.Random(9)
    docs = [(k, "y" * int(rng.paretovariate(1.1) * 9) if k % 7 else rng.choice(["same", None])) for k in range(600)]
    n_slots, n = 64, 5
    rows = []
    for k, text in docs:
        data = (text or "").encode()
        crc = zlib.crc32(data)
        rows.append((int(hashlib.md5(f"{k}:{crc}".encode()).hexdigest()[:8], 16) % n_slots, k, crc, len(data) + 1))
    size = Counter()
    for s, _, _, b in rows:
        size[s] += b
    share, load, shard = -(-sum(size.values()) // n), [0] * n, {}
    for b, s in sorted(((size[s], s) for s in range(n_slots)), reverse=True):
        to = s % n if load[s % n] + b <= share else load.index(min(load))
        load[to] += b
        shard[s] = to
    places, expected = Counter(), set()
    for s, k, crc, b in sorted(rows):
        expected.add((k, b, crc, s, shard[s], places[shard[s]]))
        places[shard[s]] += 1
    found = slots.shard(spark.createDataFrame(docs, "doc_id long, text string"), n, n_slots).collect()
    assert {(r.doc_id, r["size"], r.text_crc32, r.virtual_slot, r.shard, r.slot) for r in found} == expected


def test_balance_and_moves(spark, tmp_path):
    rng = random.Random(1)
    docs = spark.createDataFrame([(k, "x" * int(rng.paretovariate(1.2) * 20)) for k in range(4000)], "doc_id long, text string")
    rows = slots.slotted(docs, 256)
    sizes = slots.slot_sizes(rows, 256).cache()
    assert sizes.count() == 256
    first = slots.first_map(spark, 4, 256)
    path = str(tmp_path / "map")
    slots.save_version(first, path)
    slots.save_version(slots.rebalance(first, sizes, 4), path)
    even = slots.load_version(spark, path)
    load = lambda m: [r[0] for r in m.join(sizes, "virtual_slot").groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    before, after = load(first), load(even)
    total, largest = sum(after), sizes.agg(F.max("bytes")).first()[0]
    assert max(after) <= max(total / 4 * 1.02, largest) and max(after) - min(after) <= max(before) - min(before)
    assert slots.moved(first, even).count() < 128 and slots.load_version(spark, path, 1).where("version = 1").count() == 256
    more = slots.rebalance(even, sizes, 5)
    assert {r.shard for r in more.collect()} == set(range(5)) and slots.moved(even, more).count() < 128


def test_stored_map_goes_on(spark, tmp_path):
    """Runs that share a table: equal data leaves it alone, other data or another number of shards adds a version."""
    rng = random.Random(4)
    path = str(tmp_path / "kept")
    docs = spark.createDataFrame([(k, "x" * rng.randrange(200)) for k in range(2000)], "doc_id long, text string")
    held = lambda df, n=4, slack=0.02: {(r.doc_id, r.virtual_slot): (r.shard, r.version) for r in slots.shard(df, n, 256, path, slack).collect()}
    one = held(docs)
    assert {v for _, v in one.values()} == {2} and held(docs) == one
    more = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 5000))
    assert {k: v for k, v in held(more, slack=0.5).items() if k in one} == one  # even enough: nothing moves
    heavy = docs.withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.repeat(F.lit("y"), 5000)).otherwise(F.col("text")))
    new = slots.shard(heavy, 4, 256, path, 0.02).collect()
    assert {r.version for r in new} == {3}
    five = held(docs, 5)
    assert {v for _, v in five.values()} == {4} and {s for s, _ in five.values()} == set(range(5))
    assert slots.load_version(spark, path, 2).count() == 256  # earlier versions stay
    with pytest.raises(ValueError):
        slots.shard(docs, 4, 128, path)



def best_fit(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits)[1]] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit(items):
    runs = packing.plan(Counter(items), 40)
    filled = defaultdict(list)
    for length, first, sequence, each, offset in runs:
        later = [r[1] for r in runs if r[0] == length and r[1] > first]
        for rank in range(first, min(later, default=Counter(items)[length])):
            filled[sequence + (rank - first) // each].append((offset + (rank - first) % each * length, length))
    assert sorted(x for v in filled.values() for _, x in v) == sorted(items) and len(filled) == best_fit(items, 40)
    for v in filled.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 40


def test_room_tree():
    tree = packing.RoomTree(1024)
    assert tree.tightest(0) is None
    for r in (5, 700, 1024):
        tree.add(r, 1)
    assert [tree.tightest(x) for x in (0, 5, 6, 700, 701, 1024)] == [5, 5, 700, 700, 1024, 1024]
    tree.add(1024, -1)
    assert tree.tightest(701) is None


def test_ids_are_the_library_s():
    rng = random.Random(2)
    slow = Tokenizer.from_file(PATH)
    slow.encode_special_tokens = True
    texts = ["", " ", "a  b", "a\n \n b ", "it's we'll THEY'RE 's", "x <|endoftext|> y", "a　 b", "你好 мир", "é" * 100, "a" * 3000] + ["".join(rng.choice("ab \n\t'1.éß½²_\x0b ’") for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    encoder = Encoder(PATH)
    assert encoder.fast is not None
    ids, off = encoder.encode(pa.array(texts), 2)
    for k, t in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == [*slow.encode(t, add_special_tokens=False).ids, 2], t


def test_packing_round_trip(spark, odd_docs, odd_rows, no_docs):
    rows = packing.pack(odd_docs, PATH, 128, with_ids=True).collect()
    slow = Tokenizer.from_file(PATH)
    whole = Counter((i, tuple([*slow.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in odd_rows)
    by_sequence = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and (r.length == 128 or r.piece == 0)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for v in by_sequence.values():
        assert [o for o, _ in sorted(v)] == np.concatenate([[0], np.cumsum([n for _, n in sorted(v)])])[:-1].tolist() and sum(n for _, n in v) <= 128
    single = {i for i, n in Counter(i for i, _ in odd_rows).items() if n == 1}
    joined = defaultdict(list)
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.piece)):
        if r.doc_id in single:
            assert r.start == len(joined[r.doc_id])
            joined[r.doc_id] += r.ids
    assert {(i, tuple(v)) for i, v in joined.items()} == {x for x in whole if x[0] in single}
    assert len(by_sequence) == best_fit([r.length for r in rows], 128)
    assert packing.pack(no_docs, PATH).count() == 0


def test_pipeline_stages(spark, odd_docs, tmp_path):
    """Each stage alone against brute force, with its decisions in effect and all columns kept."""
    rng = random.Random(12)
    item, passage = sentence(rng, 40), sentence(rng, 60)
    texts = {k: sentence(rng, 40) for k in range(30)}
    texts |= {30: texts[3], 31: texts[3] + " more", 32: f"{sentence(rng, 30)} {item} {sentence(rng, 5)}", 33: f"{sentence(rng, 70)} {passage}", 34: f"{sentence(rng, 70)} {passage} {sentence(rng, 20)}", 35: "too short", 36: None}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts.items()], brute.DOCS).withColumn("row", F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    where = str(tmp_path)
    one = pipeline.quality_rules_stage(spark, docs, where)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(texts) - {35, 36}
    two = pipeline.jaccard_stage(spark, one, where)
    heads = {i for i, n, c in brute.components([(k, t) for k, t in texts.items() if k not in (35, 36)]) if i == c}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == heads and 30 not in heads
    three = pipeline.suffix_stage(spark, two, where).collect()
    removed = {i: r for i, _, r, _, _ in brute.remove_repeats([(k, texts[k]) for k in heads])}
    assert {r.doc_id: len((texts[r.doc_id]).encode()) - len(r.text.encode()) for r in three} == removed and removed[34] >= len(passage) and all(r.n_chars == len(r.text) for r in three)
    assert {r.doc_id for r in pipeline.decontaminate_stage(spark, two, where).collect()} == heads - {32}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "suffix_dedup", "benchmark_decontamination", "best_fit_packing"]
    final = corpus_pipeline.run(spark, where).collect()
    assert {r.doc_id for r in final} == heads - {32}
    for stage in (pipeline.jaccard_stage, pipeline.suffix_stage, pipeline.decontaminate_stage, pipeline.quality_rules_stage):
        assert stage(spark, odd_docs, where).columns == odd_docs.columns and stage(spark, docs.limit(0), where).count() == 0
    repeated = pipeline.jaccard_stage(spark, odd_docs, where)
    assert repeated.groupBy("doc_id", "text").count().where("count > 1").count() == 0
