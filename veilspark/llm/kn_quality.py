"""Quality by the perplexity of an interpolated modified Kneser-Ney trigram model of trusted text.

The model is fitted on all labelled good documents but one in ``HELD``, whole; its tables grow with them. Trigrams are
dealt out by their middle word: the counts of a trigram, of the contexts before and behind it and of the middle word
then lie in one shard, where they are merged, so a shard builds its tables of probabilities and back-off weights by
itself. What shards can't know comes from counts over all of them: discounts for counts of one, two and three or more
at each order, from counts of counts, and how many words each word follows (collected and broadcast whole; this grows
with the vocabulary of the trusted texts, not with their length).

Documents are scored by a join: the trigrams of every text go to the shards in ``ROUNDS`` rounds, a part of the shards in
each, and only sums of logarithms by text come back. Trigrams travel as arrays, one for each shard and slice of texts,
with the slice's words numbered and those that no trusted text has as one; nothing is a row of a shuffle for each token. Equal texts have equal scores, so sums of
rounds meet by two hashes of the text.

One trusted document in ``HELD`` (by a hash of its id) never takes part in a fit. A document is kept if its perplexity is
within the ``quantile`` of that of the trusted documents of its language outside the fit. A further trusted document
exceeds the k-th least of n such values with probability 1 - k / (n + 1) at most, so for the share 1 - ``quantile`` no
cutoff exists below n = quantile / (1 - quantile) documents (199): a language with fewer, or with none, keeps everything.

Words are split at ASCII white space and keep their case; the end of a text is a token. Null texts are empty. A null
language is one of its own (and not the empty one). A document with several labels counts by its lowest quality. Repeated ids share a label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, column, discard, hash_strings, key_filter, materialise, mix, signed, slices, split_words, texts_of

SHARDS = 4
#: Rounds in which documents are scored, and rows of arrays in an Arrow batch.
ROUNDS, PACKED_ROWS = 4, 64
#: Shards of a model at least: what a slice sends to one of them stays small.
LEAST_SHARDS = 96
#: Bytes of texts whose trigrams travel together.
DEAL_BYTES = 16 << 20
QUANTILE, HELD = 0.995, 3
#: Fingerprints of a word that no trusted text has, and of the start and the end of a text.
UNKNOWN, START, STOP = np.uint64(0), np.uint64(1), np.uint64(2)


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts as numbers, two starts before and an end behind each; the row of each token; fingerprints by number."""
    words, row = split_words(texts)
    coded = words.dictionary_encode()
    known = np.concatenate([np.array([START, STOP], np.uint64), hash_strings(coded.dictionary)])
    n = len(texts)
    size = np.bincount(row, minlength=n)
    out = np.zeros(len(row) + 3 * n, np.int64)
    out[np.arange(len(row)) + 3 * row + 2] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 2
    out[np.cumsum(size + 3) - 1] = 1
    return out, np.repeat(np.arange(n), size + 3), known


def _stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the tokens of all texts, two starts before and an end behind each, and the row of each token."""
    s, row, known = _coded(texts)
    return known[s], row


def _join(*keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros(len(keys[0]), np.uint64)
        for k in keys:
            out = mix(out * BASE + k, 3)
        return out


def _large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with about ``DEAL_BYTES`` of text, whatever the rows of those that come in: a word is sent once for each."""
    held, size = [], 0
    for b in slices(batches, "text", DEAL_BYTES):
        held.append(b)
        size += pc.sum(pc.binary_length(column(b, "text"))).as_py() or 0
        if size >= DEAL_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _small(x: np.ndarray) -> np.ndarray:
    most = int(x.max(initial=0))
    return x.astype("<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")


def pack(known: np.ndarray, abc: list[np.ndarray], extra: np.ndarray) -> bytes:
    """Trigrams of numbered words, with a number for each, as compressed bytes. ``known``: what the numbers stand for, in
    ascending order; only what occurs is kept, as differences, and like bytes of all numbers lie together."""
    used = np.zeros(len(known), bool)
    for x in abc:
        used[x] = True
    at = np.flatnonzero(used)
    place = np.zeros(len(known), np.int64)
    place[at] = np.arange(len(at))
    names = known[at].astype(np.uint64)
    names[1:] -= names[:-1].copy()
    parts = [_small(x) for x in (names, *[place[x] for x in abc], extra)]
    raw = np.array([x for p in parts for x in (p.itemsize, len(p))], np.int64).tobytes() + b"".join(p.view(np.uint8).reshape(-1, p.itemsize).T.tobytes() for p in parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(packed: bytes, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """a, b, c and the number of each trigram of :func:`pack`; ``names``: what the words of ``known`` are numbers of."""
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    at, parts = 80, []
    for size, n in np.frombuffer(raw, np.int64, 10).reshape(5, 2).tolist():
        parts.append(np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n).T.copy().view(f"<u{size}").reshape(n))
        at += size * n
    known, *abc, extra = parts
    known = np.cumsum(known, dtype=np.uint64)
    if names is not None:
        known = names[known]
    return (*[known[x] for x in abc], extra)


def _dealt(s: np.ndarray, row: np.ndarray, known: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The trigrams of a slice with the row of each, by the shard ``of`` the middle word (below 0: they don't travel)."""
    ok = np.flatnonzero(row[2:] == row[:-2])
    b = s[ok + 1]
    ok, b = ok[of[b] >= 0], b[of[b] >= 0]
    order = np.argsort(of[b] * len(known) + b, kind="stable")
    ok, shard = ok[order], of[b[order]]
    cut = np.flatnonzero(np.diff(shard, prepend=-1))
    for i, j in zip(cut, np.append(cut[1:], len(ok)), strict=True):
        yield int(shard[i]), pack(known, [s[ok[i:j] + k] for k in range(3)], row[ok[i:j]])


def _shard(words: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(words, 21) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _fit_deal(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _large(batches):
            s, row, known = _coded(texts_of(b))
            known, number = np.unique(known, return_inverse=True)
            for shard, packed in _dealt(number[s], row, known, _shard(known, shards)):
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "packed": [packed]})

    return run


def _of_counts(counts: np.ndarray) -> np.ndarray:
    """How many are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by shard: the trigrams of each by pairs with their counts, and counts of the counts of trigrams and
    of words before a pair."""

    def ready(shard: int, held: list[bytes]) -> pa.RecordBatch:
        a, b, c = (np.concatenate(x) for x in zip(*[unpack(p)[:3] for p in held], strict=True))
        order = np.lexsort((a, c, b))
        a, b, c = a[order], b[order], c[order]
        pair = np.append(True, (b[1:] != b[:-1]) | (c[1:] != c[:-1]))
        new = np.flatnonzero(pair | np.append(True, a[1:] != a[:-1]))
        n = np.diff(np.append(new, len(a)))
        a, b, c, pair = a[new], b[new], c[new], np.flatnonzero(pair[new])
        known, at = np.unique(np.concatenate([a, b, c]), return_inverse=True)
        return pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "packed": pa.array([pack(known, np.split(at, 3), n)], pa.binary()),
            "threes": [_of_counts(n).tolist()], "twos": [_of_counts(np.diff(np.append(pair, len(a)))).tolist()]})

    held, now = [], None
    for b in batches:
        for shard, packed in zip(column(b, "shard").to_pylist(), column(b, "packed").to_pylist(), strict=True):
            if shard != now and held:
                yield ready(now, held)
                held = []
            now = shard
            held.append(packed)
    if held:
        yield ready(now, held)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that the pairs of shards end in, and the number of pairs."""
    for batch in batches:
        for packed in column(batch, "packed").to_pylist():
            _, b, c, _ = unpack(packed)
            words, kinds = np.unique(c[np.append(True, (b[1:] != b[:-1]) | (c[1:] != c[:-1]))], return_counts=True)
            yield pa.RecordBatch.from_pydict({"word": signed(words), "kinds": kinds})


def discounts_of(n: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4 (0.75 for all where those are too few)."""
    n = n.astype(float)
    if (n == 0).any():
        return np.array([0, 0.75, 0.75, 0.75])
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], [0, 0.05, 0.1, 0.1], [0, 1, 2, 3])


def discounts(counts: np.ndarray) -> np.ndarray:
    return discounts_of(_of_counts(counts))


class Table:
    """Values by key in shards: ranges of sorted keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, shards: int = SHARDS):
        order = np.argsort(keys)
        keys, values = keys[order], values[order].astype(np.float32)
        cuts = np.searchsorted(keys, (np.arange(1, shards, dtype=np.uint64) * np.uint64(2**64 // shards & 2**64 - 1)))
        self.shards = list(zip(np.split(keys, cuts), np.split(values, cuts), strict=True))

    def get(self, keys: np.ndarray, otherwise: float) -> np.ndarray:
        out = np.full(len(keys), otherwise, np.float32)
        of = (keys >> np.uint64(32)).astype(np.int64) * len(self.shards) >> 32
        for k, (own, values) in enumerate(self.shards):
            mine = np.flatnonzero(of == k)
            if len(own) and len(mine):
                at = np.minimum(np.searchsorted(own, keys[mine]), len(own) - 1)
                out[mine] = np.where(own[at] == keys[mine], values[at], otherwise)
        return out


def _level(context: np.ndarray, counts: np.ndarray, lower: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interpolated probability of each n-gram; contexts and their back-off weights."""
    d = cut[np.minimum(counts, 3)]
    keys, of = np.unique(context, return_inverse=True)
    total = np.bincount(of, weights=counts)
    back = np.bincount(of, weights=d) / total
    return (counts - d) / total[of] + back[of] * lower, keys, back


class Lowest:
    """Probabilities of words alone, from the number of words each follows; the discounts of the orders above."""

    def __init__(self, words: np.ndarray, kinds: np.ndarray, twos: np.ndarray, threes: np.ndarray):
        d = discounts(kinds)[np.minimum(kinds, 3)]
        self.unknown = d.sum() / kinds.sum() / (len(words) + 1)
        self.one = Table(words, (kinds - d) / kinds.sum() + self.unknown, 1)
        self.twos, self.threes = twos, threes

    def names(self) -> np.ndarray:
        """What the numbers of words stand for: the words of the table, a start, and all that aren't there."""
        return np.concatenate([self.one.shards[0][0], np.array([START, UNKNOWN], np.uint64)])

    def numbers(self, known: np.ndarray) -> np.ndarray:
        words = self.one.shards[0][0]
        at = np.searchsorted(words, known)
        return np.where(words[np.minimum(at, len(words) - 1)] == known, at, np.where(known == START, len(words), len(words) + 1))


class Model:
    """Three orders of probabilities and the back-off weights of contexts, from distinct trigrams. With ``lowest`` they
    may be a part: all trigrams of some middle words, which holds for those."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, counts: np.ndarray, lowest: Lowest | None = None):
        pair = _join(b, c)
        pairs, first, at, follow = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)  # words seen before each pair
        pb, pc_ = b[first], c[first]
        lowest = lowest or Lowest(*np.unique(pc_, return_counts=True), discounts(follow), discounts(counts))
        self.one, self.unknown = lowest.one, lowest.unknown
        p2, ctx2, back2 = _level(pb, follow, self.one.get(pc_, self.unknown).astype(float), lowest.twos)
        p3, ctx3, back3 = _level(_join(a, b), counts, p2[at], lowest.threes)
        self.two, self.three = Table(pairs, p2), Table(_join(a, b, c), p3)
        self.back_two, self.back_three = Table(ctx2, back2), Table(ctx3, back3)

    def probability(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """P(c | a b)."""
        p = self.three.get(_join(a, b, c), 0)
        rest = np.flatnonzero(p == 0)
        ra, rb, rc = a[rest], b[rest], c[rest]
        low = self.two.get(_join(rb, rc), 0)
        none = np.flatnonzero(low == 0)
        low[none] = self.back_two.get(rb[none], 1) * self.one.get(rc[none], self.unknown)
        p[rest] = self.back_three.get(_join(ra, rb), 1) * low
        return p


def _let_through(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(known.value.passes(column(b, "hash").to_numpy().view(np.uint64)))).select(["doc_id", "text"])

    return run


def fit(docs: DataFrame, trusted: DataFrame) -> tuple[DataFrame, Lowest | None, int]:
    """The trigram counts of the documents in ``trusted`` (doc_id, each once) by shard, what all shards share, and the
    number of shards."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(LEAST_SHARDS, 2 * parts)
    hashed = docs.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("hash"), "text")
    some = hashed.mapInArrow(_let_through(key_filter(trusted.select(F.xxhash64("doc_id")))), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")
    held = some.join(trusted, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # of a repeated id one text
    dealt = held.select("text").mapInArrow(_fit_deal(shards), "shard int, packed binary").repartition(parts, "shard").sortWithinPartitions("shard")
    table = materialise(dealt.mapInArrow(_merged, "shard int, packed binary, threes array<long>, twos array<long>"), "kn-counts", tidy=True, rows=PACKED_ROWS)
    counted = table.select("threes", "twos").toArrow()
    if not counted.num_rows:
        return table, None, shards
    twos, threes = (discounts_of(np.array(counted.column(k).to_pylist()).sum(axis=0)) for k in ("twos", "threes"))
    words = table.select("packed").mapInArrow(_words, "word long, kinds long").groupBy("word").agg(F.sum("kinds").cast("int").alias("kinds")).toArrow()  # at most a word and a count for each word of the trusted texts
    return table, Lowest(words.column("word").to_numpy().view(np.uint64), words.column("kinds").to_numpy(), twos, threes), shards


def _asked(shared, shards: int, turn: int):
    """Trigrams of texts for the shards of a round. The first row of a slice also has its texts' hashes and sizes, and in
    the first round the sums over trigrams with an unknown word inside, which back off to the last word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        lowest = shared.value
        names = lowest.names()
        for k, batch in enumerate(_large(batches)):
            s, row, known = _coded(texts_of(batch))
            known, number = np.unique(lowest.numbers(known), return_inverse=True)
            s, n = number[s], batch.num_rows
            of, there = _shard(names[known], shards), known < len(names) - 1
            size, total = np.bincount(row, minlength=n) - 2, np.zeros(n)
            if not turn:
                ok = np.flatnonzero((row[2:] == row[:-2]) & ~there[s[1:-1]])
                p = np.log10(np.append(lowest.one.shards[0][1], np.float32([1, lowest.unknown])).astype(np.float64)[known])
                total = np.bincount(row[ok], weights=p[s[ok + 2]], minlength=n)
            head = np.concatenate([column(batch, "k1").to_numpy(), column(batch, "k2").to_numpy(), size, total.view(np.int64)]).astype("<i8").tobytes()
            out = lambda shard, packed, head: pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "slice": [base + k], "texts": pa.array([n], pa.int32()), "packed": [packed], "head": pa.array([head], pa.binary())})  # noqa: E731, B023
            for shard, packed in _dealt(s, row, known, np.where(there & (of % ROUNDS == turn), of, -1)):
                yield out(shard, packed, head)
                head = None
            if head:
                yield out(turn, b"", head)

    return run


def _answered(shared):
    """Sums of log10 probabilities by text, for each array of trigrams; the counts of a shard come before those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, model, names = None, None, shared.value.names()
        for b in batches:
            for shard, part, n, packed, head in zip(*[column(b, k).to_pylist() for k in ("shard", "slice", "texts", "packed", "head")], strict=True):
                if part < 0:
                    now, model = shard, Model(*unpack(packed), shared.value)
                    continue
                if shard != now:  # no trusted text has a word of this shard inside
                    none = np.zeros(0, np.uint64)
                    now, model = shard, Model(none, none, none, np.zeros(0, np.int64), shared.value)
                total = np.zeros(n)
                if packed:
                    x, y, z, row = unpack(packed, names)
                    total = np.bincount(row, weights=np.log10(model.probability(x, y, z).astype(np.float64)), minlength=n)
                yield pa.RecordBatch.from_pydict({"slice": [part], "shard": pa.array([shard], pa.int32()), "sums": [total.astype("<f8").tobytes()], "head": pa.array([head], pa.binary())})

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k1, k2, n, total of each text, from rows sorted by slice."""
    now, total, head = None, None, None

    def ready() -> pa.RecordBatch:
        k1, k2, n, own = np.frombuffer(head, "<i8").reshape(4, -1)
        return pa.RecordBatch.from_pydict({"k1": k1, "k2": k2, "n": n, "total": total + own.view("<f8")})

    for b in batches:
        for part, sums, first in zip(*[column(b, k).to_pylist() for k in ("slice", "sums", "head")], strict=True):
            if part != now:
                if now is not None:
                    yield ready()
                now, total, head = part, 0.0, None
            total = total + np.frombuffer(sums, "<f8")
            head = head or first
    if now is not None:
        yield ready()


def score(docs: DataFrame, table: DataFrame, lowest: Lowest, shards: int) -> DataFrame:
    """doc_id, lang, n_tokens, log10_prob, perplexity of every row of ``docs`` by the counts of :func:`fit`."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(lowest)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", "lang", F.xxhash64(text).alias("k1"), F.crc32(text).alias("k2"), "text")
    rounds = []
    for turn in range(ROUNDS):
        asked = keyed.select("k1", "k2", "text").mapInArrow(_asked(shared, shards, turn), "shard int, slice long, texts int, packed binary, head binary")
        counts = table.where(F.col("shard") % ROUNDS == turn).select("shard", F.lit(-1).cast("long").alias("slice"), F.lit(0).alias("texts"), "packed", F.lit(None).cast("binary").alias("head"))
        met = counts.unionByName(asked).repartition(parts, "shard").sortWithinPartitions("shard", "slice")
        sums = met.mapInArrow(_answered(shared), "slice long, shard int, sums binary, head binary").repartition(parts, "slice").sortWithinPartitions("slice", "shard")
        found = materialise(sums.mapInArrow(_gathered, "k1 long, k2 long, n long, total double"), "kn-sums", tidy=True, rows=PACKED_ROWS)
        rounds.append(found.groupBy("k1", "k2").agg(F.max("n").alias("n"), F.min("total").alias("total")))  # equal texts, equal sums
    whole = rounds[0]
    for more in rounds[1:]:
        whole = whole.unionByName(more)
    whole = whole.groupBy("k1", "k2").agg(F.max("n").alias("n_tokens"), F.sum("total").alias("log10_prob"))
    rows = keyed.select("doc_id", "lang", "k1", "k2").join(whole, ["k1", "k2"])
    return rows.select("doc_id", "lang", "n_tokens", "log10_prob", F.pow(F.lit(10.0), F.least(-F.col("log10_prob") / F.col("n_tokens"), F.lit(300.0))).alias("perplexity"))


def _language():
    """A key for a language; null is a language of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_tokens, log10_prob, perplexity, threshold, kept of every row of ``docs`` (doc_id, lang, text)."""
    trusted = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(HELD)) == 0
    table, lowest, shards = fit(docs, trusted.where(~held))
    if lowest is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", "lang", F.lit(None).cast("long").alias("n_tokens"), none.alias("log10_prob"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("kept"))
    scored = materialise(score(docs, table, lowest, shards), "kn-scores", tidy=True)
    discard(table)
    known = scored.join(trusted.where(held), "doc_id").select(_language().alias("of"), "perplexity")
    limit = F.percentile_approx("perplexity", quantile, 10_000)
    by_language = materialise(known.groupBy("of").agg(F.when(F.count(F.lit(1)) * (1 - quantile) >= quantile - 1e-9, limit).alias("threshold")), "kn-thresholds")
    rows = scored.withColumn("of", _language()).join(by_language, "of", "left").drop("of")
    return rows.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
