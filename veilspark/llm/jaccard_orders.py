"""Exact Jaccard join on word shingles by prefix filters under several global token orders.

A document's set holds its distinct shingles of five words (lower-cased A-Z; fewer words: the whole sequence as one).
Two sets link when 100 * intersection >= 75 * union. Under any global order of tokens, linked sets share a token among
their first n - ceil(0.75 n) + 1. So a candidate must share such a prefix token under each of several orders.

1. Equal sets become one node; copies need no pairs. Stars: of the nodes with the same first token under one of ``STARS``
   orders one is the hub, the one that shares first tokens with most others (of a group of edited copies that is the
   original, or nearly so). A node and a hub that meet under ``AGREE`` of the orders at least are candidates. Components
   of their verified links hold most near copies, at one comparison each instead of one for each pair.
2. The rest. Three orders put popular tokens last (the more popular the later), so shared passages hardly enter a
   prefix; each breaks ties its own way. Tokens of the first order's prefixes all of whose nodes are in one component can
   add nothing and go. Nodes of different components that share one of the others, with sizes and ranks that allow a
   link (position filter), are met with the prefixes of both under the second and the third order: the pairs whose
   prefixes meet under all three are the candidates, and only those are verified on whole sets. Nodes of tokens with
   more than ``CROWD`` nodes (large groups of texts just below the limit) are compared block by block inside tasks, by
   the same three orders, so that their pairs are never written.

Links of both steps give the components. No link between different components is lost, no list of partners is capped,
and nothing of a group is collected. What is popular (tokens of several components in prefixes by hashes alone) is cut
off at ``POPULAR`` rows so that it can be broadcast; it only shapes the orders, and under any order the result is the
same. Tokens travel as arrays, one for each range of them, and a filter of fixed size keeps those of one component
from becoming rows; what it lets through is joined exactly. Tokens are 64-bit fingerprints. A class or a text that many rows share is a hot
key of an equi-join between tables of their own, which adaptive execution splits; rows without shingles are in no join.

Null and empty texts have no shingles, link with nothing and are their own component. Rows with a null id take part;
they never name a component (a component of nothing but such rows has a null id). Repeated ids are separate documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WIDE_ROWS, column, discard, key_filter, materialise, mix, signed, slices, split_words, texts_of, window_hashes, word_hashes
from .graph import components

SHINGLE = 5
#: Orders whose first token makes a star, how many of them must agree on a pair, and seeds of the orders of the prefix filter.
STARS, AGREE = 16, 2
ORDERS = (0, 42, 43)
#: Rows of the table of popular tokens (16 bytes each).
POPULAR = 1_000_000
NULL_ID = 2**63 - 1
#: Bytes of the texts of a block of nodes, and partners of a node that are compared at a time.
BLOCK_BYTES, CHUNK = 4 << 20, 2000
#: Nodes of a token beyond which its pairs are made inside tasks only, and bytes of a block of such nodes.
CROWD, CROWD_BYTES = 64, 4 << 20
#: Leading bits that the filter of shared tokens tells apart (a broadcast of 8 MB).
FILTER_BITS = 26
TOP = np.uint64(56)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, as (row, fingerprint), sorted by both."""
    words, row = split_words(texts, lower=True)
    hashes = word_hashes(words)
    n = np.bincount(row, minlength=len(texts))
    with np.errstate(over="ignore"):
        start = np.flatnonzero(row[size - 1 :] == row[: max(0, len(row) - size + 1)]) if len(row) >= size else np.zeros(0, np.int64)
        rows, tokens = row[start], mix(window_hashes(hashes, size)[start] if len(start) else np.zeros(0, np.uint64), 1)
        few = np.flatnonzero((n > 0) & (n < size))
        if len(few):
            first = np.searchsorted(row, few)
            whole = np.zeros(len(few), np.uint64)
            for k in range(size - 1):
                there = k < n[few]
                whole[there] = mix(whole[there], 2) + hashes[first[there] + k]
            rows, tokens = np.concatenate([rows, few]), np.concatenate([tokens, mix(whole + n[few].astype(np.uint64), 3)])
            order = np.argsort(rows, kind="stable")
            rows, tokens = rows[order], tokens[order]
    _sort_each(tokens, np.searchsorted(rows, np.arange(len(texts) + 1)))
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (tokens[1:] != tokens[:-1])
    return rows[new], tokens[new]


def _sort_each(values: np.ndarray, off: np.ndarray) -> None:
    """Sort the values between offsets in place; much faster than one sort by two keys."""
    for a, b in zip(off[:-1], off[1:], strict=True):
        values[a:b].sort()


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _ends(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.bincount(rows, minlength=n)
    return size, np.cumsum(size) - size


def _signatures(percent: int):
    """Fingerprints of each set, its first token under each of the star orders, and its prefix by hashes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows, tokens = shingle_sets(texts_of(b))
            size, first = _ends(rows, b.num_rows)
            full = np.flatnonzero(size)
            out = {}
            with np.errstate(over="ignore"):
                for k, seed in enumerate((21, 22)):
                    s = np.zeros(b.num_rows, np.uint64)
                    if len(full):
                        s[full] = mix(np.add.reduceat(mix(tokens, seed), first[full]) + size[full].astype(np.uint64), seed)
                    out[f"s{k + 1}"] = signed(s)
            mins = np.zeros((len(full), STARS), np.uint64)
            for k in range(STARS if len(full) else 0):
                mins[:, k] = np.minimum.reduceat(mix(tokens, 100 + k), first[full])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *np.where(size > 0, STARS, 0)]).astype(np.int32)), pa.array(signed(mins.ravel())))
            prefix = _prefix_lists(None, rows, tokens, b.num_rows, ORDERS[0], percent)
            yield pa.RecordBatch.from_pydict({"doc_id": column(b, "doc_id"), "id": column(b, "id"), "tag": column(b, "tag"), "n": size.astype(np.int32), **out, "mins": lists, "prefix": prefix})

    return run


class Order:
    """Global orders of tokens: those that aren't popular first, then by popularity; each seed breaks ties its own way, and
    the seed 0 by the token itself."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens = tokens[order]
        self.levels = np.concatenate([1 + np.log2(counts[order].astype(float)), [0]]).astype(np.uint64)
        self.maybe = np.zeros(1 << 24, bool)
        self.maybe[self.tokens >> np.uint64(40)] = True

    def level(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), np.uint64)
        at = np.flatnonzero(self.maybe[tokens >> np.uint64(40)])
        if len(at):
            k = np.searchsorted(self.tokens, tokens[at])
            same = self.tokens[np.minimum(k, len(self.tokens) - 1)] == tokens[at]
            out[at] = np.where(same, self.levels[k], 0)
        return out

    def keys(self, tokens: np.ndarray, seed: int) -> np.ndarray:
        return (self.level(tokens) << TOP) | ((mix(tokens, seed) if seed else tokens) >> np.uint64(8))


def _prefix_lists(order_by: Order | None, rows: np.ndarray, tokens: np.ndarray, n: int, seed: int, percent: int) -> pa.Array:
    """The prefix of each of n sets (sorted) under the order with that seed, in that order. Without levels: by the tokens
    themselves."""
    size, first = _ends(rows, n)
    if order_by and seed:
        tokens = tokens[np.lexsort((order_by.keys(tokens, seed), rows))]
    elif order_by:  # sets without popular tokens are in order
        level = order_by.level(tokens)
        some = np.flatnonzero(np.isin(rows, np.unique(rows[level > 0])))
        tokens = tokens.copy()
        tokens[some] = tokens[some][np.lexsort((level[some], rows[some]))]
    chosen = np.arange(len(rows)) - first[rows] < prefix_size(size, percent)[rows]
    count = np.bincount(rows[chosen], minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count]).astype(np.int32)), pa.array(signed(tokens[chosen])))


def _prefixes(order_by, percent: int):
    """The prefix of each set under the first order, in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows, tokens = shingle_sets(texts_of(b))
            size, first = _ends(rows, b.num_rows)
            with np.errstate(over="ignore"):
                s = np.zeros((2, b.num_rows), np.uint64)
                full = np.flatnonzero(size)
                for k, seed in enumerate((21, 22) if len(full) else ()):
                    s[k, full] = mix(np.add.reduceat(mix(tokens, seed), first[full]) + size[full].astype(np.uint64), seed)
            yield pa.RecordBatch.from_pydict({"id": column(b, "id"), "tag": column(b, "tag"), "s1": signed(s[0]), "s2": signed(s[1]), "prefix": _prefix_lists(order_by.value, rows, tokens, b.num_rows, ORDERS[0], percent)})

    return run


def _dealt(ranges: int):
    """The tokens of prefixes, each once for a batch with the least and the greatest component that holds it and their
    number, as arrays of bytes for each range of tokens: one row for a range, not one for a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = column(b, "prefix")
            t = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if not len(t):
                continue
            own = np.repeat(column(b, "component").to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            order = np.lexsort((own, t))
            t, own = t[order], own[order]
            new = np.append(True, t[1:] != t[:-1])
            c = np.add.reduceat((new | np.append(True, own[1:] != own[:-1])).astype(np.int32), at := np.flatnonzero(new))
            t, low, high = t[at], own[at], own[np.append(at[1:], len(own)) - 1]
            place = ((t >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
            cut = np.flatnonzero(np.diff(place, prepend=-1))
            pieces = list(zip(cut, np.append(cut[1:], len(t)), strict=True))
            yield pa.RecordBatch.from_pydict({"range": place[cut], **{k: pa.array([v[i:j].tobytes() for i, j in pieces], pa.binary()) for k, v in (("t", t), ("low", low), ("high", high), ("c", c.astype("<i4")))}})

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens that more than one component holds, and how many do, from rows of :func:`_dealt` sorted by range."""
    held: dict[str, list[bytes]] = {}
    now = None

    def ready() -> pa.RecordBatch:
        t = np.frombuffer(b"".join(held["t"]), np.uint64)
        low, high = (np.frombuffer(b"".join(held[k]), np.int64) for k in ("low", "high"))
        order = np.argsort(t, kind="stable")
        t = t[order]
        at = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        low, high = np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at)
        c = np.add.reduceat(np.frombuffer(b"".join(held["c"]), "<i4")[order].astype(np.int64), at)
        more = low < high
        return pa.RecordBatch.from_pydict({"t": signed(t[at][more]), "c": c[more]})

    for b in batches:
        for k, one in enumerate(column(b, "range").to_pylist()):
            if one != now:
                if held:
                    yield ready()
                held, now = {x: [] for x in ("t", "low", "high", "c")}, one
            for x, parts in held.items():
                parts.append(column(b, x)[k].as_py())
    if held:
        yield ready()


def _mixed(prefixes: DataFrame) -> DataFrame:
    """t, c: tokens of the ``prefixes`` (component, prefix) of more than one component, and how many hold them (rows of
    a component in several batches count several times). A token is in one row of a range for each batch, however many
    sets hold it."""
    parts = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prefixes.select("component", "prefix").mapInArrow(_dealt(2 * parts), "range int, t binary, low binary, high binary, c binary")
    return rows.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(_met, "t long, c long")


def _postings(known):
    """Tokens of prefixes that a filter lets through, with their set and their rank in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = column(b, "prefix")
            t = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.flatnonzero(known.value.passes(t.view(np.uint64))) if len(t) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(b.num_rows), count)[at]
            rank = at - (np.cumsum(count) - count)[row]
            yield pa.RecordBatch.from_arrays([*[column(b, k).take(pa.array(row)) for k in ("node", "n", "component")], pa.array(rank.astype(np.int32)), pa.array(t[at])], names=["node", "n", "component", "rank", "t"])

    return run


def _further(order_by, percent: int):
    """The prefixes of each node under the further orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows, tokens = shingle_sets(texts_of(b))
            yield pa.RecordBatch.from_pydict({"node": column(b, "node"), **{f"p{k}": _prefix_lists(order_by.value, rows, tokens, b.num_rows, seed, percent) for k, seed in enumerate(ORDERS[1:], 1)}})

    return run


def _verify(percent: int):
    """Pairs (a, b) of a group that link, from the whole texts of its nodes."""

    def run(key: tuple, pairs: pa.Table, texts: pa.Table) -> pa.Table:
        sets: dict[int, np.ndarray] = {}
        for b in slices(iter(texts.combine_chunks().to_batches()), "text"):
            rows, tokens = shingle_sets(texts_of(b))
            size, first = _ends(rows, b.num_rows)
            for k, node in enumerate(column(b, "node").to_pylist()):
                sets[node] = tokens[first[k] : first[k] + size[k]].copy()
        a, b = (pairs.column(c).to_numpy() for c in "ab")
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        linked = np.zeros(len(a), bool)
        cut = [*np.flatnonzero(np.diff(a, prepend=a[0] - 1 if len(a) else 0)), len(a)]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            mine = sets.get(a[i])
            if mine is None:
                continue
            for k in range(i, j, CHUNK):
                at = [x for x in range(k, min(j, k + CHUNK)) if b[x] in sets]
                if not at:
                    continue
                size = np.array([len(sets[b[x]]) for x in at])
                flat = np.concatenate([sets[b[x]] for x in at])
                place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                both = np.add.reduceat((mine[place] == flat).astype(np.int64), np.cumsum(size) - size)
                linked[at] = 100 * both >= percent * (len(mine) + size - both)
        return pa.table({"a": pa.array(a[linked]), "b": pa.array(b[linked])})

    return run


class _Index:
    """Which of some sets hold each of some tokens (numbered from 0)."""

    def __init__(self, flat: np.ndarray, count: np.ndarray, tokens: int):
        self.flat, self.cut, self.sets = flat, np.concatenate([[0], np.cumsum(count)]), len(count)
        order = np.argsort(flat, kind="stable")
        self.holder = np.repeat(np.arange(self.sets), count)[order]
        self.begin = np.searchsorted(flat[order], np.arange(tokens + 1))

    def shared(self, i: int) -> np.ndarray:
        """Tokens of set i that each set holds."""
        t = self.flat[self.cut[i] : self.cut[i + 1]]
        count = self.begin[t + 1] - self.begin[t]
        at = np.repeat(self.begin[t] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.bincount(self.holder[at], minlength=self.sets)


def _crowd(order_by, percent: int):
    """Links among the nodes of two blocks of a crowd (of one, if they are the same), from their texts. Prefixes under all
    orders must meet; then whole sets are compared. Pairs exist only here, as rows of an array of counts."""

    def run(key: tuple, nodes: pa.Table) -> pa.Table:
        x, y = key[1].as_py(), key[2].as_py()
        node, own, component = (nodes.column(c).to_numpy() for c in ("node", "own", "component"))
        texts = nodes.column("text").combine_chunks()
        rows, tokens = shingle_sets((pa.chunked_array([texts]) if isinstance(texts, pa.Array) else texts).combine_chunks().fill_null(""))
        n = len(node)
        size, first = _ends(rows, n)
        dense, code = np.unique(tokens, return_inverse=True)
        views = []
        for seed in ORDERS:
            lists = _prefix_lists(order_by.value, rows, tokens, n, seed, percent)
            flat = np.searchsorted(dense, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            views.append(_Index(flat, pc.list_value_length(lists).to_numpy(zero_copy_only=False), len(dense)))
        views.append(_Index(code, size, len(dense)))
        a, b = [], []
        for i in np.flatnonzero(own == x):
            fits = (own == y) & (component != component[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
            if x == y:
                fits[: i + 1] = False
            for view in views[:-1]:
                if not fits.any():
                    break
                fits &= view.shared(i) > 0
            live = np.flatnonzero(fits)
            if len(live):
                both = views[-1].shared(i)[live]
                live = live[100 * both >= percent * (size[live] + size[i] - both)]
            partners = node[live]
            a.append(np.minimum(partners, node[i]))
            b.append(np.maximum(partners, node[i]))
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return run


def _crowd_links(listed: DataFrame, crowded: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, repeated: bool, order_by) -> DataFrame:
    """Links among nodes that share a crowded token. Nodes that crowded tokens connect are one crowd; its nodes fall into
    blocks of about ``CROWD_BYTES`` of text and each two blocks are one task, so no list of pairs is ever written."""
    members = listed.join(crowded, "t", "left_semi")
    heads = members.groupBy("t").agg(F.min("node").alias("a"))
    crowds = components(members.join(heads, "t").select("a", F.col("node").alias("b")).distinct())
    found = docs.join(nodes.select("node", "id", "tag").join(crowds.select("node"), "node", "left_semi"), ["id", "tag"]).select("node", "text")
    texts = materialise(found.dropDuplicates(["node"]) if repeated else found, "jaccard-texts", tidy=True)
    placed = crowds.withColumnRenamed("component", "crowd").join(members.select("node", "component").distinct(), "node").join(texts, "node")
    sizes = placed.groupBy("crowd").agg(F.ceil(F.sum(F.octet_length("text")) / F.lit(CROWD_BYTES)).cast("int").alias("blocks"))
    blocked = placed.join(sizes, "crowd").withColumn("own", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))).cast("int"))
    dealt = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)))
    dealt = dealt.select("crowd", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "own", "component", "text")
    # else a crowd, by which the rows lie already, would be one task
    dealt = dealt.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "crowd", "x", "y")
    return materialise(dealt.groupBy("crowd", "x", "y").applyInArrow(_crowd(order_by, percent), "a long, b long").distinct(), "jaccard-links", tidy=True, rows=WIDE_ROWS)


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, repeated: bool, order_by=None) -> DataFrame:
    """The pairs (a, b) of nodes that link, verified on whole texts. With an order, prefixes under all further orders must
    meet first. Nodes fall into blocks of about ``BLOCK_BYTES`` of text, and a task compares the pairs of two blocks: a
    text is sent once for each block that it has partners in, not once for each partner. ``repeated``: whole rows may
    occur twice."""
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node").select("node", "id", "tag")
    texts = materialise((lambda x: x.dropDuplicates(["node"]) if repeated else x)(docs.join(need, ["id", "tag"]).select("node", "text")), "jaccard-texts", tidy=True)
    if order_by is not None:
        names = [f"p{k}" for k in range(1, len(ORDERS))]
        held = materialise(texts.mapInArrow(_further(order_by, percent), "node long, " + ", ".join(f"{x} array<long>" for x in names)), "jaccard-further", rows=WIDE_ROWS)
        for side in "ab":
            pairs = pairs.join(held.select(F.col("node").alias(side), *[F.col(x).alias(f"{x}_{side}") for x in names]), side)
        meet = reduce(lambda x, y: x & y, [F.arrays_overlap(f"{x}_a", f"{x}_b") for x in names])
        pairs = materialise(pairs.where(meet).select("a", "b"), "jaccard-candidates", tidy=True)
        discard(held)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).alias("x" if c == "a" else "y")
    placed = pairs.select("a", "b", block("a"), block("b"))
    wanted = placed.select(F.col("a").alias("node"), "x", "y").union(placed.select("b", "x", "y")).distinct()
    ready = texts.join(wanted, "node").select(F.col("x").alias("to_x"), F.col("y").alias("to_y"), "node", "text")
    found = placed.groupBy("x", "y").cogroup(ready.groupBy("to_x", "to_y")).applyInArrow(_verify(percent), "a long, b long")
    found = materialise(found.distinct(), "jaccard-links", tidy=True, rows=WIDE_ROWS)
    discard(texts)
    if order_by is not None:
        discard(pairs)
    return found


def join_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, text_crc32, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    docs = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NULL_ID)).alias("id"), F.crc32(F.coalesce("text", F.lit(""))).alias("tag"), "text")
    signs = materialise(docs.mapInArrow(_signatures(percent), "doc_id long, id long, tag long, n int, s1 long, s2 long, mins array<long>, prefix array<long>"), "jaccard-signs", rows=WIDE_ROWS)
    repeated = not signs.groupBy("id", "tag").count().where("count > 1").isEmpty()
    first = F.min(F.struct("id", "tag"))
    sets = signs.where("n > 0").groupBy("s1", "s2").agg(F.min("n").alias("n"), F.min("doc_id").alias("least"), first.alias("rep"), F.first("mins").alias("mins"))
    twice = sets.where("least is not null").groupBy("least").count().where("count > 1").select("least", F.lit(True).alias("shared"))
    named = sets.join(twice, "least", "left").withColumn("node", F.when(F.col("shared") | F.col("least").isNull(), F.col("s1")).otherwise(F.col("least")))
    nodes = materialise(named.select("node", "s1", "s2", "n", "least", "rep.id", "rep.tag", "mins"), "jaccard-nodes")

    stars = nodes.select("node", "n", F.posexplode("mins").alias("k", "m"))
    held_by = stars.groupBy("k", "m").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared_firsts = materialise(stars.join(held_by, ["k", "m"]), "jaccard-firsts")
    central = shared_firsts.groupBy("node").agg(F.sum("c").alias("central"))
    ranked = shared_firsts.join(central, "node").withColumn("order", F.struct(-F.col("central"), "node"))
    hubs = ranked.groupBy("k", "m").agg(F.min_by(F.struct("node", "n"), "order").alias("hub")).select("k", "m", F.col("hub.node").alias("a"), F.col("hub.n").alias("n_a"))
    hubs = materialise(hubs, "jaccard-hubs")  # a table of its own, so that a popular first token is a join that can be split
    met = shared_firsts.join(hubs, ["k", "m"]).where("a <> node").where(100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a"))
    met = met.groupBy(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).agg(F.countDistinct("k").alias("orders"))
    pairs = materialise(met.where(F.col("orders") >= AGREE).select("a", "b"), "jaccard-stars")
    discard(shared_firsts)
    discard(hubs)
    found = _linked(pairs, nodes, docs, percent, repeated)
    discard(pairs)
    groups = components(found)

    named = nodes.join(groups, "node").select("s1", "component")
    popular = materialise(_mixed(signs.where("n > 0").join(named, "s1", "left").select(F.coalesce("component", "s1").alias("component"), "prefix")), "jaccard-popular", tidy=True, rows=WIDE_ROWS)
    top = popular.orderBy(F.desc("c"), "t").limit(POPULAR).toArrow()  # bounded
    order = spark.sparkContext.broadcast(Order(top.column("t").to_numpy().astype(np.int64).view(np.uint64), top.column("c").to_numpy()))
    held = docs.mapInArrow(_prefixes(order, percent), "id long, tag long, s1 long, s2 long, prefix array<long>")
    held = held.where(F.size("prefix") > 0).join(nodes.select("node", "s1", "s2", "n", "id", "tag"), ["s1", "s2", "id", "tag"])
    held = (held.dropDuplicates(["node"]) if repeated else held).join(groups, "node", "left")
    held = materialise(held.select("node", "n", F.coalesce("component", "node").alias("component"), "prefix"), "jaccard-prefixes", tidy=True, rows=WIDE_ROWS)
    mixed = materialise(_mixed(held).select("t"), "jaccard-tokens", tidy=True, rows=WIDE_ROWS)
    rows = held.mapInArrow(_postings(key_filter(mixed, FILTER_BITS)), "node long, n int, component long, rank int, t long")
    listed = materialise(rows.join(mixed, "t"), "jaccard-postings", tidy=True, rows=WIDE_ROWS)
    crowded = materialise(listed.groupBy("t").count().where(F.col("count") > CROWD).select("t"), "jaccard-crowded")
    few = listed.join(crowded, "t", "left_anti")
    left, right = (few.select("t", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "component", "rank")]) for s in "ab")
    needed = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))
    fits = (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    place = F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b")) >= needed
    pairs = left.join(right, (left["t"] == right["t"]) & fits & place).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    pairs = materialise(pairs.distinct(), "jaccard-pairs", tidy=True)
    more = _linked(pairs, nodes, docs, percent, repeated, order)
    if not crowded.isEmpty():
        more = more.union(_crowd_links(listed, crowded, nodes, docs, percent, repeated, order))
    groups = components(found.union(more))
    for table in (held, mixed, listed, crowded, pairs, found):
        discard(table)

    # a component is named by its least node, which is a doc_id unless one of its nodes goes by a fingerprint
    labelled = nodes.join(groups, "node", "left").select("node", "s1", "s2", "least", F.coalesce("component", "node").alias("component"))
    labelled = materialise(labelled, "jaccard-labels")
    odd = labelled.where(~F.col("node").eqNullSafe(F.col("least"))).select("component").distinct()
    heads = labelled.join(odd, "component", "left_semi").groupBy("component").agg(F.min("least").alias("component_id"), F.lit(True).alias("renamed"))
    labelled = labelled.join(heads, "component", "left").select("s1", "s2", F.when(F.col("renamed"), F.col("component_id")).otherwise(F.col("component")).alias("component_id"))
    with_sets = signs.where("n > 0").join(labelled, ["s1", "s2"], "left").select("doc_id", "tag", "n", "component_id")
    rows = with_sets.unionByName(signs.where("n = 0").select("doc_id", "tag", "n", F.col("doc_id").alias("component_id")))
    return rows.select("doc_id", F.col("tag").alias("text_crc32"), F.col("n").cast("long").alias("n_shingles"), "component_id")
