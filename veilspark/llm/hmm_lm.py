"""Hidden Markov language model: Baum-Welch over all training texts, exact likelihood of whole texts.

Tokens are lower-cased (A-Z) words and one end for each text. The ``SYMBOLS`` most frequent training tokens are symbols
of the hidden Markov model; any other token is the symbol of its class (``CLASSES`` classes, by the word's last two
bytes) and a draw of the word within the class, by counts with 0.1 added and one place for words never seen. So every
token has a probability and those of a text multiply to a proper likelihood:

    log10 P(text) = log10 of the forward recursion over symbols + sum of log10 P(word | class) of its rarer words.

Training: texts become sequences of symbols once (a table in the shared folder). Each round reads all of them, computes
expected counts by the scaled forward-backward recursion in each partition and adds them up by symbol in a shuffle; the
re-estimated tables have a fixed size and are broadcast for the next round. Texts are whole in training and in scoring:
those of more than ``SEGMENT`` tokens advance in pieces of that length side by side; pieces become products of transfer
matrices, which are chained, so that each is entered with exactly what precedes and follows it.

Counts of rare words (any number of them) are never broadcast: the words are joined to their counts in a shuffle. A
rare word is by construction at most one token in ``SYMBOLS``, so that join has no hot key.

Words are identified by 64-bit fingerprints. Null texts are empty: one token, the end. The crc32 of a null id is that
of the empty string. Repeated rows are separate texts. With nothing to train on, N and V are 0 and all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, column, discard, hash_strings, materialise, signed, slices, split_words, texts_of

SYMBOLS, CLASSES = 60_000, 1024
STATES, ROUNDS = 8, 5
SEGMENT = 1024
#: Bytes of symbol sequences handled at a time (two for each token).
SEQUENCE_BYTES = 1 << 20
#: The end token's key; words have fingerprints.
END = 0
#: Weight of the training frequencies in each state's emissions, in tokens.
PRIOR = 200.0


def _classes(words: pa.Array) -> np.ndarray:
    raw, off = buffers(words)
    last = raw[off[1:] - 1].astype(np.int64)
    before = np.where(np.diff(off) > 1, raw[np.maximum(off[1:] - 2, 0)], 0).astype(np.int64)
    return (last * 251 + before * 31) % CLASSES


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, code) of each word; fingerprint and class of each code."""
    words, row = split_words(texts, lower=True)
    coded = words.dictionary_encode()
    if not len(words):
        return row, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), hash_strings(coded.dictionary), _classes(coded.dictionary)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        _, code, keys, classes = _coded(texts_of(b))
        n = np.bincount(code, minlength=len(keys))
        yield pa.RecordBatch.from_pydict({"k": np.append(signed(keys), END), "cls": np.append(classes, -1).astype(np.int32), "n": np.append(n, b.num_rows)})


def word_counts(texts: DataFrame) -> DataFrame:
    """k, cls, n of every distinct token of all ``texts`` (text)."""
    return texts.select("text").mapInArrow(_count_words, "k long, cls int, n long").groupBy("k").agg(F.first("cls").alias("cls"), F.sum("n").alias("n")).where("n > 0")


def _sequences(table):
    """Each text as symbols (two bytes each) and the list of its rarer words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, symbols = table.value
        part, done = TaskContext.get().partitionId() << 40, 0
        for b in slices(batches, "text"):
            row, code, words, classes = _coded(texts_of(b))
            at = np.minimum(np.searchsorted(keys, words), max(0, len(keys) - 1))
            known = keys[at] == words if len(keys) else np.zeros(len(words), bool)
            symbol = np.where(known, symbols[at] if len(keys) else 0, 1 + SYMBOLS + classes)
            n = b.num_rows
            size = np.bincount(row, minlength=n)
            cut = np.cumsum(size + 1)
            stream = np.zeros(cut[-1], "<u2")
            stream[np.arange(len(row)) + row] = symbol[code]  # the end is symbol 0
            rare = ~known[code]
            lists = pa.StructArray.from_arrays([pa.array(signed(words)[code[rare]]), pa.array(classes[code[rare]].astype(np.int32))], names=["k", "cls"])
            begin = np.concatenate([[0], cut[:-1]])
            yield pa.RecordBatch.from_pydict({
                "rid": part + done + np.arange(n), "doc_id": column(b, "doc_id"), "held_out": column(b, "held_out"), "n_tokens": size + 1,
                "seq": pa.array([stream[i:j].tobytes() for i, j in zip(begin, cut, strict=True)], pa.binary()),
                "rare": pa.ListArray.from_arrays(pa.array(np.searchsorted(row[rare], np.arange(n + 1)).astype(np.int32)), lists)})
            done += n

    return run


class Tables:
    """Start, transition and emission probabilities; emissions are by symbol (rows) and state."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit.astype(np.float32)


def _layout(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length; tokens step by step over all sequences that reach a step; where each step begins."""
    order = np.argsort(-size, kind="stable")
    active = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
    begin = np.concatenate([[0], np.cumsum(active)])
    step = np.repeat(np.arange(len(active)), active)
    return order, first[order][np.arange(begin[-1]) - begin[step]] + step, begin


def _pieces(off: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and sizes of runs of at most ``most`` tokens, and the text of each."""
    size = np.diff(off)
    count = -(-size // most)
    row = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = off[:-1][row] + k * most
    return first, np.minimum(most, off[1:][row] - first), row


def _borders(t: Tables, symbols: np.ndarray, first: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a piece begins its text; the states before it, given all of the text that precedes it; and the likelihood of
    all that follows it by its last state (up to a factor). ``of``: the text of each piece, in order.

    The pieces of longer texts become transfer matrices, all at a time, which are chained from either end."""
    states = len(t.start)
    head = np.append(True, of[1:] != of[:-1])
    before, after = np.zeros((len(of), states)), np.ones((len(of), states))
    long = np.flatnonzero(~head | np.append(~head[1:], False))
    if not len(long):
        return head, before, after
    order, token, begin = _layout(first[long], size[long])
    rows = np.tile(np.eye(states, dtype=np.float32), (len(long), 1, 1))
    heads, move, start = head[long][order], t.move.astype(np.float32), t.start.astype(np.float32)
    symbols = symbols[token]
    for step, (a, b) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
        k = b - a
        now = (rows[:k].reshape(-1, states) @ move).reshape(k, states, states)
        if not step:
            now[heads] = start
        emit = t.emit[symbols[a:b]]
        now *= (emit / emit.max(axis=1, keepdims=True))[:, None, :]
        rows[:k] = now if step % 4 else now / now.max(axis=(1, 2))[:, None, None]
    back = np.empty(len(long), np.int64)
    back[order] = np.arange(len(long))
    rows = rows[back].astype(np.float64)
    rows /= rows.max(axis=(1, 2))[:, None, None]
    place = np.arange(len(long))
    depth = place - np.maximum.accumulate(np.where(head[long], place, 0))  # of a piece in its text
    for d in range(1, int(depth.max()) + 1):
        at = place[depth == d]
        state = rows[at - 1, 0] if d == 1 else np.einsum("ns,nst->nt", before[long[at - 1]], rows[at - 1])
        before[long[at]] = state / state.sum(axis=1, keepdims=True)
    for d in range(int(depth.max()), 0, -1):
        at = place[depth == d]
        state = np.einsum("nst,nt->ns", rows[at], after[long[at]])
        after[long[at - 1]] = state / state.max(axis=1, keepdims=True)
    return head, before, after


def expected_counts(t: Tables, symbols: np.ndarray, off: np.ndarray, most: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts and transitions of whole sequences (between offsets), the posterior of the states of each token,
    the tokens' symbols in the same order, and the log-likelihood of all sequences.

    Sequences of more than ``most`` tokens advance in pieces; what lies on either side of a piece enters it exactly."""
    first, size, of = _pieces(off, most)
    head, before, after = _borders(t, symbols, first, size, of)
    order, token, begin = _layout(first, size)
    head, before, after = head[order], before[order].astype(np.float32), after[order].astype(np.float32)
    move, states = t.move.astype(np.float32), len(t.start)
    symbols = symbols[token]
    emit = t.emit[symbols]
    post, scale = np.empty_like(emit), np.empty(len(symbols), np.float32)
    last = None
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        now = np.multiply(emit[a:b], np.where(head[:, None], t.start.astype(np.float32), before @ move) if last is None else last[: b - a] @ move, out=post[a:b])
        np.sum(now, axis=1, out=scale[a:b])
        now /= scale[a:b, None]
        last = now
    emit /= scale[:, None]
    moves = np.zeros((states, states))
    if len(begin) == 1:
        return np.zeros(states), moves, post, symbols, 0.0
    ends = begin[size[order] - 1] + np.arange(len(order))
    beta = after / (post[ends] * after).sum(axis=1, keepdims=True)
    for a, b, past in zip(begin[-2:0:-1], begin[:1:-1], begin[-3::-1], strict=True):
        k = b - a
        post_here = post[a:b] * beta[:k]
        back = beta[:k] * emit[a:b]
        moves += post[past : past + k].T @ back
        post[a:b] = post_here
        beta[:k] = back @ move.T
    post[: begin[1]] *= beta
    inner = ~head
    moves += before[inner].T @ (beta * emit[: begin[1]])[inner]
    starts = post[: begin[1]][head].sum(axis=0, dtype=np.float64)
    return starts, moves * t.move, post, symbols, float(np.log(scale.astype(np.float64)).sum())


def _gather(model, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = model.value
        states = len(t.start)
        emits, rest = np.zeros((total, states)), np.zeros((states + 1, states))
        for b in slices(batches, "seq", SEQUENCE_BYTES):
            raw, off = buffers(column(b, "seq"))
            symbols = raw.view("<u2").astype(np.int64)
            starts, moves, post, symbols, _ = expected_counts(t, symbols, off // 2)
            rest[0] += starts
            rest[1:] += moves
            for s in range(states):
                emits[:, s] += np.bincount(symbols, weights=post[:, s], minlength=total)
        there = np.flatnonzero(emits.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([there, np.arange(-states - 1, 0)]).astype(np.int32)), *[pa.array(np.concatenate([emits[there, s], rest[:, s]])) for s in range(states)]],
            names=["symbol", *[f"s{s}" for s in range(states)]],
        )

    return run


def baum_welch(sequences: DataFrame, frequency: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Tables:
    """Tables after ``rounds`` passes over all ``sequences`` (seq). ``frequency``: training tokens of each symbol."""
    total = len(frequency)
    prior = (frequency + 0.01) / (frequency + 0.01).sum()
    noise = np.random.default_rng(5).gumbel(size=(total, states))
    emit = prior[:, None] * np.exp(0.5 * noise)
    move = np.full((states, states), 0.05 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    t = Tables(np.full(states, 1 / states), move, emit / emit.sum(axis=0))
    columns = [f"s{s}" for s in range(states)]
    for _ in range(rounds):
        shared = sequences.sparkSession.sparkContext.broadcast(t)  # SYMBOLS + CLASSES + 1 rows, fixed
        summed = sequences.select("seq").mapInArrow(_gather(shared, total), "symbol int, " + ", ".join(f"{c} double" for c in columns)).groupBy("symbol").agg(*[F.sum(c).alias(c) for c in columns])
        rows = summed.toArrow()
        shared.unpersist()
        key = rows.column("symbol").to_numpy()
        value = np.stack([rows.column(c).to_numpy() for c in columns], axis=1)
        counts, rest = np.zeros((total, states)), np.zeros((states + 1, states))
        counts[key[key >= 0]] = value[key >= 0]
        rest[key[key < 0] + states + 1] = value[key < 0]
        emit = counts + PRIOR * prior[:, None]
        t = Tables((rest[0] + 0.1) / (rest[0] + 0.1).sum(), (rest[1:] + 0.1) / (rest[1:] + 0.1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return t


def log_likelihood(t: Tables, symbols: np.ndarray, off: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Natural log-likelihood of each whole sequence by the scaled forward recursion, in double precision."""
    states, move, emit = len(t.start), t.move, t.emit.astype(np.float64)
    size = np.diff(off)
    out = np.zeros(len(size))
    short = np.flatnonzero(size <= segment)
    order, token, begin = _layout(off[:-1][short], size[short])
    last, sums = None, np.zeros(len(short))
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        now = (t.start if last is None else last[: b - a] @ move) * emit[symbols[token[a:b]]]
        total = now.sum(axis=1)
        sums[: b - a] += np.log(total)
        last = now / total[:, None]
    out[short[order]] = sums
    long = np.flatnonzero(size > segment)
    if not len(long):
        return out
    # a transfer matrix for each segment but the first: rows are the states before it
    begin, length, of = _pieces(np.concatenate([[0], np.cumsum(size[long])]), segment)
    shift = (off[:-1][long] - np.concatenate([[0], np.cumsum(size[long])[:-1]]))[of]
    begin = begin + shift
    order, token, steps = _layout(begin, length)
    head = np.concatenate([[True], of[1:] != of[:-1]])[order]
    rows = np.tile(np.eye(states), (len(order), 1, 1))
    scale = np.zeros(len(order))
    for step, (a, b) in enumerate(zip(steps[:-1], steps[1:], strict=True)):
        k = b - a
        now = rows[:k] @ move if step else np.where(head[:, None, None], t.start[None, None, :], rows[:k] @ move)
        now = now * emit[symbols[token[a:b]]][:, None, :]
        total = now.max(axis=(1, 2))
        scale[:k] += np.log(total)
        rows[:k] = now / total[:, None, None]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    rows, scale = rows[back], scale[back]
    for k, text in enumerate(long):
        mine = np.flatnonzero(of == k)
        state, value = rows[mine[0]][0], scale[mine[0]]
        for m in mine[1:]:
            total = state.sum()
            state, value = (state / total) @ rows[m], value + np.log(total) + scale[m]
        out[text] = value + np.log(state.sum())
    return out


def _score(model, logs):
    """Log10 likelihood of the symbols, and base score and count of known tokens among the frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, (base, seen) = model.value, logs.value
        for b in slices(batches, "seq", SEQUENCE_BYTES):
            raw, off = buffers(column(b, "seq"))
            symbols, off = raw.view("<u2").astype(np.int64), off // 2
            row = np.repeat(np.arange(b.num_rows), np.diff(off))
            frequent = symbols <= SYMBOLS
            names = ["rid", "doc_id", "held_out", "n_tokens"]
            yield pa.RecordBatch.from_arrays(
                [*[column(b, n) for n in names], pa.array(np.bincount(row, weights=frequent & seen[symbols], minlength=b.num_rows).astype(np.int64)),
                 pa.array(np.bincount(row, weights=np.where(frequent, base[symbols], 0), minlength=b.num_rows)), pa.array(log_likelihood(t, symbols, off) / np.log(10))],
                names=[*names, "known", "base", "hmm"],
            )

    return run


def score(docs: DataFrame, held_out, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    ``held_out``: a boolean column; other rows train. base_score: sum of log10((c + 0.1) / (N + 0.1 * (V + 1))).
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    counts = materialise(word_counts(docs.where("not held_out")), "hmm-counts", tidy=True)
    size, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.where(F.col("k") != END).orderBy(F.desc("n"), "k").limit(SYMBOLS).toArrow()  # bounded
    keys = top.column("k").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    table = (keys[order], (1 + order).astype(np.int64))
    rare = counts.join(F.broadcast(spark.createDataFrame(top.select(["k"]))), "k", "left_anti").where(F.col("k") != END)
    per_class = rare.groupBy("cls").agg(F.sum("n").alias("cls_n"), F.count(F.lit(1)).alias("cls_v"))
    classes = {r[0]: (r[1], r[2]) for r in per_class.collect()}  # at most CLASSES rows
    frequency = np.zeros(1 + SYMBOLS + CLASSES)
    frequency[1 : 1 + len(keys)] = top.column("n").to_numpy()
    frequency[0] = next((r[0] for r in counts.where(F.col("k") == END).select("n").collect()), 0)
    for c, (n, _) in classes.items():
        frequency[1 + SYMBOLS + c] = n
    made = docs.mapInArrow(_sequences(spark.sparkContext.broadcast(table)), f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, seq binary, rare array<struct<k:long,cls:int>>")
    made = materialise(made, "hmm-sequences", tidy=True)
    model = spark.sparkContext.broadcast(baum_welch(made.where("not held_out"), frequency, states, rounds))
    denominator = size + 0.1 * (distinct + 1)
    logs = spark.sparkContext.broadcast((np.log10((frequency + 0.1) / denominator), frequency > 0))
    scored = made.drop("rare").mapInArrow(_score(model, logs), f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, known long, base double, hmm double")
    words = made.select("rid", F.inline("rare"))
    sized = spark.createDataFrame([(c, *classes.get(c, (0, 0))) for c in range(CLASSES)], "cls int, cls_n long, cls_v long")
    found = words.join(rare.select("k", "n"), "k", "left").join(F.broadcast(sized), "cls")
    c = F.coalesce("n", F.lit(0))
    sums = found.groupBy("rid").agg(
        F.sum((c > 0).cast("long")).alias("rare_known"), F.sum(F.log10((c + 0.1) / F.lit(denominator))).alias("rare_base"),
        F.sum(F.log10((c + 0.1) / (F.col("cls_n") + 0.1 * (F.col("cls_v") + 1)))).alias("rare_score"),
    )
    zero = F.lit(0.0)
    out = scored.join(sums, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(size).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"), (F.col("hmm") + F.coalesce("rare_score", zero)).alias("score"),
    )
    return out if size else out.withColumns({"base_score": zero, "score": zero})
