"""Scratch tables, Arrow batch slicing and vectorised hashing shared by the operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; this is their separator.
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of text that a Python worker handles at a time (one longer text is handled alone).
SLICE_BYTES = 4 << 20
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch where a row is a text or a long array, and in the queries' sessions.
WIDE_ROWS, TEXT_ROWS = 1000, 2000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where that is unset, as in tests, a folder of our own: a
    temporary one if driver and executors are one process, else one in the warehouse, which a cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] == "local":
            base = "file://" + tempfile.mkdtemp(prefix="veilspark-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/veilspark-scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Plans that run inside send Python workers at most ``rows`` rows at a time. Buffers of a batch are held by the JVM
    and by the worker, so rows that are texts or long arrays need fewer of them than the default."""
    before = spark.conf.get(ARROW_ROWS)
    if rows:
        spark.conf.set(ARROW_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        if rows:
            spark.conf.set(ARROW_ROWS, before)


def text_batches(spark: SparkSession) -> None:
    """Size the Arrow batches of a session for tables of texts, unless it has a size of its own."""
    if spark.conf.get(ARROW_ROWS) == "10000":  # Spark's default
        spark.conf.set(ARROW_ROWS, str(TEXT_ROWS))


def materialise(df: DataFrame, name: str, tidy: bool = False, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it reread: lineage ends there, and a lost
    executor costs no recomputation of what came before. ``tidy``: let go of the shuffle files behind it. ``rows``: as
    for :func:`arrow_rows`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with arrow_rows(spark, rows):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if tidy:
        release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files that nobody refers to. It acts when the JVM collects garbage; the
    last query is garbage once its listeners know of its end, and all of it only at a second collection. Listeners that
    are behind after ten seconds, as they may be after stages of very many tasks, are not waited for: the files go later."""
    for _ in range(2):
        gc.collect()
        try:
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        except Py4JJavaError as e:
            if "TimeoutException" not in str(e.java_exception):
                raise
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialise` wrote and that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    parents = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for p in parents:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes; rows stay whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column with null as the empty string."""
    return pc.fill_null(column(batch, name), "")


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of a slice, one after the other, and the row each comes from."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)  # as split_pattern_regex(texts, SPACES), and several times as fast
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), counts)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), row[full.to_numpy(zero_copy_only=False)]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Splitmix64 finaliser on unsigned 64-bit numbers; each seed is another permutation."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(256, dtype=np.uint64), 7)
_BYTES2 = mix(np.arange(256, dtype=np.uint64), 11)


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and the n+1 offsets of its strings in them."""
    strings = pa.concat_arrays([strings]) if strings.offset else strings
    wide = pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type)
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int64 if wide else np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = strings.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw, offsets - offsets[0]


def hash_strings(strings: pa.Array) -> np.ndarray:
    """A 64-bit fingerprint of each string: its bytes as the digits of a number to an odd base, mod 2**64."""
    raw, off = buffers(strings)
    if not len(strings):
        return np.zeros(0, np.uint64)
    length = np.diff(off)
    place = np.arange(len(raw)) - np.repeat(off[:-1], length)
    with np.errstate(over="ignore"):
        power = np.ones(int(length.max(initial=0)) + 1, np.uint64)
        power[1:] = BASE
        power = np.multiply.accumulate(power)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * power[place], out=total[1:])
        return mix(total[off[1:]] - total[off[:-1]] + length.astype(np.uint64) * _M2)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit fingerprint of each word of :func:`split_words`; each distinct word is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    return hash_strings(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` values, by doubling; one fewer than ``size`` shorter than the input."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, have, step, power = None, 0, values, BASE
        width, rest = 1, size
        while rest:
            if rest & 1:
                piece = step[have : have + n]
                out = piece.copy() if out is None else out * power + piece
                have += width
            rest >>= 1
            if rest:
                step = step[: len(step) - width] * power + step[width:]
                power = power * power
                width *= 2
        return out


def byte_values(raw: np.ndarray, second: bool = False) -> np.ndarray:
    return (_BYTES2 if second else _BYTES)[raw]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def row_offsets(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each of n rows in the sorted array of row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))


class KeyFilter:
    """A bit for the leading bits of each key: lets all of them through, and some others."""

    def __init__(self, bits: np.ndarray, width: int):
        self.bits, self.width = bits, width

    def passes(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> np.uint64(64 - self.width)).astype(np.int64)
        return (self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def _filter_words(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = np.unique(b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - width)).astype(np.int64)
            if len(slot):
                at = np.flatnonzero(np.diff(slot >> 5, prepend=-1))
                yield pa.RecordBatch.from_pydict({"word": slot[at] >> 5, "bits": np.bitwise_or.reduceat(np.int64(1) << (slot & 31), at)})

    return run


def key_filter(keys: DataFrame, width: int = 25):
    """A broadcast :class:`KeyFilter` of a column of hashes. Its size is fixed; at most 2**width / 32 rows are collected."""
    words = keys.mapInArrow(_filter_words(width), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << width - 5, "<u4")
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype("<u4")
    return keys.sparkSession.sparkContext.broadcast(KeyFilter(bits.view(np.uint8), width))
