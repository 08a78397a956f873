"""What the operators of this subpackage share: shared folders, splits, word and shingle hashing.

Texts travel to Python in Arrow batches and are handled a batch at a time with
pyarrow and numpy: words are dictionary-encoded, each distinct word of a batch is
hashed once, and shingles are rolled over the codes of the whole batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_dir

#: Texts of one step inside a task, in bytes (a longer text is a step of its own).
STEP_CHARS = 2_000_000
#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 16 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most in this session, so that a task holds as much of long rows as of short ones.

    A bound that the session has stays.
    """
    key, unset = "spark.sql.execution.arrow.maxBytesPerBatch", str((1 << 31) - 2)
    if spark.conf.get(key, unset) == unset:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """A query that is written in here deletes its shuffle files when it is through, so they don't wait for the driver's collector."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends, a lost executor costs nothing, and shuffle files go."""
    bounded_batches(df.sparkSession)
    path = shared_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def held_out(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's text leaves remainder 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == 2, F.lit(False))


def hash_unit(col: Column, seed: int) -> Column:
    """A uniform number in [0, 1) that depends on the value alone."""
    return F.pmod(F.xxhash64(col, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of each have at most so many bytes, or are one row."""
    for b in batches:
        n = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(n), 0
        while start < len(n):
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + most, "right")))
            yield b.slice(start, stop - start)
            start = stop
    release()


def release() -> None:
    """Give freed memory back to the system: workers live on for tasks that need other amounts."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


class Words:
    """The lower-case white-space words of a batch of texts: codes into distinct words, with offsets by text."""

    def __init__(self, texts: pa.Array, ascii_only: bool = False):
        """ascii_only: lower-cases A-Z and splits at the white space of ASCII alone."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = texts.take(pa.array(np.arange(len(texts))))  # a copy: ascii_lower misreads slices
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts)) if ascii_only else pc.utf8_split_whitespace(pc.utf8_lower(texts))
        flat = lists.flatten()
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        if not full.all():
            offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
            flat = flat.filter(pa.array(full))
        coded = flat.dictionary_encode()
        self.offsets = offsets
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = coded.dictionary

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def hashes(self, distinct: pa.Array | None = None) -> np.ndarray:
        """A 64-bit hash of each distinct word: the sum of scrambled (place, byte) pairs, scrambled again."""
        raw = (self.distinct if distinct is None else distinct).cast(pa.large_binary())
        if not len(raw):
            return np.empty(0, np.uint64)
        ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
        n, starts = np.diff(ends), ends[:-1] - ends[0]
        each = mix((((np.arange(len(data)) - np.repeat(starts, n)).astype(np.uint64) << np.uint64(8)) | data) * _MULT + _MULT)
        out = n.astype(np.uint64)
        full = n > 0
        if full.any():
            out[full] += np.add.reduceat(each, starts[full])
        return mix(out)


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingles(words: Words, size: int = 5, bits: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Ids (of so many bits) of all word shingles of a batch, and offsets by text.

    A text of fewer than `size` words, but at least one, has one shingle: all of
    its words. A text without words has none.
    """
    h = words.hashes()[words.codes]
    n = np.diff(words.offsets)
    total = len(h)
    acc = np.zeros(total, np.uint64)
    for j in range(min(size, total)):
        acc[: total - j] = acc[: total - j] * _MULT + (h[j:] if j else h)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    at = np.repeat(words.offsets[:-1] - offsets[:-1], count) + np.arange(offsets[-1])
    out = acc[at]
    for d in np.flatnonzero((n > 0) & (n < size)):
        x = np.uint64(n[d])
        for w in h[words.offsets[d] : words.offsets[d + 1]]:
            x = np.uint64((int(x) * int(_MULT) + int(w)) & 0xFFFFFFFFFFFFFFFF)
        out[offsets[d]] = x
    return mix(out) >> np.uint64(64 - bits), offsets


def distinct_by_doc(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each text in ascending order, how often each occurs, and new offsets. ids have 48 bits."""
    docs = len(offsets) - 1
    parts = []
    for first in range(0, docs, 65_535):
        last = min(docs, first + 65_535)
        doc = np.repeat(np.arange(last - first, dtype=np.uint64), np.diff(offsets[first : last + 1]))
        key = np.sort((doc << np.uint64(48)) | ids[offsets[first] : offsets[last]])
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        tf = np.diff(np.concatenate([new, [len(key)]]))
        key = key[new]
        per = np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=last - first)
        parts.append((key & np.uint64((1 << 48) - 1), tf, per))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(1, np.int64)
    counts = np.concatenate([p[2] for p in parts])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([[0], np.cumsum(counts)])


class Pool:
    """Ids of strings met so far, in one array: number of a string -> its ids."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.flat, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def add(self, strings: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of the strings, which may be known: they are met under the last number."""
        first = len(self.ends) - 1
        self.place.update(zip(strings, range(first, first + len(strings)), strict=True))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, ids])
        return np.arange(first, first + len(strings))

    def numbers(self, strings) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, strings), np.int64, len(strings))

    def learnt(self, strings: list[str], learn) -> np.ndarray:
        """Numbers of strings, by `learn` (which adds them, and returns theirs) of those that aren't here yet."""
        found = np.fromiter(map(self.place.get, strings, itertools.repeat(-1)), np.int64, len(strings))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            found[missing] = learn([strings[i] for i in missing.tolist()])
        return found

    def runs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of these strings begin, and how many each has."""
        begin = self.ends[numbers]
        return begin, self.ends[numbers + 1] - begin

    def ids(self, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ids of such runs in a row."""
        at = np.repeat(begin - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return self.flat[at]

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these strings in a row, and how many each has."""
        begin, n = self.runs(numbers)
        return self.ids(begin, n), n


def tokenizer_path(name: str, path: str | None = None) -> str:
    """Where a vocabulary file lies; `path` overrides the public package's own place."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def binary_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary value for each text: its slice of `values`."""
    raw = np.ascontiguousarray(values)
    width = raw.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

