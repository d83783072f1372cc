"""Helpers shared by the corpus operators: column selection, shared-folder tables, byte tokenisation."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.storage import shared_dir, write_table  # noqa: F401 (the operators take them from here)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- columns


class Columns:
    """A frame with positional inner names, so that clashing or case-variant names never meet.

    The first column of the exact name is meant by that name; every other column only travels along.
    """

    def __init__(self, df: DataFrame):
        self.outer = list(df.columns)
        self.inner = [f"__in_{i}" for i in range(len(self.outer))]
        self.df = df.toDF(*self.inner)

    def __call__(self, name: str) -> Column:
        if name not in self.outer:
            raise KeyError(f"the table has no column {name!r}; it has {self.outer}")
        return F.col(self.inner[self.outer.index(name)])

    def has(self, name: str) -> bool:
        return name in self.outer

    def select(self, **names: str) -> DataFrame:
        """select(id='doc_id') gives the column doc_id under the name id."""
        return self.df.select(*[self(outer).alias(new) for new, outer in names.items()])

    def restore(self, df: DataFrame, *extra: str) -> DataFrame:
        return df.select(*self.inner, *extra).toDF(*self.outer, *extra)


#: A side of a join that is certainly smaller than this is sent to all executors; any other is shuffled.
BROADCAST_BYTES = 32 << 20


def small_side(df: DataFrame, row_bytes: Column) -> DataFrame:
    """df, marked for broadcasting if the sum of row_bytes over it is small; costs a pass over df, so write it first."""
    size = df.agg(F.sum(row_bytes).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


class Mapped:
    """Arrays in files that each executor fetches once and its tasks map, so that its workers share their pages."""

    def __init__(self, spark: SparkSession, **arrays: np.ndarray):
        folder = tempfile.mkdtemp(prefix="sievewright-")
        atexit.register(shutil.rmtree, folder, True)  # executors that come later fetch them too
        self.files = {name: f"{name}-{uuid.uuid4().hex}.npy" for name in arrays}
        for name, x in arrays.items():
            np.save(f"{folder}/{self.files[name]}", x)
            spark.sparkContext.addFile(f"{folder}/{self.files[name]}")

    @property
    def arrays(self) -> dict[str, np.ndarray]:
        return {name: np.load(SparkFiles.get(file), mmap_mode="r") for name, file in self.files.items()}


def released(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """task, after which its worker, which Spark keeps for later ones, gives back the memory it has freed."""

    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return run


def text_digest(text: Column) -> Column:
    """128 bits that name a text; null for a null text."""
    return F.unhex(F.md5(text))


# ---------------------------------------------------------------- tokens from Arrow buffers

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True
_rng = np.random.default_rng(20240611)
_BYTE_HASH = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
#: Bytes that are hashed at a time, in the processor's cache; powers of an odd number, and of its inverse.
_PIECE = 1 << 16
_POWERS, _INVERSE = (np.multiply.accumulate(np.append(np.uint64(1), np.full(_PIECE - 1, x, np.uint64))) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
#: Bytes that one call of tokenise() is given at a time; a longer text comes alone and whole.
CHUNK_BYTES = 1 << 22


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges [i, j) of at most limit bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capital letters of ASCII and Latin-1 made small."""
    low = _LOWER[data]
    upper = np.flatnonzero(low[:-1] == 0xC3) + 1
    upper = upper[(low[upper] >= 0x80) & (low[upper] <= 0x9E) & (low[upper] != 0x97)]
    low[upper] += 32
    return low


def prefix_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray, sizes: tuple[int, ...]):
    """For each size in turn (index of the words that are longer, in bytes; hash of that many first bytes)."""
    h, deep = np.zeros(len(start), np.uint64), 0
    live = np.arange(len(start))
    for p in sizes:
        live = live[end[live] - start[live] > p]
        for k in range(deep, p):
            h[live] += _BYTE_HASH[low[start[live] + k]] * _POWERS[k]
        deep = p
        yield live, mix64(h[live] + np.uint64(p))


def _split_unspaced(low: np.ndarray, word: np.ndarray, begins: np.ndarray) -> None:
    """In place: characters of U+3000 to U+9FFF, Thai, Lao, Burmese and Khmer are words of their own; what lies from
    U+3000 to U+303F is none."""
    at = np.flatnonzero((low >= 0xE0) & (low <= 0xE9))
    at = at[at + 2 < len(low)]
    lead, second = low[at], low[at + 1]
    own = (lead >= 0xE3) | ((lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB)) | ((lead == 0xE1) & ((second <= 0x82) | (second == 0x9E) | (second == 0x9F)))
    sign = at[(lead == 0xE3) & (second == 0x80)]
    at = at[own]
    for k in range(3):
        word[sign + k] = False
    begins[at] = word[at]
    after = at[at + 3 < len(low)] + 3
    begins[after] = word[after]
    begins[sign] = False


def tokenise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as maximal runs of letters and digits, in lower case; in scripts written without spaces, each character.

    Returns (hash of each word, first token of each row (rows + 1), first byte, end byte of each word).
    """
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = lowered(data)
    word = _WORD[low]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = word[first]  # a row begins a word even where the row before ends in one
    if low.max() >= 0xE0:
        _split_unspaced(low, word, begins)
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), start, start
    last = word.copy()
    last[:-1] &= ~word[1:] | begins[1:]
    end = np.flatnonzero(last) + 1
    return _word_hashes(low, start, end), np.searchsorted(start, offsets), start, end


def _word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial of each word's bytes, from running sums over a piece of the text."""
    out = np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):
        j = max(k + 1, int(np.searchsorted(end, start[k] + _PIECE, side="right")))
        s = start[k]
        value = _BYTE_HASH[low[s : end[j - 1]]]
        value *= _POWERS[: len(value)] if len(value) <= _PIECE else np.resize(_POWERS, len(value))
        total = np.cumsum(value)
        first = start[k:j] - s
        out[k:j] = (total[end[k:j] - s - 1] - total[first] + value[first]) * _INVERSE[first]
        k = j
    return mix64(out)
