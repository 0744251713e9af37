"""Helpers shared by the operators of this package.

Functions that run inside Python tasks are pickled by value, so executors need
numpy / pyarrow but not this package on their path.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__package__])


# -- storage -----------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares."""
    return ensure_checkpoint_dir(spark).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (cuts lineage)."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: what goes to a Python task at once; texts differ in length, so bytes bound it too
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4096", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python tasks by small Arrow batches."""
    for name, value in BATCH_CONF.items():
        spark.conf.set(name, value)


def keyed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the wanted columns under fixed names, so other columns never clash.

    A name is matched exactly if it can be, else ignoring case; columns whose
    names differ only by case are told apart by position.
    """
    small_batches(df.sparkSession)
    names = df.columns
    lower = [n.lower() for n in names]
    at = {name: names.index(src) if src in names else lower.index(src.lower()) for name, src in columns.items()}
    by_place = df.toDF(*[f"_{i}" for i in range(len(names))])
    return by_place.select(*[F.col(f"_{i}").alias(name) for name, i in at.items()])


# -- inside Python tasks -----------------------------------------------------


def _caches() -> dict:
    key = "_spendlens_worker_cache"
    mod = sys.modules.get(key)
    if mod is None:
        mod = sys.modules[key] = types.ModuleType(key)
    return mod.__dict__


def process_cache(name: str) -> dict:
    """A dict that lives in the Python worker (reused from task to task) until another operator begins there."""
    return _caches().setdefault(name, {})


def new_owner() -> str:
    """Names one call of an operator, whose tasks share what their workers cache."""
    return uuid.uuid4().hex


def begin(owner: str) -> None:
    """Drop what the worker still keeps of other operators' calls."""
    kept = _caches()
    if kept.get("_owner") != owner:
        for name in [n for n, v in kept.items() if isinstance(v, dict)]:
            del kept[name]
        kept["_owner"] = owner
        pa.set_memory_pool(pa.system_memory_pool())  # what Arrow frees goes back to the system
        release_memory()


def owned(owner: str, fn):
    """``fn`` for ``mapInArrow`` as part of one operator call: its workers hold no other call's
    caches, and give freed memory back after each task."""

    def run(batches):
        begin(owner)
        yield from fn(batches)
        release_memory()

    return run


def release_memory() -> None:
    """Give freed memory back to the system; workers outlive their tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them (null: empty)."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    arr = arr.cast(pa.large_binary()) if not pa.types.is_string(arr.type) else arr.cast(pa.binary()).cast(pa.large_binary())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; one long row makes a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def ascii_classes(word, lower: bool = True) -> np.ndarray:
    """256-entry table: 0 for separator bytes, else the (lower-cased) byte."""
    lut = np.zeros(256, np.uint8)
    for b in range(256):
        if word(b):
            lut[b] = b + 32 if lower and 0x41 <= b <= 0x5A else b
    return lut


class Words:
    """Words of a slice of rows, found on the bytes.

    ``canon`` holds the mapped words, each followed by one space; word ``j``
    lies at ``canon[start[j]:end[j]]`` and belongs to row ``row[j]``; the words
    of row ``r`` are ``first[r]`` up to ``first[r + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lut: np.ndarray):
        mapped = lut[data]
        is_word = mapped != 0
        begin = is_word.copy()
        if len(data):
            begin[1:] &= ~is_word[:-1]
            heads = offsets[:-1][offsets[:-1] < len(data)]
            begin[heads] = is_word[heads]
        src = np.flatnonzero(is_word)
        word_of = np.cumsum(begin)[src] - 1 if len(src) else src
        begins = np.flatnonzero(begin)
        n = len(begins)
        length = np.bincount(word_of, minlength=n) if n else np.zeros(0, np.int64)
        ends = np.cumsum(length + 1)
        self.canon = np.full(int(ends[-1]) if n else 0, 0x20, np.uint8)
        self.canon[np.arange(len(src)) + word_of] = mapped[src]
        self.start = ends - length - 1
        self.end = ends - 1
        self.first = np.searchsorted(begins, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.source = begins

    def __len__(self) -> int:
        return len(self.start)


# odd multiplier of the polynomial hashes, and its inverse modulo 2^64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept per worker."""
    cache = process_cache("powers")
    have = cache.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if len(have) <= 1 << 22:
            cache[base] = have
    return have[:n]


def span_hashes(canon: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``canon[start:end]`` for many spans at once."""
    if not len(start):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(canon) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[canon] * _powers(_INVERSE, len(canon)), out=sums[1:])
    h = (sums[end] - sums[start]) * _powers(_BASE, len(canon) + 1)[start]
    return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (bijective finalizer)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA5CB9243F0AEF1B5)
    return h ^ (h >> np.uint64(32))
