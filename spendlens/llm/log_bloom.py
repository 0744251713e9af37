"""Log-frequency Bloom filter: quantised counts of n-grams, read by repeated membership probes.

A key of count c is stored as the entries (key, 1) .. (key, q), q = 1 +
floor(log_base c). A look-up probes (key, 1), (key, 2), ... until one is missing;
the last one found is the key's level, and the level's mean count stands for the
count. Levels are never too low, and too high by one level with the chance of a
false positive. An entry sets its bits in one 64-bit word, so a probe is one
memory access (about 1.9 % false positives with 10 bits an entry and 4 of them set).

The filter lies in shards by key, stored as rows of a table in the shared folder.
Workers load as many shards at a time as their byte bound allows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, new_folder, process_cache, release_memory
from .files import resolve

#: keys are this many bits; the upper ones choose the shard
KEY_BITS = 48
MAX_LEVEL = 96


@dataclass(frozen=True)
class LogBloom:
    """Where the shards lie, and which of them are loaded together (``rounds`` of (first, last) shards)."""

    path: str
    shard_bits: int
    base: float
    probes: int
    rounds: list[tuple[int, int]]
    entries: int
    bytes: int

    def estimates(self) -> np.ndarray:
        """Mean count of each level (0: unseen)."""
        out = np.zeros(MAX_LEVEL + 1)
        for j in range(1, MAX_LEVEL + 1):
            lo, hi = np.ceil(self.base ** (j - 1) - 1e-9), np.ceil(self.base**j - 1e-9) - 1
            out[j] = (lo + hi) / 2 if hi >= lo else self.base ** (j - 1)
        return out


def level_of(count: np.ndarray, base: float) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(count) / np.log(base) + 1e-9).astype(np.int64), MAX_LEVEL)


def _entry(key: np.ndarray, level: int, words: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(word of each key's shard, bits of that word) of the entries (key, level)."""
    h = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF))
    mask = np.zeros(len(key), np.uint64)
    for p in range(probes):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * p)) & np.uint64(63))
    return ((h >> np.uint64(32)) * words) >> np.uint64(32), mask


def pack_keys(key: np.ndarray) -> bytes:
    """48-bit keys, six bytes each."""
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order with their summed counts."""
    if not len(keys):
        return keys, counts
    by = np.argsort(keys)
    keys, counts = keys[by], counts[by]
    del by
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


PART_SCHEMA = "shard int, keys binary, counts binary"


def parts(keys: np.ndarray, counts: np.ndarray, shard_bits: int) -> pa.RecordBatch:
    """One row a shard of sorted distinct keys and their counts."""
    shard = (keys >> np.uint64(KEY_BITS - shard_bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else shard
    at = np.append(first, len(shard)).tolist()
    cut = list(zip(at[:-1], at[1:], strict=True))
    small = counts.astype("<u4")
    return pa.RecordBatch.from_arrays(
        [pa.array(shard[first], pa.int32()), pa.array([pack_keys(keys[i:j]) for i, j in cut], pa.binary()), pa.array([small[i:j].tobytes() for i, j in cut], pa.binary())],
        ["shard", "keys", "counts"],
    )


def _build(base: float, probes: int, bits_per_entry: int):
    def build(group: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack_keys(x) for x in group.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in group.column("counts").to_pylist()]).astype(np.int64)
        keys, counts = counted(keys, counts)
        levels = level_of(counts, base)
        entries = int(levels.sum())
        words = np.zeros(max(1, -(-entries * bits_per_entry // 64)), np.uint64)
        for j in range(1, int(levels.max()) + 1):
            keys, levels = keys[levels >= j], levels[levels >= j]
            at, mask = _entry(keys, j, np.uint64(len(words)), probes)
            np.bitwise_or.at(words, at.astype(np.int64), mask)
        made = words.astype("<u8").tobytes()
        return pa.table({"shard": group.column("shard").slice(0, 1), "entries": pa.array([entries], pa.int64()), "size": pa.array([len(made)], pa.int64()), "bits": pa.array([made], pa.binary())})

    return build


def build_filter(partial: DataFrame, shard_bits: int, *, base: float = 1.5, probes: int = 4, bits_per_entry: int = 10, round_bytes: int = 128 << 20) -> LogBloom:
    """Merge partial counts by shard and store each shard's bits.

    A shard holds the keys of ``2**-shard_bits`` of the key space, so its task
    stays small whatever keys are frequent.
    """
    spark = partial.sparkSession
    path = new_folder(spark, "log-bloom")
    made = partial.groupBy("shard").applyInArrow(_build(base, probes, bits_per_entry), "shard int, entries long, size long, bits binary")
    made.write.parquet(path)
    # whole runs of shards up to the byte bound; each row names where a run begins
    sizes = spark.read.parquet(path).select("shard", "size", "entries")
    step = max(1, (1 << shard_bits) // max(1, 4096))
    runs = sizes.groupBy(F.floor(F.col("shard") / step).cast("long").alias("run")).agg(F.sum("size").alias("size"), F.sum("entries").alias("entries")).orderBy("run").collect()
    rounds, size = [], 0
    for r in runs:
        lo, hi = r["run"] * step, r["run"] * step + step - 1
        if rounds and size + r["size"] <= round_bytes:
            rounds[-1] = rounds[-1][0], hi
            size += r["size"]
        else:
            rounds.append((lo if rounds else 0, hi))
            size = r["size"]
    return LogBloom(path, shard_bits, base, probes, rounds or [(0, (1 << shard_bits) - 1)], sum(r["entries"] for r in runs), sum(r["size"] for r in runs))


class Loaded:
    """The shards of one round in a worker's memory."""

    def __init__(self, bloom: LogBloom, lo: int, hi: int):
        import pyarrow.dataset as ds

        fs, path = resolve(bloom.path)
        self.bloom, self.lo, self.hi = bloom, lo, hi
        stored = ds.dataset(path, filesystem=fs, format="parquet")
        inside = (ds.field("shard") >= lo) & (ds.field("shard") <= hi)
        sizes = stored.to_table(columns=["shard", "size"], filter=inside)
        self.words = np.zeros(hi - lo + 1, np.uint64)  # of each shard
        self.words[sizes["shard"].to_numpy() - lo] = sizes["size"].to_numpy() // 8
        self.start = (np.cumsum(self.words) - self.words).astype(np.int64)
        self.data = np.zeros(int(self.words.sum()), np.uint64)
        # a few shards at a time: nothing is held twice
        for batch in stored.to_batches(columns=["shard", "bits"], filter=inside, batch_size=4, batch_readahead=1, fragment_readahead=1, use_threads=False):
            for shard, raw in zip(batch.column("shard").to_pylist(), batch.column("bits"), strict=True):
                at = self.start[shard - lo]
                self.data[at : at + int(self.words[shard - lo])] = np.frombuffer(raw.as_buffer(), "<u8")
        release_memory()

    def levels(self, key: np.ndarray) -> np.ndarray:
        """Level of each key (0: unseen, or of a shard that is not loaded)."""
        level = np.zeros(len(key), np.uint8)
        shard = (key >> np.uint64(KEY_BITS - self.bloom.shard_bits)).astype(np.int64) - self.lo
        inside = (shard >= 0) & (shard <= self.hi - self.lo)
        live = np.flatnonzero(inside)
        shard = shard[live]
        some = self.words[shard] > 0
        live, key, start, words = live[some], key[live[some]], self.start[shard[some]], self.words[shard[some]]
        for j in range(1, MAX_LEVEL + 1):
            if not len(live):
                break
            at, mask = _entry(key, j, words, self.bloom.probes)
            found = (self.data[start + at.astype(np.int64)] & mask) == mask
            live, key, start, words = live[found], key[found], start[found], words[found]
            level[live] = j
        return level


def loaded(bloom: LogBloom, lo: int, hi: int) -> Loaded:
    """The round's shards; a worker keeps one round."""
    cache = process_cache("log-bloom")
    if (bloom.path, lo, hi) not in cache:
        cache.clear()
        cache[bloom.path, lo, hi] = Loaded(bloom, lo, hi)
    return cache[bloom.path, lo, hi]
