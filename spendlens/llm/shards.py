"""Sharding by histogram sort.

Documents are ordered by (hash of the text, hash of the id, hash of a stored row
number), so equal texts are neighbours and no two rows share a key. Splitters
that cut this order into shards of near-equal bytes are found by counting: every
round, all partitions count the exact bytes and rows below a set of candidate
boundaries, and only the brackets that still miss their target get new probes.
When every splitter is within tolerance the rows move once, to buckets whose
exact start slots the counts already give.

Defined results: a null text has no bytes (size 1) and counts as empty; null
ids order as one; rows that repeat both id and text are neighbours, cut like any
others where a shard is full; an empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, stored

_HALF = 1 << 63  # each part of a key is below it
_PARTS = ["k1", "k2", "k3"]


@dataclass(frozen=True)
class Splitters:
    """Boundaries of the buckets (keys), with the bytes and rows below each."""

    keys: list[int]
    bytes_below: list[int]
    rows_below: list[int]
    shard: list[int]  # of each bucket; one more than there are keys
    first_slot: list[int]
    rounds: int


def _key_bytes(parts: list[np.ndarray]) -> np.ndarray:
    out = np.empty((len(parts[0]), len(parts)), ">u8")
    for i, part in enumerate(parts):
        out[:, i] = part
    return out.view(f"S{8 * len(parts)}").ravel()


def _probe_bytes(keys: list[int], n_parts: int) -> np.ndarray:
    return _key_bytes([np.array([k // _HALF**i % _HALF for k in keys], np.uint64) for i in range(n_parts - 1, -1, -1)])


def _histogram(probes: list[int], parts: list[str]):
    at = _probe_bytes(probes, len(parts))

    def count(batches):
        rows = np.zeros(len(at) + 1, np.int64)
        size = np.zeros(len(at) + 1, np.int64)
        for b in batches:
            cell = np.searchsorted(at, _key_bytes([b[p].to_numpy() for p in parts]), "right")
            rows += np.bincount(cell, minlength=len(rows))
            s = b["size"].to_numpy()
            order = np.argsort(cell, kind="stable")
            edges = np.searchsorted(cell[order], np.arange(len(rows) + 1))
            sums = np.concatenate([[0], np.cumsum(s[order])])
            size += sums[edges[1:]] - sums[edges[:-1]]
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(rows[used]), pa.array(size[used])], ["cell", "n", "s"])

    return count


def _probes_between(lo: int, hi: int, n: int) -> list[int]:
    """Evenly spaced keys inside (lo, hi), between texts (else ids) as long as the gap spans several."""
    out = []
    unit = next((u for u in (_HALF**2, _HALF) if hi - lo > 4 * u), 1)
    for i in range(1, n + 1):
        k = lo + (hi - lo) * i // (n + 1)
        k -= k % unit
        if lo < k < hi:
            out.append(k)
    return sorted(set(out))


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float, bucket_bytes: int, probes: int = 32) -> Splitters:
    """Iterate the histogram over ``keys`` (parts of the key in order, size) until all splitters fit.

    Shard boundaries must come within ``tolerance`` of a shard's mean bytes;
    inside shards, bucket boundaries may be off by a quarter of a bucket.
    """
    parts = [c for c in keys.columns if c != "size"]
    end = _HALF ** len(parts)
    first = keys.agg(F.count("*").alias("n"), F.sum("size").alias("s")).first()
    rows, total = int(first["n"]), int(first["s"] or 0)
    per_shard = max(4, -(-total // (n_shards * bucket_bytes)))
    known = {0: (0, 0), end: (total, rows)}
    targets = [(total * j / (n_shards * per_shard), j % per_shard == 0) for j in range(1, n_shards * per_shard)]
    near = {True: tolerance * total / n_shards, False: total / (n_shards * per_shard) / 4}
    rounds = 0
    while True:
        order = sorted(known)
        below = [known[k][0] for k in order]
        chosen, wanted = [], set()
        for t, main in targets:
            i = bisect.bisect_right(below, t) - 1
            lo, hi = order[i], order[min(i + 1, len(order) - 1)]
            best = min((lo, hi), key=lambda k: abs(known[k][0] - t))
            chosen.append(best)
            if rows and hi - lo > 1 and abs(known[best][0] - t) > near[main]:
                wanted.update(_probes_between(lo, hi, probes))
        if not wanted:
            break
        new = sorted(wanted)
        got = {r["cell"]: (r["n"], r["s"]) for r in keys.mapInArrow(_histogram(new, parts), "cell long, n long, s long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
        n = s = 0
        for i, k in enumerate(new):
            dn, ds = got.get(i, (0, 0))
            n, s = n + dn, s + ds
            known[k] = (s, n)
        rounds += 1
    mains = [k for k, (_, main) in zip(chosen, targets, strict=True) if main]
    cuts = sorted(set(chosen) - {0, end})
    shard = [bisect.bisect_right(mains, k) for k in [0, *cuts]]
    begins: dict[int, int] = {}
    slots = []
    for sh, k in zip(shard, [0, *cuts], strict=True):
        begins.setdefault(sh, known[k][1])
        slots.append(known[k][1] - begins[sh])
    return Splitters(cuts, [known[k][0] for k in cuts], [known[k][1] for k in cuts], shard, slots, rounds)


def histogram_shards(docs: DataFrame, n_shards: int = 16, tolerance: float = 0.002, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with their ``size``, ``shard`` and ``slot`` (gapless in the shard).

    The slot order is (text hash, id hash, row hash), so equal texts of a shard
    follow each other; a group of copies is cut only where it alone would
    overfill a shard, and so are rows that repeat both id and text.
    """
    spark = docs.sparkSession
    rows = keyed(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        "text",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1).alias("k1"),
        F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("k2"),
        F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 1).alias("k3"),
    )
    # with the texts: counting and moving see the same row numbers, whatever ``docs`` is computed from
    rows = stored(rows, "shard-rows")
    found = find_splitters(rows.select(*_PARTS, "size"), n_shards, tolerance, bucket_bytes)
    at = _probe_bytes(found.keys, len(_PARTS))

    @F.pandas_udf("int")
    def bucket_of(k1, k2, k3):
        import pandas as pd

        return pd.Series(np.searchsorted(at, _key_bytes([k.to_numpy() for k in (k1, k2, k3)]), "right").astype(np.int32))

    buckets = spark.createDataFrame([(i, sh, sl) for i, (sh, sl) in enumerate(zip(found.shard, found.first_slot, strict=True))], "bucket int, shard int, first_slot long")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*_PARTS, "doc_id", "size"))
    placed = rows.withColumn("bucket", bucket_of(*_PARTS)).repartition("bucket").withColumn("rank", rank)
    return placed.join(buckets, "bucket").select("doc_id", "text", "size", "shard", (F.col("first_slot") + F.col("rank") - 1).alias("slot"))
