"""Byte-level BPE over content-defined chunks; shared chunks are encoded once.

1. A rolling hash over the bytes cuts every text where the content says so, so
   equal passages give equal chunks wherever they stand. Chunk keys are counted
   over the whole corpus; keys seen twice or more are shared.
2. A Bloom filter of the shared keys (its size is bounded, its false hits only
   cost work) tells every task which of its chunks to hand over. Each distinct
   shared chunk is encoded once, from one copy of its text.
3. Joins are repaired by re-encoding: from each join the window grows outward,
   over the ends of the neighbouring chunks, to the nearest places where the
   tokenizer always cuts (before a space that a printable character follows).
   There the re-encoded ids and those of the chunk agree whatever lies around,
   so chunk middles and windows together are the ids of the whole text. A
   chunk without such places is all window.
4. Documents without shared chunks never move. The others are put together
   from windows and chunk ids by position.

Defined results: a null text is empty (no ids); null or repeated ids keep one
row per input row; an empty table gives an empty result; other columns are
ignored. Texts are never cut off; a task holds one text and its ids at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BYTE_VALUES, _INVERSE, _powers, keyed, new_folder, new_owner, owned, row_slices, text_buffer
from .encoders import SpaceSegments, load_tokenizer, segment_table

WINDOW = 32
MIN_CHUNK = 96
_SLICE = 2 << 20
_LOCAL, _REF, _TEXT, _WHOLE = 0, 1, 2, 3
_PIECES = "kind int, rid long, doc_id long, pos int, key binary, payload binary"
_COLUMNS = {"ids": ("array<int>", pa.list_(pa.int32())), "n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


# -- chunks ------------------------------------------------------------------


def chunk_bounds(data: np.ndarray, offsets: np.ndarray, mean_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunk edges of a slice of texts: all edges, and the first edge of each row.

    A chunk ends behind a window of ``WINDOW`` bytes whose hash is 0 modulo
    ``mean_bytes`` (a power of two), at a whole character, ``MIN_CHUNK`` bytes
    or more after the last end.
    """
    n = len(data)
    inner: list[int] = []
    if n > WINDOW:
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * _powers(_INVERSE, n), out=sums[1:])
        h = (sums[WINDOW:] - sums[:-WINDOW]) * _powers(_BASE, n + 1 - WINDOW)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        at = np.flatnonzero(h >> np.uint64(64 - mean_bytes.bit_length() + 1) == 0) + WINDOW
        at = at[at < n]
        at = at[(data[at] & 0xC0) != 0x80]
        row = np.searchsorted(offsets, at, "right") - 1
        inside = (at - offsets[row] >= max(WINDOW, MIN_CHUNK)) & (at != offsets[row])
        at, row = at[inside], row[inside]
        last, last_row = -MIN_CHUNK, -1
        for p, r in zip(at.tolist(), row.tolist(), strict=True):
            if r != last_row or p - last >= MIN_CHUNK:
                inner.append(p)
                last, last_row = p, r
    edges = np.concatenate([offsets, np.array(inner, np.int64)])
    edges.sort(kind="stable")
    return edges, np.searchsorted(edges, offsets[:-1], "left")


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Positions before which the tokenizer always cuts: a space, then printable ASCII."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    nxt = data[1:]
    return np.flatnonzero((data[:-1] == 0x20) & (nxt > 0x20) & (nxt < 0x7F))


def middle(cuts: np.ndarray, begin: int, end: int) -> tuple[int, int] | None:
    """First and last safe cut inside ``[begin, end)``, judged on the chunk alone."""
    lo = int(np.searchsorted(cuts, begin, "left"))
    hi = int(np.searchsorted(cuts, end - 1, "left")) - 1
    return (int(cuts[lo]), int(cuts[hi])) if hi > lo else None


def _keys(data: bytes, edges: list[int]) -> list[bytes]:
    view = memoryview(data)
    blake = hashlib.blake2b
    return [blake(view[a:b], digest_size=16).digest() for a, b in zip(edges[:-1], edges[1:], strict=True)]


# -- Bloom filter of shared keys ---------------------------------------------


def _bit_places(keys: list[bytes], bits: int) -> np.ndarray:
    if not keys:
        return np.zeros((0, 4), np.int64)
    words = np.frombuffer(b"".join(keys), "<u4").reshape(-1, 4)
    return (words & np.uint32(bits - 1)).astype(np.int64)


def shared_filter(keys: DataFrame, owner: str, max_bits: int = 1 << 26) -> np.ndarray:
    """Bytes of a filter with 4 bits per key; at most ``max_bits`` (8 MB) for any input."""
    n = keys.count()
    bits = min(max_bits, max(1 << 13, 1 << (16 * n).bit_length()))

    def words(batches):
        have = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at = _bit_places(b["key"].to_pylist(), bits).ravel()
            np.bitwise_or.at(have, at >> 3, (1 << (at & 7)).astype(np.uint8))
        w = have.view("<i8")
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(w[used])], ["word", "bits"])

    got = keys.mapInArrow(owned(owner, words), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint8)


def may_contain(have: np.ndarray, keys: list[bytes]) -> np.ndarray:
    at = _bit_places(keys, len(have) * 8)
    return ((have[at >> 3] >> (at & 7)) & 1).all(axis=1)


# -- outputs -----------------------------------------------------------------


class _Output:
    """Turns (doc_id, ids) into the columns asked for: ids, their number, digests of ids and decoded text."""

    def __init__(self, tokenizer: str, columns: list[str]):
        self.tokenizer, self.columns = tokenizer, columns
        self.sql = "".join(f", {c} {_COLUMNS[c][0]}" for c in columns)
        self.fields = [pa.field(c, _COLUMNS[c][1]) for c in columns]
        self.names: list[str] | None = None

    def batch(self, doc_ids: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        made: dict[str, pa.Array] = {}
        sha = hashlib.sha256
        lists = [x.tolist() for x in ids] if len({"ids_sha256", "decoded_sha256"} & set(self.columns)) else []
        for c in self.columns:
            if c == "ids":
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                made[c] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids).astype(np.int32)))
            elif c == "n_tokens":
                made[c] = pa.array([len(x) for x in ids], pa.int64())
            elif c == "ids_sha256":
                if self.names is None:
                    self.names = [str(i) for i in range(load_tokenizer(self.tokenizer).get_vocab_size(with_added_tokens=True))]
                name = self.names.__getitem__
                made[c] = pa.array([sha(",".join(map(name, x)).encode()).hexdigest() for x in lists], pa.string())
            else:
                text = load_tokenizer(self.tokenizer).decode_batch(lists, skip_special_tokens=False)
                made[c] = pa.array([sha(t.encode()).hexdigest() for t in text], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *made.values()], ["doc_id", *made])


# -- jobs --------------------------------------------------------------------


def shared_chunks(rows: DataFrame, mean_bytes: int, owner: str) -> DataFrame:
    """Keys of chunks that occur twice or more in the corpus."""

    def count(batches):
        for b in batches:
            data, offsets = text_buffer(b["text"])
            for lo, hi in row_slices(offsets, _SLICE):
                part = np.ascontiguousarray(data[offsets[lo] : offsets[hi]])
                edges, _ = chunk_bounds(part, offsets[lo : hi + 1] - offsets[lo], mean_bytes)
                edges = np.unique(edges)
                seen: dict[bytes, int] = {}
                for k in _keys(part.tobytes(), edges.tolist()):
                    seen[k] = seen.get(k, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["key", "n"])

    return rows.select("text").mapInArrow(owned(owner, count), "key binary, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


def _pieces(rows: DataFrame, tokenizer: str, have: np.ndarray, mean_bytes: int, width: str, out: _Output, owner: str) -> DataFrame:
    """Rows by kind: finished documents, windows, chunk references, chunk texts (once a slice)."""
    empty = {"kind": pa.int32(), "rid": pa.int64(), "doc_id": pa.int64(), "pos": pa.int32(), "key": pa.binary(), "payload": pa.binary()}
    schema = pa.schema([*map(pa.field, empty, empty.values()), *out.fields])
    names = out.columns

    def as_rows(n: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches):
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 40
        table = segment_table(tokenizer, SpaceSegments)
        for b in batches:
            data, offsets = text_buffer(b["text"])
            ids_in = b["doc_id"].to_pylist()
            for lo, hi in row_slices(offsets, _SLICE):
                at = offsets[lo : hi + 1] - offsets[lo]
                part = np.ascontiguousarray(data[offsets[lo] : offsets[hi]])
                raw = part.tobytes()
                edges, _ = chunk_bounds(part, at, mean_bytes)
                uniq = np.unique(edges).tolist()
                keys = _keys(raw, uniq)
                hit = dict(zip(uniq[:-1], zip(keys, uniq[1:], may_contain(have, keys).tolist(), strict=True), strict=True))
                cuts = safe_cuts(part)
                texts, refs, store = [], [], {}
                spans: list[tuple[int, int]] = []  # (row, pos) of each window in ``texts``
                for r in range(hi - lo):
                    begin, end = int(at[r]), int(at[r + 1])
                    p, pos, done = begin, 0, begin
                    while p < end:
                        key, q, shared = hit[p]
                        m = middle(cuts, p, q) if shared else None
                        if m is not None:
                            if m[0] > done:
                                texts.append(raw[done : m[0]].decode())
                                spans.append((r, pos))
                            refs.append((r, pos + 1, key))
                            store[key] = raw[p:q]
                            pos, done = pos + 2, m[1]
                        p = q
                    if done < end or pos == 0:
                        texts.append(raw[done:end].decode())
                        spans.append((r, pos if pos else -1))
                ids, bounds = table.encode_column(pa.array(texts, pa.string()))
                runs = [ids[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                whole = [(ids_in[lo + r], x) for (r, pos), x in zip(spans, runs, strict=True) if pos < 0]
                if whole:
                    made = out.batch([d for d, _ in whole], [x for _, x in whole])
                    yield as_rows(len(whole), {"kind": pa.array([_WHOLE] * len(whole), pa.int32()), "doc_id": made["doc_id"], **{n: made[n] for n in names}})
                local = [(rid + r, ids_in[lo + r], pos, x.astype(width).tobytes()) for (r, pos), x in zip(spans, runs, strict=True) if pos >= 0]
                if local:
                    c = list(zip(*local, strict=True))
                    yield as_rows(len(local), {"kind": pa.array([_LOCAL] * len(local), pa.int32()), "rid": pa.array(c[0], pa.int64()), "doc_id": pa.array(c[1], pa.int64()), "pos": pa.array(c[2], pa.int32()), "payload": pa.array(c[3], pa.binary())})
                if refs:
                    yield as_rows(len(refs), {"kind": pa.array([_REF] * len(refs), pa.int32()), "rid": pa.array([rid + r for r, _, _ in refs], pa.int64()), "doc_id": pa.array([ids_in[lo + r] for r, _, _ in refs], pa.int64()), "pos": pa.array([p for _, p, _ in refs], pa.int32()), "key": pa.array([k for _, _, k in refs], pa.binary())})
                    yield as_rows(len(store), {"kind": pa.array([_TEXT] * len(store), pa.int32()), "key": pa.array(list(store), pa.binary()), "payload": pa.array(list(store.values()), pa.binary())})
                rid += hi - lo

    return rows.mapInArrow(owned(owner, run), _PIECES + out.sql)


def _encoded_chunks(pieces: DataFrame, tokenizer: str, width: str, owner: str) -> DataFrame:
    """(key, ids of the chunk's middle): each distinct shared chunk encoded once."""

    def run(batches):
        table = segment_table(tokenizer, SpaceSegments)
        for b in batches:
            texts = []
            for t in b["payload"].to_pylist():
                m = middle(safe_cuts(np.frombuffer(t, np.uint8)), 0, len(t))
                texts.append(t[m[0] : m[1]].decode())
            ids, bounds = table.encode_column(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([b["key"], pa.array([ids[i:j].astype(width).tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())], ["key", "payload"])

    once = pieces.where(F.col("kind") == _TEXT).groupBy("key").agg(F.first("payload").alias("payload"))
    return once.mapInArrow(owned(owner, run), "key binary, payload binary")


def _put_together(parts: DataFrame, width: str, out: _Output, owner: str) -> DataFrame:
    """Documents from their windows and chunk ids, in order of position."""

    def run(batches):
        doc, got = None, []
        ready: list[tuple] = []
        held = 0

        def flush():
            return out.batch([d for d, _ in ready], [x for _, x in ready])

        for b in batches:
            rids, doc_ids, payloads = b["rid"].to_pylist(), b["doc_id"].to_pylist(), b["payload"].to_pylist()
            for r, d, p in zip(rids, doc_ids, payloads, strict=True):
                if doc is not None and doc[0] != r:
                    ready.append((doc[1], np.frombuffer(b"".join(got), width)))
                    held += len(ready[-1][1])
                    got = []
                    if held > 1 << 20:
                        yield flush()
                        ready, held = [], 0
                doc = (r, d)
                got.append(p)
        if doc is not None:
            ready.append((doc[1], np.frombuffer(b"".join(got), width)))
        if ready:
            yield flush()

    ordered = parts.repartition("rid").sortWithinPartitions("rid", "pos")
    return ordered.select("rid", "doc_id", "payload").mapInArrow(owned(owner, run), "doc_id long" + out.sql)


def encode_by_chunks(docs: DataFrame, tokenizer: str, columns: list[str] | None = None, mean_bytes: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text, or doc_id and the given columns.

    ``columns``: of ``ids``, ``n_tokens``, ``ids_sha256`` (decimal ids joined
    by commas) and ``decoded_sha256`` (the library's decoding). ``tokenizer``
    is the file of a byte-level BPE vocabulary; ``mean_bytes`` (a power of two)
    is the mean chunk length.
    """
    spark = docs.sparkSession
    rows = keyed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    width = "<u2" if load_tokenizer(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
    out = _Output(tokenizer, columns or ["ids"])
    keys_at = new_folder(spark, "bpe-shared")
    owner = new_owner()
    shared_chunks(rows, mean_bytes, owner).write.parquet(keys_at)
    have = shared_filter(spark.read.schema("key binary").parquet(keys_at), owner)
    made = _pieces(rows, tokenizer, have, mean_bytes, width, out, owner)
    at = new_folder(spark, "bpe-pieces")
    made.write.option("compression", "zstd").partitionBy("kind").parquet(at)
    pieces = spark.read.schema(made.schema).parquet(at)
    chunks = _encoded_chunks(pieces, tokenizer, width, owner)
    refs = pieces.where(F.col("kind") == _REF).select("rid", "doc_id", "pos", "key").join(chunks, "key").select("rid", "doc_id", "pos", "payload")
    windows = pieces.where(F.col("kind") == _LOCAL).select("rid", "doc_id", "pos", "payload")
    whole = pieces.where(F.col("kind") == _WHOLE).select("doc_id", *out.columns)
    return whole.unionByName(_put_together(refs.unionByName(windows), width, out, new_owner()))  # needs no segment table


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the library's decoding, special tokens kept."""

    def run(batches):
        tok = load_tokenizer(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(tok.decode_batch([x or [] for x in b["ids"].to_pylist()], skip_special_tokens=False), pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(owned(new_owner(), run), "doc_id long, text string")
