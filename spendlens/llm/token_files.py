"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

1. Every whole text is encoded once (``tokenizers``), ids go to a stored table.
2. Ids are counted over the whole corpus and ranked; frequent ids get small ranks.
3. Ranks are coded as 1 to 4 little-endian bytes. The lengths sit apart in
   control bytes (four 2-bit lengths each), the bytes in a data stream.
4. Documents go to files by ascending id ranges; a file ends in an index.
5. Reading gathers lengths and values by table lookup and maps ranks to ids.

File layout (little-endian): per document its control bytes then data bytes;
then the index (doc_id int64, null flag uint8, n_tokens uint32, n_data uint32
columns), then a 24-byte trailer: n_docs uint64, index position uint64, magic.

Defined results: a null text is empty; a null id orders first; equal ids order
by their ids' checksum; an empty table gives no file. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed, new_folder, row_slices, stored, text_buffer
from .encoders import BlankSegments, load_tokenizer, segment_table
from .files import resolve, unique_name

MAGIC = b"SVBTOK01"
#: lengths (1..4) of the four values of a control byte
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_SLICE = 4 << 20


# -- coding ------------------------------------------------------------------


def encode_ranks(ranks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, data bytes and their offsets by row, for rows of ranks."""
    counts = np.diff(bounds)
    padded = -(-counts // 4) * 4
    pad_ends = np.cumsum(padded)
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(int(pad_ends[-1]) if len(pad_ends) else 0, np.uint8)
    codes[np.arange(len(ranks)) + np.repeat(pad_ends - padded - bounds[:-1], counts)] = extra
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) <= extra[:, None]]
    data_ends = np.concatenate([[0], np.cumsum(extra.astype(np.int64) + 1)])
    return control, data, np.concatenate([[0], pad_ends // 4]), data_ends[bounds]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + n[i] - 1 of all i, in order."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def decode_ranks(buf: np.ndarray, start: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
    """Ranks of many documents: each has its control bytes at ``start``, then its data."""
    n_control = -(-n_tokens // 4)
    control = buf[_ranges(start, n_control)]
    taken = _ranges(4 * (np.cumsum(n_control) - n_control), n_tokens)  # without padding
    lens = LENGTHS[control].ravel()[taken].astype(np.int64)
    ends = np.cumsum(lens)
    done = np.concatenate([[0], ends])[np.cumsum(n_tokens) - n_tokens]  # data bytes of earlier documents
    at = ends - lens + np.repeat(start + n_control - done, n_tokens)
    padded = np.concatenate([buf, np.zeros(4, np.uint8)])
    words = np.ndarray(shape=(len(padded) - 3,), dtype="<u4", buffer=padded, strides=(1,))
    return words[at] & _MASKS[lens]


# -- jobs --------------------------------------------------------------------


def _width(tokenizer: str, end_id: int | None) -> str:
    """Bytes of a stored id: two while the vocabulary allows."""
    size = max(load_tokenizer(tokenizer).get_vocab_size(with_added_tokens=True), (end_id or 0) + 1)
    return "<u2" if size <= 1 << 16 else "<u4"


def encoded_ids(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(counts, doc_id, n, ids) of every whole text; ``end_id`` closes each document.

    ``ids`` are little-endian bytes. Every task ends with a row of its own
    (``counts`` true): how often it has met each id, 8 bytes an id.
    """
    width = _width(tokenizer, end_id)
    names = ["counts", "doc_id", "n", "ids"]

    def run(batches):
        table = segment_table(tokenizer, BlankSegments)
        seen = np.zeros(1, np.int64)
        for b in batches:
            _, offsets = text_buffer(b["text"])
            for lo, hi in row_slices(offsets, _SLICE):
                ids, bounds = table.encode_column(b["text"].slice(lo, hi - lo))
                if end_id is not None:
                    ids = np.insert(ids, bounds[1:], end_id)
                    bounds = bounds + np.arange(len(bounds))
                n = np.bincount(ids, minlength=len(seen))
                n[: len(seen)] += seen
                seen = n
                raw = ids.astype(width)
                columns = [pa.array(np.zeros(hi - lo, bool)), b["doc_id"].slice(lo, hi - lo), pa.array(np.diff(bounds)), _binary(raw.view(np.uint8), bounds * raw.itemsize)]
                yield pa.RecordBatch.from_arrays(columns, names)
        yield pa.RecordBatch.from_arrays([pa.array([True]), pa.nulls(1, pa.int64()), pa.array([0]), pa.array([seen.astype("<i8").tobytes()], pa.binary())], names)

    rows = keyed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "counts boolean, doc_id long, n long, ids binary")


def _flat(column, width: str) -> tuple[np.ndarray, np.ndarray]:
    data, at = text_buffer(column)
    size = np.dtype(width).itemsize
    return np.frombuffer(np.ascontiguousarray(data), width), at // size


def id_ranks(counts: DataFrame) -> np.ndarray:
    """Ids by falling corpus frequency, from the tasks' counts (the vocabulary bounds the result)."""

    def add(batches):
        seen = np.zeros(1, np.int64)
        for b in batches:
            for raw in b["ids"]:
                n = np.frombuffer(raw.as_buffer(), "<i8").copy()
                if len(n) < len(seen):
                    n, seen = seen, n
                n[: len(seen)] += seen
                seen = n
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["id", "n"])

    total = counts.select("ids").mapInArrow(add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return total.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)


def write_token_files(ids: DataFrame, width: str, folder: str, ranked: np.ndarray, tokens_per_file: int = 8_000_000, min_files: int = 64) -> DataFrame:
    """Write (doc_id, n, ids) to files; returns the stored manifest (part, file, n_docs, n_tokens)."""
    sizes = ids.select("doc_id", "n")
    total, n_docs = sizes.agg(F.sum("n"), F.count("*")).first()
    parts = max(-(-int(total or 0) // tokens_per_file), min(min_files, n_docs // 16), 1)
    cuts = []
    if parts > 1:
        at = [i / parts for i in range(1, parts)]
        cuts = sorted(set(sizes.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, at)), F.lit(20 * parts))).first()[0] or []))
    edges = np.array(cuts, np.int64)
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.int64)
    rank_of[ranked] = np.arange(len(ranked))

    def code(batches):
        for b in batches:
            _, at = text_buffer(b["ids"])
            for lo, hi in row_slices(at, _SLICE):
                part = b.slice(lo, hi - lo)
                flat, bounds = _flat(part["ids"], width)
                control, data, c_at, d_at = encode_ranks(rank_of[flat], bounds)
                raw = flat.tobytes()
                size = flat.itemsize
                key = part["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy()
                columns = [
                    pa.array(np.searchsorted(edges, key, "left").astype(np.int32)),
                    part["doc_id"],
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array([zlib.crc32(raw[size * i : size * j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.int64()),
                    _binary(control, c_at),
                    _binary(data, d_at),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "n_tokens", "crc", "control", "data"])

    def write(batches):
        out = _FileWriter(folder)
        for b in batches:
            yield from out.add(b)
        yield from out.close()

    rows = ids.select("doc_id", "ids").mapInArrow(code, "part int, doc_id long, n_tokens long, crc long, control binary, data binary")
    ordered = rows.repartition("part").sortWithinPartitions(F.col("part"), F.col("doc_id").asc_nulls_first(), F.col("crc"))
    return stored(ordered.select("part", "doc_id", "n_tokens", "control", "data").mapInArrow(write, "part int, file string, n_docs long, n_tokens long"), "token-manifest")


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class _FileWriter:
    """Writes rows that come in order of (part, doc_id); one file per part."""

    def __init__(self, folder: str):
        self.fs, self.folder = resolve(folder)
        self.part = self.out = None

    def add(self, b):
        parts = b["part"].to_numpy()
        lo = 0
        for hi in [*np.flatnonzero(np.diff(parts)) + 1, len(parts)]:
            hi = int(hi)
            if lo == hi:
                continue
            if self.out is None or int(parts[lo]) != self.part:
                yield from self.close()
                self.part = int(parts[lo])
                self.fs.create_dir(self.folder, recursive=True)
                self.name = unique_name(f"{self.folder}/ids-{self.part:06d}", ".svb")
                self.out = self.fs.open_output_stream(self.name)
                self.index: list[tuple[np.ndarray, ...]] = []
            piece = b.slice(lo, hi - lo)
            d_len = pc.binary_length(piece["data"]).to_numpy()
            for c, d in zip(piece["control"], piece["data"], strict=True):
                self.out.write(c.as_buffer())
                self.out.write(d.as_buffer())
            null = piece["doc_id"].is_null().to_numpy(zero_copy_only=False)
            self.index.append((piece["doc_id"].fill_null(0).to_numpy().astype("<i8"), null.astype(np.uint8), piece["n_tokens"].to_numpy().astype("<u4"), d_len.astype("<u4")))
            lo = hi

    def close(self):
        if self.out is None:
            return
        columns = [np.concatenate(c) for c in zip(*self.index, strict=True)]
        at = self.out.tell()
        for c in columns:
            self.out.write(c.tobytes())
        self.out.write(np.array([len(columns[0]), at], "<u8").tobytes() + MAGIC)
        self.out.close()
        self.out = None
        yield pa.RecordBatch.from_pylist([{"part": self.part, "file": self.name, "n_docs": len(columns[0]), "n_tokens": int(columns[2].sum())}], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))


def read_documents(f, ranked: np.ndarray, piece: int = 4 << 20):
    """(doc_ids, null flags, ids, bounds) of runs of documents of an open file, in order."""
    size = f.size()
    tail = f.read_at(24, size - 24)
    if tail[16:] != MAGIC:
        raise ValueError("not a token-id file")
    n, at = np.frombuffer(tail[:16], "<u8").tolist()
    index = f.read_at(n * 17, at)
    doc_id = np.frombuffer(index, "<i8", n)
    null = np.frombuffer(index, np.uint8, n, 8 * n).astype(bool)
    n_tokens = np.frombuffer(index, "<u4", n, 9 * n).astype(np.int64)
    n_data = np.frombuffer(index, "<u4", n, 13 * n).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(-(-n_tokens // 4) + n_data)])
    for lo, hi in row_slices(offsets, piece):
        buf = np.frombuffer(f.read_at(int(offsets[hi] - offsets[lo]), int(offsets[lo])), np.uint8)
        ranks = decode_ranks(buf, offsets[lo:hi] - offsets[lo], n_tokens[lo:hi])
        yield doc_id[lo:hi], null[lo:hi], ranked[ranks], np.concatenate([[0], np.cumsum(n_tokens[lo:hi])])


def read_token_files(spark: SparkSession, manifest: DataFrame, ranked: np.ndarray, folder: str, reduce: Callable[[np.ndarray], int]) -> DataFrame:
    """(doc_id, start, n_tokens, value) read back; ``reduce`` makes the value from a document's ids."""

    def run(batches):
        fs, _ = resolve(folder)
        for b in batches:
            for file, start in zip(b["file"].to_pylist(), b["start"].to_pylist(), strict=True):
                with fs.open_input_file(file) as f:
                    for doc_ids, null, ids, bounds in read_documents(f, ranked):
                        values = [reduce(ids[i:j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                        columns = [pa.array(doc_ids, pa.int64(), mask=null), pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(values, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "value"])
                        start += int(bounds[-1])

    files = manifest.count()
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = manifest.select("part", "file", F.coalesce(before, F.lit(0)).alias("start"))
    return starts.repartition(max(files, 1), "part").select("file", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, value long")


def token_file_round_trip(docs: DataFrame, tokenizer: str, end_id: int | None = 1, reduce: Callable[[np.ndarray], int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Encode, rank, write and read back: (documents read, manifest, ids by rank)."""
    spark = docs.sparkSession
    path = new_folder(spark, "token-ids")
    encoded = encoded_ids(docs, tokenizer, end_id, id_col, text_col)
    encoded.write.option("compression", "zstd").partitionBy("counts").parquet(path)
    stored_ids = spark.read.schema(encoded.schema).parquet(path)
    ranked = id_ranks(stored_ids.where("counts"))
    folder = new_folder(spark, "token-files")
    manifest = write_token_files(stored_ids.where("NOT counts").select("doc_id", "n", "ids"), _width(tokenizer, end_id), folder, ranked)
    return read_token_files(spark, manifest, ranked, folder, reduce or checksum), manifest, ranked


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
