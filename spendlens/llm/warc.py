"""WARC archives with a two-level capture index.

Writing: equal payloads keep one response (the smallest page id), the others
become revisit records. Records are sorted by reversed-host URL key and page id
and written as gzip members, an archive per task. Beside each archive goes an
index shard: lines (key, page id, offset, length) in compressed blocks of
``BLOCK_LINES``, and a sparse directory with the first key of every block.

An archive may end between captures of one key, and rows of one key and page id
are cut into tasks by their row number, so a hot key is not one task's work.

Reading: a query finds its shards among the first keys of the shards (all that
may hold its key), its block by binary search in the shard's directory, its line
by binary search in the block, and then the record by a range read.

Defined results: a null payload is empty; a null url has the empty key; a null
page id orders first, never is a group's response when another id exists, and
where all ids of a group are null each record is a response; rows that repeat
the smallest id are all responses; an empty table writes nothing and reads
empty. Other columns are ignored. A record is held in memory one at a time.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, new_folder, stored
from .files import resolve, unique_name

BLOCK_LINES = 1000
ARCHIVE_BYTES = 256 << 20
_READ = 4 << 20
_NULL_ID = -(1 << 63)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class CaptureIndex:
    """Shards of an index in key order: their first keys and file names."""

    folder: str
    first: list[tuple[str, int]]
    shard: list[str]


def url_key(url: Column) -> Column:
    """Sort key of a URL: ``https://www.a.org:80/x?y#z`` -> ``org,a,www:80)/x?y``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(url, r"(?s)^[^/?#]*?://", ""), r"(?s)#.*$", "")
    authority = F.regexp_extract(rest, r"^[^/?]*", 0)
    tail = F.substr(rest, F.length(authority) + 1)
    host = F.lower(F.regexp_replace(authority, r":[0-9]*$", ""))
    port = F.regexp_extract(authority, r":[0-9]*$", 0)
    return F.when(url == "", "").otherwise(F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), port, F.lit(")"), tail))


def with_roles(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """(key, page_id, row, url, payload, refers_to): payload groups found by digest, roles joined back."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", F.coalesce("html", F.lit("")).alias("payload"), url_key(F.col("url")).alias("key"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= revisit_from, F.unhex(F.sha1(F.col("payload").cast("binary")))))
    groups = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND digest IS NOT NULL").select("digest", "first_id")
    # stored first: the planner then knows the size, and moves no payloads for a small side
    groups = stored(groups, "warc-groups")
    copy = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(groups, "digest", "left").select("key", "page_id", "row", "url", "payload", F.when(copy, F.col("first_id")).alias("refers_to"))


# -- records -----------------------------------------------------------------


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One gzip member holding a response record, or a revisit when ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _id(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)))
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _id(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{_digest(payload)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress(head.encode() + block + b"\r\n\r\n") + out.flush()


def parse(member: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload (None for revisits), payload_bytes, payload_digest."""
    raw = zlib.decompress(member, 31)
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    length = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n", 1)[0])
    number = lambda s: int(s[10:-1]) if len(s) > 11 else None
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != length or f"sha1:{_digest(payload)}" != fields["WARC-Payload-Digest"]):
        raise ValueError("payload does not match its digest")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": None if response else number(fields["WARC-Refers-To"]),
        "payload": payload if response else None,
        "payload_bytes": length,
        "payload_digest": fields["WARC-Payload-Digest"][5:],
    }


# -- writing -----------------------------------------------------------------


class _Shard:
    """An archive and its index shard, written together in key order."""

    def __init__(self, fs, folder: str):
        self.fs = fs
        fs.create_dir(folder, recursive=True)
        self.name = unique_name(f"{folder}/captures", "")
        self.archive = fs.open_output_stream(f"{self.name}.warc.gz", compression=None)
        self.index = fs.open_output_stream(f"{self.name}.cdx.gz", compression=None)
        self.at = self.index_at = 0
        self.lines: list[str] = []
        self.directory: list[str] = []
        self.first: tuple[str, int] | None = None
        self.last: tuple[str, int] | None = None
        self.captures = 0

    def add(self, key: str, page_id: int, member: bytes) -> None:
        if self.first is None:
            self.first = (key, page_id)
        self.last = (key, page_id)
        if not self.lines:
            self.block_first = f"{_line(key)}\t{page_id}"
        self.archive.write(member)
        self.lines.append(f"{_line(key)}\t{page_id}\t{self.at}\t{len(member)}\n")
        self.at += len(member)
        self.captures += 1
        if len(self.lines) == BLOCK_LINES:
            self._block()

    def _block(self) -> None:
        data = zlib.compress("".join(self.lines).encode())
        self.index.write(data)
        self.directory.append(f"{self.block_first}\t{self.index_at}\t{len(data)}\n")
        self.index_at += len(data)
        self.lines = []

    def close(self) -> dict:
        if self.lines:
            self._block()
        self.archive.close()
        self.index.close()
        with self.fs.open_output_stream(f"{self.name}.dir.gz", compression=None) as f:
            f.write(zlib.compress("".join(self.directory).encode()))
        return {"key": self.first[0], "page_id": self.first[1], "last_key": self.last[0], "last_id": self.last[1], "shard": self.name, "captures": self.captures, "blocks": len(self.directory)}


def _line(key: str) -> str:
    """The key with the three characters that would break a line escaped."""
    return key.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r") if not key.isprintable() or "\\" in key else key


_MANIFEST = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("last_key", pa.string()), ("last_id", pa.int64()), ("shard", pa.string()), ("captures", pa.int64()), ("blocks", pa.int64())])


def in_key_order(rows: DataFrame) -> DataFrame:
    """Range partitions by key and page id; equal ones are cut by row number."""
    order = ["key", F.col("page_id").asc_nulls_first(), "row"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")


def write_archives(pages: DataFrame, folder: str, revisit_from: int = 0, date: str = "2024-01-01T00:00:00Z") -> CaptureIndex:
    """Write archives and index of (page_id, url, html); the index is returned open for queries."""

    def write(batches):
        fs, root = resolve(folder)
        shard = None
        for b in batches:
            for r in b.to_pylist():
                if shard is not None and shard.at >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pylist([shard.close()], schema=_MANIFEST)
                    shard = None
                if shard is None:
                    shard = _Shard(fs, root)
                member = record(r["page_id"], r["url"], r["payload"].encode(), r["refers_to"], date)
                shard.add(r["key"], _NULL_ID if r["page_id"] is None else r["page_id"], member)
        if shard is not None:
            yield pa.RecordBatch.from_pylist([shard.close()], schema=_MANIFEST)

    ordered = in_key_order(with_roles(pages, revisit_from))
    manifest = stored(ordered.mapInArrow(write, "key string, page_id long, last_key string, last_id long, shard string, captures long, blocks long"), "warc-manifest")
    # one row per archive; of those with the same first key the one that goes beyond it comes last
    found = sorted(((r["key"], r["page_id"]), (r["last_key"], r["last_id"]), r["shard"]) for r in manifest.drop("captures", "blocks").collect())
    return CaptureIndex(folder, [first for first, _, _ in found], [s for _, _, s in found])


# -- reading -----------------------------------------------------------------


class _Reader:
    """Binary search in one shard; queries come in key order, so blocks are read once."""

    def __init__(self, fs, shard: str):
        self.fs, self.shard = fs, shard
        with fs.open_input_stream(f"{shard}.dir.gz", compression=None) as f:
            self.blocks = [_split(line) for line in zlib.decompress(f.read()).decode().split("\n")[:-1]]
        self.keys = [(k, p) for k, p, _, _ in self.blocks]
        self.index = fs.open_input_file(f"{shard}.cdx.gz")
        self.archive = fs.open_input_file(f"{shard}.warc.gz")
        self.block = -1

    def _load(self, i: int) -> None:
        if i != self.block:
            _, _, at, n = self.blocks[i]
            self.lines = [_split(line) for line in zlib.decompress(self.index.read_at(n, at)).decode().split("\n")[:-1]]
            self.line_keys = [(k, p) for k, p, _, _ in self.lines]
            self.block = i

    def find(self, key: str, page_id: int) -> list[tuple[int, int]]:
        """(offset, length) of the captures with this key and id (repeats included)."""
        out = []
        i = max(bisect.bisect_left(self.keys, (key, page_id)) - 1, 0)
        while i < len(self.blocks) and self.keys[i] <= (key, page_id):
            self._load(i)
            j = bisect.bisect_left(self.line_keys, (key, page_id))
            while j < len(self.lines) and self.line_keys[j] == (key, page_id):
                out.append(self.lines[j][2:])
                j += 1
            i += 1
        return out

    def close(self) -> None:
        self.index.close()
        self.archive.close()

    def records(self, places: list[tuple[int, int]]):
        """Parsed records; neighbours are fetched by one range read."""
        i = 0
        while i < len(places):
            begin, end, j = places[i][0], places[i][0] + places[i][1], i + 1
            while j < len(places) and places[j][0] == end and end + places[j][1] - begin <= _READ:
                end += places[j][1]
                j += 1
            buf = self.archive.read_at(end - begin, begin)
            for at, n in places[i:j]:
                yield parse(buf[at - begin : at - begin + n])
            i = j


def _split(line: str) -> tuple[str, int, int, int]:
    key, page_id, at, n = line.split("\t")
    if "\\" in key:
        key = key.replace("\\\\", "\0").replace("\\t", "\t").replace("\\n", "\n").replace("\\r", "\r").replace("\0", "\\")
    return key, int(page_id), int(at), int(n)


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def read_captures(index: CaptureIndex, queries: DataFrame) -> DataFrame:
    """Records of the distinct (url, page_id) asked for: through directory, block and range read.

    Returns page_id, url, record_type, refers_to, payload (null for revisits),
    payload_bytes and payload_digest (both of the full payload).
    """

    def shards_of(keys, page_ids):
        import pandas as pd

        wanted = list(zip(keys, page_ids.tolist(), strict=True))
        # the last shard that starts below the key may end with it; all that start at it hold it
        return pd.Series([list(range(max(bisect.bisect_left(index.first, w) - 1, 0), bisect.bisect_right(index.first, w))) for w in wanted])

    def read(batches):
        fs, _ = resolve(index.folder)
        reader, open_shard = None, -1
        for b in batches:
            places: list[tuple[int, int]] = []
            shards, keys, ids = b["shard"].to_pylist(), b["key"].to_pylist(), b["page_id"].to_pylist()
            for s, k, p in zip(shards, keys, ids, strict=True):
                if s != open_shard:
                    if reader is not None:
                        yield from _batches(reader.records(places))
                        reader.close()
                    reader, open_shard, places = _Reader(fs, index.shard[s]), s, []
                places.extend(reader.find(k, _NULL_ID if p is None else p))
            if reader is not None:
                yield from _batches(reader.records(places))

    spark = queries.sparkSession
    fields = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    if not index.shard:
        return spark.createDataFrame([], fields)
    asked = queries.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long")).distinct()
    asked = asked.withColumn("shard", F.explode(F.pandas_udf(shards_of, "array<int>")("key", F.coalesce("page_id", F.lit(_NULL_ID)))))  # without nulls, ids do not become floats
    ordered = asked.repartition("shard").sortWithinPartitions("shard", "key", F.col("page_id").asc_nulls_first())
    return ordered.mapInArrow(read, fields)


def _batches(records):
    held, size = [], 0
    for r in records:
        held.append(r)
        size += r["payload_bytes"]
        if size > _READ or len(held) >= 1000:
            yield pa.RecordBatch.from_pylist(held, schema=_RECORD)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_RECORD)


def archive_round_trip(pages: DataFrame, revisit_from: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages to archives in the shared folder, then read every capture back by the index."""
    spark: SparkSession = pages.sparkSession
    rows = keyed(pages, page_id=id_col, url=url_col, html=html_col).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    index = write_archives(rows, new_folder(spark, "warc"), revisit_from)
    return read_captures(index, rows.select("url", "page_id"))
