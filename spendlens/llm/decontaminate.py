"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every window of ``window`` consecutive words of a benchmark item is a pattern
(an item of fewer words is one pattern). Documents are scanned as bytes of
their normalized words: a table over blocks of bytes says how far the scan may
jump, because no pattern has that block any nearer to its (shortest common)
end; where the jump is 0 the block's hash selects the bucket of patterns that
end so, an 8-byte prefix narrows it, and direct comparison confirms.

The scan runs on many lanes of a slice at once with numpy. Patterns are dealt
into blocks of at most ``block_patterns``; more patterns mean more passes, not
more memory.

Defined results: words are runs of ASCII digits and letters (A-Z lower-cased)
and of all non-ASCII characters. A null or wordless text has no words and no
hits; a wordless item has no window; items without id mark words but are not
listed; repeated document rows give a row each; empty tables give empty
results. Other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, ascii_classes, begin, keyed, new_owner, owned, process_cache, row_slices, stored, text_buffer

#: bytes that belong to words: digits, letters, everything outside ASCII
WORD_BYTES = ascii_classes(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
_SLICE = 2 << 20
_LANE = 2048
_PAD = 8
RESULT = "doc_id long, n_words long, n_hit long, spans array<struct<first:int,last:int>>, items array<long>"


class PatternClass:
    """Shift and bucket tables of patterns of similar length."""

    def __init__(self, patterns: list[bytes], numbers: np.ndarray, block: int):
        self.patterns = patterns
        self.numbers = numbers
        self.m = m = min(255, *map(len, patterns)) if len(patterns) > 1 else min(255, len(patterns[0]))
        self.block = block = min(block, m)
        k = len(patterns)
        self.bits = min(22, max(12, (16 * k * (m - block + 1)).bit_length()))
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(k, m)
        self.shift = np.full(1 << self.bits, m - block + 1, np.uint8)
        for j in range(m - block + 1):
            v = np.zeros(k, np.uint64)
            for x in range(block):
                v |= heads[:, j + x].astype(np.uint64) << np.uint64(8 * x)
            h = self._hash(v)
            np.minimum.at(self.shift, h, np.uint8(m - block - j))
        order = np.argsort(h, kind="stable")  # of the last block, where the shift is 0
        self.bucket_hash, self.bucket = h[order], order
        self.prefix_bytes = min(8, m)
        prefix = np.zeros((k, 8), np.uint8)
        prefix[:, : self.prefix_bytes] = heads[:, : self.prefix_bytes]
        self.prefix = prefix.view("<u8").ravel()
        self.prefix_mask = np.uint64((1 << 8 * self.prefix_bytes) - 1)

    def _hash(self, v: np.ndarray) -> np.ndarray:
        return ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def scan(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of all occurrences; ``text`` has ``_PAD`` spare bytes on both sides."""
        n = len(text) - 2 * _PAD
        if n < self.m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words = np.ndarray(shape=(len(text) - 7,), dtype="<u8", buffer=text, strides=(1,))
        drop = np.uint64(8 * (8 - self.block))
        at = np.arange(self.m, n + 1, _LANE)  # end of the window
        last = np.minimum(at + _LANE - 1, n)
        ends, hashes = [], []
        while len(at):
            h = self._hash(words[at + (_PAD - 8)] >> drop)
            step = self.shift[h]
            zero = step == 0
            if zero.any():
                ends.append(at[zero])
                hashes.append(h[zero])
            at = at + np.maximum(step, 1)
            going = at <= last
            if not going.all():
                at, last = at[going], last[going]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.concatenate(ends) - self.m
        h = np.concatenate(hashes)
        lo = np.searchsorted(self.bucket_hash, h, "left")
        size = np.searchsorted(self.bucket_hash, h, "right") - lo
        cum = np.cumsum(size)
        which = self.bucket[np.repeat(lo - (cum - size), size) + np.arange(int(cum[-1]))]
        start = np.repeat(start, size)
        same = (words[start + _PAD] & self.prefix_mask) == self.prefix[which]
        start, which = start[same], which[same]
        raw = memoryview(text)[_PAD : _PAD + n]
        ok = [raw[s : s + len(self.patterns[p])] == self.patterns[p] for s, p in zip(start.tolist(), which.tolist(), strict=True)]
        keep = np.array(ok, bool)
        return start[keep], self.numbers[which[keep]]


class WuManber:
    """Patterns (normalized words, each followed by a space) by classes of length."""

    def __init__(self, patterns: list[bytes]):
        lens = np.array([len(p) for p in patterns], np.int64)
        self.n_words = np.array([p.count(b" ") for p in patterns], np.int64)
        self.classes = []
        for low, high, block in ((24, 1 << 62, 6), (8, 24, 4), (1, 8, 2)):
            mine = np.flatnonzero((lens >= low) & (lens < high))
            if len(mine):
                self.classes.append(PatternClass([patterns[i] for i in mine], mine, block))

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of the occurrences that start at a word and stay in one row."""
        text = np.zeros(len(words.canon) + 2 * _PAD, np.uint8)
        text[_PAD:-_PAD] = words.canon
        firsts, found = [], []
        for c in self.classes:
            start, pattern = c.scan(text)
            w = np.searchsorted(words.start, start)
            inside = w < len(words)
            w, start, pattern = w[inside], start[inside], pattern[inside]
            last = w + self.n_words[pattern] - 1
            good = (words.start[w] == start) & (last < len(words))
            w, pattern, last = w[good], pattern[good], last[good]
            same = words.row[w] == words.row[last]
            firsts.append(w[same])
            found.append(pattern[same])
        return np.concatenate(firsts) if firsts else np.zeros(0, np.int64), np.concatenate(found) if found else np.zeros(0, np.int64)


def benchmark_windows(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (pattern, item_id) of a benchmark table."""

    def cut(batches):
        for b in batches:
            data, offsets = text_buffer(b["text"])
            ids = b["item_id"].to_pylist()
            for lo, hi in row_slices(offsets, _SLICE):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], WORD_BYTES)
                raw = words.canon.tobytes()
                got = set()
                for r in range(hi - lo):
                    a, z = int(words.first[r]), int(words.first[r + 1])
                    for i in range(a, max(z - window, a) + 1 if z > a else a):
                        j = min(i + window, z) - 1
                        got.add((raw[words.start[i] : words.end[j] + 1], ids[lo + r]))
                pairs = list(got)
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.binary()), pa.array([i for _, i in pairs], pa.int64())], ["pattern", "item_id"])

    rows = keyed(benchmark, item_id=id_col, text=text_col).select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(owned(new_owner(), cut), "pattern binary, item_id long").distinct()


def _search(docs: DataFrame, pairs: list[tuple[bytes, int | None]]) -> DataFrame:
    spark = docs.sparkSession
    by_pattern: dict[bytes, list[int]] = {}
    for p, i in pairs:
        items = by_pattern.setdefault(bytes(p), [])
        if i is not None:
            items.append(i)
    patterns = list(by_pattern)
    counts = np.array([len(by_pattern[p]) for p in patterns], np.int64)
    ends = np.cumsum(counts)
    items = np.array([i for p in patterns for i in by_pattern[p]], np.int64)
    shared = spark.sparkContext.broadcast((patterns, counts, ends, items))

    def run(batches):
        patterns, counts, ends, items = shared.value
        search = WuManber(patterns)
        for b in batches:
            data, offsets = text_buffer(b["text"])
            for lo, hi in row_slices(offsets, _SLICE):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], WORD_BYTES)
                n = hi - lo
                first, which = search.find(words)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + search.n_words[which], -1)
                hit = np.cumsum(edge)[:-1] > 0
                n_hit = np.bincount(words.row[hit], minlength=n)
                spans = _spans(hit, words, n)
                row = words.row[first]
                size = counts[which]
                total = int(size.sum())
                cum = np.cumsum(size)
                item = items[np.repeat((ends - counts)[which] - (cum - size), size) + np.arange(total)]
                pairs = np.unique(np.stack([np.repeat(row, size), item], 1), axis=0) if total else np.zeros((0, 2), np.int64)
                at = np.searchsorted(pairs[:, 0], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(lo, n), pa.array(np.diff(words.first)), pa.array(n_hit.astype(np.int64)), spans, pa.ListArray.from_arrays(pa.array(at), pa.array(pairs[:, 1]))],
                    ["doc_id", "n_words", "n_hit", "spans", "items"],
                )

    return docs.mapInArrow(owned(new_owner(), run), RESULT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_patterns: int = 250_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows without any occurring window, with all their columns; a filter for each block of patterns."""
    windows = stored(benchmark_windows(benchmark, window, item_col, item_text_col).select("pattern").distinct(), "benchmark-windows")
    blocks = max(1, -(-windows.count() // block_patterns))
    owner = new_owner()
    for i in range(blocks):
        mine = windows.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == i)
        shared = docs.sparkSession.sparkContext.broadcast([bytes(r["pattern"]) for r in mine.collect()])
        docs = docs.where(_clean(shared, owner, i)(F.col(f"`{text_col}`")))
    return docs


def _clean(shared, owner: str, name: int):
    """Column function: no pattern of the broadcast occurs in the text; a worker keeps the tables of all blocks."""

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        begin(owner)
        cache = process_cache("searches")
        if name not in cache:
            cache[name] = WuManber(shared.value)
        data, offsets = text_buffer(texts)
        out = np.ones(len(texts), bool)
        for lo, hi in row_slices(offsets, _SLICE):
            words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], WORD_BYTES)
            out[lo + words.row[cache[name].find(words)[0]]] = False
        return pa.array(out)

    return clean


def _spans(hit: np.ndarray, words: Words, n: int) -> pa.Array:
    """Runs of hit words by row, as word positions inside the row."""
    begin, end = hit.copy(), hit.copy()
    if len(hit):
        new_row = np.zeros(len(hit), bool)
        heads = words.first[:-1][words.first[:-1] < len(hit)]
        new_row[heads] = True
        begin[1:] &= ~hit[:-1] | new_row[1:]
        end[:-1] &= ~hit[1:] | new_row[1:]
    b, e = np.flatnonzero(begin), np.flatnonzero(end)
    row = words.row[b]
    base = words.first[row] if len(row) else row
    at = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array((b - base).astype(np.int32)), pa.array((e - base).astype(np.int32))], ["first", "last"])
    return pa.ListArray.from_arrays(pa.array(at), runs)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_patterns: int = 250_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items): what of each document a benchmark has too.

    ``spans`` are the runs of hit words (first and last position), ``items``
    the sorted ids of the items with occurring windows.
    """
    rows = keyed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    windows = stored(benchmark_windows(benchmark, window, item_col, text_col), "benchmark-windows")
    blocks = max(1, -(-windows.count() // block_patterns))
    if blocks == 1:
        return _search(rows, [tuple(r) for r in windows.collect()])
    # several passes over numbered rows, merged by number
    numbered = stored(rows.withColumn("row", F.monotonically_increasing_id()), "decontaminate-docs")
    parts = []
    for i in range(blocks):
        mine = windows.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == i)
        parts.append(_search(numbered.select(F.col("row").alias("doc_id"), "text"), [tuple(r) for r in mine.collect()]))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    merged = merged.groupBy("doc_id").agg(F.first("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    step = """aggregate(all, cast(array() as array<struct<first:int,last:int>>), (acc, s) ->
        if(size(acc) > 0 and s.first <= element_at(acc, -1).last + 1,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'last', greatest(element_at(acc, -1).last, s.last)))),
           concat(acc, array(s))))"""
    merged = merged.withColumn("spans", F.expr(step)).withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1)"))
    return numbered.select("row", F.col("doc_id").alias("id")).join(merged.withColumnRenamed("doc_id", "row"), "row").select(F.col("id").alias("doc_id"), "n_words", "n_hit", "spans", "items")
