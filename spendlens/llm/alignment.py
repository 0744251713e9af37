"""Alignment of two tokenizers' tokens of the same texts.

Both tokenizers split ``space + text`` into byte ranges; places where tokens of
both end cut them into groups, and each group links its last A token with its
last B token. Nearly all groups hold one token of each side with the same
bytes: those are recognised by an array from A ids to the B id of equal bytes
and counted in a vector with one entry an A id. Only the links of the other
groups are shuffled as id pairs.

Texts are cut before a space between other characters, where neither tokenizer
joins what lies on the two sides; every distinct segment is encoded and aligned
once a worker and kept in a bounded table.

Counts go back to documents in two ways: the vector and the most frequent pairs
(at most ``hot_pairs``) are sent to every task; the other pairs, none of which is
frequent, are joined. All counts are exact.

Defined results: null and empty texts, and texts whose tokens of either side do
not spell ``space + text``, have zeros and an empty digest; rows that repeat an
id are kept apart; null ids are ids like others; an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, new_folder, process_cache, release_memory, row_slices, stored, text_buffer
from .encoders import _Rows, byte_letters
from .frequent import frequent_from
from .packing import pack_multisets, unpack_multisets

#: a link's key is a_id * B_SPACE + b_id
B_SPACE = 1 << 15
#: pairs sent to every task (24 bytes each)
HOT_PAIRS = 1 << 18
SLICE_BYTES = 4 << 20
#: longer segments go to the tokenizer itself
LONG = 400
# Fixed value: how byte-level BPE splits text before merging.
BYTE_LEVEL_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: distinct links a task holds before it hands their counts on
HELD_LINKS = 1 << 21


def load_pair(path_a: str, path_b: str):
    """Byte-level BPE (tokenizers) and piece BPE (sentencepiece); strings of special tokens are plain text."""
    cache = process_cache("pair")
    if (path_a, path_b) not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(path_a)
        a.no_truncation()
        a.no_padding()
        a.encode_special_tokens = True
        cache[path_a, path_b] = a, SentencePieceProcessor(model_file=path_b)
    return cache[path_a, path_b]


@dataclass(frozen=True)
class Vocabularies:
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    #: A id -> B id with the same bytes, -1 without one
    same: np.ndarray


def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    a, b = load_pair(path_a, path_b)
    to_byte = {c: x for x, c in byte_letters().items()}
    a_bytes = [b""] * a.get_vocab_size()
    for token, i in a.get_vocab().items():
        a_bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
    b_bytes, of_bytes = [], {}
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
        if not b.is_byte(i) and not b.is_control(i) and not b.is_unknown(i):
            of_bytes.setdefault(b_bytes[-1], i)
    for i in range(b.get_piece_size()):
        if b.is_byte(i):
            of_bytes.setdefault(b_bytes[i], i)
    return Vocabularies(a_bytes, b_bytes, np.array([of_bytes.get(x, -1) for x in a_bytes], np.int64))


def _opens(piece: str) -> bool:
    return "!" <= piece[0] <= "~" or piece[0].isalnum()


def segments(text: str) -> list[str]:
    """Parts of the text, each without the space before it."""
    parts = text.split(" ")
    out, before = [parts[0]], parts[0]
    for p in parts[1:]:
        if before and p and _opens(p):
            out.append(p)
        else:
            out[-1] += " " + p
        before = p
    return out


class TokenBytes:
    """The bytes of all tokens of a vocabulary in one array."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spells(self, ids: np.ndarray, segment: np.ndarray, raw: list[bytes], size: np.ndarray) -> np.ndarray:
        """Whether the tokens of each segment spell its bytes."""
        n = self.length[ids]
        ends = np.cumsum(n)
        made = self.data[np.repeat(self.start[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        total = np.bincount(segment, weights=n, minlength=len(raw)).astype(np.int64)
        good = total == size
        want = np.frombuffer(b"".join([r for r, ok in zip(raw, good.tolist(), strict=True) if ok]), np.uint8)
        have = made[np.repeat(good, total)]
        wrong = np.repeat(np.arange(len(raw)), np.where(good, size, 0))[have != want]
        good[wrong] = False
        return good


def ranked_bpe(path: str, tokens: list[bytes]):
    """The same byte-level BPE by token rank (tiktoken), which encodes short texts much faster.

    Only for a vocabulary whose merges make tokens in the order of their ids, split by the
    byte-level rule; None for any other.
    """
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    plain = plain and not model.get("dropout") and not model.get("ignore_merges") and not model.get("byte_fallback")
    if not plain:
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(x + y, -1) for x, y in pairs]
    bytes_first = sorted(model["vocab"][c] for c in byte_letters().values() if c in model["vocab"])
    if len(bytes_first) != 256 or made != list(range(256, 256 + len(made))) or bytes_first != list(range(256)):
        return None
    import tiktoken

    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks={tokens[i]: i for i in range(256 + len(made))}, special_tokens={})


class Aligner:
    """Aligned segments of a worker: ids are kept as link keys, same-byte A ids and the groups' text."""

    memo = 300_000
    memo_bytes = 24 << 20

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = load_pair(path_a, path_b)
        self.vocab = vocabularies(path_a, path_b)
        self.bytes_a, self.bytes_b = TokenBytes(self.vocab.a_bytes), TokenBytes(self.vocab.b_bytes)
        self.ranked = ranked_bpe(path_a, self.vocab.a_bytes)
        self._clear()

    def _clear(self) -> None:
        self.rows, self.text = _Rows(), []
        self.fact = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, spelled as the segment
        self.seen = np.zeros(0, np.int64)
        self.pools = {"same": (np.zeros(0, np.int64), np.zeros(1, np.int64)), "link": (np.zeros(0, np.int64), np.zeros(1, np.int64))}
        self.bytes = 0

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is None:
            return [e.ids for lo in range(0, len(texts), 10_000) for e in self.a.encode_batch(texts[lo : lo + 10_000], add_special_tokens=False)]
        ordinary, library = self.ranked.encode_ordinary, self.a.encode
        return [ordinary(t) if len(t) < LONG else library(t, add_special_tokens=False).ids for t in texts]

    def _take(self, name: str, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the segments in order, how many each has)."""
        pool, bounds = self.pools[name]
        n = bounds[row + 1] - bounds[row]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return pool[np.repeat(bounds[row] - (ends - n), n) + np.arange(total)], n

    def _forget(self) -> None:
        """Keep the half seen most often."""
        often = np.argsort(-self.seen, kind="stable")[: self.memo // 2]
        keep = np.sort(often[self.seen[often] > 1])
        names, text, fact, seen = list(self.rows), self.text, self.fact, self.seen
        pools = {k: self._take(k, keep) for k in self.pools}
        self._clear()
        kept = keep.tolist()
        self.rows.update((names[k], i) for i, k in enumerate(kept))
        self.text = [text[k] for k in kept]
        self.fact, self.seen = fact[keep], seen[keep] // 2
        self.pools = {k: (values, np.concatenate([[0], np.cumsum(n)])) for k, (values, n) in pools.items()}
        self.bytes = sum(map(len, self.text)) + sum(len(names[k]) for k in kept)
        if self.bytes > self.memo_bytes // 2:
            self._clear()

    def _add(self, new: list[str]) -> None:
        ids_a = self.encode_a([" " + s for s in new])
        ids_b = self.b.encode(new, num_threads=1) if new else []
        raw = [(" " + s).encode() for s in new]
        n_new = len(new)
        size = np.fromiter(map(len, raw), np.int64, n_new)
        good = np.ones(n_new, bool)
        flat, of_seg = [], []
        for ids, table in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            count = np.fromiter(map(len, ids), np.int64, n_new)
            flat.append(np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum())))
            of_seg.append(np.repeat(np.arange(n_new), count))
            good &= table.spells(flat[-1], of_seg[-1], raw, size)
        (flat_a, flat_b), (seg_a, seg_b) = ([f[good[o]] for f, o in zip(flat, of_seg, strict=True)], [o[good[o]] for o in of_seg])
        end_a, end_b = np.cumsum(self.bytes_a.length[flat_a]), np.cumsum(self.bytes_b.length[flat_b])
        cut, at_a, _ = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        group_a, group_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
        n_a, n_b = np.bincount(group_a, minlength=len(cut)), np.bincount(group_b, minlength=len(cut))
        a, b = flat_a[np.cumsum(n_a) - 1], flat_b[np.cumsum(n_b) - 1]
        same = (n_a == 1) & (n_b == 1) & (self.vocab.same[a] == b)
        of = seg_a[at_a]
        n_groups = np.bincount(of, minlength=n_new)
        fact = np.stack([np.bincount(seg_a, minlength=n_new), np.bincount(seg_b, minlength=n_new), n_groups, good], axis=1)
        self.fact = np.concatenate([self.fact, fact])
        self.seen = np.concatenate([self.seen, np.zeros(n_new, np.int64)])
        for name, values, mask in (("same", a, same), ("link", a * B_SPACE + b, ~same)):
            pool, bounds = self.pools[name]
            n = np.bincount(of[mask], minlength=n_new)
            self.pools[name] = np.concatenate([pool, values[mask]]), np.concatenate([bounds, bounds[-1] + np.cumsum(n)])
        made = self._texts(flat_a, flat_b, group_a, group_b, n_a, n_b, n_groups)
        self.text += made
        self.bytes += sum(map(len, made)) + int(size.sum())

    @staticmethod
    def _texts(flat_a, flat_b, group_a, group_b, n_a, n_b, n_groups) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` of each segment, written for all of them at once."""
        before_a, before_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        place_a = np.arange(len(flat_a)) + before_b[group_a]
        place_b = np.arange(len(flat_b)) + before_a[group_b + 1]
        ids, mark = np.empty(len(flat_a) + len(flat_b), np.int64), np.full(len(flat_a) + len(flat_b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = flat_a, flat_b
        ends_a, ends_b = place_a[before_a[1:] - 1], place_b[before_b[1:] - 1]
        mark[ends_a], mark[ends_b] = ord("|"), ord(";")
        powers = 10 ** np.arange(5, -1, -1)
        digits = ((ids[:, None] // powers) % 10 + ord("0")).astype(np.uint8)
        width = np.searchsorted(powers[::-1][1:], ids, "right") + 1  # of each id
        cells = np.concatenate([digits, mark[:, None]], axis=1)
        shown = np.arange(7) >= 6 - width[:, None]
        out = cells[shown].tobytes()
        # a segment's text ends before the mark of its last group
        last = np.cumsum(width + 1)[ends_b]
        ends = np.concatenate([[0], last])[np.cumsum(n_groups)].tolist()
        return [out[lo : max(lo, hi - 1)] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]

    def align(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(table row of every segment, bounds of the texts) of a string column (null: no segment)."""
        if len(self.rows) > self.memo or self.bytes > self.memo_bytes:
            self._forget()
        column = pc.fill_null(column, "")
        lists = pc.split_pattern(column, " ")
        coded = lists.values.dictionary_encode()
        names = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        # texts in which a piece is no segment of its own are cut one by one
        spelled, at = text_buffer(coded.dictionary)
        blank = np.diff(at) == 0
        first = np.zeros(len(names), np.uint8)
        first[~blank] = spelled[at[:-1][~blank]]
        opens = (first >= 0x21) & (first <= 0x7E)
        other = np.flatnonzero(first >= 0x80)
        opens[other] = [_opens(names[i]) for i in other.tolist()]
        starts = opens[index] if len(names) else np.zeros(0, bool)
        if len(index):
            starts[1:] &= ~blank[index[:-1]]
        starts[bounds[:-1]] = True
        single = np.concatenate([[0], np.cumsum(~starts)])
        odd = single[bounds[1:]] > single[bounds[:-1]]
        odd |= blank[index[bounds[:-1]]] if len(bounds) > 1 else False  # empty, or starting with a space
        plain = np.zeros(len(index), bool) if not len(index) else ~np.repeat(odd, np.diff(bounds))
        used = np.zeros(len(names), bool)
        used[index[plain]] = True
        of_name = np.zeros(len(names), np.int64)
        at = np.flatnonzero(used)
        of_name[at] = list(map(self.rows.__getitem__, names if len(at) == len(names) else [names[i] for i in at.tolist()]))
        row = of_name[index]
        if odd.any():
            parts, counts = [], np.diff(bounds).copy()
            texts = dict(zip(np.flatnonzero(odd).tolist(), column.filter(pa.array(odd)).to_pylist(), strict=True))
            for k, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if k in texts:
                    mine = [self.rows[s] for s in segments(texts[k])] if texts[k] else []
                    parts.append(np.array(mine, np.int64))
                    counts[k] = len(mine)
                else:
                    parts.append(row[i:j])
            row, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])
        if self.rows.new:
            new, self.rows.new = self.rows.new, []
            self._add(new)
        self.seen += np.bincount(row, minlength=len(self.seen))
        return row, bounds


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    width = values.dtype.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _align(path_a: str, path_b: str):
    def align(batches):
        cache = process_cache("aligner")
        table = cache.setdefault((path_a, path_b), None) or Aligner(path_a, path_b)
        cache[path_a, path_b] = table
        n_ids = len(table.vocab.a_bytes)
        for batch in batches:
            _, offsets = text_buffer(batch.column("text"))
            for lo, hi in row_slices(offsets, SLICE_BYTES):
                row, bounds = table.align(batch.column("text").slice(lo, hi - lo))
                n = hi - lo
                spelled = (_sums(1 - table.fact[row, 3], bounds) == 0) & (np.diff(bounds) > 0)
                row = row[np.repeat(spelled, np.diff(bounds))]
                bounds = np.concatenate([[0], np.cumsum(np.where(spelled, np.diff(bounds), 0))])
                n_a, n_b, n_groups = (_sums(table.fact[row, k], bounds) for k in range(3))
                names, r = table.text, row.tolist()
                digest = [hashlib.sha256(b";".join([names[k] for k in r[i:j]])).hexdigest() if j > i else "" for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                doc = np.repeat(np.arange(n), np.diff(bounds))
                same, many = table._take("same", row)
                link, few = table._take("link", row)
                keys = np.sort(np.repeat(doc, few) << 32 | link)
                link_bounds = np.searchsorted(keys >> 32, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, n),
                        *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)),
                        pa.array(digest, pa.string()),
                        pack_multisets(np.repeat(doc, many), same, n, n_ids),
                        _binary((keys & 0xFFFFFFFF).astype("<u4"), link_bounds),
                    ],
                    ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "same", "links"],
                )
        release_memory()

    return align


def aligned(docs: DataFrame, path_a: str, path_b: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: token and group counts, digest of the groups, packed same-byte A ids and link keys."""
    rows = keyed(docs, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_align(path_a, path_b), f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, same binary, links binary")


def identity_counts(table: DataFrame, n_ids: int) -> np.ndarray:
    """Occurrences of each A id in exact one-to-one groups (a vector a task, summed)."""

    def count(batches):
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            values, _ = unpack_multisets(*text_buffer(batch.column("same")))
            total += np.bincount(values, minlength=n_ids)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["a", "n"])

    out = np.zeros(n_ids, np.int64)
    for r in table.select("same").mapInArrow(count, "a int, n long").groupBy("a").agg(F.sum("n").alias("n")).collect():
        out[r["a"]] = r["n"]
    return out


def pair_counts(table: DataFrame) -> DataFrame:
    """(key, n) of the links of irregular groups, counted in tasks before they are shuffled."""

    def count(batches):
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

        for batch in batches:
            data, _ = text_buffer(batch.column("links"))
            found, times = np.unique(data.view("<u4"), return_counts=True)
            both = np.concatenate([keys, found.astype(np.int64)])
            keys, place = np.unique(both, return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([n, times]), minlength=len(keys)).astype(np.int64)
            if len(keys) > HELD_LINKS:
                yield rows()
                keys, n = keys[:0], n[:0]
        yield rows()

    return table.select("links").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _weigh(identity: np.ndarray, best_identity: np.ndarray, hot: tuple[np.ndarray, np.ndarray, np.ndarray]):
    keys, count, best = hot

    def weigh(batches):
        for batch in batches:
            same, bounds = unpack_multisets(*text_buffer(batch.column("same")))
            n_best, total = _sums(best_identity[same].astype(np.int64), bounds), _sums(identity[same], bounds)
            data, at = text_buffer(batch.column("links"))
            link, at = data.view("<u4").astype(np.int64), at // 4
            place = np.searchsorted(keys, link)
            known = place < len(keys)
            known[known] = keys[place[known]] == link[known]
            here = np.where(known, place, 0)
            if len(keys):
                n_best += _sums(np.where(known, best[here], False).astype(np.int64), at)
                total += _sums(np.where(known, count[here], 0), at)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[~known]
            rest, times = np.unique(doc << 32 | link[~known], return_counts=True)
            first = np.searchsorted(rest >> 32, np.arange(len(at))).astype(np.int32)
            others = pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays([pa.array(rest & 0xFFFFFFFF, pa.int64()), pa.array(times, pa.int64())], ["key", "times"]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")] + [pa.array(n_best), pa.array(total), others], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_best", "count_sum", "others"])

    return weigh


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, *, doc_id: str = "doc_id", text: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per document: token, group and link counts, links at their B id's highest count, sum of the links' counts."""
    spark = docs.sparkSession
    path = new_folder(spark, "aligned")
    aligned(docs, path_a, path_b, doc_id=doc_id, text=text).write.option("compression", "zstd").parquet(path)
    table = spark.read.parquet(path)
    vocab = vocabularies(path_a, path_b)
    identity = identity_counts(table, len(vocab.a_bytes))
    pairs = stored(pair_counts(table), "pairs")
    # the highest count of each B id: vectors of the vocabulary's length
    highest = np.zeros(len(vocab.b_bytes), np.int64)
    for r in pairs.groupBy((F.col("key") % B_SPACE).alias("b")).agg(F.max("n").alias("n")).collect():
        highest[r["b"]] = r["n"]
    mapped = vocab.same >= 0
    np.maximum.at(highest, vocab.same[mapped], identity[mapped])
    best_identity = np.where(mapped, identity == highest[vocab.same], False)
    least = frequent_from(pairs, "n", hot_pairs)
    rows = pairs.where(F.col("n") >= least).toArrow()
    hot_key, hot_n = (rows.column(c).to_numpy() for c in ("key", "n"))
    by_key = np.argsort(hot_key)
    hot_key, hot_n = hot_key[by_key], hot_n[by_key]
    hot = hot_key, hot_n, hot_n == highest[hot_key % B_SPACE]
    kind = table.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long, others array<struct<key: long, times: long>>"
    weighed = table.mapInArrow(_weigh(identity, best_identity, hot), schema).withColumn("_row", F.monotonically_increasing_id())
    weighed = stored(weighed, "weighed")
    top = spark.createDataFrame(pa.table({"b": pa.array(np.arange(len(highest)), pa.int64()), "top": pa.array(highest)}))
    rare = pairs.where(F.col("n") < least).join(F.broadcast(top), F.col("key") % B_SPACE == F.col("b")).select("key", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    asked = weighed.select("_row", F.explode("others").alias("o")).select("_row", "o.key", "o.times")
    found = asked.join(rare, "key").groupBy("_row").agg(F.sum(F.col("times") * F.col("best")).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    out = weighed.join(found, "_row", "left")
    return out.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        F.col("n_groups").alias("n_links"),
        (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
