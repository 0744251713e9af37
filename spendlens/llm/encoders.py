"""Whole-text encoding with the ``tokenizers`` library, one distinct segment at a time.

A text is cut only where the tokenizer's own pre-tokenization always cuts, so
the ids of the text are the ids of its segments in order. Every distinct
segment goes to the library once; repeats come from a table of the worker.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import process_cache, text_buffer

# letters that every Unicode version since 3.0 treats alike (no case or
# normalization surprises)
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ſ"
_PLAIN = re.compile(f"([{_LETTERS}]+)([.,;:!?]*)")
_BLANKS = re.compile("[\n\t\r]")
_ODD_SPACE = re.compile(r" (?![!-~\w])")
_FIRST = "\x00"
_BLANK_BYTES = np.arange(256, dtype=np.uint8)
_BLANK_BYTES[[9, 10, 13]] = 0x20
_LOWER_BYTES = _BLANK_BYTES.copy()
_LOWER_BYTES[0x41:0x5B] += 32
_SIGN = np.isin(np.arange(256), list(b".,;:!?"))
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True


def load_tokenizer(path: str):
    """The library's tokenizer (single-threaded, no truncation or padding)."""
    cache = process_cache("tokenizers")
    if path not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        cache[path] = tok
    return cache[path]


def byte_letters() -> dict[int, str]:
    """Byte -> printable stand-in used by byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Rows(dict):
    """Segment -> row number; unknown segments get the next one and are noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class SegmentTable:
    """Ids of distinct segments of one tokenizer.

    ``memo`` segments are remembered by a worker; beyond it those seen once
    are forgotten.
    """

    memo = 250_000

    def __init__(self, path: str):
        self.tok = load_tokenizer(path)
        self.byte_shown = byte_letters()
        self.rows = _Rows()
        self.pool = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.seen = np.zeros(1 << 14, np.int64)
        self.used = 0

    # -- cutting ---------------------------------------------------------

    def segments(self, text: str) -> list[str]:
        raise NotImplementedError

    def pieces(self, column: pa.Array) -> pa.Array:
        """Space-separated pieces of a string column as a list column."""
        raise NotImplementedError

    def odd(self, names: list[str], index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts have pieces that are no segments (those texts need ``segments``)."""
        return np.zeros(len(bounds) - 1, bool)

    def first_rows(self, row: np.ndarray, first: np.ndarray, names: list[str], index: np.ndarray) -> None:
        """Correct the rows of the texts' first pieces, where those differ."""

    def plain(self, segment: str) -> tuple[str, str] | None:
        """(word, signs) as the model sees them, when both are one piece each."""
        raise NotImplementedError

    def raw(self, segment: str) -> str:
        return segment

    # -- ids -------------------------------------------------------------

    def _ids(self, segments: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        rest: list[int] = []
        piece, plain = self.tok.model.tokenize, self.plain
        signs: dict[str, list[int]] = {"": []}
        for i, s in enumerate(segments):
            p = plain(s)
            if p is None:
                rest.append(i)
                out.append([])
                continue
            word, sign = p
            ids = [t.id for t in piece(word)]
            if sign:
                if sign not in signs:
                    signs[sign] = self.tok.encode(sign, add_special_tokens=False).ids
                ids += signs[sign]
            out.append(ids)
        for lo in range(0, len(rest), 10_000):
            part = rest[lo : lo + 10_000]
            for i, e in zip(part, self.tok.encode_batch([self.raw(segments[i]) for i in part], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def _grown(self, a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(len(a), n - len(a)), a.dtype)])

    def _store_new(self) -> None:
        new, self.rows.new = self.rows.new, []
        have = len(self.rows) - len(new)
        lists = self._ids(new)
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(lens.sum())
        self.pool = self._grown(self.pool, self.used + total)
        self.start, self.length, self.seen = (self._grown(a, len(self.rows)) for a in (self.start, self.length, self.seen))
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(lists), np.int32, total)
        rows = slice(have, len(self.rows))
        self.start[rows] = self.used + np.cumsum(lens) - lens
        self.length[rows] = lens
        self.seen[rows] = 0
        self.used += total

    def _forget(self) -> None:
        n = len(self.rows)
        keep = np.flatnonzero(self.seen[:n] > 1)
        if len(keep) > self.memo // 2:
            keep = keep[:0]
        keys = list(self.rows)
        lens = self.length[keep]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        pool = self.pool[np.repeat(self.start[keep] - (ends - lens), lens) + np.arange(total)]
        self.rows = _Rows()
        self.rows.update((keys[k], i) for i, k in enumerate(keep.tolist()))
        self.pool = self._grown(pool, 1 << 16)
        self.used = total
        self.start, self.length, self.seen = (self._grown(a, 1 << 14) for a in (ends - lens, lens, self.seen[keep] // 2))

    def _gather(self, row: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.rows.new:
            self._store_new()
        n = len(self.rows)
        self.seen[:n] += np.bincount(row, minlength=n)
        lens = self.length[row]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.start[row] - (ends - lens), lens) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and the offsets of the texts into them."""
        if len(self.rows) > self.memo:
            self._forget()
        per_text = [self.segments(t) for t in texts]
        counts = np.fromiter(map(len, per_text), np.int64, len(per_text))
        row = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(per_text)), np.int64, int(counts.sum()))
        return self._gather(row, counts)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for a string column (null: empty); pieces are made distinct before look-up."""
        if len(self.rows) > self.memo:
            self._forget()
        lists = self.pieces(column)
        coded = lists.values.dictionary_encode()
        names = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy()
        row = np.fromiter(map(self.rows.__getitem__, names), np.int64, len(names))[index]
        bounds = lists.offsets.to_numpy().astype(np.int64)
        odd = self.odd(names, index, bounds)
        self.first_rows(row, bounds[:-1], names, index)
        ids, bounds = self._gather(row, np.diff(bounds))
        if not odd.any():
            return ids, bounds
        slow, at = self.encode([t or "" for t in column.filter(pa.array(odd)).to_pylist()])
        parts = [ids[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k, r in enumerate(np.flatnonzero(odd).tolist()):
            parts[r] = slow[at[k] : at[k + 1]]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


class BlankSegments(SegmentTable):
    """For vocabularies that lower-case and drop white space: cut at blanks.

    Lower-casing early for pure ASCII texts, where it is the same, only makes
    more segments equal.
    """

    memo = 600_000

    def segments(self, text: str) -> list[str]:
        if _BLANKS.search(text):
            text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if text.isascii() and "<|" not in text:
            text = text.lower()
        return text.split(" ")

    def pieces(self, column: pa.Array) -> pa.Array:
        data, offsets = text_buffer(column)
        data = (_BLANK_BYTES if b"<|" in data.tobytes() else _LOWER_BYTES)[data]
        # one sign between a letter and a blank is a piece of its own
        sign = _SIGN[data]
        if len(data):
            sign[0] = False
            sign[1:] &= _LETTER[data[:-1]]
            after = np.append(data[1:] == 0x20, True)
            heads = offsets[(offsets > 0) & (offsets < len(data))]
            after[heads - 1] = True
            sign[heads] = False
            sign &= after
        at = np.flatnonzero(sign)
        data = np.insert(data, at, 0x20)
        offsets = (offsets + np.searchsorted(at, offsets, "left")).astype(np.int32)
        texts = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        return pc.split_pattern(texts, " ")

    def plain(self, segment: str) -> tuple[str, str] | None:
        if segment.isascii() and segment.isalpha():
            return segment.lower(), ""
        m = _PLAIN.fullmatch(segment)
        if m is None:
            return None
        word = m[1].lower()
        if not word.isascii():
            word = "".join(map(self.byte_shown.__getitem__, word.encode()))
        return word, m[2]


class SpaceSegments(SegmentTable):
    """For byte-level vocabularies whose pieces carry one leading space.

    A cut before ``" x"`` with ``x`` a letter, digit or printable ASCII sign is
    always a cut of the pre-tokenizer. Segments are kept without that space;
    the first one of a text is marked instead.
    """

    def segments(self, text: str) -> list[str]:
        if _ODD_SPACE.search(text) is None:
            parts = text.split(" ")
            parts[0] = _FIRST + parts[0]
            return parts
        out = [_FIRST]
        for i, p in enumerate(text.split(" ")):
            if i and p and ("!" <= p[0] <= "~" or p[0].isalnum()):
                out.append(p)
            else:
                out[-1] += " " + p if i else p
        return out

    def pieces(self, column: pa.Array) -> pa.Array:
        return pc.split_pattern(pc.fill_null(column, ""), " ")

    def odd(self, names: list[str], index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        strange = np.array([not p or not ("!" <= p[0] <= "~" or p[0].isalnum()) for p in names], bool)
        bad = strange[index] if len(strange) else np.zeros(0, bool)
        bad[bounds[:-1]] = False
        total = np.concatenate([[0], np.cumsum(bad)])
        return total[bounds[1:]] > total[bounds[:-1]]

    def first_rows(self, row: np.ndarray, first: np.ndarray, names: list[str], index: np.ndarray) -> None:
        row[first] = [self.rows[_FIRST + names[i]] for i in index[first].tolist()]

    def plain(self, segment: str) -> tuple[str, str] | None:
        if segment.isascii() and segment.isalpha():
            return self.byte_shown[0x20] + segment, ""
        m = _PLAIN.fullmatch(segment)
        if m is None:
            return None
        word = m[1]
        if not word.isascii():
            word = "".join(map(self.byte_shown.__getitem__, word.encode()))
        return self.byte_shown[0x20] + word, m[2]

    def raw(self, segment: str) -> str:
        return segment[1:] if segment.startswith(_FIRST) else " " + segment


def segment_table(path: str, kind: type[SegmentTable]) -> SegmentTable:
    cache = process_cache("segments")
    if (path, kind.__name__) not in cache:
        cache[path, kind.__name__] = kind(path)
    return cache[path, kind.__name__]
