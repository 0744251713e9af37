"""CRC-32 (zlib's) of many byte spans at once."""

from __future__ import annotations

import zlib

import numpy as np

from .common import process_cache

_POLYNOMIAL = 0xEDB88320
_DIRECT = 64  # lengths with a table of their own; longer ones are composed of powers of two


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0)) ^ (c >> np.uint32(1))
    return c


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte table, shift by 0..64 zero bytes, shift by 2^0..2^31 zero bytes); shifts as [n, byte place, byte]."""
    cache = process_cache("crc")
    if not cache:
        one = _byte_table()
        shift = np.empty((_DIRECT + 1, 4, 256), np.uint32)
        shift[0] = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
        for n in range(_DIRECT):
            shift[n + 1] = one[shift[n] & np.uint32(255)] ^ (shift[n] >> np.uint32(8))
        double = np.empty((32, 4, 256), np.uint32)
        double[0] = shift[1]
        for j in range(31):
            double[j + 1] = _apply(double[j], double[j])
        cache["all"] = one, shift, double
    return cache["all"]


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    byte = [(crc >> np.uint32(8 * p)) & np.uint32(255) for p in range(4)]
    return table[0][byte[0]] ^ table[1][byte[1]] ^ table[2][byte[2]] ^ table[3][byte[3]]


def append_byte(crc: np.ndarray, byte: int) -> np.ndarray:
    """CRCs after one more byte."""
    one, _, _ = _tables()
    c = ~crc
    return ~(one[(c ^ np.uint32(byte)) & np.uint32(255)] ^ (c >> np.uint32(8)))


def joined(left: np.ndarray, right: np.ndarray, right_length: np.ndarray) -> np.ndarray:
    """CRCs of left + right from the CRCs of both and the length of the right."""
    _, shift, double = _tables()
    n = np.minimum(right_length, _DIRECT)
    flat = shift.reshape(-1)
    base = n * 1024
    moved = flat[base + (left & np.uint32(255))]
    for p in (1, 2, 3):
        moved ^= flat[base + 256 * p + ((left >> np.uint32(8 * p)) & np.uint32(255))]
    far = np.flatnonzero(right_length > _DIRECT)
    for i in far.tolist():  # words of more than 64 bytes
        c, rest = left[i : i + 1], int(right_length[i])
        for j in range(rest.bit_length()):
            if rest >> j & 1:
                c = _apply(double[j], c)
        moved[i] = c[0]
    return moved ^ right


def span_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRCs of ``data[start:end]`` for many spans."""
    one, _, _ = _tables()
    length = end - start
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    live = np.flatnonzero(length <= _DIRECT)
    k = 0
    while True:
        live = live[length[live] > k]
        if not len(live):
            break
        c = crc[live]
        crc[live] = one[(c ^ data[start[live] + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
        k += 1
    crc = ~crc
    for i in np.flatnonzero(length > _DIRECT).tolist():
        crc[i] = zlib.crc32(data[start[i] : end[i]])
    return crc
