"""Vectorised word hashing over Arrow string buffers.

Words are maximal runs of bytes other than space and \\x09-\\x0D, so `[^\\x20\\x09-\\x0D]+` over UTF-8. A word's hash
is a polynomial in 2^64 over random byte values, mixed; it is a function of the word's bytes alone, the same in every
batch, process and run. All of it is numpy over whole buffers: a few nanoseconds for each byte, and no Python object
for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are handled in slices of about so many bytes (one longer text: alone), which bounds a worker's memory.
SLICE_BYTES = 1 << 20
BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so that powers have inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which near inputs part."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


_BYTE = stream(256, 11)
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
#: Of a second hash that shares nothing with the first: byte values and bases. Both together are 128 bits.
_BYTE_2, BASE_2, WORD_BASE_2 = stream(256, 31), 0xA24BAED4963EE407, 0x9FB21C651E98DF25
_pow: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; the longest so far is kept."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, SLICE_BYTES * 2), U)
        have[1:] = U(base)
        np.multiply.accumulate(have, out=have)
        _pow[base] = have
    return have[:n]


class Words:
    """The words of some texts: hashes, byte bounds in buf, and first[i]:first[i+1], the words of text i."""

    __slots__ = ("buf", "start", "end", "first", "hash", "of")

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, lower: bool, values: bool = True) -> None:
        n = len(buf)
        self.buf = buf
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash, self.first = np.zeros(0, U), np.zeros(len(bounds), np.int64)
            return
        word = ~_SEP[buf]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        left, right = np.ones(n, bool), np.ones(n, bool)
        np.logical_not(word[:-1], out=left[1:])
        np.logical_not(word[1:], out=right[:-1])
        left |= edge[:n]
        right |= edge[1:]
        self.start, self.end = np.flatnonzero(word & left), np.flatnonzero(word & right) + 1
        self.first = np.searchsorted(self.start, bounds)
        if values:
            self.hash = self.spans(self.start, self.end, lower)

    def spans(self, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
        """Hashes of byte spans of buf."""
        return self._spans(start, end, _BYTE_LOWER if lower else _BYTE, BASE)

    def second(self) -> np.ndarray:
        """Of each word as it stands a second hash."""
        return self._spans(self.start, self.end, _BYTE_2, BASE_2)

    def _spans(self, start: np.ndarray, end: np.ndarray, values: np.ndarray, base: int) -> np.ndarray:
        total = np.zeros(len(self.buf) + 1, U)
        np.cumsum(values[self.buf] * powers(base, len(self.buf)), out=total[1:])
        h = (total[end] - total[start]) * powers(pow(base, -1, 1 << 64), len(self.buf) + 1)[start]
        return mix(h + (end - start).astype(U))

    def owners(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds in them) of slices of a string column; nulls have no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def grams(h: np.ndarray, first: np.ndarray, n: int, base: int = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words within one text, and the position of each run's first word."""
    m = len(h)
    if m < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.zeros(m + 1, U)
    np.cumsum(h * powers(base, m), out=total[1:])
    at = starts(first, n)
    return mix((total[at + n] - total[at]) * powers(pow(base, -1, 1 << 64), m)[at] + U(n)), at


def starts(first: np.ndarray, n: int) -> np.ndarray:
    """Positions at which a run of n words of one text starts."""
    ok = np.ones(int(first[-1]), bool)
    for back in range(1, n):  # the last n-1 words of each text start none
        at = first[1:] - back
        ok[at[at >= first[:-1]]] = False
    return np.flatnonzero(ok)




def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values: two running minima over blocks of w."""
    n = len(x)
    if n < w:
        return np.zeros(0, x.dtype)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
