"""Vectorised word scanning over UTF-8 buffers, shared by the text operators.

Every function works on one *block*: some texts laid end to end in a byte
array, with offsets. Words are maximal runs of word bytes; the separators of
both alphabets below are ASCII, so no UTF-8 sequence is ever cut. Capital
A-Z count as a-z. A word's hash is a polynomial in its bytes modulo 2**64,
finished by a mixer, computed for all words of a block at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20  # bytes worked on at once; a longer text is cut between words

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
    values[65:91] = values[97:123]
    return values


_BYTES = _byte_values()


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(1 << 16, _BASE)  # both grow with the blocks that are met
_INV = _powers(1 << 16, pow(_BASE, -1, 2**64))


def _grown(n: int) -> None:
    global _POW, _INV
    if len(_POW) <= n:
        _POW = _powers(n + (n >> 3), _BASE)
        _INV = _powers(n + (n >> 3), pow(_BASE, -1, 2**64))


def alphabet(kind: str) -> np.ndarray:
    """``blank``: all but space and U+0009-000D. ``alnum``: 0-9, letters, and all beyond ASCII."""
    table = np.ones(256, dtype=bool)
    if kind == "blank":
        table[[32, 9, 10, 11, 12, 13]] = False
    elif kind == "alnum":
        table[:128] = False
        for a, b in (("0", "9"), ("a", "z"), ("A", "Z")):
            table[ord(a) : ord(b) + 1] = True
    else:
        raise ValueError(kind)
    return table


BLANK, ALNUM = alphabet("blank"), alphabet("alnum")


def _scan(buf: np.ndarray, breaks: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(buf)
    if not n:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, np.empty(0, dtype=np.uint64)
    _grown(n)
    word = table[buf]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = breaks[(breaks > 0) & (breaks < n)]
    inner = inner[word[inner] & word[inner - 1]]
    starts[inner], ends[inner - 1] = True, True
    at, to = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[buf] * _POW[:n], out=sums[1:])
    return at, to, mix((sums[to] - sums[at]) * _INV[at])


class Words:
    """Words of a block. ``first[i]:first[i+1]`` are those of text i; ``at``/``to`` are byte places in the block."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        parts, lo, n = [], 0, len(buf)
        while lo < n:
            hi = min(n, lo + BLOCK)
            if hi < n:  # cut just behind the last separator, or else behind the next
                blank = np.flatnonzero(~table[buf[lo:hi]])
                while not len(blank) and hi < n:
                    was, hi = hi, min(n, hi + BLOCK)
                    blank = np.flatnonzero(~table[buf[was:hi]]) + (was - lo)
                hi = lo + int(blank[-1]) + 1 if len(blank) else n
            at, to, h = _scan(buf[lo:hi], offsets - lo, table)
            parts.append((at + lo, to + lo, h))
            lo = hi
        if len(parts) == 1:
            self.at, self.to, self.hash = parts[0]
        else:
            cat = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else _scan(buf, offsets, table)
            self.at, self.to, self.hash = cat
        self.first = np.searchsorted(self.at, offsets)

    def __len__(self) -> int:
        return len(self.at)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty. No copy is made unless the column has nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if off else np.zeros(1, dtype=np.int64)
    offsets = offsets.astype(np.int64) if len(offsets) else np.zeros(1, dtype=np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return buf, offsets - offsets[0]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``size`` bytes; a longer text stands alone."""
    buf, offsets = utf8(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        j = min(j, n, i + 65536)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_SHINGLE = [_U(x | 1) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2127599BF4325C37, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x94D049BB133111EB)]


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values, by their first place."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += h[j : j + n] * (_SHINGLE[j] if j < len(_SHINGLE) else _SHINGLE[j % 13] * _U(2 * j + 1))
    return mix(out + _U(k))


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingles; all words as one where there are fewer than k; none without words."""
    rolled = rolling(words.hash, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = rolling(words.hash[a:b], b - a)
        else:
            s = np.empty(0, dtype=np.uint64)
        out.append(s)
    return out
