"""Word scanning over the UTF-8 bytes of Arrow text columns.

Separators of every word definition used here are ASCII, so words can be cut in the bytes without decoding.
All arrays are per block (about a megabyte of text), so a task's memory does not depend on the table or on the
size of an Arrow batch; a single text longer than a block is scanned in pieces cut after a separator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

#: words ``[^\x20\x09-\x0D]+``
PLAIN = np.ones(256, bool)
PLAIN[[9, 10, 11, 12, 13, 32]] = False
#: words of letters, digits and non-ASCII characters, after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """``base ** 0 .. base ** (n-1)`` modulo 2**64; those of the default base are kept."""
    global _powers
    if base != _BASE:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)
    if len(_powers) < n:
        out = np.full(2 * n, base, np.uint64)
        out[0] = 1
        _powers = np.cumprod(out, dtype=np.uint64)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bit mixing of 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8), at.astype(np.int64)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo:hi`` of a text column with their bytes and offsets from 0, at most ``limit`` bytes unless one text is longer."""
    data, at = texts(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """Words of a block: byte ranges, document number and a 64-bit hash each; ``first[d]:first[d+1]`` are those of document d."""

    __slots__ = ("start", "end", "doc", "hash", "first")

    def __init__(self, start, end, doc, hash_, first):
        self.start, self.end, self.doc, self.hash, self.first = start, end, doc, hash_, first


def _scan(buf: np.ndarray, cuts: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = word[buf]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    inner = cuts[(cuts > 0) & (cuts < len(buf))]
    begins[inner] = inside[inner]
    ends[inner - 1] = inside[inner - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    size = end - start
    head = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=head[1:])
    place = np.arange(int(size.sum()), dtype=np.int64)
    place -= np.repeat(head, size)
    value = _BYTE[buf[inside]]
    value *= powers(int(size.max()))[place]
    return start, end, mix(np.add.reduceat(value, head))


def scan(buf: np.ndarray, at: np.ndarray, word: np.ndarray, piece: int = 4 * BLOCK_BYTES) -> Words:
    """Words of the documents ``buf[at[d]:at[d+1]]``."""
    if len(buf) <= piece:
        start, end, h = _scan(buf, at, word)
    else:
        found, lo = [], 0
        while lo < len(buf):
            hi = min(lo + piece, len(buf))
            if hi < len(buf):
                gap = np.flatnonzero(~word[buf[lo:hi]])
                while not len(gap) and hi < len(buf):  # one word longer than a piece
                    step = buf[hi : hi + piece]
                    gap = np.flatnonzero(~word[step]) + (hi - lo)
                    hi = min(hi + piece, len(buf))
                    if len(gap):
                        gap = gap[:1]
                if len(gap):
                    hi = lo + int(gap[-1]) + 1
            s, e, h = _scan(buf[lo:hi], at - lo, word)
            found.append((s + lo, e + lo, h))
            lo = hi
        start, end, h = (np.concatenate(x) for x in zip(*found, strict=True))
    first = np.searchsorted(start, at)
    first[-1] = len(start)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(start, end, doc, h, first)


def windows(words: Words, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the first words of all ``k``-word windows inside one document, and a 64-bit hash of each window."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    base = np.uint64((0xD6E8FEB86659FD93 + 2 * salt) | 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= base
        h += words.hash[j : j + n]
    at = np.flatnonzero(words.doc[:n] == words.doc[k - 1 : k - 1 + n])
    return at, mix(h[at])


def digests(words: Words, base: np.uint64 = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have words, and a 64-bit hash of the word sequence of each."""
    size = np.diff(words.first)
    doc = np.flatnonzero(size)
    if not len(doc):
        return doc, np.zeros(0, np.uint64)
    place = np.arange(len(words.hash)) - words.first[words.doc]
    sums = np.add.reduceat(words.hash * powers(int(size.max()), base)[place], words.first[doc])
    return doc, mix(sums + size[doc].astype(np.uint64))
