"""Vectorised text kernels shared by the text operators of this subpackage.

Everything here works on one Arrow batch inside a task: Spark decides which rows meet in which task,
these helpers only turn the bytes of a few megabytes of text into word and shingle hashes.

Words are the runs of ``[^\\x20\\x09-\\x0D]`` of the UTF-8 bytes with A-Z lower-cased.  A shingle is five
consecutive words; a text of one to four words is one shingle by itself, a text without words has none.
Shingles are 64-bit hashes: two different shingles of a corpus of a billion shingles agree with a
probability of about 3 %, and even then only a pair that holds both would be off by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
#: Bytes of text that are turned into hashes at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {"p": np.ones(1, dtype=_U), "i": np.ones(1, dtype=_U)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the public splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_BYTE_LOWER = _BYTE[_LOWER]
_PLACE = mix64(np.arange(11, 11 + SHINGLE_WORDS, dtype=_U)) | _U(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, from 0 to n."""
    if len(_powers["p"]) <= n:
        m = max(n + 1, SLICE_BYTES + 65536)
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("p", _BASE), ("i", inverse)):
            a = np.full(m, base, dtype=_U)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["p"][: n + 1], _powers["i"][: n + 1]


def prefix_hash(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """c with c[j] - c[i] times the inverse power i being the hash of bytes i to j."""
    p, _ = powers(len(buf))
    c = np.zeros(len(buf) + 1, dtype=_U)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * p[: len(buf)], out=c[1:])
    return c


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column end to end, and where each begins (one entry more than texts). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    if not len(offsets):
        return buf[:0], np.zeros(1, dtype=np.int64)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the index of each text's first word (one entry more than texts)."""
    solid = ~_SPACE[buf]
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | cut[1:-1]
    b = np.flatnonzero(begins)
    return b, np.flatnonzero(ends) + 1, np.searchsorted(b, offsets)


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of every word, and the index of each text's first word."""
    b, e, first = word_spans(buf, offsets)
    if not len(b):
        return np.zeros(0, dtype=_U), b, e, first
    c = prefix_hash(buf, lower=True)
    _, inverse = powers(len(buf))
    return mix64((c[e] - c[b]) * inverse[b] + (e - b).astype(_U)), b, e, first


def shingle_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle in text order with repeats, and the index of each text's first shingle."""
    counts = np.diff(first)
    n_shingles = np.where(counts >= SHINGLE_WORDS, counts - SHINGLE_WORDS + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(n_shingles)])
    out = np.empty(int(starts[-1]), dtype=_U)
    n = len(words)
    if n >= SHINGLE_WORDS:
        acc = words[: n - SHINGLE_WORDS + 1] * _PLACE[0]
        for j in range(1, SHINGLE_WORDS):
            acc += words[j : n - SHINGLE_WORDS + 1 + j] * _PLACE[j]
        acc = mix64(acc)
        long = counts >= SHINGLE_WORDS
        take = np.repeat(first[:-1] - starts[:-1], n_shingles) + np.arange(len(out))
        keep = np.repeat(long, n_shingles)
        out[keep] = acc[take[keep]]
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS)):
        w = words[first[i] : first[i + 1]]
        out[starts[i]] = mix64((w * _PLACE[: len(w)]).sum(dtype=_U, keepdims=True) + _U(len(w)))[0]
    return out, starts


def distinct_shingles(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of a column in order: the distinct sorted shingles of each text end to end, and where each text's begin."""
    buf, offsets = utf8(column)
    for i, j in slices(offsets):
        at = offsets[i : j + 1]
        words, _, _, first = word_hashes(buf[at[0] : at[-1]], at - at[0])
        flat, starts = shingle_hashes(words, first)
        for k in range(j - i):
            flat[starts[k] : starts[k + 1]].sort()
        fresh = np.ones(len(flat), dtype=bool)
        fresh[1:] = flat[1:] != flat[:-1]
        fresh[starts[:-1][starts[:-1] < len(flat)]] = True
        seen = np.concatenate([[0], np.cumsum(fresh)])
        yield flat[fresh], seen[starts]


def set_signatures(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set (0 for the empty set)."""
    sizes = np.diff(starts)
    full = sizes > 0
    out = np.zeros(len(sizes), dtype=_U)
    if full.any():
        out[full] = mix64(np.add.reduceat(mix64(flat ^ _U(0x452821E638D01377)), starts[:-1][full]) + sizes[full].astype(_U))
    return out.view(np.int64)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text of a column its distinct shingles, sorted."""
    for flat, starts in distinct_shingles(column):
        for k in range(len(starts) - 1):
            yield flat[starts[k] : starts[k + 1]]
