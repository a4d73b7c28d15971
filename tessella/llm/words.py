"""Vectorised word and shingle hashing over Arrow string columns.

Words are runs of bytes outside ``0x20 0x09-0x0D`` of the UTF-8 text with A-Z in
lower case. A word's hash is a polynomial in its bytes modulo 2**64, taken as the
difference of two prefix sums, so a whole block of texts is hashed with a few numpy
passes. Two different words (or shingles) share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text hashed at once; longer texts go in several blocks.
BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = mix((_LOWER.astype(U) + U(1)) * U(0xD1342543DE82EF95))
_COEF = [U(int(mix(np.array([k + 77], U))[0]) | 1) for k in range(5)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_R, BLOCK + 1), _powers(_RINV, BLOCK + 1)


def _block(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and raw hash of the words of at most BLOCK bytes; no word spans a text start."""
    n = len(buf)
    total = np.empty(n + 1, U)
    total[0] = 0
    np.cumsum(_BYTE[buf] * _POW[:n], out=total[1:])
    word = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[starts[starts <= n]] = True
    edge[0] = edge[n] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, (total[e] - total[s]) * _INV[s]


def _finish(raw: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(raw + length.astype(U) * U(0xA0761D6478BD642F))


def _long(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like _block for one text of any length: a word that spans blocks is put together."""
    ss, ee, hh = [], [], []
    for at in range(0, len(buf), BLOCK):
        s, e, h = _block(buf[at : at + BLOCK], np.zeros(1, int))
        s, e = s + at, e + at
        if len(s) and ee and len(ee[-1]) and ee[-1][-1] == at == s[0]:
            hh[-1][-1:] += h[:1] * U(pow(_R, int(ee[-1][-1] - ss[-1][-1]), 1 << 64))
            ee[-1][-1] = e[0]
            s, e, h = s[1:], e[1:], h[1:]
        if len(s):
            ss.append(s), ee.append(e), hh.append(h)
    if not ss:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, U)
    return np.concatenate(ss), np.concatenate(ee), np.concatenate(hh)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: its index, and start byte, end byte and hash of each of its words."""
    data, off = buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = i + 1
        while j < n and off[j + 1] - off[i] <= BLOCK:
            j += 1
        part, base = data[off[i] : off[j]], off[i]
        if j == i + 1:
            s, e, h = _long(part)
        else:
            s, e, h = _block(part, (off[i:j] - base))
        h = _finish(h, e - s)
        cut = np.searchsorted(s, off[i : j + 1] - base)
        for k in range(i, j):
            a, b = cut[k - i], cut[k - i + 1]
            yield k, s[a:b] + (base - off[k]), e[a:b] + (base - off[k]), h[a:b]
        i = j


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles in order; of fewer words the whole sequence is one."""
    n = len(h)
    if n == 0:
        return h
    m = max(1, n - k + 1)
    out = np.zeros(m, U)
    for j in range(min(k, n)):
        out += h[j : j + m] * _COEF[j]
    return mix(out + U(min(n, k)))


def shingle_set(h: np.ndarray, k: int = 5) -> np.ndarray:
    """The distinct shingles in ascending order of hash."""
    s = np.sort(shingles(h, k))
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s
