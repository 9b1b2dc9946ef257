"""Vectorised word and window hashing over the UTF-8 buffers of Arrow columns.

Words are found with a 256-entry byte table, so a class of word characters may
hold any ASCII bytes and all or none of the bytes from 0x80 up. A word's hash
is a sum of random 64-bit byte values times powers of an odd constant, read off
prefix sums; blocks of bytes bound the working memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BLOCK = 1 << 19
_LONG = 1 << 16


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, in place."""
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_POW = _powers(_BASE, _BLOCK + _LONG + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), _BLOCK + _LONG + 1)
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_STEP = _U(0xA24BAED4963EE407)
_STEP2 = _U(0x9FB21C651E98DF25)
#: A second set of values, for hashes that must tell apart what the first ones do not.
_BYTE2 = mix(np.arange(1001, 1257, dtype=_U) * _U(0x8CB92BA72F3D8DD7))

#: Lower case for A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words after LOWER: digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words that white space (0x20, 0x09-0x0D) parts.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is read as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    b = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def row_slices(offs: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together, or of one longer row."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def find_words(buf: np.ndarray, offs: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each row's place in that list (rows + 1 entries)."""
    w = chars[buf]
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    first = w.copy()
    first[1:] &= ~w[:-1]
    heads = offs[:-1][offs[:-1] < len(w)]
    first[heads] = w[heads]
    last = w.copy()
    last[:-1] &= ~w[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    last[tails] = w[tails]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, offs)


def hash_words(buf: np.ndarray, s: np.ndarray, e: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same on every machine; ``second`` gives another one."""
    values = _BYTE2 if second else _BYTE
    out = np.empty(len(s), dtype=_U)
    i = 0
    while i < len(s):
        at = int(s[i])
        j = max(i + 1, int(np.searchsorted(s, at + _BLOCK, side="left")))
        short = e[i:j] - s[i:j] <= _LONG
        end = min(int(e[j - 1]), at + _BLOCK + _LONG)
        c = np.zeros(end - at + 1, dtype=_U)
        np.cumsum(values[buf[at:end]] * _POW[: end - at], out=c[1:])
        a, b = s[i:j] - at, np.minimum(e[i:j] - at, end - at)
        out[i:j] = (c[b] - c[a]) * _INV[a]
        for k in np.flatnonzero(~short) + i:
            out[k] = int.from_bytes(blake2b(buf[s[k] : e[k]].tobytes(), digest_size=8, person=b"second" if second else b"").digest(), "little")
        i = j
    return mix(out)


def hash_windows(words: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words; runs may cross rows, see ``inside``."""
    step = _STEP2 if second else _STEP
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=_U)
    h = words[:m].copy()
    for k in range(1, n):
        h *= step
        h += words[k : k + m]
    return mix(h)


def inside(places: np.ndarray, n: int) -> np.ndarray:
    """Which runs of ``n`` words lie within one row, as a mask over ``hash_windows``."""
    total = int(places[-1])
    ok = np.ones(max(0, total - n + 1), dtype=bool)
    for back in range(1, n):
        cut = places[1:-1] - back
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    # rows shorter than n let several boundaries fall in one run; each is marked above
    return ok
