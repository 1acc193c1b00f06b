"""Words of many texts at once, as 64-bit hashes, straight from Arrow's UTF-8 buffers.

A word's hash is a polynomial over its bytes (each byte stands for a random 64-bit number),
taken as a difference of running sums, so a batch of texts costs a few numpy passes and no
Python step per word. Equal words have equal hashes in every batch, task and run; different
words share a hash with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PIECE = 1 << 18
_U = np.uint64
_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = []

_LOWER = np.arange(256)
_LOWER[65:91] += 32
LOWERED = _BYTE[_LOWER]
AS_IS = _BYTE


def class_of(separators: set[int]) -> np.ndarray:
    """Which byte values belong to words."""
    inside = np.ones(256, dtype=bool)
    inside[sorted(separators)] = False
    return inside


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = class_of({0x20, *range(0x09, 0x0E)})
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased (so A-Z belong to words here)
ALNUM = class_of({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (a finaliser: every input bit reaches every output bit)."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n, and their inverses modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, _PIECE + 1)
        _powers[:] = [np.cumprod(np.concatenate(([_U(1)], np.full(size - 1, b, dtype=np.uint64)))) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, dtype=np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)), offsets


def _pieces(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Byte ranges of about _PIECE that never end within a word."""
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(lo + _PIECE, end)
        if hi < end:
            doc = int(np.searchsorted(offsets, hi, "right")) - 1
            if offsets[doc] > lo:
                hi = int(offsets[doc])
            elif len(gaps := np.flatnonzero(~inside[data[lo:hi]])):
                hi = lo + int(gaps[-1]) + 1
            else:
                stop = int(offsets[doc + 1])
                more = np.flatnonzero(~inside[data[hi:stop]])
                hi = hi + int(more[0]) + 1 if len(more) else stop
        yield lo, hi
        lo = hi


class Words:
    """``hashes`` of all words in order; text i has those from ``first[i]`` to ``first[i + 1]``.

    ``prefixes[k]``: hash of each word's first k bytes, 0 for shorter words. ``begin`` and ``end``:
    where each word's bytes lie, if asked for.
    """

    def __init__(self, column, inside: np.ndarray, table: np.ndarray = LOWERED, prefixes: tuple[int, ...] = (), places: bool = False):
        data, offsets = utf8(column)
        n = len(offsets) - 1
        self.first = np.full(n + 1, -1, dtype=np.int64)
        total, found, begin, end = 0, [], [], []
        heads: dict[int, list[np.ndarray]] = {k: [] for k in prefixes}
        for lo, hi in _pieces(data, offsets, inside):
            piece = data[lo:hi]
            word = inside[piece]
            a, b = np.searchsorted(offsets[:-1], (lo, hi))
            cut = offsets[a:b] - lo
            starts, ends = word.copy(), word.copy()
            starts[1:] &= ~word[:-1]
            ends[:-1] &= ~word[1:]
            inner = cut[(cut > 0) & (cut < hi - lo)]
            starts[inner] = word[inner]
            ends[inner - 1] = word[inner - 1]
            s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
            up, down = powers(hi - lo)
            run = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(table[piece] * up[: hi - lo], out=run[1:])
            found.append(mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64)))
            for k, out in heads.items():
                stop = s + k
                long = stop <= e
                head = np.zeros(len(s), dtype=np.uint64)
                head[long] = mix((run[stop[long]] - run[s[long]]) * down[s[long]] + _U(k << 32))
                out.append(head)
            if places:
                begin.append(s + lo)
                end.append(e + lo)
            self.first[a:b] = np.searchsorted(s, cut) + total
            total += len(s)
        self.first[self.first < 0] = total
        self.hashes = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
        self.prefixes = {k: np.concatenate(v) if v else np.zeros(0, dtype=np.uint64) for k, v in heads.items()}
        self.data = data
        self.begin, self.end = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (begin, end))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def sequence_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row (len(words) - k + 1 of them, at least none)."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(m, _U(k), dtype=np.uint64)
    for i in range(k):
        out += words[i : i + m] * _STEP[i]
    return mix(out)


class HashTable:
    """Fixed set of 64-bit keys with small values, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray | None = None):
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.values = (np.arange(len(keys)) if values is None else values)[order]
        bits = max(10, int(np.ceil(np.log2(max(1, len(keys))))) + 4)
        self.mask = _U((1 << bits) - 1)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[(self.keys & self.mask).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``keys`` that are in the table, and their values."""
        maybe = np.flatnonzero(self.seen[(keys & self.mask).astype(np.int64)])
        if not len(maybe) or not len(self.keys):
            return np.zeros(0, dtype=np.int64), self.values[:0]
        at = np.searchsorted(self.keys, keys[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys[maybe]
        return maybe[hit], self.values[at[hit]]
