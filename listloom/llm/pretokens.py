"""Pre-tokens of many texts at once, and caches of what a tokenizer makes of them.

A byte-level BPE tokenizer first cuts a text into pre-tokens and then encodes each alone, so
equal pre-tokens have equal ids. Texts are cut here in numpy over code points; each distinct
pre-token is encoded by the tokenizer's own library once a worker.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from .text import _BYTE, mix, powers

LETTER, NUMBER, OTHER, SPACE, UNSURE = range(5)
_RNG = np.random.default_rng(0xB9E)
_POINT = _RNG.integers(1, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_classes: list[np.ndarray] = []
#: Code points of a text handled at a time.
PIECE = 1 << 20


def classes() -> np.ndarray:
    """Class of each code point below 2**16. Those whose class a tokenizer's Unicode tables might
    see otherwise (assigned or changed after version 3.2, or other white space) are UNSURE."""
    if not _classes:
        old, out = unicodedata.ucd_3_2_0, np.full(1 << 16, UNSURE, dtype=np.uint8)
        for point in range(1 << 16):
            kind = unicodedata.category(chr(point))
            if kind == old.category(chr(point)) and kind not in ("Cn", "Cs", "Zs", "Zl", "Zp") and point != 0x85:
                out[point] = {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
        out[[9, 10, 11, 12, 13, 32]] = SPACE
        _classes.append(out)
    return _classes[0]


def cut(points: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, for texts that lie end to end; ``heads``: where non-empty texts begin.

    The rule (that of byte-level BPE): an English contraction's end, or a run of letters, of
    numbers or of other characters with one space before it; white space gives its last
    character to what follows if that is a space, and stands alone if not.
    """
    n = len(points)
    kind = classes()[points]
    change = np.ones(n, dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    head = np.zeros(n + 1, dtype=bool)
    head[heads] = True
    head[n] = True
    change |= head[:n]
    blank = kind == SPACE
    begin = change & blank
    spaced = np.zeros(n, dtype=bool)
    spaced[1:] = (points[:-1] == 32) & ~head[1:n]
    solid = np.flatnonzero(change & ~blank)
    begin[solid[~spaced[solid]]] = True
    after = solid[(solid > 0) & ~head[solid]]
    after = after[blank[after - 1]]
    begin[after - 1] = True
    quote = np.flatnonzero((points == 39) & begin)
    if len(quote):
        near = np.concatenate((points, np.zeros(3, dtype=points.dtype)))
        inside = np.concatenate((head, np.ones(3, dtype=bool)))
        quote = quote[~inside[quote + 1]]
        one, two = near[quote + 1], np.where(inside[quote + 2], 0, near[quote + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for at, size in ((quote[short], 2), (quote[long], 3)):
            begin[at + 1] = False
            rest = at + size
            rest = rest[(rest < n)]
            # a space that the next word takes along has been marked already
            begin[rest[~blank[rest]]] = True
    return np.flatnonzero(begin)


def point_hashes(points: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hash of each pre-token's code points."""
    up, down = powers(len(points))
    run = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(_POINT[points] * up[: len(points)], out=run[1:])
    end = np.append(begin[1:], len(points))
    return mix((run[end] - run[begin]) * down[begin] + (end - begin).astype(np.uint64))


def byte_hashes(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hash of each piece of ``data`` from one beginning to the next."""
    up, down = powers(len(data))
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=run[1:])
    end = np.append(begin[1:], len(data))
    return mix((run[end] - run[begin]) * down[begin] + (end - begin).astype(np.uint64))


class Slots:
    """A table with one slot for each value of a hash's last bits: compact, and looked up by arrays."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.zeros(1 << bits, dtype=np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = (keys & self.mask).astype(np.int64)
        self.keys[at], self.values[at] = keys, values

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, which of them are right)."""
        at = (keys & self.mask).astype(np.int64)
        return self.values[at], self.keys[at] == keys


class Cache:
    """What ``make`` gives for pre-tokens (a number each), by hash: slots first, then a dictionary."""

    def __init__(self, make: Callable[[list], list[int]], bits: int = 18, most: int = 250_000):
        self.make, self.most = make, most
        self.slots, self.all = Slots(bits), {}

    def get(self, hashes: np.ndarray, texts: Callable[[np.ndarray], list]) -> np.ndarray:
        """``texts(positions)``: the pre-tokens at these positions."""
        values, right = self.slots.get(hashes)
        if len(miss := np.flatnonzero(~right)):
            keys, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            known = [self.all.get(k) for k in keys.tolist()]
            new = [i for i, v in enumerate(known) if v is None]
            if new:
                if self.all and len(self.all) + len(new) > self.most:
                    self.forget()
                    return self.get(hashes, texts)
                made = self.make(texts(miss[first[new]]))
                for i, v in zip(new, made):
                    known[i] = v
                self.all.update(zip(keys[new].tolist(), made))
            found = np.array(known, dtype=np.int64)
            self.slots.put(keys, found)
            values = values.copy()
            values[miss] = found[back]
        return values

    def forget(self) -> None:
        self.all = {}
