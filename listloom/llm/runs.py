"""Periodic runs of words: passages that repeat themselves back to back (operator 11).

A run is a stretch of words with smallest period q (words q apart are equal), at least
``max(least, 2 * q)`` words long, which no neighbouring word extends with that period.

The search is a sparse dynamic program over diagonals: the match length of lag q at word i is one
more than at word i - 1 if words i and i - q are equal, else nothing. Only lags that an earlier
occurrence of what begins at i proposes are ever touched; a diagonal that is not lengthened ends
there, and is emitted at once if it has become long enough.

* What is looked up is not the single word, which would propose every lag of every common word, but
  the shortest sequence every run of that lag must repeat: ``ceil(least / 2)`` words for short lags,
  m words for the lags from m to 2 m - 1, with m doubling from level to level. A level's sequences are
  pairs of the level before, so only what occurred twice there is looked at again.
* Inside a run of a short period each sequence has occurred at every multiple of the period. These
  multiples are no smallest periods and are skipped; where the same short-period passage stands in two places
  a diagonal between them grows by the whole passage at once. A word then proposes a handful
  of lags a level, so a text of n words takes about n log n steps whatever it holds.

Words are compared by 64-bit hashes (``text.Words``). Documents never share rows of one task's work:
all stay where they lie, there is no shuffle.

Results: a null or empty text and one without words have no runs and '' as collapsed text. A text of
any length is one unit (about 200 bytes of memory a word). Equal rows give equal rows. An empty table
gives an empty result. Other columns are carried along; those named like an added one are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import append
from .text import AS_IS, NOT_SPACE, Words, sequence_hash

LEAST = 12
#: ``text.sequence_hash`` hashes sequences of up to so many words.
LONGEST_SEQUENCE = 64
ADDED = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo..hi - 1, and which range each is from."""
    n = np.maximum(hi - lo, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + lo[owner], owner


def _classes(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``at`` whose key occurs more than once, by class and position; and their class numbers."""
    if not len(at):
        return at, at
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    repeated = np.concatenate((same, [False])) | np.concatenate(([False], same))
    number = np.cumsum(np.concatenate(([True], ~same)))[repeated]
    dense = np.cumsum(np.concatenate(([0], number[1:] != number[:-1]))) if len(number) else number
    return at[order[repeated]], dense


def _lengthened(at: np.ndarray, kind: np.ndarray, n: int, m: int, lags: tuple[int, int], known: np.ndarray) -> np.ndarray:
    """Rows (lag, first, last): on the diagonal of that lag, the sequences beginning at first..last match.

    ``at`` holds the places of repeated sequences of m words, ``kind`` their classes. ``known`` are the
    runs (start, end, period) that hold such a sequence twice over: one place lies in one of them at most.
    """
    home = np.full(n, -1, dtype=np.int64)
    inside, owner = _ranges(known[:, 0], known[:, 1] - m + 1)
    home[inside] = owner
    key = kind * (n + 1) + at
    at_home = home[at]
    free = at_home < 0
    last = np.zeros(len(at), dtype=bool)
    last[~free] = at[~free] == known[at_home[~free], 1] - m

    ask = np.flatnonzero(free | last)
    before, who = _ranges(np.searchsorted(key, kind[ask] * (n + 1) + np.maximum(at[ask] - lags[1], 0)), np.searchsorted(key, kind[ask] * (n + 1) + at[ask] - lags[0], "right"))
    late, early = ask[who], before
    if len(ends := np.flatnonzero(last)):
        after, who = _ranges(np.searchsorted(key, kind[ends] * (n + 1) + at[ends] + lags[0]), np.searchsorted(key, kind[ends] * (n + 1) + np.minimum(at[ends] + lags[1], n - 1), "right"))
        late, early = np.concatenate((late, after)), np.concatenate((early, ends[who]))
    # late and early have one class, so both lie in a short-period run or neither does
    apart = (at_home[late] < 0) | (at_home[late] != at_home[early])
    late, early = late[apart], early[apart]
    lag, first = at[late] - at[early], at[late].copy()
    whole = at_home[late] >= 0
    first[whole] = np.maximum(known[at_home[late[whole]], 0], known[at_home[early[whole]], 0] + lag[whole])
    return np.stack((lag, first, at[late]), axis=1)


def _ended(grown: np.ndarray, m: int, least: int) -> np.ndarray:
    """Diagonals made of all their pieces; (start, end, period) of those long enough."""
    grown = grown[np.lexsort((grown[:, 1], grown[:, 0]))]
    lag, first, last = grown.T
    begins = np.concatenate(([True], (lag[1:] != lag[:-1]) | (first[1:] > last[:-1] + 1)))
    head = np.flatnonzero(begins)
    end = last[np.append(head[1:], len(grown)) - 1] + m
    start, period = first[head] - lag[head], lag[head]
    long = end - start >= np.maximum(least, 2 * period)
    return np.stack((start[long], end[long], period[long]), axis=1)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """One row a stretch, that of its smallest period; by start, then period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):
        runs = runs[np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)))]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of several texts, by start and period.

    ``words`` are the texts' word hashes in a row; text t has those from ``first[t]`` to ``first[t + 1]``.
    """
    n = len(words)
    found = np.zeros((0, 3), dtype=np.int64)
    m = min(max(1, (least + 1) // 2), LONGEST_SEQUENCE)
    if n < least:
        return found
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(n - m + 1)
    at = at[text[at] == text[at + m - 1]]
    salted = sequence_hash(words, m)[at] + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, kind = _classes(salted, at)
    lags = (1, 2 * m - 1)
    while len(at):
        known = found[(2 * found[:, 2] <= m) & (found[:, 1] - found[:, 0] >= m)] if m >= least else found[:0]
        grown = _lengthened(at, kind, n, m, lags, known)
        if len(grown):
            found = _smallest(np.concatenate((found, _ended(grown, m, least))))
        # a sequence of 2 m words occurs twice only if both its halves do
        rank = np.full(n, -1, dtype=np.int64)
        rank[at] = kind
        at = np.sort(at)
        at = at[at + 2 * m <= n]
        at = at[(rank[at + m] >= 0) & (text[at] == text[at + 2 * m - 1])]
        at, kind = _classes(rank[at] * (n + 1) + rank[at + m], at)
        m *= 2
        lags = (m, 2 * m - 1)
    return found


def find_runs(docs: DataFrame, column: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with n_words, runs (by start, then period) and collapsed (text without repetitions).

    ``collapsed`` has the words of the text, joined by one space, but those that any run holds after
    its first period.
    """

    def of(batch: pa.RecordBatch) -> list:
        texts = batch.column(column)
        words = Words(texts, NOT_SPACE, AS_IS)
        first = words.first
        runs = runs_of(words.hashes, first, least)
        start, end, period = runs.T
        text = np.searchsorted(first, start, "right") - 1
        gone = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        np.add.at(gone, start + period, 1)
        np.add.at(gone, end, -1)
        kept = np.cumsum(gone)[:-1] == 0
        has = np.bincount(text, minlength=len(texts)) if len(text) else np.zeros(len(texts), dtype=np.int64)
        collapsed = []
        for t, lo, hi, some in zip(texts, first[:-1].tolist(), first[1:].tolist(), has.tolist()):
            own = (t.as_py() or "").encode().split()
            collapsed.append(b" ".join(own if not some else [own[i] for i in np.flatnonzero(kept[lo:hi]).tolist()]).decode())
        offsets = pa.array(np.concatenate(([0], np.cumsum(has))).astype(np.int32))
        rows = pa.StructArray.from_arrays([pa.array(start - first[text]), pa.array(end - start), pa.array(period)], names=["start", "length", "period"])
        return [pa.array(words.counts()), pa.ListArray.from_arrays(offsets, rows), pa.array(collapsed, pa.string())]

    return append(docs, of, ADDED, column)
