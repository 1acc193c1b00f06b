"""String and record similarity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values -------------------------------------------------------------------
WEIGHTS = {"name": 0.4, "address": 0.3, "phone": 0.2, "category": 0.1}
MATCH_THRESHOLD = 80.0
# --------------------------------------------------------------------------------
#: Pairs ``ratios_of`` compares side by side: few enough for the nearest caches.
_HELD = 1 << 14


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine operation per character.

    Bit-parallel method of Hyyro (2004); Python integers make it good for any length.
    """
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio_of(a: str | None, b: str | None) -> int | None:
    """2 * LCS / (sum of lengths), in whole percent; NULL if either side is empty."""
    if not a or not b:
        return None
    if a == b:
        return 100
    return int(math.floor(200.0 * lcs_length(a, b) / (len(a) + len(b)) + 0.5))


def _distinct(values) -> tuple[list[str], np.ndarray]:
    codes, found = pd.factorize(pd.Series(values, dtype=object).fillna(""))
    return list(found), codes


def ratios_of(a: list, b: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``ratio_of(a[i], b[j])`` for whole index arrays, 0 where it is NULL.

    The same bit-parallel steps over arrays of 64-bit words; each distinct pair of strings
    is compared once, and pairs of two strings longer than a word one by one.
    """
    texts_a, code_a = _distinct(a)
    texts_b, code_b = _distinct(b)
    code = code_a[i].astype(np.int64) * max(1, len(texts_b)) + code_b[j]
    if len(texts_a) * len(texts_b) <= 8 * len(code):
        asked = np.zeros(len(texts_a) * len(texts_b), dtype=bool)
        asked[code] = True
        pairs, back = np.flatnonzero(asked), (np.cumsum(asked) - 1)[code]
    else:
        pairs, back = np.unique(code, return_inverse=True)
    left, right = pairs // max(1, len(texts_b)), pairs % max(1, len(texts_b))
    out = np.zeros(len(pairs), dtype=np.int64)
    len_a = np.array([len(t) for t in texts_a], dtype=np.int64)
    len_b = np.array([len(t) for t in texts_b], dtype=np.int64)
    fits = (len_a[left] <= 64) & (len_a[left] > 0) & (len_b[right] > 0)
    for k in np.flatnonzero(~fits):
        out[k] = ratio_of(texts_a[left[k]], texts_b[right[k]]) or 0
    letters = {ch: n for n, ch in enumerate(sorted({ch for t in texts_a if len(t) <= 64 for ch in t}), 1)}
    where = np.zeros((len(texts_a), len(letters) + 1), dtype=np.uint64)
    for n, t in enumerate(texts_a):
        if len(t) <= 64:
            for pos, ch in enumerate(t):
                where[n, letters[ch]] |= np.uint64(1 << pos)
    # a line for each place in a text
    spelled = np.zeros((int(len_b.max(initial=0)), len(texts_b)), dtype=np.int32)
    for n, t in enumerate(texts_b):
        spelled[: len(t), n] = [letters.get(ch, 0) for ch in t]
    chosen, wide = np.flatnonzero(fits), len(letters) + 1
    places = where.ravel()
    for start in range(0, len(chosen), _HELD):
        part = chosen[start : start + _HELD]
        x, y = left[part], right[part]
        row = np.full(len(part), np.iinfo(np.uint64).max, dtype=np.uint64)
        first, at, hit = x * wide, np.empty(len(part), dtype=np.int64), np.empty(len(part), dtype=np.uint64)
        for step in range(int(len_b[y].max())):
            np.add(first, spelled[step].take(y), out=at)
            np.take(places, at, out=hit, mode="clip")
            hit &= row
            row = (row + hit) | (row ^ hit)
        unused = np.uint64(64) - len_a[x].astype(np.uint64)
        lcs = np.bitwise_count((~row << unused) >> unused).astype(np.int64)
        out[part] = np.floor(200.0 * lcs / (len_a[x] + len_b[y]) + 0.5).astype(np.int64)
    return out[back]


@F.pandas_udf(T.IntegerType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """X32 as a column: ``ratio_of`` over Arrow batches; NULL if either side is empty."""
    rows = np.arange(len(a))
    got = pd.Series(ratios_of(a.to_list(), b.to_list(), rows, rows), dtype="Int32")
    return got.mask(((a.fillna("") == "") | (b.fillna("") == "")).to_numpy())


def ratio_bound(a: Column, b: Column) -> Column:
    """Upper bound of the ratio from the lengths alone; JVM-side filter before the UDF."""
    la, lb = F.length(a), F.length(b)
    return F.coalesce(F.when((la > 0) & (lb > 0), F.floor(200.0 * F.least(la, lb) / (la + lb) + 0.5)), F.lit(0))


def weighted_score(name, address, phone_equal, category) -> Column:
    """Sum of the parts present; missing parts are not re-weighted."""

    def part(value: Column, key: str) -> Column:
        return F.coalesce(value * F.lit(WEIGHTS[key]), F.lit(0.0))

    phone = F.when(phone_equal, F.lit(100.0)).otherwise(F.lit(0.0))
    return part(name, "name") + part(address, "address") + part(phone, "phone") + part(category, "category")
