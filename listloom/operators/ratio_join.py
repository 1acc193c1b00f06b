"""Pairs of records one of whose texts is similar, without comparing all pairs (J3 below 80, ``normalize``).

The ratio of two texts of a and b characters is at least r only if they share, as bags, at least
c(a, b) = ceil((r - 0.5) * (a + b) / 200) characters; a text's bag is the set of its (character, occurrence).
With all tokens in one order, rarest first, two sets that share c of them share s among the first
``size - c + s`` of each (the prefix filter), so records meet under the combinations of s tokens of
these prefixes. The shorter text of a pair takes c(a, a), the longer one c(b, least b), so prefixes are
short: a pair is one text in the role of the shorter and one in that of the longer. How many tokens make a key is
settled by the length of the longer text alone: as many as give at most ``KEYS`` keys.

A pair meets under all combinations it shares; it is looked at only under the first one, which is the one
with no other shared token before its last. What meets is first bounded by lengths and whole bags, then
scored. Lists of any length are cut into parts that meet two at a time. No pair is missed.

Where most texts resemble each other (numbered names, say), a pair shares very many keys, and more pairs meet than there
are. ``meetings`` tells that beforehand; ``all_pairs`` then compares every two records once, with the same result.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import WEIGHTS, ratio_bound, ratios_of, similarity_ratio, weighted_score
from ..session import cut
from .blocks import by_cell, to_cells

#: Keys of a text in one role, at most (one token a key may give more), and tokens of a key.
KEYS, MOST_TOKENS = 256, 4
#: Occurrences of a character whose frequencies are told apart.
OCCURRENCES = 16
CELL, SMALL = 2000, 64
#: Two different texts of so many characters may have a ratio that rounds to 100.
ROUNDS_UP_FROM = 100
#: Occurrences of a character that bags tell apart; the number of later ones is counted.
_APART = 64
_STRIP = 64
_CELLS = 1 << 22
#: ``meetings`` counts one of so many keys; ``all_pairs`` takes the ratios of so many pairs at a time.
_COUNTED, _RATED = 16, 1 << 19
TEXTS = ("name", "address", "category")


def shared_least(a: int, b: int, least: int) -> int:
    """Characters two texts of these lengths share at least if their ratio is ``least`` or more."""
    return max(1, math.ceil((2 * least - 1) * (a + b) / 400))


def partner_lengths(a: int, least: int) -> tuple[int, int]:
    """The shortest and longest text that may have a ratio of ``least`` with one of length ``a``."""
    r = 2 * least - 1
    return max(1, -(-a * r // (400 - r))), max(a, a * (400 - r) // r)


def tokens_a_key(b: int, least: int) -> int:
    """Tokens of a key for pairs whose longer text has length ``b``."""
    c = shared_least(partner_lengths(b, least)[0], b, least)
    fits = [s for s in range(1, min(MOST_TOKENS, c) + 1) if math.comb(min(b, b - c + s), s) <= KEYS]
    return max(fits, default=1)


def token_ranks(texts: DataFrame, column: str) -> dict[str, list[int]]:
    """For each character, the places of its occurrences in the order of rarity.

    One aggregation over all texts; the result has ``OCCURRENCES`` numbers a character of the alphabet.
    """

    def count(batches):
        total: dict[tuple[str, int], int] = {}
        for pdf in batches:
            for text in pdf[column]:
                for ch in set(text):
                    for n in range(min(text.count(ch), OCCURRENCES)):
                        total[ch, n] = total.get((ch, n), 0) + 1
        rows = [(ch, n, t) for (ch, n), t in total.items()]
        yield pd.DataFrame(rows, columns=["ch", "n", "texts"])

    counted = texts.select(column).filter(F.length(column) > 0).mapInPandas(count, "ch string, n int, texts long")
    rows = counted.groupBy("ch", "n").agg(F.sum("texts").alias("texts")).collect()
    ranks: dict[str, list[int]] = {}
    for place, row in enumerate(sorted(rows, key=lambda r: (r.texts, r.ch, -r.n))):
        ranks.setdefault(row.ch, [0] * OCCURRENCES)[row.n] = place
    return ranks


def ordered_tokens(text: str, ranks: dict[str, list[int]]) -> list[int]:
    """The numbers of a text's tokens, rarest first: a place in the order, then the occurrence."""
    seen: dict[str, int] = {}
    out = []
    for ch in text:
        n = seen.get(ch, 0)
        seen[ch] = n + 1
        # later occurrences are rarer than any that is counted apart
        out.append(ranks[ch][n] + 1 if n < OCCURRENCES else -(ord(ch) * (1 << 32) + n))
    return sorted(out)


def _keys(prefix: list[int], s: int) -> list[tuple[int, int]]:
    """(key, last token) of every combination."""
    return [(hash((s, *c)), c[-1]) for c in itertools.combinations(prefix, s)]


def meeting_keys(text: str, least: int, ranks: dict[str, list[int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(key, its tokens, the last of them, role, prefix): role 0 for longer partners or equal ones, 1 for shorter ones."""
    a = len(text)
    tokens = ordered_tokens(text, ranks)
    low, high = partner_lengths(a, least)
    out = []
    for s in {tokens_a_key(b, least) for b in range(a, high + 1)}:
        prefix = tokens[: a - shared_least(a, a, least) + s]
        out += [(key, s, last, 0, prefix) for key, last in _keys(prefix, s)]
    s = tokens_a_key(a, least)
    prefix = tokens[: a - shared_least(low, a, least) + s]
    return out + [(key, s, last, 1, prefix) for key, last in _keys(prefix, s)]


def meetings(p: DataFrame, column: str, least: int) -> int:
    """About how many pairs meet under the keys of a text, by every ``_COUNTED``th key."""
    # a stated number of tasks: the texts are few bytes, often one file, and their keys much work
    texts = p.filter(F.length(column) > 0).select(column).repartition(4 * p.sparkSession.sparkContext.defaultParallelism)
    ranks = token_ranks(texts, column)

    def count(batches):
        for pdf in batches:
            met = Counter((k[0], k[3]) for text, n in Counter(pdf[column]).items() for k in meeting_keys(text, least, ranks) * n if k[0] % _COUNTED == 0)
            yield pd.DataFrame([(key, n * (role == 0), n * (role == 1)) for (key, role), n in met.items()], columns=["key", "n0", "n1"])

    counted = texts.mapInPandas(count, "key long, n0 long, n1 long").groupBy("key").agg(F.sum("n0").cast("double").alias("n0"), F.sum("n1").alias("n1"))
    return int(counted.agg(F.coalesce(F.sum(F.col("n0") * F.col("n1")), F.lit(0.0))).first()[0] * _COUNTED)


def _met(p: DataFrame, column: str, least: int, cell: int, small: int) -> DataFrame:
    """Rows (key, list, few, ia, ib, role, tokens, last, prefix, rep): each record in the cells of its keys.

    ``few`` lists make at most ``small`` squared pairs and are not cut.
    """
    ranks = token_ranks(p, column)

    def spell(batches):
        for pdf in batches:
            rows = [(rep, lists, *k) for rep, text, lists in zip(pdf["rep"], pdf[column], pdf["lists"]) for k in meeting_keys(text, least, ranks)]
            yield pd.DataFrame(rows, columns=["rep", "lists", "key", "tokens", "last", "role", "prefix"])

    kind = p.schema["rep"].dataType.simpleString()
    asked = p.filter(F.length(column) > 0).select("rep", column, "lists")
    spelled = asked.mapInPandas(spell, f"rep {kind}, lists array<int>, key long, tokens int, last long, role int, prefix array<long>")
    rows = cut(spelled.withColumn("list", F.explode("lists")).withColumn("key", F.xxhash64("key", "list")).drop("lists"), "keys")
    size = rows.groupBy("key").agg(F.count_if(F.col("role") == 0).alias("n0"), F.count_if(F.col("role") == 1).alias("n1"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    size = size.filter("n0 > 0 and n1 > 0 and lo < hi").withColumn("few", F.col("n0") * F.col("n1") <= small * small)
    parts = {f"p{r}": F.when(F.col("few"), 1).otherwise(F.ceil(F.col(f"n{r}") / cell)).cast("int") for r in (0, 1)}
    own = F.when(F.col("role") == 0, F.col("p0")).otherwise(F.col("p1"))
    other = F.when(F.col("role") == 0, F.col("p1")).otherwise(F.col("p0"))
    dealt = rows.join(size.select("key", "few", *[c.alias(n) for n, c in parts.items()]), "key")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), own).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    side = [F.when(F.col("role") == r, F.col("own")).otherwise(F.col("other")).alias(n) for r, n in ((0, "ia"), (1, "ib"))]
    return dealt.select("key", "list", "few", *side, "role", "tokens", "last", "prefix", "rep")


def _in_few(rows: DataFrame, by: str, least: int, threshold: float, normalize: bool, skip: dict[str, int], equal: bool) -> DataFrame:
    """Short lists: an equi join, bounded by lengths before the ratios are taken."""
    shared = ["key", "list", "tokens", "last"]
    left, right = (rows.filter(F.col("role") == r).select(*shared, *[F.col(c).alias(f"{x}_{c}") for c in rows.columns if c not in shared]) for r, x in ((0, "l"), (1, "r")))
    pairs = left.join(right.drop("list", "tokens", "last"), "key")

    def early(x: str):
        return F.filter(f"{x}_prefix", lambda t: t <= F.col("last"))

    a, b = F.length(f"l_n_{by}"), F.length(f"r_n_{by}")
    both = {t: F.col(f"l_n_{t}").isNotNull() & F.col(f"r_n_{t}").isNotNull() for t in TEXTS}
    alike = F.lit(True)
    for t in TEXTS:
        alike = alike & F.coalesce(F.col(f"l_n_{t}") == F.col(f"r_n_{t}"), F.lit(False)) & (F.length(f"l_n_{t}") < ROUNDS_UP_FROM)
    # records that belong to several lists with their like meet in list 0
    pairs = pairs.filter((F.col("list") == 0) | (F.col("l_has") != F.col("r_has")))
    pairs = pairs.filter(((a < b) | ((a == b) & (F.col("l_rep") < F.col("r_rep")))) & (F.col("l_has").bitwiseAND(F.col("r_has")) == 0))
    pairs = pairs.filter(~F.coalesce(F.col("l_n_phone") == F.col("r_n_phone"), F.lit(False)) & (F.lit(equal) | ~alike))
    weight = F.lit(1.0)
    if normalize:
        weight = sum((F.when(both[t], F.lit(WEIGHTS[t])).otherwise(0.0) for t in TEXTS), F.lit(0.0))
        weight = weight + F.when(F.col("l_n_phone").isNotNull() & F.col("r_n_phone").isNotNull(), F.lit(WEIGHTS["phone"])).otherwise(0.0)
    bounds = {t: ratio_bound(F.col(f"l_n_{t}"), F.col(f"r_n_{t}")) for t in TEXTS}
    none = F.lit(False)
    likely = pairs.filter((bounds[by] >= least) & (F.round(weighted_score(bounds["name"], bounds["address"], none, bounds["category"]) / weight, 4) >= threshold))
    likely = likely.filter(F.size(F.array_intersect(early("l"), early("r"))) == F.col("tokens"))
    rated = likely.withColumns({f"s_{t}": similarity_ratio(F.col(f"l_n_{t}"), F.col(f"r_n_{t}")) for t in TEXTS})
    score = weighted_score(F.col("s_name"), F.col("s_address"), none, F.col("s_category")) / weight
    rated = rated.withColumn("score", F.round(score, 4)).filter((F.col("score") >= threshold) & (F.col(f"s_{by}") >= least))
    for t, r in skip.items():
        rated = rated.filter(F.coalesce(F.col(f"s_{t}") < r, F.lit(True)))
    return rated.select(F.least("l_rep", "r_rep").alias("l_rep"), F.greatest("l_rep", "r_rep").alias("r_rep"), "score")


class _Side:
    """The records of one role in a cell."""

    def __init__(self, pdf: pd.DataFrame, number: dict[int, int]):
        self.rep = pdf["rep"].to_numpy()
        self.has = pdf["has"].to_numpy() if "has" in pdf else None
        self.phone = pdf["n_phone"].fillna("").to_numpy(dtype=object)
        self.texts = {t: pdf[f"n_{t}"].fillna("").to_numpy(dtype=object) for t in TEXTS}
        self.size = {t: np.array([len(x) for x in self.texts[t]]) for t in TEXTS}
        self.early = np.zeros((len(pdf), len(number)), dtype=np.float32)
        for row, prefix in zip(self.early, pdf["prefix"] if number else ()):
            row[[number[t] for t in prefix if t in number]] = 1
        self.bags: dict[str, np.ndarray] = {}
        self.later: dict[str, np.ndarray] = {}

    def fill_bags(self, order: dict[str, dict]) -> None:
        """One row a text, 1 for each (character, occurrence) it has."""
        for t in TEXTS:
            # many records may have one text
            codes, texts = pd.factorize(self.texts[t])
            bags = np.zeros((len(texts), len(order[t])), dtype=np.float32)
            for row, text in zip(bags, texts):
                for ch, n in Counter(text).items():
                    first = order[t][ch, 0]
                    row[first : first + min(_APART, n)] = 1
            self.bags[t] = bags[codes]
            self.later[t] = self.size[t] - self.bags[t].sum(axis=1)


def _order(texts) -> dict[tuple[str, int], int]:
    most: dict[str, int] = {}
    for text in set(texts):
        for ch, n in Counter(text).items():
            if n > most.get(ch, 0):
                most[ch] = n
    return {token: i for i, token in enumerate((ch, n) for ch, m in most.items() for n in range(min(m, _APART)))}


def _bounds(left: _Side, right: _Side, t: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What the ratios of pairs can be at most, by their bags; 0 if either text is empty."""
    common = np.empty(len(i))
    step = max(1, _CELLS // max(1, left.bags[t].shape[1]))
    for lo in range(0, len(i), step):
        part = slice(lo, lo + step)
        common[part] = np.einsum("ij,ij->i", left.bags[t][i[part]], right.bags[t][j[part]])
    common += np.minimum(left.later[t][i], right.later[t][j])
    return np.floor(200.0 * common / np.maximum(1, left.size[t][i] + right.size[t][j]) + 0.5)


def combine(parts: dict[str, np.ndarray], both: dict[str, np.ndarray], phones: np.ndarray, normalize: bool) -> np.ndarray:
    """Scores of pairs whose phones differ, from ratios (or bounds) of the texts; ``phones``: both have one."""
    total = sum(parts[t] * WEIGHTS[t] for t in TEXTS)
    if not normalize:
        return np.round(total, 4)
    weight = sum(both[t] * WEIGHTS[t] for t in TEXTS) + phones * WEIGHTS["phone"]
    return np.round(total / np.where(weight > 0, weight, 1.0), 4)


def similar_by(
    p: DataFrame, by: str, least: int, threshold: float, normalize: bool, skip: dict[str, int], equal: bool, cell: int = CELL, small: int = SMALL
) -> DataFrame:
    """(l_rep, r_rep, score): pairs of profiles with unequal phones whose text ``by`` has a ratio of ``least`` or
    more and whose score reaches the threshold; without pairs whose ratio of a text in ``skip`` reaches the one
    named there, and, unless ``equal``, without those equal in all three texts of less than ``ROUNDS_UP_FROM`` characters.

    By category only pairs are looked for that have neither name nor address in common.
    """
    column, fields = f"n_{by}", [f"n_{t}" for t in TEXTS]
    name, address = F.col("n_name").isNotNull().cast("int"), F.col("n_address").isNotNull().cast("int")
    p = p.withColumn("has", name + 2 * address if by == "category" else F.lit(0))
    # the lists 0 and so on are those of pairs: none with any, only a name with only an address
    lists = F.when(F.col("has") == 0, F.array(*map(F.lit, (0, 1, 2, 3)))).when(F.col("has") == 3, F.array(F.lit(3))).otherwise(F.array("has", F.lit(4)))
    met = _met(p.withColumn("lists", lists if by == "category" else F.array(F.lit(0))), column, least, cell, small)
    rows = met.join(p.select("rep", *fields, "n_phone", "has"), "rep")

    def scored(left: _Side, right: _Side, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        """The pairs that match: bounds first, then one true ratio after the other."""
        both = {t: (left.size[t][i] > 0) & (right.size[t][j] > 0) for t in TEXTS}
        parts = {t: _bounds(left, right, t, i, j) for t in TEXTS}
        phones = (left.phone[i] != "") & (right.phone[j] != "")
        alike = np.logical_and.reduce([both[t] & (left.texts[t][i] == right.texts[t][j]) & (left.size[t][i] < ROUNDS_UP_FROM) for t in TEXTS])
        keep = (parts[by] >= least) & (equal | ~alike)
        for t in (by, *[t for t in TEXTS if t != by]):
            keep &= combine(parts, both, phones, normalize) >= threshold
            i, j, phones = i[keep], j[keep], phones[keep]
            both, parts = {k: v[keep] for k, v in both.items()}, {k: v[keep] for k, v in parts.items()}
            parts[t] = ratios_of(left.texts[t].tolist(), right.texts[t].tolist(), i, j).astype(float)
            keep = (parts[t] >= (least if t == by else 0)) & (parts[t] < skip.get(t, 101))
        score = combine(parts, both, phones, normalize)
        good = keep & (score >= threshold)
        x, y = left.rep[i[good]], right.rep[j[good]]
        return pd.DataFrame({"l_rep": np.minimum(x, y), "r_rep": np.maximum(x, y), "score": score[good]})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        last, tokens = int(pdf["last"].iloc[0]), int(pdf["tokens"].iloc[0])
        number = {t: i for i, t in enumerate(sorted({t for x in pdf["prefix"] for t in x if t <= last}))}
        left, right = (_Side(pdf[pdf["role"] == r], number) for r in (0, 1))
        order = {t: _order([*left.texts[t], *right.texts[t]]) for t in TEXTS}
        left.fill_bags(order)
        right.fill_bags(order)
        found = [pd.DataFrame({"l_rep": [], "r_rep": [], "score": []})]
        for lo in range(0, len(left.rep), _STRIP):
            a, b = left.size[by][lo : lo + _STRIP, None], right.size[by][None, :]
            first_met = left.early[lo : lo + _STRIP] @ right.early.T == tokens
            shorter = (a < b) | ((a == b) & (left.rep[lo : lo + _STRIP, None] < right.rep[None, :]))
            i, j = np.nonzero(first_met & shorter & (200 * a >= (2 * least - 1) / 2 * (a + b)))
            i = i + lo
            different = ((left.phone[i] != right.phone[j]) | (left.phone[i] == "")) & (left.has[i] & right.has[j] == 0)
            if pdf["list"].iloc[0]:
                different &= left.has[i] != right.has[j]
            found.append(scored(left, right, i[different], j[different]))
        return pd.concat(found[1:] or found, ignore_index=True)

    kind = p.schema["rep"].dataType.simpleString()
    many = by_cell(rows.filter("not few"), ["key", "ia", "ib"]).applyInPandas(compare, f"l_rep {kind}, r_rep {kind}, score double")
    return _in_few(rows.filter("few"), by, least, threshold, normalize, skip, equal).unionByName(many)


def all_pairs(p: DataFrame, threshold: float, normalize: bool, equal: bool, cell: int = CELL) -> DataFrame:
    """(l_rep, r_rep, score): pairs of profiles with unequal phones whose score reaches the threshold; unless ``equal``,
    without those equal in all three texts of less than ``ROUNDS_UP_FROM`` characters.

    Every two profiles are compared once, in bounded cells: whole bags first, then true ratios of what these leave.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        first, second = pdf["part_a"].iloc[0], pdf["part_b"].iloc[0]
        left, right = (_Side(pdf[pdf["part_no"] == n], {}) for n in (first, second))
        order = {t: _order([*left.texts[t], *right.texts[t]]) for t in TEXTS}
        left.fill_bags(order)
        right.fill_bags(order)
        rows, columns = np.arange(len(left.rep)), np.arange(len(right.rep))

        def most(t: str, part: slice) -> np.ndarray:
            """What the ratios of a strip can be at most, by their bags."""
            common = (left.bags[t][part] @ right.bags[t].T).astype(float)
            if left.later[t][part].any() and right.later[t].any():
                common += np.minimum(left.later[t][part, None], right.later[t][None, :])
            return np.floor(200.0 * common / np.maximum(1, left.size[t][part, None] + right.size[t][None, :]) + 0.5)

        def rated(i: np.ndarray, j: np.ndarray, parts: dict[str, np.ndarray]) -> pd.DataFrame:
            both = {t: (left.size[t][i] > 0) & (right.size[t][j] > 0) for t in TEXTS}
            phones = (left.phone[i] != "") & (right.phone[j] != "") if normalize else np.zeros(len(i), dtype=bool)
            # texts that many records have in common come first, names last
            for t in reversed(TEXTS):
                keep = combine(parts, both, phones, normalize) >= threshold
                i, j, phones = i[keep], j[keep], phones[keep]
                both, parts = {k: v[keep] for k, v in both.items()}, {k: v[keep] for k, v in parts.items()}
                parts[t] = ratios_of(left.texts[t].tolist(), right.texts[t].tolist(), i, j).astype(float)
            score = combine(parts, both, phones, normalize)
            good = score >= threshold
            if not equal:
                same = [both[t] & (parts[t] == 100) & (left.texts[t][i] == right.texts[t][j]) & (left.size[t][i] < ROUNDS_UP_FROM) for t in TEXTS]
                good &= ~np.logical_and.reduce(same)
            x, y = left.rep[i[good]], right.rep[j[good]]
            return pd.DataFrame({"l_rep": np.minimum(x, y), "r_rep": np.maximum(x, y), "score": score[good]})

        codes, _ = pd.factorize(np.concatenate((left.phone, right.phone)))
        mine, theirs = codes[: len(rows)], np.where(right.phone == "", -1, codes[len(rows) :])
        waiting, held = [], 0
        for lo in range(0, len(rows), _STRIP):
            part = slice(lo, lo + _STRIP)
            bounds = {t: most(t, part) for t in TEXTS}
            both = {t: (left.size[t][part, None] > 0) & (right.size[t][None, :] > 0) for t in TEXTS}
            phones = (left.phone[part, None] != "") & (right.phone[None, :] != "") if normalize else np.False_
            likely = (combine(bounds, both, phones, normalize) >= threshold) & (mine[part, None] != theirs[None, :])
            if first == second:
                likely &= rows[part, None] < columns[None, :]
            i, j = np.nonzero(likely)
            waiting.append((i + lo, j, *[bounds[t][i, j] for t in TEXTS]))
            held += len(i)
            if held >= _RATED or lo + _STRIP >= len(rows):
                i, j, *of = (np.concatenate(x) for x in zip(*waiting))
                waiting, held = [], 0
                yield rated(i, j, dict(zip(TEXTS, of)))

    kind = p.schema["rep"].dataType.simpleString()
    parted = to_cells(p.select("rep", *[f"n_{t}" for t in TEXTS], "n_phone").withColumn("block_n", F.lit(p.count())), "rep", cell)
    return by_cell(parted, ["part_a", "part_b"]).applyInPandas(compare, f"l_rep {kind}, r_rep {kind}, score double")
