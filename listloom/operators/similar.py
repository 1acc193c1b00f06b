"""Fuzzy duplicates.

The score is the sum of four weighted parts, so at a threshold of 80 two records can only
match if (a) their phones are equal, or (b) name, address and category all reach 100.
Scores are whole multiples of 0.1; they are rounded to four decimals before any comparison
with the threshold, so no floating-point sum decides a match, whatever the size of the block.
Both are equi joins that miss no pair; below 80, and where scores are weighed anew by the fields
that both records have (``normalize``), (b) becomes a join on similar texts (``ratio_join``):

* rows equal in all four compared fields form one *profile*; it is compared once;
* profiles equal in name, address and category but not in phone all match each other at
  exactly 80, so each is linked to the group's first profile only;
* profiles with one phone are compared pair by pair, in bounded cells if there are many.

A ratio of two strings of 100 characters or more may round to 100 without being equal;
such a string is left out of the join key of (b) and compared instead.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.presence import nullify
from ..functions.similarity import (
    MATCH_THRESHOLD,
    WEIGHTS,
    ratio_bound,
    ratios_of,
    similarity_ratio,
    weighted_score,
)
from ..functions.text import clean_phone, clean_string
from ..session import cut
from .blocks import by_cell, to_cells, with_block_size
from .components import connected_components
from .ratio_join import ROUNDS_UP_FROM, all_pairs, meetings, similar_by

SMALL_BLOCK = 64
CELL_PART = 2000
_STRIP = 128
_TEXTS = ("name", "address", "category")
_COMPARED = [*(f"n_{t}" for t in _TEXTS), "n_phone"]


def normalized(df: DataFrame) -> DataFrame:
    """The four compared fields as the score sees them; '' becomes NULL."""
    return df.select(
        "seq",
        nullify(F.lower("name")).alias("n_name"),
        nullify(clean_string("address")).alias("n_address"),
        nullify(F.lower("category")).alias("n_category"),
        clean_phone("primary_phone").alias("n_phone"),
    )


def profiles(rows: DataFrame) -> DataFrame:
    """One row per distinct combination of compared fields of ``normalized`` rows: ``rep`` is its lowest seq."""
    return rows.groupBy(*_COMPARED).agg(F.min("seq").alias("rep"), F.count("*").alias("members"))


def _self_score(p: DataFrame) -> Column:
    def full(c, key):
        return F.when(F.col(c).isNotNull(), F.lit(100 * WEIGHTS[key])).otherwise(F.lit(0.0))

    return full("n_name", "name") + full("n_address", "address") + full("n_phone", "phone") + full("n_category", "category")


def member_links(n: DataFrame, p: DataFrame, threshold: float = MATCH_THRESHOLD, normalize: bool = False) -> DataFrame:
    """``normalized`` rows of one profile linked to its first row, where such rows match at all."""
    first = p.filter("members > 1").select(*[F.col(c).alias("f_" + c) for c in _COMPARED], "rep").withColumn("__key", F.xxhash64(*["f_" + c for c in _COMPARED]))
    same = [F.col(c).eqNullSafe(F.col("f_" + c)) for c in _COMPARED]
    cond = F.col("k") == F.col("__key")
    for s in same:
        cond = cond & s
    joined = n.withColumn("k", F.xxhash64(*_COMPARED)).join(first, cond).filter("seq > rep")
    own = _self_score(joined)
    score = F.when(own > 0, F.lit(100.0)).otherwise(own) if normalize else own
    return _links(joined, F.col("rep"), F.col("seq"), F.round(score, 4), "same_profile").filter(F.col("score") >= threshold)


def _links(df: DataFrame, a: Column, b: Column, score: Column, kind: str) -> DataFrame:
    """Links by a score that is rounded already; Spark rounds by way of decimals, which tells where there are very many."""
    return df.select(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), score.alias("score"), F.lit(kind).alias("kind")
    )


def _sides(p: DataFrame, side: str, keys: list[str]) -> DataFrame:
    return p.select(*keys, *[F.col(c).alias(side + c) for c in [*_COMPARED, "rep"] if c not in keys])


def _present_weight(same_phone: bool) -> Column:
    """The weights of the texts that both sides of a pair have, and of an equal phone."""
    both = [F.when(F.col(f"l_n_{t}").isNotNull() & F.col(f"r_n_{t}").isNotNull(), F.lit(WEIGHTS[t])).otherwise(F.lit(0.0)) for t in _TEXTS]
    return sum(both, F.lit(WEIGHTS["phone"] if same_phone else 0.0))


def _scored(pairs: DataFrame, phone_equal: Column, threshold: float, weight: Column | None = None) -> DataFrame:
    """Adds ``score`` to pairs with l_ and r_ columns; the length bound prunes before the UDF."""
    bounds = {t: ratio_bound(F.col(f"l_n_{t}"), F.col(f"r_n_{t}")) for t in _TEXTS}
    bound = weighted_score(bounds["name"], bounds["address"], phone_equal, bounds["category"])
    bound = bound if weight is None else bound / weight
    likely = pairs.filter(F.round(bound, 4) >= threshold)
    ratios = {t: similarity_ratio(F.col(f"l_n_{t}"), F.col(f"r_n_{t}")) for t in _TEXTS}
    scored = likely.withColumns({f"s_{t}": c for t, c in ratios.items()})
    score = weighted_score(F.col("s_name"), F.col("s_address"), phone_equal, F.col("s_category"))
    score = score if weight is None else score / weight
    return scored.withColumn("score", F.round(score, 4)).filter(F.col("score") >= threshold)


def _pairs_in_small_blocks(p: DataFrame, keys: list[str], same_phone: bool, threshold: float, normalize: bool) -> DataFrame:
    pairs = _sides(p, "l_", keys).join(_sides(p, "r_", keys), keys).filter("l_rep < r_rep")
    if not same_phone:
        pairs = pairs.filter("not coalesce(l_n_phone = r_n_phone, false)")
    return _scored(pairs, F.lit(same_phone), threshold, _present_weight(same_phone) if normalize else None).select("l_rep", "r_rep", "score")


def _length_bounds(left: pd.Series, right: pd.Series, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a = left.str.len().fillna(0).to_numpy(dtype=float)[i]
    b = right.str.len().fillna(0).to_numpy(dtype=float)[j]
    both = (a > 0) & (b > 0)
    return np.where(both, np.floor(200.0 * np.minimum(a, b) / np.where(both, a + b, 1.0) + 0.5), 0.0)


def _pairs_in_cells(p: DataFrame, keys: list[str], same_phone: bool, threshold: float, normalize: bool) -> DataFrame:
    """Exact comparison within large blocks, one bounded cell per task step."""

    weights = [WEIGHTS[t] for t in _TEXTS]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = pdf["part_a"].iloc[0], pdf["part_b"].iloc[0]
        left = pdf[pdf["part_no"] == first].reset_index(drop=True)
        right = pdf[pdf["part_no"] == second].reset_index(drop=True)
        found = []
        for start in range(0, len(left), _STRIP):
            i, j = np.meshgrid(np.arange(start, min(start + _STRIP, len(left))), np.arange(len(right)), indexing="ij")
            i, j = i.ravel(), j.ravel()
            keep = np.ones(len(i), dtype=bool) if first != second else i < j
            phones = left["n_phone"].to_numpy(dtype=object)[i] == right["n_phone"].to_numpy(dtype=object)[j]
            phones &= left["n_phone"].notna().to_numpy()[i]
            keep &= phones == same_phone
            i, j = i[keep], j[keep]
            # start from upper bounds by length, then put in the true ratios one by one
            parts = [_length_bounds(left[f"n_{t}"], right[f"n_{t}"], i, j) * w for t, w in zip(_TEXTS, weights)]
            base = 100.0 * WEIGHTS["phone"] if same_phone else 0.0
            weight = np.ones(len(i))
            if normalize:
                have = [(left[f"n_{t}"].notna().to_numpy()[i] & right[f"n_{t}"].notna().to_numpy()[j]) * w for t, w in zip(_TEXTS, weights)]
                weight = base / 100.0 + sum(have)
            for k, t in enumerate(_TEXTS):
                likely = np.round((base + sum(parts)) / weight, 4) >= threshold
                i, j, parts, weight = i[likely], j[likely], [p[likely] for p in parts], weight[likely]
                parts[k] = ratios_of(left[f"n_{t}"].to_list(), right[f"n_{t}"].to_list(), i, j) * weights[k]
            score = np.round((base + sum(parts)) / weight, 4)
            good = score >= threshold
            a, b = left["rep"].to_numpy()[i[good]], right["rep"].to_numpy()[j[good]]
            found.append(pd.DataFrame({"l_rep": np.minimum(a, b), "r_rep": np.maximum(a, b), "score": score[good]}))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=["l_rep", "r_rep", "score"])

    rep_type = p.schema["rep"].dataType.simpleString()
    cells = to_cells(p, "rep", CELL_PART)
    return by_cell(cells, [*keys, "part_a", "part_b"]).applyInPandas(compare, f"l_rep {rep_type}, r_rep {rep_type}, score double")


def _block_pairs(p: DataFrame, keys: list[str], same_phone: bool, threshold: float, small: int, normalize: bool = False) -> DataFrame:
    """Matches within blocks, among pairs whose phones are equal or are not, as asked."""
    blocks = with_block_size(p, keys)
    few = _pairs_in_small_blocks(blocks.filter(F.col("block_n") <= small), keys, same_phone, threshold, normalize)
    many = _pairs_in_cells(blocks.filter(F.col("block_n") > small), keys, same_phone, threshold, normalize)
    return few.unionByName(many)


def scores_by_phone(df: DataFrame, threshold: float = 0.0, small_block: int = SMALL_BLOCK) -> DataFrame:
    """(a, b, score) of all profiles that share a phone, by their first rows, from ``threshold`` on."""
    p = profiles(normalized(df)).filter("n_phone is not null")
    return _block_pairs(p, ["n_phone"], True, threshold, small_block).select(F.col("l_rep").alias("a"), F.col("r_rep").alias("b"), "score")


def text_routes(threshold: float, normalize: bool = False) -> dict[str, int]:
    """For each text, the least ratio by which a pair without an equal phone must be similar in some text.

    The weights of what a pair lacks in name, address and category must leave ``threshold``, so not both name and address
    can lack more than their weighted share. With ``normalize`` a pair that has neither in common may match by category.
    """
    w = WEIGHTS

    def least(*texts: str) -> float:
        """Some of these texts must have this ratio, the category being equal if both have one, or missing."""
        have = sum(w[t] for t in texts)
        if not normalize:
            return (threshold - 100 * w["category"]) / have
        return min(threshold, (threshold * (have + w["category"]) - 100 * w["category"]) / have)

    if normalize:
        found = {"name": min(least("name"), least("name", "address")), "address": min(least("address"), least("name", "address")), "category": threshold}
    else:
        found = {"name": least("name", "address"), "address": least("name", "address")}
    return {t: math.ceil(round(r, 6)) for t, r in found.items()}


def _unequal_phones(p: DataFrame, threshold: float, normalize: bool) -> list[DataFrame]:
    """Links of profiles whose phones are not equal, below 80 or with new weights."""
    routes = text_routes(threshold, normalize)
    if min(routes.values()) < 1:
        raise ValueError("at this threshold records match without any similar text")
    n = p.count()
    if sum(meetings(p, f"n_{t}", routes[t]) for t in ("name", "address")) > n * (n - 1) / 2:
        # the keys would bring more pairs together than there are
        every = all_pairs(p, threshold, normalize, equal=normalize)
        return [_links(every, F.col("l_rep"), F.col("r_rep"), F.col("score"), "pair")]
    out, skip = [], {}
    for t, least in routes.items():
        out.append(similar_by(p, t, least, threshold, normalize, dict(skip), equal=normalize))
        skip[t] = least
    return [_links(d, F.col("l_rep"), F.col("r_rep"), F.col("score"), "pair") for d in out]


def _same_text(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of profiles equal in all three texts to the first of them; and profiles with texts too long for that."""
    full = p.filter(" and ".join(f"n_{t} is not null" for t in _TEXTS))
    long = F.greatest(*[F.length(f"n_{t}") for t in _TEXTS]) >= ROUNDS_UP_FROM
    keys = [f"n_{t}" for t in _TEXTS]
    heads = full.filter(~long).groupBy(*keys).agg(F.min("rep").alias("head"), F.count("*").alias("n")).filter("n > 1")
    same = full.filter(~long).join(heads, keys).filter("rep > head")
    return _links(same, F.col("head"), F.col("rep"), F.lit(80.0), "same_text"), full.filter(long)


def similar_links(df: DataFrame, threshold: float = MATCH_THRESHOLD, small_block: int = SMALL_BLOCK, normalize: bool = False) -> DataFrame:
    """J3 in compact form: (a, b, score, kind), a < b.

    ``pair`` links are matches of two profiles, given by their first rows. ``same_profile``
    and ``same_text`` links tie the members of a group to its first one; any two members
    match with the score shown. ``expand_links`` lists every single pair. With ``normalize`` a score is weighed anew
    by the fields that both records have. Exact at any threshold above 10; the lower it is, the more pairs match.
    """
    n = cut(normalized(df), "normalized")
    p = cut(profiles(n), "profiles")
    by_phone = _block_pairs(p.filter("n_phone is not null"), ["n_phone"], True, threshold, small_block, normalize)
    out = [member_links(n, p, threshold, normalize), _links(by_phone, F.col("l_rep"), F.col("r_rep"), F.col("score"), "pair")]
    if normalize:
        out += _unequal_phones(p, threshold, True)
    elif threshold <= 80:
        same, long = _same_text(p)
        out.append(same)
        if threshold < 80:
            out += _unequal_phones(p, threshold, False)
        else:
            masked = long.withColumns({f"k_{t}": F.when(F.length(f"n_{t}") >= ROUNDS_UP_FROM, "*").otherwise(F.col(f"n_{t}")) for t in _TEXTS})
            near = _block_pairs(masked, [f"k_{t}" for t in _TEXTS], False, threshold, small_block)
            out.append(_links(near, F.col("l_rep"), F.col("r_rep"), F.col("score"), "pair"))
    result = out[0]
    for d in out[1:]:
        result = result.unionByName(d)
    return result


def expand_links(links: DataFrame) -> DataFrame:
    """Every matching pair (a, b, score) behind ``similar_links``.

    As many rows as there are matching pairs, which for large groups of copies is their
    square; use the links themselves for grouping.
    """
    members = cut(links.filter("kind = 'same_profile'"), "members")
    of_profile = members.select(F.col("a").alias("rep"), F.col("b").alias("seq"))
    # written, so that its size is known and the pairs, which are many more, need not be shuffled to meet it
    belongs = cut(of_profile.unionByName(members.select(F.col("a").alias("rep")).distinct().withColumn("seq", F.col("rep"))), "belongs")
    # profile pairs: explicit ones, and all pairs inside a same_text group
    text = cut(links.filter("kind = 'same_text'"), "texts")
    group = text.select(F.col("a").alias("head"), F.col("b").alias("rep")).unionByName(text.select(F.col("a").alias("head"), F.col("a").alias("rep")).distinct())
    inner = (
        group.join(group.withColumnRenamed("rep", "rep2"), "head")
        .filter("rep < rep2")
        .select(F.col("rep").alias("a"), F.col("rep2").alias("b"), F.lit(80.0).alias("score"))
    )
    profile_pairs = links.filter("kind = 'pair'").select("a", "b", "score").unionByName(inner)
    across = (
        profile_pairs.filter("a IS NOT NULL AND b IS NOT NULL")
        .join(belongs.select(F.col("rep").alias("a"), F.col("seq").alias("sa")), "a", "left")
        .join(belongs.select(F.col("rep").alias("b"), F.col("seq").alias("sb")), "b", "left")
        .withColumns({"sa": F.coalesce("sa", "a"), "sb": F.coalesce("sb", "b")})
        .select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"), "score")
    )
    own = belongs.join(members.select(F.col("a").alias("rep"), "score").distinct(), "rep")
    within = (
        own.join(belongs.withColumnRenamed("seq", "seq2"), "rep")
        .filter("seq < seq2")
        .select(F.col("seq").alias("a"), F.col("seq2").alias("b"), "score")
    )
    return across.unionByName(within)


def duplicate_groups(df: DataFrame, threshold: float = MATCH_THRESHOLD, normalize: bool = False) -> DataFrame:
    """C4: (seq, group_id) for every record that matches another, groups closed transitively."""
    groups = connected_components(similar_links(df, threshold, normalize=normalize))
    return groups.select(F.col("node").alias("seq"), F.col("component").alias("group_id"))
