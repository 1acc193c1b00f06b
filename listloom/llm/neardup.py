"""Near-duplicate documents by MinHash with one permutation (operator 6).

* One pass over the texts hashes each document's set of word shingles, puts the hashes into
  128 bins by their leading bits and keeps each bin's least one. An empty bin takes the value of
  the first filled bin in a fixed random order of its own (optimal densification). Bands of up to 4
  bins are the bucket keys; their number follows ``percent`` (``band_rows``), so that all of them differ
  with a chance of 1e-7 at most: 32 bands at 85 (5e-11) and at 80 (5e-8), 64 below 79, 128 below 48.
  Below 12 percent the chance is larger.
* Equal sets are one class before any bucket is formed, so groups of copies cost nothing here.
* In a bucket every class is linked to the least class only: stars, one edge a member. Edges are
  confirmed on full sets.
* A star can miss a link between two members that are far from its centre. So members of one
  bucket that are still in different components after the stars are compared as well, all with
  all, in cells of bounded size; only links leave a cell. No partner is dropped: before full sets
  are counted, pairs are ruled out only by upper bounds of what they can share. This part is
  quadratic in the size of a group of documents that resemble each other but are not linked.

Results: null and empty texts, and texts without words, have the empty set and stay alone.
Fewer words than a shingle form one shingle. Repeated rows are rows of one set; rows with a null
id are returned as kept, without a component. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import by_cell, to_cells
from ..operators.components import connected_components
from ..session import cut
from .tables import checked_broadcast, slices, whole_texts
from .text import LOWERED, NOT_SPACE, Words, mix, sequence_hash

SHINGLE = 5
PERCENT = 85
BINS = 128
#: Bins of a band at most, and the chance with which a pair just similar enough may miss all bands.
ROWS = 4
MISS = 1e-7
#: Equal bins that all but one in a million pairs of a similarity of 0.85 have. Nothing is filtered by it.
LEAST_BINS = 88
#: Bits of the maps that bound what two sets of a cell share, at least and at most.
MAP_BITS = 1 << 10, 1 << 15
#: Buckets up to this size are compared pair by pair; larger ones as stars.
SMALL_BUCKET = 6
#: What a part of a cell holds at most (a single longer set makes its part longer).
CELL_DOCS = 500
CELL_SHINGLES = 1 << 20

_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
_ORDER = np.argsort(np.random.default_rng(6).random((BINS, BINS)), axis=1)
_SALT = np.random.default_rng(66).integers(1, 2**63, (BINS, ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column, k: int = SHINGLE):
    """Sorted distinct shingle hashes of each text."""
    words = Words(column, NOT_SPACE, LOWERED)
    runs, first = sequence_hash(words.hashes, k), words.first
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        n = hi - lo
        if n >= k:
            s = np.sort(runs[lo : hi - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        else:
            yield sequence_hash(words.hashes[lo:hi], n) if n else runs[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Each bin's value for a sorted, non-empty set."""
    at = np.searchsorted(shingles, _EDGES)
    filled = at < np.append(at[1:], len(shingles))
    least = shingles[np.minimum(at, len(shingles) - 1)]
    if len(empty := np.flatnonzero(~filled)):
        order = _ORDER[empty]
        least[empty] = least[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return least


def band_rows(percent: int) -> int:
    """Bins of a band: as many as keep the chance of a miss at this similarity below ``MISS``."""
    fits = [n for n in (ROWS, ROWS // 2) if (1 - (percent / 100) ** n) ** (BINS // n) <= MISS]
    return fits[0] if fits else 1


def bands_of(shingles: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """The bucket keys of a sorted, non-empty set."""
    least, salt = signature(shingles).reshape(BINS // rows, rows), _SALT[: BINS // rows]
    return mix((least * salt[:, :rows]).sum(axis=1, dtype=np.uint64) + salt[:, ROWS])


def bit_maps(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, which cells of the hash range it has hashes in: a row of bits packed to 64."""
    bits = min(max(MAP_BITS[0], 1 << (4 * max(map(len, sets))).bit_length()), MAP_BITS[1])
    maps = np.zeros((len(sets), bits // 8), dtype=np.uint8)
    for row, s in zip(maps, sets):
        marked = np.zeros(bits, dtype=bool)
        marked[(s >> np.uint64(65 - bits.bit_length())).astype(np.int64)] = True
        row[:] = np.packbits(marked)
    return maps.view(np.uint64)


def signatures(docs: DataFrame, k: int = SHINGLE, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_digest, bands) of every row of (doc_id, text)."""

    def run(batches):
        for batch in slices(batches):
            sizes, digests, bands = [], [], []
            for s in shingle_sets(batch.column("text"), k):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(bands_of(s, rows).view(np.int64) if len(s) else np.zeros(0, dtype=np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32)
            values = np.concatenate(bands) if bands else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["doc_id", "n_shingles", "set_digest", "bands"],
            )
            del batch

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_digest binary, bands array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(star, node, shingles) for the rows of ``wanted`` (star, node)."""

    def run(batches):
        for batch in slices(batches):
            sets = list(shingle_sets(batch.column("text"), k))
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("stars"), batch.column("node"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["stars", "node", "shingles"]
            )
            del batch

    # one row a text, whatever the number of its stars
    lists = cut(wanted.groupBy("node").agg(F.collect_set("star").alias("stars")), "stars")
    texts = docs.join(checked_broadcast(lists), F.col("doc_id") == F.col("node")).select("stars", "node", "text")
    sets = texts.mapInArrow(run, "stars array<long>, node long, shingles array<long>")
    return sets.select(F.explode("stars").alias("star"), "node", "shingles")


def _confirmed(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    heads = pairs.select(F.col("a").alias("star"), F.col("a").alias("node")).distinct()
    ends = pairs.select(F.col("a").alias("star"), F.col("b").alias("node")).unionByName(heads)
    sets = cut(_full_sets(docs, ends, k), "sets")
    centre = sets.filter("star = node").select(F.col("star").alias("a"), F.col("shingles").alias("of_a"))
    other = sets.filter("star <> node").select(F.col("star").alias("a"), F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = other.join(centre, "a").withColumn("shared", F.size(F.array_intersect("of_a", "of_b")).cast("long"))
    union = F.size("of_a") + F.size("of_b") - F.col("shared")
    return both.filter(100 * F.col("shared") >= percent * union).select("a", "b")


def _near_in_size(x: str, y: str, percent: int):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _members(reps: DataFrame) -> DataFrame:
    """(bucket, node, n, members, centre, centre_n) for every bucket of two nodes or more."""
    rows = reps.select("node", "n", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min(F.struct("node", "n")).alias("least")).filter("members > 1")
    buckets = buckets.select("bucket", "members", F.col("least.node").alias("centre"), F.col("least.n").alias("centre_n"))
    return cut(rows.join(buckets, "bucket"), "buckets")


def _candidates(members: DataFrame, percent: int) -> DataFrame:
    """Stars of large buckets and pairs of small ones: (a, b), a < b."""
    stars = members.filter((F.col("node") > F.col("centre")) & _near_in_size("n", "centre_n", percent)).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    few = members.filter(f"members between 3 and {SMALL_BUCKET} and node <> centre")
    left = few.select("bucket", F.col("node").alias("a"), F.col("n").alias("n_a"))
    right = few.select("bucket", F.col("node").alias("b"), F.col("n").alias("n_b"))
    pairs = left.join(right, "bucket").filter((F.col("a") < F.col("b")) & _near_in_size("n_a", "n_b", percent)).select("a", "b")
    return stars.unionByName(pairs).distinct()


def _left_over(docs: DataFrame, members: DataFrame, component: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Links between members of large buckets that the stars left in different components: (a, b).

    Buckets that hold several components, and share members, form blocks. A block is cut into
    parts of at most ``CELL_DOCS`` documents and about ``CELL_SHINGLES`` shingles, and each two
    parts meet in one cell. A cell of the hash range that only one set of a pair has hashes in holds a
    hash they do not share; pairs that this leaves able to be similar enough are counted on full sets,
    and only links that join two components leave the cell.
    """
    big = members.filter(f"members > {SMALL_BUCKET}").select("bucket", "node")
    known = big.join(component, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    split = known.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("head")).filter("lo <> hi")
    star = cut(known.join(split.select("bucket", "head"), "bucket").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "blocks")
    if star.isEmpty():
        return None
    blocks = cut(connected_components(star).select(F.col("component").alias("star"), "node"), "blocks")
    sets = cut(_full_sets(docs, blocks, k), "sets").select(F.col("star").alias("block"), "node", "shingles")
    sizes = sets.groupBy("block").agg(F.count("*").alias("docs"), F.sum(F.size("shingles")).alias("shingles"))
    parts = F.greatest(F.col("docs"), CELL_DOCS * F.ceil(F.col("shingles") / CELL_SHINGLES))
    labelled = sets.join(sizes.select("block", parts.alias("block_n")), "block").join(component, "node", "left")
    rows = labelled.withColumn("component", F.coalesce("component", "node"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        sets = [x.astype(np.int64).view(np.uint64) for x in pdf["shingles"]]
        sizes = np.array([len(x) for x in sets])
        flat, at = np.concatenate(sets), np.cumsum(sizes) - sizes
        marks = bit_maps(sets)
        marked = np.bitwise_count(marks).sum(axis=1, dtype=np.int64)
        label, node, part = pdf["component"].to_numpy().copy(), pdf["node"].to_numpy(), pdf["part_no"].to_numpy()
        two = pdf["part_a"].iloc[0] != pdf["part_b"].iloc[0]
        out = []
        for i, own in enumerate(sets):
            other = (part > part[i]) if two else (np.arange(len(sets)) > i)
            likely = np.flatnonzero(other & (label != label[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])))
            both = np.bitwise_count(marks[likely] & marks[i]).sum(axis=1, dtype=np.int64)
            most = np.minimum(sizes[i] - marked[i], sizes[likely] - marked[likely]) + both
            likely = likely[100 * most >= percent * (sizes[likely] + sizes[i] - most)]
            for j in np.array_split(likely, 1 + int(sizes[likely].sum()) // CELL_SHINGLES):
                n = sizes[j]
                upto = np.cumsum(n)
                theirs = flat[np.repeat(at[j] - (upto - n), n) + np.arange(int(n.sum()))]
                place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                shared = np.add.reduceat(own[place] == theirs, upto - n) if len(j) else n
                for t in j[100 * shared >= percent * (n + len(own) - shared)].tolist():
                    if label[t] != label[i]:
                        out.append((min(node[i], node[t]), max(node[i], node[t])))
                        label[label == label[t]] = label[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    cells = by_cell(to_cells(rows, "node", CELL_DOCS), ["block", "part_a", "part_b"])
    return cells.applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents with 100 * common shingles >= percent * all shingles are linked; ``component_id``
    is the least doc_id reachable. Rows that share an id count as one document with several texts.
    """
    docs = whole_texts(docs.select("doc_id", "text"))
    known = cut(signatures(docs, k, band_rows(percent)), "signatures")
    classes = known.filter("n_shingles > 0 and doc_id is not null").groupBy("set_digest")
    reps = cut(classes.agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"), F.min("n_shingles").alias("n")), "classes")
    members = _members(reps)
    links = cut(_confirmed(docs, _candidates(members, percent), k, percent), "links")
    component = connected_components(links)
    more = _left_over(docs, members, component, k, percent)
    if more is not None:
        component = connected_components(links.unionByName(more))
    of_set = reps.join(component, "node", "left").select("set_digest", F.coalesce("component", "node").alias("component_id"))
    out = known.filter("doc_id is not null").join(of_set, "set_digest", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    alone = known.filter("doc_id is null").withColumn("component_id", F.lit(None).cast("long"))
    rows = out.select("doc_id", "n_shingles", "component_id").unionByName(alone.select("doc_id", "n_shingles", "component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group: that with the least doc_id, and one row of it.

    Rows with a null id stay.
    """
    result = cut(near_duplicates(docs.select("doc_id", "text"), k, percent), "near")
    gone = result.filter("not kept").select("doc_id").distinct()
    left = docs.join(checked_broadcast(cut(gone, "gone")), "doc_id", "left_anti").select(docs.columns)
    repeated = cut(result.filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once)
