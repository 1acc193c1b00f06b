"""Near-duplicate documents by SimHash (operator 12).

* A fingerprint has 64 bits; bit b is set if over half of the XXH64 values of a text's word shingles,
  repeats included, have it.
* Documents with one fingerprint are one class before any index is made, so copies cost nothing.
* Candidates come from an inverted index over the fingerprints' bytes by position. Fingerprints that differ in at
  most d bits differ in at most d of the 8 bytes, so 8 - d positional bytes match at least. A list for
  each single (position, byte) would hold every 256th fingerprint; so lists are intersected before any pair
  is made: of five matching positions three lie in the same half, and the index has one list for the
  bytes at three positions of a half (8 lists a fingerprint). Below five sure matches, lists are those of
  the largest sets of positions that some such set must contain (``posted``).
* In a list the matching positional bytes of each two fingerprints are tallied, pairs that
  reach the minimum are verified bit by bit, and the links found are kept as a forest: a list
  returns fewer links than it has fingerprints.
* Lists longer than ``CELL`` are cut into parts that meet two at a time, so no task holds a long list. The work
  in one list is the square of its *different* fingerprints.

Results: null and empty texts and those without words have fingerprint zero and are linked like any
other. Fewer words than a shingle form one shingle. Rows that share an id count as one document with
several texts: what any of them is linked with belongs to its component. Rows with a null id keep their fingerprint,
without a component. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import spread
from ..operators.components import connected_components
from ..session import cut
from .tables import checked_broadcast, slices, whole_texts

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Fingerprints of a part of a long list; two parts meet in one task.
CELL = 4096
#: A class of copies is hot beyond this many rows and this share of the table; so 1 / HOT_SHARE classes are, at most.
HOT_ROWS, HOT_SHARE = 100, 1e-5
#: Shingles hashed before their bits are counted, and pairs compared at a time.
_SHINGLES = 1 << 16
_PAIRS = 1 << 21

_UPPER_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode().translate(_UPPER_TO_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    m = max(1, len(words) - k + 1)
    starts, ends = starts[:m].tolist(), (ends[min(k, len(words)) - 1 :] - 1).tolist()
    set_bits = np.zeros(64, dtype=np.int64)
    of = xxhash.xxh64_intdigest
    for lo in range(0, m, _SHINGLES):
        part = [of(line[a:b], seed) for a, b in zip(starts[lo : lo + _SHINGLES], ends[lo : lo + _SHINGLES])]
        bits = np.unpackbits(np.array(part, dtype=np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > m, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row of (doc_id, text); ``fp`` is the fingerprint as a signed long."""

    def run(batches):
        for batch in slices(batches):
            found = [fingerprint(t.as_py(), k, seed) for t in batch.column("text")]
            fp = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])
            del batch

    return whole_texts(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, fp long")


def posted(distance: int) -> list[tuple[int, ...]]:
    """Sets of byte positions, one of which any two fingerprints within ``distance`` bits match in."""
    sure = 8 - distance
    if sure < 1:
        raise ValueError("SimHash lists need a distance of 7 bits or less")
    if sure >= 5:
        return [half[:i] + half[i + 1 :] for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for i in range(4)]
    groups = 8 - sure + 1
    return [tuple(range(8 * g // groups, 8 * (g + 1) // groups)) for g in range(groups)]


def _postings(classes: DataFrame, distance: int) -> DataFrame:
    """(no, at, a, b, own, node, fp): each class in the lists (no, at) of its positional bytes.

    A list longer than ``CELL`` is cut into parts; ``own`` is a row's part, and the rows of parts ``a`` and ``b`` meet.
    """
    keys = []
    for number, places in enumerate(posted(distance)):
        mask = sum(0xFF << (8 * p) for p in places)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("no"), F.col("fp").bitwiseAND(F.lit(signed)).alias("at")))
    rows = classes.select("node", "fp", F.explode(F.array(*keys)).alias("key")).select("node", "fp", "key.*")
    # at most one list in CELL rows is long
    long = cut(rows.groupBy("no", "at").agg(F.count("*").alias("held")).filter(F.col("held") > CELL), "lists")
    parts = F.coalesce(F.ceil(F.col("held") / CELL), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    met = rows.join(checked_broadcast(long), ["no", "at"], "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return met.select("no", "at", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "fp")


def unequal_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the 8 bytes of each value are not zero."""
    x = x | (x >> np.uint64(4))
    x = x | (x >> np.uint64(2))
    x = x | (x >> np.uint64(1))
    return np.bitwise_count(x & np.uint64(0x0101010101010101))


def matching(left: np.ndarray, right: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs reach the minimum of matching positional bytes and, of those, differ in few enough bits."""
    x = left ^ right
    tally = unequal_bytes(x) <= min(distance, 8)
    tally[tally] = np.bitwise_count(x[tally]) <= distance
    return tally


def _lowest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each row's least reachable row so far) after the links a-b are added."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def _pairs_of(size: np.ndarray, start: np.ndarray):
    """Row pairs of every list (rows start..start + size - 1), about ``_PAIRS`` at a time."""
    first = np.repeat(start, size) if len(size) else np.zeros(0, dtype=np.int64)
    row = np.arange(len(first)) + (start[0] if len(start) else 0)
    behind = row - first
    upto = np.concatenate(([0], np.cumsum(behind)))
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + _PAIRS, "right")) - 1)
        n = behind[lo:hi]
        right = np.repeat(row[lo:hi], n)
        left = np.arange(len(right)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[lo:hi], n)
        yield left, right
        lo = hi


def _links(cells: DataFrame, distance: int) -> DataFrame:
    """(a, b): a forest of the links in each list; ``cells`` has whole lists in each partition, in order."""

    def compare(batches):
        held: list[pa.Table] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            elif not held:
                return
            table = pa.Table.from_batches(held)
            keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("no", "at", "a", "b")])
            new = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))) if table.num_rows else np.zeros(0, dtype=np.int64)
            upto = table.num_rows if batch is None else (int(new[-1]) if len(new) else 0)
            held = table.slice(upto).to_batches()
            start = new[new < upto]
            if not len(start):
                continue
            fp = table.column("fp").to_numpy()[:upto].view(np.uint64)
            node, own = table.column("node").to_numpy(), table.column("own").to_numpy()
            two = keys[2, :upto] != keys[3, :upto]
            label = np.arange(upto)
            for left, right in _pairs_of(np.diff(np.append(start, upto)), start):
                wanted = (own[left] != own[right]) | ~two[right]
                left, right = left[wanted], right[wanted]
                near = matching(fp[left], fp[right], distance)
                label = _lowest(label, left[near], right[near])
            linked = np.flatnonzero(label != np.arange(upto))
            yield pa.RecordBatch.from_arrays([pa.array(node[label[linked]]), pa.array(node[linked])], names=["a", "b"])

    return cells.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    Documents whose fingerprints differ in at most ``distance`` bits (7 at most) are linked; ``component_id`` is the least
    doc_id reachable.
    """
    known = cut(fingerprints(docs, k, seed), "fingerprints")
    named = known.filter("doc_id is not null")
    classes = cut(named.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes")
    order = ["no", "at", "a", "b"]
    cells = spread(_postings(classes, distance), order).sortWithinPartitions(*order)
    links = _links(cells, distance)
    # texts of one id hold their classes together
    several = named.groupBy("doc_id").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least <> most").select("doc_id")
    texts = named.join(several, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    component = connected_components(links.unionByName(texts))
    of = cut(classes.join(component, "node", "left").select("fp", "copies", F.coalesce("component", "node").alias("component_id")), "of")
    hot_from = max(HOT_ROWS, int(HOT_SHARE * known.count()))
    hot, rest = of.filter(F.col("copies") > hot_from).select("fp", F.col("component_id").alias("of_hot")), of.filter(F.col("copies") <= hot_from).drop("copies")
    marked = named.join(F.broadcast(hot), "fp", "left")
    of_hot = marked.filter("of_hot is not null").select("doc_id", "fp", F.col("of_hot").alias("component_id"))
    of_rest = marked.filter("of_hot is null").join(rest, "fp").select("doc_id", "fp", "component_id")
    alone = known.filter("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id"))
    return of_hot.unionByName(of_rest).unionByName(alone)
