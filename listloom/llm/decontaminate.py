"""Benchmark decontamination with suffix arrays of the training texts (operator 8).

The documents of an Arrow batch are a shard. Its suffix array holds the word positions whose
first words also begin some benchmark suffix (no other can match), sorted by the words that
follow. Every benchmark suffix is found in it by binary search, which gives all places where
its first ten words (all of a shorter item) occur verbatim; places on one diagonal are joined
to the longest match. No shuffle: documents stay where they are, the benchmark travels. Spark
writes it to the shared folder in blocks of a fixed number of bytes; a task reads one block after
the other and searches the documents at hand for it, so neither the driver nor a task ever
holds more than one block, however long the benchmark is.

Results: null, empty and wordless texts have no words and no matches; such items match nothing.
Repeated items are found each; an item without an id is matched but not listed. Repeated rows
are rows of their own. A document is affected by any match, also by one of a short item.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_path
from .tables import slices, whole_texts
from .text import ALNUM, HashTable, Words, sequence_hash

WINDOW = 10
#: Leading words by which a position enters the suffix array.
ANCHOR = 3
#: Benchmark text held by a task at a time (one item may be longer).
BLOCK_BYTES = 4 << 20
#: Documents a task searches for a block before it reads the next one.
SLAB_BYTES = 16 << 20
#: Longest suffix array; a batch with more matching positions is several shards.
SHARD_SUFFIXES = 1 << 19

_MATCH = "struct<item_id: long, item_start: long, doc_start: long, length: long>"


class Suffixes:
    """The suffixes of some benchmark items, by the number of words that must match."""

    def __init__(self, ids: list, texts: pa.Array, window: int):
        words = Words(texts, ALNUM)
        self.ids = ids
        self.classes = []
        counts = words.counts()
        for k in np.unique(np.minimum(counts[counts > 0], window)).tolist():
            items = np.flatnonzero(counts >= k) if k == window else np.flatnonzero(counts == k)
            m = counts[items] - k + 1
            item = np.repeat(items, m)
            start = np.arange(len(item)) - np.repeat(np.cumsum(m) - m, m)
            rows = words.hashes[(words.first[item] + start)[:, None] + np.arange(k)]
            _, one, same = np.unique(sequence_hash_rows(rows), return_index=True, return_inverse=True)
            by = np.argsort(same, kind="stable")
            bounds = np.searchsorted(same[by], np.arange(len(one) + 1))
            anchor = min(k, ANCHOR)
            self.classes.append((k, rows[one], item[by], start[by], bounds, anchor, HashTable(np.unique(sequence_hash_rows(rows[one][:, :anchor])))))


def sequence_hash_rows(rows: np.ndarray) -> np.ndarray:
    """``sequence_hash`` of each row of a matrix."""
    n, k = rows.shape
    return sequence_hash(rows.ravel(), k)[::k] if n else np.zeros(0, dtype=np.uint64)


def _bound(suffixes: np.ndarray, wanted: np.ndarray, upper: bool) -> np.ndarray:
    """For each wanted row its lower or upper bound in the sorted rows, all searches side by side."""
    lo, hi = np.zeros(len(wanted), dtype=np.int64), np.full(len(wanted), len(suffixes), dtype=np.int64)
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) // 2
        rows, own = suffixes[mid], wanted[open_]
        differs = rows != own
        at = differs.argmax(axis=1)
        line = np.arange(len(open_))
        right = rows[line, at] < own[line, at]
        if upper:
            right |= ~differs[line, at]
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]
    return lo


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges lo to hi: which range, and every number in it."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _matches(words: Words, tests: Suffixes):
    """(doc, doc start, length, item, item start) of the maximal matches in a batch."""
    stops = np.repeat(words.first[1:], words.counts())
    found = []
    for k, rows, item, start, bounds, anchor, table in tests.classes:
        at, _ = table.find(sequence_hash(words.hashes, anchor))
        at = at[at + k <= stops[at]]
        for part in range(0, len(at), SHARD_SUFFIXES):
            places = at[part : part + SHARD_SUFFIXES]
            keys = words.hashes[places[:, None] + np.arange(k)]
            order = np.lexsort(keys.T[::-1])
            keys, places = keys[order], places[order]
            window, line = _spread(_bound(keys, rows, False), _bound(keys, rows, True))
            which, entry = _spread(bounds[window], bounds[window + 1])
            found.append(np.stack([item[entry], places[line][which] - start[entry], start[entry], np.full(len(entry), k)]))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 5
    item, diagonal, start, k = np.concatenate(found, axis=1)
    order = np.lexsort((start, diagonal, item))
    item, diagonal, start, k = item[order], diagonal[order], start[order], k[order]
    new = np.ones(len(item), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, len(item))) - 1 + k[head]
    place = diagonal[head] + start[head]
    doc = np.searchsorted(words.first, place, "right") - 1
    return doc, place - words.first[doc], length, item[head], start[head]


def with_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (text) with n_words, n_hit and matches: the longest verbatim matches with ``benchmark``
    (item_id, text), each with its place in the item and in the document, in words. Input columns with these three
    names are replaced, all others kept."""
    out = _search(docs, _write_blocks(benchmark, block_bytes), window)
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m.doc_start.alias("lo"), (m.doc_start + m.length).alias("hi"))))
    first = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    hit = F.aggregate(
        spans,
        first,
        lambda a, s: F.struct(F.greatest(a.upto, s.hi).alias("upto"), (a.n + F.greatest(F.lit(0), s.hi - F.greatest(a.upto, s.lo))).alias("n")),
        lambda a: a.n,
    )
    return out.withColumn("n_hit", hit)


def _write_blocks(benchmark: DataFrame, block_bytes: int) -> str:
    """The folder to which Spark has written the benchmark, a row for each block of about ``block_bytes`` of text."""
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches, limit=block_bytes):
            new = pc.sum(pc.binary_length(batch.column("text"))).as_py()
            if held and n + new > block_bytes:
                yield _block(held)
                held, n = [], 0
            held.append(batch)
            n += new
        if held:
            yield _block(held)

    path = work_path(benchmark.sparkSession, "benchmark")
    # tasks read several small partitions each, so that blocks do not come out smaller than need be
    few = items.coalesce(max(1, -(-size // block_bytes)))
    whole_texts(few).mapInArrow(blocks, "ids array<long>, texts array<string>").write.parquet(path)
    return path


def _block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    one = pa.array([0, table.num_rows], pa.int32())
    columns = [pa.ListArray.from_arrays(one, table.column(name).combine_chunks()) for name in ("item_id", "text")]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "texts"])


class Blocks:
    """The blocks of a folder, read one after the other; a single one is kept for the next slab."""

    def __init__(self, path: str, window: int):
        self.files, root = fs.FileSystem.from_uri(path)
        found = self.files.get_file_info(fs.FileSelector(root))
        self.window, self.only = window, None
        self.names = sorted(f.path for f in found if f.path.endswith(".parquet"))
        self.single = sum(pq.ParquetFile(self.files.open_input_file(name)).metadata.num_rows for name in self.names) == 1

    def __iter__(self) -> Iterator[Suffixes]:
        if self.only is not None:
            yield self.only
            return
        for name in self.names:
            with self.files.open_input_file(name) as file:
                # buffered, so that a file is not read whole for its first block
                for row in pq.ParquetFile(file, buffer_size=1 << 20).iter_batches(batch_size=1):
                    tests = Suffixes(row.column("ids")[0].values.to_pylist(), row.column("texts")[0].values, self.window)
                    if self.single:
                        self.only = tests
                    yield tests
                    del tests, row


def _slabs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Slices of documents, as many at a time as fill a slab."""
    held, n = [], 0
    for batch in slices(batches):
        held.append(batch)
        n += batch.nbytes
        del batch
        if n >= SLAB_BYTES:
            yield held
            held, n = [], 0
    if held:
        yield held


def _search(docs: DataFrame, path: str, window: int) -> DataFrame:
    new = T.StructType.fromDDL(f"n_words long, matches array<{_MATCH}>")
    kept = [f for f in docs.schema if f.name.lower() not in new.names]
    schema = T.StructType([*kept, *new])

    def run(batches):
        blocks = Blocks(path, window)
        for slab in _slabs(batches):
            words = [Words(batch.column("text"), ALNUM) for batch in slab]
            found = [[] for _ in slab]
            for tests in blocks:
                for out, one in zip(found, words):
                    doc, place, length, item, start = _matches(one, tests)
                    if len(doc):
                        known = np.array([i is not None for i in tests.ids])[item]
                        ids = np.array([i or 0 for i in tests.ids], dtype=np.int64)[item]
                        out.append(np.stack([doc, place, ids, start, length, known]))
            for batch, one, out in zip(slab, words, found):
                columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(one.counts()), _listed(out, batch.num_rows)], names=schema.names)
            del slab, words, found

    return whole_texts(docs).mapInArrow(run, schema)


def _listed(found: list[np.ndarray], n: int) -> pa.ListArray:
    """The matches of n documents, by their place in the document, whichever block they come from."""
    doc, place, ids, start, length, known = np.concatenate(found, axis=1) if found else np.zeros((6, 0), dtype=np.int64)
    order = np.lexsort((start, ids, known, place, doc))
    offsets = np.searchsorted(doc[order], np.arange(n + 1)).astype(np.int32)
    columns = [pa.array(ids[order], mask=known[order] == 0), *(pa.array(x[order].astype(np.int64)) for x in (start, place, length))]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, names=["item_id", "item_start", "doc_start", "length"]))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a verbatim window of the benchmark."""
    rows = docs.select(F.struct(*docs.columns).alias("document"), "text")
    return with_matches(rows, benchmark, window).filter("n_hit = 0").select("document.*")
