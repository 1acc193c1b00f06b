"""Token counts of whole texts (operator 7).

The tokenizer is a SentencePiece BPE model without normalisation, none of whose pieces holds a
space behind another character or a line feed. So no merge crosses from a character to a
following space, or into or out of a line feed: texts are cut there, and a text's count is the
sum of its pre-tokens' counts. Lengths are looked up on the map side in two tiers: a compact
table of frequent pre-tokens, sent to every task, and a cache in each worker, which asks the
library for what neither knows. The table is made from the most frequent pre-tokens of every
slice of all documents, counted before they leave the task; no pre-token itself is shuffled,
and what the table holds changes the time it takes, never a count.

Results: null and empty texts have no bytes and no tokens. Repeated rows, null ids and other
columns pass through; an input column named like a result is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .pretokens import Cache, Slots, byte_hashes
from .tables import append, slices, whole_texts
from .text import utf8

LIMIT = 4096
#: Frequent pre-tokens sent to the tasks, and those a slice of the documents puts forward.
FREQUENT = 1 << 16
_TOP = 4096


def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def separable(path: str) -> bool:
    """Whether a model's pieces allow texts to be cut before spaces and around line feeds."""
    model = _model(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
    probe = "  a b ﬁ x\t"
    return plain and model.decode(model.encode(probe)) == probe and len(model.encode("\n")) == 2


def _cut(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each with the space that the model puts before it; where pre-tokens
    begin; each text's first pre-token; sizes."""
    size = np.diff(utf8(column)[1])
    # the model's own sign for a space counts as one
    data, offsets = utf8(pc.replace_substring(column, "\u2581", " "))
    joined = np.insert(data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], 32)
    heads = offsets[:-1] - offsets[0] + np.arange(len(size))
    space, feed = joined == 32, joined == 10
    begin = space | feed
    begin[1:] &= ~(space[1:] & space[:-1])
    begin[1:] |= feed[:-1]
    begin[heads] = True
    begin = np.flatnonzero(begin)
    return joined, begin, np.searchsorted(begin, heads), size


def _texts(joined: np.ndarray, begin: np.ndarray):
    end = np.append(begin[1:], len(joined))
    return lambda at: ["\n" + joined[b:e].tobytes().decode() for b, e in zip(begin[at].tolist(), end[at].tolist())]


def _lengths(path: str):
    held = []  # the model, once a task has asked; it travels empty

    def lengths(texts):
        if not held:
            held.append(_model(path))
        # the line feed before a pre-token keeps the model from putting a space there; it and the space before it are two tokens
        return [len(ids) - 2 for ids in held[0].encode(texts, num_threads=1)]

    return lengths


def frequent(docs: DataFrame, model: str, size: int = FREQUENT) -> Slots:
    """The first tier: lengths of the most frequent pre-tokens."""

    def count(batches):
        cache = Cache(_lengths(model))
        for batch in slices(batches):
            joined, begin, _, _ = _cut(batch.column("text"))
            keys, at, n = np.unique(byte_hashes(joined, begin), return_index=True, return_counts=True)
            top = np.argsort(-n, kind="stable")[:_TOP]
            values = cache.get(keys[top], lambda i: _texts(joined, begin)(at[top][i]))
            yield pa.RecordBatch.from_arrays([pa.array(keys[top].view(np.int64)), pa.array(values), pa.array(n[top])], names=["key", "length", "n"])

    parts = whole_texts(docs).select("text").mapInArrow(count, "key long, length long, n long")
    counted = cut(parts.groupBy("key").agg(F.max("length").alias("length"), F.sum("n").alias("n")), "frequent")
    # by powers of two: the least count that leaves no more than ``size`` of them
    level = F.floor(F.log2("n"))
    least, held = 0, 0
    for row in counted.groupBy(level.alias("level")).agg(F.count("*").alias("distinct")).orderBy(F.desc("level")).collect():  # 64 rows at most
        held += row["distinct"]
        if held > size:
            least = row["level"] + 1
            break
    rows = counted.filter(level >= least).orderBy("n", "key").collect()  # of two in one slot the more frequent stays
    table = Slots(17)
    table.put(np.array([r.key for r in rows], dtype=np.int64).view(np.uint64), np.array([r.length for r in rows], dtype=np.int64))
    return table


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """``docs`` (doc_id, text) with n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    ``model``: path of the model file, which every executor must have.
    """
    if not separable(model):
        raise ValueError("this model's texts can't be cut into pre-tokens by its spaces")
    table = frequent(docs, model)
    caches: list[Cache] = []

    def run(batch):
        if not caches:
            caches.append(Cache(_lengths(model)))
        joined, begin, first, size = _cut(batch.column("text"))
        hashes = byte_hashes(joined, begin)
        lengths, right = table.get(hashes)
        if len(miss := np.flatnonzero(~right)):
            texts = _texts(joined, begin)
            lengths[miss] = caches[0].get(hashes[miss], lambda i: texts(miss[i]))
        total = np.where(size > 0, np.add.reduceat(lengths, first), 0)
        return [pa.array(size), pa.array(total), pa.array(total > limit)]

    return append(docs, run, "n_bytes long, n_tokens long, over_limit boolean")
