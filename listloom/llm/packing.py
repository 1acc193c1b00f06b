"""Lexical retrieval packing (operator 9).

Texts are tokenized where they lie. Full windows of long documents are sequences of their own;
the rest of each document is a *piece* that goes to a shard by a seeded hash. A shard holds a
BM25 inverted index of its pieces (terms are the words, as runs of token ids). The longest
unused piece is the seed of a window; the index ranks all unused pieces by the seed's words, and
the window takes in rank order those that fit whole. What room is left is filled with the head of
the best piece left over, whose tail stays in the shard. So only a shard's last sequence can be
short. Ranks use the shard's own counts over all its pieces, as sharded indexes do.

Results: a null or empty text is the end id alone. Rows with a null or repeated id are packed
like any other. An empty table gives no sequence. Special strings inside a text are encoded as
the library does by default.
"""

from __future__ import annotations

import os
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import pretokens
from .tables import checked_broadcast, slices, whole_texts

WINDOW = 2048
END_ID = 1
#: Pieces of a shard: what one index holds, whatever the size of the corpus.
SHARD_PIECES = 2048
K1, B = 1.2, 0.75
_SPECIAL = "<|endoftext|>"
_OUT = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _single(path: str):
    """Encodes one pre-token: tiktoken with the tokenizer's own vocabulary, which is quicker for short
    texts, if the ids follow the order of the merges (so that a piece's id is its rank)."""
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
    fast = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    probe = [" the", "ing", " unbelievably", "é", " ñandú", "\n", "'re", "12345", "...", " ß", "qwxzkj"]
    if all(fast.encode_ordinary(p) == tokenizer.encode(p, add_special_tokens=False).ids for p in probe):
        return fast.encode_ordinary
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


class Encoder:
    """Token ids of texts, with each distinct pre-token encoded once by the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.encode = path, _single(path)
        self.pool, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.cache = pretokens.Cache(self._make)
        self.cache.forget = self._forget

    @cached_property
    def tokenizer(self):
        """The library's own, for texts that are not cut here; loaded when the first one comes."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        self.cache.all, self.used = {}, 0
        self.cache.slots = pretokens.Slots(18)

    def _make(self, texts: list) -> list[int]:
        made = list(map(self.encode, texts))
        sizes = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
        flat = np.fromiter(chain.from_iterable(made), dtype=np.uint32, count=int(sizes.sum()))
        stop = self.used + len(flat)
        if stop > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(len(self.pool), len(flat)), dtype=np.uint32)))
        self.pool[self.used : stop] = flat
        values = (self.used + np.cumsum(sizes) - sizes) << 24 | sizes
        self.used = stop
        return values.tolist()

    def ids(self, texts: list) -> list[np.ndarray]:
        """The ids of each text, whole."""
        parts, owner, out = [], [], [[] for _ in texts]
        whole = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if _SPECIAL in t or len(t) > pretokens.PIECE:
                whole.append(i)
            else:
                parts.append(t)
                owner.append(i)
        if parts:
            for i, got in zip(owner, self._fast(parts)):
                out[i] = got
        for i in whole:
            out[i] = self._long(texts[i])
        return [np.asarray(x, dtype=np.uint32) for x in out]

    def _long(self, text: str) -> np.ndarray:
        """A text in pieces that end before white space that follows other characters, where no
        pre-token goes on; special strings are left to the library."""
        if _SPECIAL in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        found, lo = [], 0
        while lo < len(text):
            hi = min(lo + pretokens.PIECE, len(text))
            while hi < len(text) and not (text[hi] in " \n" and not text[hi - 1].isspace()):
                hi += 1
            found += self._fast([text[lo:hi]])
            lo = hi
        return np.concatenate(found)

    def _fast(self, texts: list) -> list[np.ndarray]:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        heads = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        low = np.minimum(points, 0xFFFF)
        unsure = np.flatnonzero((pretokens.classes()[low] == pretokens.UNSURE) | (points > 0xFFFF))
        if len(unsure):
            odd = set(np.unique(np.searchsorted(heads, unsure, "right") - 1).tolist())
            plain = [t for i, t in enumerate(texts) if i not in odd]
            rest = iter(self._fast(plain) if plain else [])
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=np.uint32) if i in odd else next(rest) for i, t in enumerate(texts)]
        begin = pretokens.cut(low, heads[:-1])
        end = np.append(begin[1:], len(points))
        hashes = pretokens.point_hashes(low, begin)
        values = self.cache.get(hashes, lambda at: [joined[b:e] for b, e in zip(begin[at].tolist(), end[at].tolist())])
        at, size = values >> 24, values & 0xFFFFFF
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.pool[np.repeat(at - (upto - size), size) + np.arange(total)]
        bounds = np.concatenate(([0], upto))[np.searchsorted(begin, heads)]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def word_starts(path: str) -> np.ndarray:
    """For each id, whether its token begins a term of the index: it does not begin with a letter."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path).get_vocab()
    out = np.ones(max(vocab.values()) + 1, dtype=bool)
    for token, i in vocab.items():
        out[i] = not (token[0].isalpha() and token[0] not in "ĠĊĉčċČ")
    return out


class Index:
    """BM25 inverted index of a shard's pieces."""

    def __init__(self, pieces: list[np.ndarray], starts: np.ndarray):
        sizes = np.array([len(p) for p in pieces])
        ids = np.concatenate(pieces)
        head = starts[ids]
        head[np.cumsum(sizes)[:-1]] = True
        head[0] = True
        begin = np.flatnonzero(head)
        up, down = pretokens.powers(len(ids))
        run = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(pretokens.mix(ids.astype(np.uint64) + np.uint64(1)) * up[: len(ids)], dtype=np.uint64)))
        end = np.append(begin[1:], len(ids))
        words = (run[end] - run[begin]) * down[begin]
        owner = np.searchsorted(np.cumsum(sizes), begin, "right")
        _, term = np.unique(words, return_inverse=True)
        pair, tf = np.unique(term.astype(np.int64) * len(pieces) + owner, return_counts=True)
        term, owner = pair // len(pieces), pair % len(pieces)
        df = np.bincount(term)
        length = np.bincount(owner, weights=tf, minlength=len(pieces))
        idf = np.log1p((len(pieces) - df + 0.5) / (df + 0.5))
        self.owner, self.n = owner, len(pieces)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / max(length.mean(), 1e-9)))
        self.at = np.concatenate(([0], np.cumsum(df)))
        by = np.argsort(owner, kind="stable")
        self.terms, self.of = term[by], np.searchsorted(owner[by], np.arange(len(pieces) + 1))

    def scores(self, piece: int) -> np.ndarray:
        """Of every piece, for the words of one of them."""
        terms = self.terms[self.of[piece] : self.of[piece + 1]]
        lo, n = self.at[terms], self.at[terms + 1] - self.at[terms]
        upto = np.cumsum(n)
        line = np.repeat(lo - (upto - n), n) + np.arange(upto[-1])
        return np.bincount(self.owner[line], weights=self.weight[line], minlength=self.n)

    def forget(self, used: np.ndarray) -> None:
        """Drops the postings of used pieces; the scores of the others stay as they are."""
        kept = ~used[self.owner]
        self.at = np.concatenate(([0], np.cumsum(kept)))[self.at]
        self.owner, self.weight = self.owner[kept], self.weight[kept]


def fill(pieces: list[np.ndarray], starts: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of a shard, each a list of (piece, from, to)."""
    index = Index(pieces, starts)
    begin = np.zeros(len(pieces), dtype=np.int64)
    left = np.array([len(p) for p in pieces])
    seeds, listed = np.argsort(-left, kind="stable"), len(pieces)
    out = []
    for seed in seeds.tolist():
        if not left[seed]:
            continue
        row = [(seed, int(begin[seed]), int(begin[seed] + left[seed]))]
        room, left[seed] = window - int(left[seed]), 0
        if room:
            unused = np.flatnonzero(left)
            if len(unused) < 0.8 * listed:
                index.forget(left == 0)
                listed = len(unused)
            ranked = unused[np.argsort(-index.scores(seed)[unused], kind="stable")]
            size, pos = left[ranked], 0
            while room and len(fits := np.flatnonzero(size[pos:] <= room)):
                pos += int(fits[0])
                p = int(ranked[pos])
                row.append((p, int(begin[p]), int(begin[p] + left[p])))
                room -= int(left[p])
                left[p] = 0
                pos += 1
            rest = ranked[left[ranked] > 0]
            if room and len(rest):
                p = int(rest[0])
                row.append((p, int(begin[p]), int(begin[p]) + room))
                begin[p] += room
                left[p] -= room
        out.append(row)
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES, seed: int = 9) -> DataFrame:
    """A row for each piece of each document of ``docs`` (doc_id, text): where it lies in its
    document and in its sequence, and its ``ids`` as little-endian unsigned 32-bit numbers.

    ``tokenizer``: path of a tokenizers file, which every executor must have.
    """
    docs = whole_texts(docs.select(F.col("doc_id").cast("long"), "text"))
    shards = max(1, -(-docs.count() // shard_pieces))
    docs = _dealt(docs, shards, shard_pieces, seed)
    schema = "shard int, rest boolean, doc_id long, start long, doc_tokens long, ids binary"

    def tokenize(batches):
        encoder, end = Encoder(tokenizer), np.array([end_id], dtype=np.uint32)
        for batch in slices(batches, limit=1 << 20):
            rows = []
            for shard, doc, ids in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), encoder.ids(batch.column("text").to_pylist())):
                n = len(ids) + 1
                full = n - n % window
                ids = np.concatenate((ids, end))
                rows += [(shard, False, doc, lo, n, ids[lo : lo + window].tobytes()) for lo in range(0, full, window)]
                if full < n:
                    rows.append((shard, True, doc, full, n, ids[full:].tobytes()))
            yield _batch(rows, schema)
            del batch, rows

    def sequences(batches):
        starts = word_starts(tokenizer)
        now, count, waiting = None, 0, []

        def packed():
            ids = [np.frombuffer(r[3], dtype=np.uint32) for r in waiting]
            for k, row in enumerate(fill(ids, starts, window)):
                at = 0
                for p, lo, hi in row:
                    doc, start, n, _ = waiting[p]
                    yield doc, start + lo, hi - lo, n, (now << 32) + count + k, at, ids[p][lo:hi].tobytes()
                    at += hi - lo

        for batch in batches:
            rows = []
            for shard, rest, *row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if shard != now:
                    if waiting:
                        rows += packed()
                    now, count, waiting = shard, 0, []
                if rest:
                    waiting.append(row)
                else:
                    doc, start, n, ids = row
                    rows.append((doc, start, len(ids) // 4, n, (now << 32) + count, 0, ids))
                    count += 1
            yield _batch(rows, _OUT)
        if waiting:
            yield _batch(list(packed()), _OUT)

    # full windows come before the rest of their shard and pass through; only the rest is held
    pieces = docs.mapInArrow(tokenize, schema).repartitionById(shards, "shard").sortWithinPartitions("shard", "rest", "doc_id", "start")
    return pieces.mapInArrow(sequences, _OUT)


def _dealt(docs: DataFrame, shards: int, shard_pieces: int, seed: int) -> DataFrame:
    """``docs`` with their shard. Rows equal in id and text share a hash; where they would crowd a shard, each is hashed
    again with a number it gets where it is read."""
    keyed = docs.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "text"))
    crowd = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > max(1, shard_pieces // 16)).select("key", F.lit(True).alias("crowd")), "crowd")
    numbered = keyed.withColumn("number", F.monotonically_increasing_id()).join(checked_broadcast(crowd), "key", "left")
    key = F.when(F.col("crowd"), F.xxhash64("key", "number")).otherwise(F.col("key"))
    return numbered.select("doc_id", "text", F.pmod(key, F.lit(shards)).cast("int").alias("shard"))


_TYPES = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[f for f, _ in fields])
